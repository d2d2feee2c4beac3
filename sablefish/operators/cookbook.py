"""Fact tables as SQL views, and statements over them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Statements that take no value; any other SELECT over the views can be given instead.
STATEMENTS = {
    "most-called": "SELECT destino_norm, count(*) AS chamadas FROM chamadas_funcao GROUP BY destino_norm ORDER BY chamadas DESC, destino_norm LIMIT 10",
    "critical-sources": "SELECT arquivo, count(*) AS achados FROM lint_findings WHERE severidade = 'critical' GROUP BY arquivo ORDER BY achados DESC, arquivo LIMIT 20",
    "endpoints": "SELECT verbo, path, arquivo, classe, funcao, annotation_style FROM rest_endpoints ORDER BY verbo, path, arquivo",
    "sql-writes": "SELECT arquivo, funcao, linha, operacao, tabelas, snippet FROM sql_embedado WHERE operacao IN ('update', 'delete', 'insert') ORDER BY arquivo, linha",
    "locks": "SELECT tabela, arquivo FROM fonte_tabela WHERE modo = 'reclock' ORDER BY tabela, arquivo",
    "findings-with-rules": "SELECT f.arquivo, f.linha, f.regra_id, f.severidade, r.categoria, r.fix_guidance FROM lint_findings f JOIN lint_rules r ON r.regra_id = f.regra_id ORDER BY f.arquivo, f.linha, f.regra_id",
    "index-counts": "SELECT (SELECT count(*) FROM fonte_chunks) AS chunks, (SELECT count(DISTINCT id) FROM palavras) AS indexed",
    "orphan-calls": "SELECT DISTINCT c.arquivo_origem FROM chamadas_funcao c LEFT ANTI JOIN fontes f ON f.arquivo = c.arquivo_origem ORDER BY 1",
}


def views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Registers the tables, and the rule catalog as ``lint_rules``."""
    from ..sources import catalogs

    for name, df in {"lint_rules": catalogs.rules(spark), **tables}.items():
        df.createOrReplaceTempView(name)


def run(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """A statement by name, or a query in SQL; nothing but queries is run."""
    views(spark, tables)
    sql = STATEMENTS.get(statement, statement)
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError(f"neither a query nor one of: {', '.join(STATEMENTS)}")
    return spark.sql(sql)
