"""Extraction, lint and dictionary queries: over the test tables where they have a shape in common, else over fixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import source_text
from ..operators import commands, facts, lint
from ..sources import table
from ..sources.staging import staged
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _blank_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, lines, again = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            out = source_text.blank(text)
            same.append(len(out) == len(text))
            lines.append(out.count("\n") == text.count("\n"))
            again.append(source_text.blank(out) == out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(lines), pa.array(again)], names=["page_id", "same_length", "same_lines", "stable"])


def strip_preserving(spark, d):
    """Blanking keeps length and lines and changes nothing when done twice."""
    return table(spark, d, "pages").select("page_id", "html").mapInArrow(_blank_lengths, "page_id long, same_length boolean, same_lines boolean, stable boolean")


QUERIES["strip_preserving"] = strip_preserving
ORACLES["strip_preserving"] = "SELECT page_id, true AS same_length, true AS same_lines, true AS stable FROM pages"

_FACTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixture_functions": facts.functions, "fixture_chunks": facts.chunks, "fixture_calls": facts.calls, "fixture_tables": facts.tables, "fixture_parameters": facts.parameters,
    "fixture_questions": facts.questions, "fixture_includes": facts.includes, "fixture_fields": facts.fields, "fixture_endpoints": facts.endpoints, "fixture_http": facts.http_calls,
    "fixture_env_openers": facts.env_openers, "fixture_logs": facts.log_calls, "fixture_defines": facts.defines, "fixture_namespaces": facts.namespaces, "fixture_sql": facts.sql_blocks,
    "fixture_ws_structures": facts.ws_structures, "fixture_ws_signatures": facts.ws_signatures, "fixture_summaries": facts.summaries, "fixture_execautos": facts.execauto_calls,
    "fixture_triggers": facts.execution_triggers, "fixture_docs": facts.doc_blocks, "fixture_lint": lint.lint_sources,
}
for _name, _make in _FACTS.items():
    QUERIES[_name] = lambda spark, d, make=_make: make(X.sources(spark, d, make))


def restricted_functions(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in lint.RESTRICTED_NAMES], "nome string")


def cross_lint(spark, src: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    made = {"functions": facts.functions(src), "parameters": facts.parameters(src), "questions": facts.questions(src), "chunks": facts.chunks(src), "sql": facts.sql_blocks(src)}
    return lint.cross_rules(tables, made, restricted_functions(spark))


QUERIES["fixture_cross_lint"] = lambda spark, d: cross_lint(spark, X.sources(spark, d), X.dictionary(spark, d)[0])


def _sx(rule: Callable[[dict[str, DataFrame], DataFrame], DataFrame], *made):
    """A rule over the dictionary and sources, of which it reads the fact tables ``made``."""

    def run(spark, d):
        return rule(X.dictionary(spark, d)[0], X.sources(spark, d, *made)).select("arquivo", "funcao", "regra_id", "severidade")

    return run


_SX3 = X.values_sql("sx3")
_SX7 = X.values_sql("sx7")
QUERIES["sx_missing_destination"] = _sx(lambda t, s: lint.sx002(t["gatilhos"], t["campos"]))
ORACLES["sx_missing_destination"] = f"""SELECT 'SX:SX7' AS arquivo, X7_CAMPO || '#' || X7_SEQUENC AS funcao, 'SX-002' AS regra_id, 'error' AS severidade FROM {_SX7}
WHERE X7_CDOMIN <> '' AND X7_CDOMIN NOT IN (SELECT X3_CAMPO FROM {_SX3})"""
QUERIES["sx_unused_parameter"] = _sx(lambda t, s: lint.sx003(t["parametros"], facts.parameters(s)), facts.parameters)
ORACLES["sx_unused_parameter"] = f"""SELECT 'SX:SX6' AS arquivo, X6_VAR AS funcao, 'SX-003' AS regra_id, 'warning' AS severidade FROM {X.values_sql('sx6')} WHERE X6_PROPRI <> 'S' AND X6_VAR NOT IN (SELECT upper(unnest(regexp_extract_all(text, '(?i)(?:GetMV|PutMV)\\w*\\(\\s*["''](MV_\\w+)', 1))) FROM {X.sources_sql()})"""
QUERIES["sx_sql_in_validation"] = _sx(lambda t, s: lint.sx006(t["campos"]))
ORACLES["sx_sql_in_validation"] = f"""SELECT 'SX:' || X3_ARQUIVO AS arquivo, X3_CAMPO AS funcao, 'SX-006' AS regra_id, 'warning' AS severidade FROM {_SX3}
WHERE regexp_matches(X3_VALID || ' ' || X3_VLDUSER, '(?i)\\b(BeginSql|TCQuery|TCSqlExec|MPSysOpenQuery)\\b')"""
QUERIES["sx_shared_table_branch"] = _sx(lambda t, s: lint.sx008(t["campos"], t["tabelas"]))
ORACLES["sx_shared_table_branch"] = f"""SELECT 'SX:' || X3_ARQUIVO AS arquivo, X3_CAMPO AS funcao, 'SX-008' AS regra_id, 'warning' AS severidade FROM {_SX3} JOIN {X.values_sql('sx2')} ON X2_CHAVE = X3_ARQUIVO
WHERE X2_MODO = 'C' AND regexp_matches(X3_VALID || ' ' || X3_VLDUSER, '(?i)\\bxFilial\\b')"""
QUERIES["sx_trigger_without_seek"] = _sx(lambda t, s: lint.sx010(t["gatilhos"]))
ORACLES["sx_trigger_without_seek"] = f"""SELECT 'SX:SX7' AS arquivo, X7_CAMPO || '#' || X7_SEQUENC AS funcao, 'SX-010' AS regra_id, 'error' AS severidade FROM {_SX7} WHERE X7_TIPO = 'P' AND X7_SEEK NOT IN ('S', '1', '.T.')"""
QUERIES["sx_missing_query"] = _sx(lambda t, s: lint.sx011(t["campos"], t["consultas"]))
ORACLES["sx_missing_query"] = f"""SELECT 'SX:' || X3_ARQUIVO AS arquivo, X3_CAMPO AS funcao, 'SX-011' AS regra_id, 'error' AS severidade FROM {_SX3} WHERE X3_F3 <> '' AND X3_F3 NOT IN (SELECT XB_ALIAS FROM {X.values_sql('sxb')})"""
QUERIES["sx_lost_rows"] = lambda spark, d: X.dictionary(spark, d)[1]
QUERIES["sx_field_groups"] = lambda spark, d: X.dictionary(spark, d)[0]["grupos_campo"].select("grupo", "tamanho", "total_campos")
ORACLES["sx_field_groups"] = f"""SELECT XG_GRUPO AS grupo, CAST(XG_TAMANHO AS INTEGER) AS tamanho, (SELECT count(*) FROM {_SX3} f WHERE f.X3_GRPSXG = g.XG_GRUPO) AS total_campos FROM {X.values_sql('sxg')} g"""


_IMPACT = "Z5_PLACA9"


def fixture_impact(spark, d):
    tables, _ = X.dictionary(spark, d)
    found = commands.impact(facts.chunks(X.sources(spark, d, facts.chunks)), tables["campos"], tables["gatilhos"], tables["perguntas"].withColumns({"f3": F.col("f3")}), _IMPACT)
    return found.select("tipo", "local", "severidade")


def fixture_cascade(spark, d):
    return commands.trigger_cascade(X.dictionary(spark, d)[0]["gatilhos"], "Z6_NUM7")


QUERIES["fixture_impact"] = fixture_impact
QUERIES["fixture_cascade"] = fixture_cascade
ORACLES["fixture_cascade"] = f"""WITH g AS {_SX7}, near AS (SELECT 'Z6_NUM7' AS node, 0 AS level), one AS (SELECT X7_CDOMIN AS node FROM g WHERE X7_CAMPO = 'Z6_NUM7' UNION SELECT X7_CAMPO FROM g WHERE X7_CDOMIN = 'Z6_NUM7'),
lv AS (SELECT * FROM near UNION ALL SELECT node, 1 FROM one UNION ALL (SELECT DISTINCT x, 2 FROM (SELECT X7_CDOMIN AS x FROM g WHERE X7_CAMPO IN (SELECT node FROM one) UNION SELECT X7_CAMPO FROM g WHERE X7_CDOMIN IN (SELECT node FROM one)) WHERE x NOT IN (SELECT node FROM one) AND x <> 'Z6_NUM7')),
t AS (SELECT level + 1 AS nivel, X7_CAMPO, X7_CDOMIN, node AS via FROM g JOIN lv ON node = X7_CAMPO UNION ALL SELECT level + 1, X7_CAMPO, X7_CDOMIN, node FROM g JOIN lv ON node = X7_CDOMIN),
b AS (SELECT *, row_number() OVER (PARTITION BY X7_CAMPO, X7_CDOMIN ORDER BY nivel, via) AS k FROM t)
SELECT nivel, g.X7_CAMPO AS origem, X7_SEQUENC AS sequencia, g.X7_CDOMIN AS destino, X7_REGRA AS regra, X7_CONDIC AS condicao, X7_TIPO AS tipo, X7_ALIAS AS alias, X7_SEEK AS seek, via
FROM g JOIN b ON g.X7_CAMPO = b.X7_CAMPO AND g.X7_CDOMIN = b.X7_CDOMIN WHERE k = 1"""


# Facts that don't hang on comments and strings can be told from the fixtures' lines in SQL as well.
_LINES = f"""SELECT arquivo, i AS linha, lines[i] AS line, len(lines) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS total
FROM (SELECT arquivo, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT arquivo, text, string_split(text, chr(10)) AS lines FROM {X.sources_sql()}))"""
ORACLES["fixture_functions"] = f"""WITH l AS ({_LINES}), f AS (
  SELECT arquivo, linha, total, regexp_extract(line, '(?i)^[ \\t]*(?:(?:Static|User|Main)[ \\t]+)?Function[ \\t]+(\\w+)', 1) AS fn,
         lower(regexp_extract(line, '(?i)^[ \\t]*(Static|User|Main)[ \\t]+Function', 1)) AS word,
         upper(regexp_extract(line, '(?i)^[ \\t]*WSMETHOD[ \\t]+(GET|POST|PUT|DELETE)[ \\t]+WSSERVICE[ \\t]+(\\w+)', 1)) AS verb,
         regexp_extract(line, '(?i)^[ \\t]*WSMETHOD[ \\t]+(GET|POST|PUT|DELETE)[ \\t]+WSSERVICE[ \\t]+(\\w+)', 2) AS cls,
         regexp_extract(line, '(?i)^[ \\t]*WSMETHOD[ \\t]+(\\w+)[ \\t]+WSRECEIVE', 1) AS ws FROM l
), n AS (
  SELECT arquivo, CASE WHEN fn <> '' THEN fn WHEN verb <> '' THEN cls || '.' || verb ELSE ws END AS nome,
         CASE WHEN fn = '' THEN 'ws_method' WHEN word = '' THEN 'function' ELSE word || '_function' END AS kind, CASE WHEN verb <> '' THEN cls ELSE '' END AS classe, linha AS linha_inicio, total
  FROM f WHERE fn <> '' OR verb <> '' OR ws <> ''
) SELECT arquivo, nome, kind, classe, linha_inicio, CASE WHEN lead(linha_inicio) OVER w IS NULL THEN total ELSE greatest(linha_inicio, lead(linha_inicio) OVER w - 1) END AS linha_fim FROM n WINDOW w AS (PARTITION BY arquivo ORDER BY linha_inicio)"""
ORACLES["fixture_includes"] = f"""SELECT DISTINCT arquivo, regexp_extract(line, '(?i)^\\s*#Include\\s+["'']([^"'']+)["'']', 1) AS include FROM ({_LINES}) WHERE regexp_matches(line, '(?i)^\\s*#Include\\s+["'']')"""
ORACLES["fixture_namespaces"] = f"""SELECT arquivo, regexp_extract(text, '(?im)^[ \\t]*Namespace[ \\t]+([A-Za-z_][\\w.]*)', 1) AS namespace FROM {X.sources_sql()}"""
ORACLES["fixture_endpoints"] = f"""SELECT arquivo, regexp_extract(line, '(?i)WSSERVICE[ \\t]+(\\w+)', 1) AS classe, '' AS funcao, upper(regexp_extract(line, '(?i)^[ \\t]*(?:WSMETHOD[ \\t]+|@)(GET|POST|PUT|DELETE|PATCH)', 1)) AS verbo,
  regexp_extract(line, '^[ \\t]*@\\w+\\(["'']([^"'']+)["'']', 1) AS path, CASE WHEN line LIKE '%@%' THEN '@verb_tlpp' ELSE 'wsmethod_restful' END AS annotation_style, linha FROM ({_LINES})
WHERE regexp_matches(line, '(?i)^[ \\t]*(WSMETHOD[ \\t]+(GET|POST|PUT|DELETE|PATCH)[ \\t]+WSSERVICE[ \\t]+\\w|@(Get|Post|Put|Delete|Patch)\\()')"""
ORACLES["fixture_questions"] = f"""SELECT DISTINCT arquivo, upper(regexp_extract(line, '(?i)(?:Pergunte|FWGetSX1)\\s*\\(\\s*["''](\\w+)["'']', 1)) AS grupo FROM ({_LINES}) WHERE regexp_matches(line, '(?i)(?:Pergunte|FWGetSX1)\\s*\\(\\s*["'']\\w')"""
ORACLES["fixture_parameters"] = f"""WITH p AS (SELECT arquivo, linha, upper(regexp_extract(line, '"(MV_\\w+)"', 1)) AS parametro, regexp_matches(line, '(?i)PutMV') AS w, regexp_extract(line, '(?i)SuperGetMV\\("\\w+", [^,]+, "([^"]*)"', 1) AS d
  FROM ({_LINES}) WHERE regexp_matches(line, '(?i)(SuperGetMV|GetMv|PutMV)\\("MV_'))
SELECT arquivo, parametro, CASE WHEN bool_or(w) AND bool_or(NOT w) THEN 'read_write' WHEN bool_or(w) THEN 'write' ELSE 'read' END AS modo, coalesce(arg_min(d, linha) FILTER (d <> ''), '') AS default_decl FROM p GROUP BY ALL"""
_OWNER = f"""SELECT l.*, coalesce(f.nome, '') AS funcao FROM ({_LINES}) l LEFT JOIN ({ORACLES['fixture_functions']}) f ON f.arquivo = l.arquivo AND l.linha BETWEEN f.linha_inicio AND f.linha_fim"""
ORACLES["fixture_http"] = f"""SELECT arquivo, funcao, linha, CASE lower(regexp_extract(line, '(?i)\\b(HttpPost|HttpGet)\\(', 1)) WHEN 'httppost' THEN 'HttpPost' ELSE 'HttpGet' END AS metodo,
  regexp_replace(regexp_extract(line, '(?i)\\bHttp\\w+\\(["'']([^"'']+)["'']', 1), 'https?://[^\\s:@/]+:[^\\s@/]+@', 'https://[REDACTED]@') AS url_literal FROM ({_OWNER}) WHERE regexp_matches(line, '(?i)\\b(HttpPost|HttpGet)\\(["'']')"""
_ENV = "'(?i)RpcSetEnv\\(" + ", *".join(['"([^"]*)"'] * 6) + "'"
ORACLES["fixture_env_openers"] = f"""SELECT arquivo, funcao, linha, regexp_extract(line, {_ENV}, 1) AS empresa, regexp_extract(line, {_ENV}, 2) AS filial, regexp_extract(line, {_ENV}, 5) AS environment,
  regexp_extract(line, {_ENV}, 6) AS modulo FROM ({_OWNER}) WHERE regexp_matches(line, '(?i)RpcSetEnv\\(')"""
ORACLES["sx_lost_rows"] = f"""SELECT 'tabelas' AS table_name, count(*) - count(DISTINCT X2_CHAVE) AS lost FROM {X.values_sql('sx2')} UNION ALL SELECT 'campos', count(*) - count(DISTINCT (X3_ARQUIVO, X3_CAMPO)) FROM {_SX3}
UNION ALL SELECT 'indices', count(*) - count(DISTINCT (INDICE, ORDEM)) FROM {X.values_sql('six')} UNION ALL SELECT 'gatilhos', count(*) - count(DISTINCT (X7_CAMPO, X7_SEQUENC)) FROM {_SX7}
UNION ALL SELECT 'parametros', count(*) - count(DISTINCT (X6_FIL, X6_VAR)) FROM {X.values_sql('sx6')} UNION ALL SELECT 'perguntas', count(*) - count(DISTINCT (X1_GRUPO, X1_ORDEM)) FROM {X.values_sql('sx1')}
UNION ALL SELECT 'consultas', count(*) - count(DISTINCT (XB_ALIAS, XB_TIPO, XB_SEQ, XB_COLUNA)) FROM {X.values_sql('sxb')} UNION ALL SELECT 'grupos_campo', count(*) - count(DISTINCT XG_GRUPO) FROM {X.values_sql('sxg')}"""
_CODE = f"(SELECT arquivo, regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g') AS code FROM {X.sources_sql()})"


def _all(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"unnest(regexp_extract_all(code, '{quoted}', 1))"


_READS = _all(r"""(?i)(?:DbSelectArea|xFilial|FwxFilial|Posicione|MsSeek|dbSetOrder|ChkFile)\s*\(\s*["'](\w{2,3})["']""")
ORACLES["fixture_tables"] = f"""WITH u AS (
  SELECT arquivo, {_READS} AS t, 'read' AS modo FROM {_CODE}
  UNION ALL SELECT arquivo, {_all(r'(?i)\b([SZQND][A-Z][0-9A-Z])\s*->')}, 'read' FROM {_CODE}
  UNION ALL SELECT arquivo, t, unnest(['reclock', 'write']) FROM (SELECT arquivo, {_all(r'(?i)RecLock\s*\(\s*"(\w{2,3})"')} AS t FROM {_CODE})
) SELECT DISTINCT arquivo, upper(t) AS tabela, modo FROM u WHERE regexp_matches(upper(t), '^[SZNQD][A-Z].$')"""
ORACLES["fixture_fields"] = f"""SELECT DISTINCT arquivo, upper(f) AS campo FROM (SELECT arquivo, {_all(r'(?i)\w{2,3}->([A-Z][A-Z0-9]_\w+)')} AS f FROM {_CODE}
  UNION ALL SELECT arquivo, {_all(r'(?i)\bReplace\s+([A-Z][A-Z0-9]_\w+)')} FROM {_CODE})"""
ORACLES["fixture_defines"] = rf"""SELECT arquivo, regexp_extract(line, '(?i)^#DEFINE[ \t]+(\w+)', 1) AS nome, trim(regexp_extract(line, '(?i)^#DEFINE[ \t]+\w+[ \t]+(.+)$', 1)) AS valor, linha
FROM ({_LINES}) WHERE regexp_matches(line, '(?i)^#DEFINE')"""
_SIGNATURE = r"(?i)WSMETHOD[ \t]+(\w+)[ \t]+WSRECEIVE[ \t]+(\w+)[ \t]+WSSEND[ \t]+(\w+)[ \t]+WSSERVICE[ \t]+(\w+)"
_PARTS = ", ".join(f"regexp_extract(line, '{_SIGNATURE}', {k}) AS {n}" for k, n in enumerate(("nome", "receive", "send", "service"), 1))
ORACLES["fixture_ws_signatures"] = f"SELECT arquivo, {_PARTS} FROM ({_LINES}) WHERE regexp_matches(line, '(?i)WSRECEIVE')"
_LOG = "'(?i)FwLogMsg\\(\"(\\w+)\", *, *\"\\w*\", *\"(\\w+)\"'"
ORACLES["fixture_logs"] = f"""SELECT arquivo, funcao, linha, 'conout' AS nivel, '' AS categoria FROM ({_OWNER}) WHERE regexp_matches(line, '(?i)\\bConOut\\(')
UNION ALL SELECT arquivo, funcao, linha, regexp_extract(line, {_LOG}, 1), regexp_extract(line, {_LOG}, 2) FROM ({_OWNER}) WHERE regexp_matches(line, '(?i)FwLogMsg\\(')"""
# calls: by what stands before the bracket, or in the block of an automatic routine
_CONTEXT = "regexp_replace(line, '//.*', '')"
ORACLES["fixture_calls"] = f"""WITH l AS (SELECT *, {_CONTEXT} AS code FROM ({_OWNER}) WHERE NOT regexp_matches(line, '^ *RecLock[^ ]* comentado')), c AS (
  SELECT arquivo, funcao, linha, 'user_func' AS tipo, unnest(regexp_extract_all(code, '(?i)\\bU_(\\w+)\\s*\\(', 1)) AS destino FROM l
  UNION ALL SELECT arquivo, funcao, linha, 'execauto', unnest(regexp_extract_all(code, '(?i)MsExecAuto\\(\\{{\\|[^|]*\\|\\s*(\\w+)\\(', 1)) FROM l
  UNION ALL SELECT arquivo, funcao, linha, 'method', unnest(regexp_extract_all(regexp_replace(code, '"[^"]*"', '""', 'g'), '\\b([A-Za-z]\\w*:[A-Za-z]\\w*)\\s*\\(', 1)) FROM l
  UNION ALL SELECT arquivo, funcao, linha, 'mvc_hook', unnest(regexp_extract_all(code, '(?i)\\b(bCommit|bCancel|bTudoOk|bLineOk|bPosVld|bPreVld|bWhen|bValid|bLoad)\\s*:=', 1)) FROM l
) SELECT arquivo AS arquivo_origem, funcao AS funcao_origem, linha AS linha_origem, tipo, destino, upper(destino) AS destino_norm FROM c"""
QUERIES["fixture_calls"] = lambda spark, d: facts.calls(X.sources(spark, d, facts.calls)).drop("contexto")
_BLOCK = r"(?is)\bBeginSql\b\s+Alias\s+\"\w+\"\s*(.*?)\bEndSql\b|\b(?:TCQuery|TCSqlExec)\(\"([^\"']+)"
ORACLES["fixture_sql"] = f"""WITH s AS (SELECT arquivo, text, unnest(regexp_extract_all(text, '{_BLOCK.replace("'", "''")}')) AS whole FROM {X.sources_sql()}),
b AS (SELECT arquivo, len(string_split(left(text, strpos(text, whole)), chr(10))) AS linha, trim(regexp_extract(whole, '{_BLOCK.replace("'", "''")}', 1) || regexp_extract(whole, '{_BLOCK.replace("'", "''")}', 2), ' ' || chr(10)) AS snippet FROM s)
SELECT b.arquivo, f.nome AS funcao, linha, lower(regexp_extract(snippet, '^(\\w+)', 1)) AS operacao, list_sort(list_distinct(regexp_extract_all(snippet, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+(\\w+)', 1))) AS tabelas, snippet
FROM b JOIN ({ORACLES['fixture_functions']}) f ON f.arquivo = b.arquivo AND linha BETWEEN linha_inicio AND linha_fim"""
QUERIES["fixture_sql"] = lambda spark, d: facts.sql_blocks(X.sources(spark, d, facts.sql_blocks)).withColumn("tabelas", F.sort_array("tabelas"))
_ROUTINES = ", ".join(f"('{r}', '{m}', '{k}', {t!r})" for r, m, k, t in facts.ROUTINES)
ORACLES["fixture_execautos"] = f"""WITH e AS (SELECT arquivo, funcao, linha, nullif(upper(regexp_extract(line, '\\|\\s*(\\w+)\\(', 1)), '') AS routine, try_cast(regexp_extract(line, ', *(\\d+)\\)', 1) AS INTEGER) AS op_code
  FROM ({_OWNER}) WHERE regexp_matches(line, '(?i)MsExecAuto\\('))
SELECT arquivo, funcao, linha, e.routine, module, routine_type, op_code, CASE op_code WHEN 3 THEN 'inclusao' WHEN 4 THEN 'alteracao' WHEN 5 THEN 'exclusao' END AS op_label, coalesce(tables, []) AS tables_resolved, e.routine IS NULL AS dynamic_call
FROM e LEFT JOIN (VALUES {_ROUTINES}) r(routine, module, routine_type, tables) ON r.routine = e.routine"""
QUERIES["fixture_execautos"] = lambda spark, d: facts.execauto_calls(X.sources(spark, d, facts.execauto_calls)).drop("arg_count", "snippet")

QUERIES["fixture_chunks"] = lambda spark, d: facts.chunks(X.sources(spark, d, facts.chunks))
_HIDDEN = r"regexp_replace(regexp_replace({0}, 'https?://[^\s:@/]+:[^\s@/]+@', 'https://[REDACTED]@', 'g'), '\b[0-9a-fA-F]{{40,}}\b', '[REDACTED]', 'g')"
ORACLES["fixture_chunks"] = f"""SELECT f.arquivo || '::' || nome || '@' || linha_inicio AS id, f.arquivo, nome AS funcao, upper(nome) AS funcao_norm, kind AS tipo_simbolo, classe, linha_inicio, linha_fim,
  substr(trim(lines[linha_inicio]), 1, 500) AS assinatura, {_HIDDEN.format("array_to_string(lines[linha_inicio:linha_fim], chr(10))")} AS content, '' AS modulo
FROM ({ORACLES['fixture_functions']}) f JOIN (SELECT arquivo, string_split(text, chr(10)) AS lines FROM {X.sources_sql()}) s ON s.arquivo = f.arquivo"""
QUERIES["fixture_ws_structures"] = lambda spark, d: facts.ws_structures(X.sources(spark, d, facts.ws_structures)).select(
    "arquivo", "kind", "nome", F.array_join("metodos", ",").alias("metodos"), F.array_join(F.transform("dados", lambda x: F.concat(x["nome"], F.lit(":"), x["tipo"])), ",").alias("dados")
)
ORACLES["fixture_ws_structures"] = rf"""WITH l AS MATERIALIZED ({_LINES}), h AS (SELECT arquivo, linha, regexp_extract(line, '^(WSSTRUCT|WSSERVICE|WSRESTFUL)\s+(\w+)', 1) AS word, regexp_extract(line, '^(WSSTRUCT|WSSERVICE|WSRESTFUL)\s+(\w+)', 2) AS nome
  FROM l WHERE regexp_matches(line, '^(WSSTRUCT|WSSERVICE|WSRESTFUL)\s+\w')), e AS (SELECT h.*, (SELECT min(l.linha) FROM l WHERE l.arquivo = h.arquivo AND l.linha > h.linha AND regexp_matches(line, '^END ?WS')) AS stop FROM h)
SELECT e.arquivo, 'ws_' || lower(substr(word, 3)) AS kind, nome,
  CASE WHEN word = 'WSSTRUCT' THEN '' ELSE coalesce(string_agg(nullif(regexp_extract(line, '^\s+WSMETHOD\s+(\w+)', 1), ''), ',' ORDER BY l.linha), '') END AS metodos,
  coalesce(string_agg(CASE WHEN regexp_matches(line, '^\s+WSDATA') THEN regexp_extract(line, 'WSDATA\s+(\w+)', 1) || ':' || regexp_extract(line, 'AS\s+(\w+)', 1) END, ',' ORDER BY l.linha), '') AS dados
FROM e JOIN l ON l.arquivo = e.arquivo AND l.linha > e.linha AND l.linha < e.stop GROUP BY e.arquivo, e.linha, word, nome"""
QUERIES["fixture_lint"] = lambda spark, d: lint.lint_sources(X.sources(spark, d)).select("arquivo", "linha", "regra_id", "severidade")
# Single-source rules over the lines of the derived sources, whose only commented code says so.
_RESERVED = "[" + ", ".join(f"'{x.upper()}'" for x in lint.RESERVED) + "]"
_RESTRICTED = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lint.RESTRICTED_NAMES) + "]"
_DECLARED = r"list_transform(string_split(regexp_replace(line, '(?i)^\s*(Local|Static|Private|Public)\s+', ''), ','), lambda v: upper(regexp_extract(trim(v), '^(\w+)', 1)))"
_TOLD = rf"""WITH l AS MATERIALIZED ({_OWNER}), f AS MATERIALIZED ({ORACLES['fixture_functions']}), q AS MATERIALIZED ({ORACLES['fixture_sql']}), erp AS (
  SELECT * FROM q WHERE len(list_filter(tabelas, lambda t: regexp_matches(upper(t), '^[SZNQD][A-Z][A-Z0-9]\d*$'))) > 0 AND regexp_matches(snippet, '(?i)\b(select|update|delete)\b')
), locks AS (SELECT f.arquivo, f.linha_inicio, list_sort(list(linha) FILTER (regexp_matches(line, '(?i)\bRecLock\(') AND NOT contains(line, 'comentado'))) AS o, count(*) FILTER (regexp_matches(line, '(?i)\bMsUnlock\(')) AS n
  FROM f JOIN l ON l.arquivo = f.arquivo AND linha BETWEEN linha_inicio AND linha_fim GROUP BY ALL
), found AS (
  SELECT arquivo, unnest(o[n + 1:]) AS linha, 'BP-001' AS regra_id FROM locks WHERE len(o) > n
  UNION ALL SELECT arquivo, linha, 'BP-002' FROM l b WHERE regexp_matches(line, '(?i)\bBEGIN\s+TRANSACTION\b') AND NOT EXISTS (SELECT 1 FROM l o WHERE o.arquivo = b.arquivo AND regexp_matches(o.line, '(?i)\bEND\s+TRANSACTION\b'))
  UNION ALL SELECT arquivo, linha, 'BP-003' FROM l b WHERE regexp_matches(line, '(?i)\bMsExecAuto\(') AND NOT EXISTS (SELECT 1 FROM l o WHERE o.arquivo = b.arquivo AND o.linha BETWEEN b.linha AND b.linha + 10 AND contains(lower(o.line), 'lmserroauto'))
  UNION ALL SELECT arquivo, linha, 'BP-004' FROM l b WHERE regexp_matches(line, '(?i)\bPergunte\("\w+", \.F\.\)') AND NOT EXISTS (SELECT 1 FROM l o WHERE o.arquivo = b.arquivo AND o.linha BETWEEN b.linha AND b.linha + 5 AND regexp_matches(o.line, '(?i)\bMV_PAR\d'))
  UNION ALL SELECT arquivo, linha_inicio, 'BP-006' FROM f WHERE EXISTS (SELECT 1 FROM l WHERE l.arquivo = f.arquivo AND linha BETWEEN linha_inicio AND linha_fim AND regexp_matches(line, '(?i)\b(DbRLock\(|dbAppend\(\))'))
    AND EXISTS (SELECT 1 FROM l WHERE l.arquivo = f.arquivo AND linha BETWEEN linha_inicio AND linha_fim AND regexp_matches(line, '(?i)\bRecLock\(') AND NOT contains(line, 'comentado'))
  UNION ALL SELECT arquivo, linha, 'SEC-001' FROM l b WHERE regexp_matches(line, '(?i)\bRpcSetEnv\(') AND EXISTS (SELECT 1 FROM l o WHERE o.arquivo = b.arquivo AND o.linha < b.linha AND regexp_matches(o.line, '(?i)^CLASS \w+ FROM WSRESTFUL'))
  UNION ALL SELECT arquivo, linha, 'BP-002b' FROM l WHERE regexp_matches(line, '(?i)^\s*Private\s') AND len(list_filter({_DECLARED}, lambda v: v <> '' AND NOT list_contains({_RESERVED}, v))) > 0
  UNION ALL SELECT arquivo, linha, 'BP-005' FROM l WHERE regexp_matches(line, '(?i)\bFunction\s+\w+\([^)]*\)') AND len(string_split(regexp_extract(line, '\(([^)]*)\)', 1), ',')) > 6
  UNION ALL SELECT arquivo, linha_inicio, 'BP-007' FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.arquivo = f.arquivo AND linha BETWEEN linha_inicio - 30 AND linha_inicio - 1 AND contains(line, '{{Protheus.doc}}'))
  UNION ALL SELECT arquivo, linha, 'BP-008' FROM l WHERE regexp_matches(line, '(?i)^\s*(Local|Static|Private|Public)\s') AND len(list_filter({_DECLARED}, lambda v: list_contains({_RESERVED}, v))) > 0
  UNION ALL SELECT arquivo, linha_inicio, 'SEC-002' FROM f WHERE kind = 'user_function' AND NOT regexp_matches(nome, '{lint.CLIENT_PREFIX}') AND NOT regexp_matches(upper(nome), '{lint.ENTRY_POINT}')
  UNION ALL SELECT arquivo, linha, 'SEC-003' FROM l WHERE regexp_matches(line, '(?i)\b(ConOut|FwLogMsg)\(') AND regexp_matches(regexp_replace(line, '"[^"]*"', '', 'g'), '\b[a-z]?(Cpf|Cnpj|Senha|Cartao|Token)')
  UNION ALL SELECT arquivo, linha, 'SEC-004' FROM l WHERE regexp_matches(line, '(?i)\bRpcSetEnv\("[^"]*", *"[^"]*", *"[^"]+", *"[^"]+"')
  UNION ALL SELECT arquivo, linha, 'SEC-005' FROM (SELECT arquivo, linha, unnest(list_distinct(regexp_extract_all(upper(line), '(?:^|[^:.A-Z0-9_])([A-Z_]\w*)\(', 1))) AS name FROM l WHERE NOT contains(line, 'comentado') AND NOT regexp_matches(line, '(?i)\bFunction\b'))
    WHERE list_contains({_RESTRICTED}, name)
  UNION ALL SELECT arquivo, linha, 'PERF-001' FROM q WHERE regexp_matches(snippet, '(?i)\bSELECT\s+\*')
  UNION ALL SELECT arquivo, linha, 'PERF-002' FROM erp WHERE NOT contains(lower(snippet), '%notdel%')
  UNION ALL SELECT arquivo, linha, 'PERF-003' FROM erp WHERE NOT regexp_matches(snippet, '(?i)%xfilial(?:[: ]\w*)?%')
  UNION ALL SELECT arquivo, linha, 'PERF-004' FROM l c WHERE regexp_matches(line, '\bc[A-Z]\w*\s*\+=') AND EXISTS (SELECT 1 FROM l o WHERE o.arquivo = c.arquivo AND o.linha < c.linha AND contains(o.line, 'While'))
    AND EXISTS (SELECT 1 FROM l o WHERE o.arquivo = c.arquivo AND o.linha > c.linha AND contains(o.line, 'EndDo'))
  UNION ALL SELECT arquivo, linha, 'PERF-005' FROM l WHERE regexp_matches(line, '(?i)\b(RecCount|LastRec)\(\s*\)\)?\s*>\s*0')
  UNION ALL SELECT arquivo, linha, 'MOD-001' FROM l WHERE regexp_matches(line, '(?i)\bConOut\(')
  UNION ALL SELECT arquivo, linha, 'MOD-002' FROM l WHERE regexp_matches(line, '(?i)^\s*PUBLIC\s')
  UNION ALL SELECT arquivo, linha, 'MOD-004' FROM l WHERE regexp_matches(line, '(?i)\b(AxCadastro|Modelo2|Modelo3|MsNewGetDados)\(')
)"""
_RANKS = "CASE regra_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lint.SEVERITY.items() if k in lint.SINGLE_RULES) + " END"
ORACLES["fixture_lint"] = f"{_TOLD} SELECT arquivo, linha, regra_id, {_RANKS} AS severidade FROM found"


def execution_triggers(spark, d):
    """What starts code indirectly, with the metadata as sorted pairs."""
    rows = facts.execution_triggers(X.sources(spark, d, facts.execution_triggers))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return rows.select("arquivo", "funcao", "linha", "kind", "target", pairs.alias("metadata"), "snippet")


QUERIES["fixture_triggers"] = execution_triggers
_Q = '"([^"]*)"'
_FIRST = "(SELECT regexp_extract(o.line, '{0}', 1) FROM l o WHERE o.arquivo = l.arquivo AND o.linha > l.linha AND regexp_matches(o.line, '{0}') ORDER BY o.linha LIMIT 1)"
ORACLES["fixture_triggers"] = rf"""WITH l AS MATERIALIZED ({_OWNER}), t AS (
  SELECT arquivo, funcao, linha, 'workflow' AS kind, regexp_extract(line, 'New\({_Q}', 1) AS target, line, ['process_id=' || regexp_extract(line, 'New\({_Q}', 1), 'description=' || regexp_extract(line, 'New\({_Q}, {_Q}', 2),
    'template=' || {_FIRST.format('NewTask\\("[^"]*", ' + _Q)}, 'to=' || {_FIRST.format('cTo := ' + _Q)}, 'subject=' || {_FIRST.format('cSubject := ' + _Q)},
    'return=' || {_FIRST.format('bReturn := .*[|] *(\\w+)')}, 'timeout=' || {_FIRST.format('bTimeOut := .*[|] *(\\w+)')}] AS m FROM l WHERE contains(line, 'TWFProcess')
  UNION ALL SELECT l.arquivo, l.funcao, l.linha, 'schedule', regexp_extract(r.line, '"[PR]", {_Q}', 1), l.line, ['type=' || regexp_extract(r.line, '"([PR])"', 1), 'group=' || regexp_extract(r.line, '"[PR]", {_Q}', 1),
    'alias=' || regexp_extract(r.line, '"[PR]", {_Q}, {_Q}', 2), 'orders=' || regexp_extract(r.line, ', \{{([^}}]*)\}}', 1), 'title=' || regexp_extract(r.line, '\}}, {_Q}', 1)]
    FROM l JOIN l r ON r.arquivo = l.arquivo AND r.linha = l.linha + 1 WHERE contains(l.line, 'SchedDef()')
  UNION ALL SELECT arquivo, funcao, linha, 'job_standalone', regexp_extract(line, 'Function (\w+)', 1), line, ['main=' || regexp_extract(line, 'Function (\w+)', 1), 'empresa=' || {_FIRST.format('RpcSetEnv\\(' + _Q)},
    'filial=' || {_FIRST.format('RpcSetEnv\\("[^"]*", ' + _Q)}, 'modulo=' || {_FIRST.format('RpcSetEnv\\((?:"[^"]*", ){4}' + _Q)},
    'sleep_seconds=' || {_FIRST.format('Sleep\\((\\d+) \\* 1000\\)')}, 'stop_file=' || {_FIRST.format('File\\(' + _Q)}] FROM l WHERE regexp_matches(line, '^Main Function')
  UNION ALL SELECT arquivo, funcao, linha, 'mail_send', '', line, ['attach=true', 'variant=message'] FROM l WHERE contains(line, 'TMailMessage')
) SELECT arquivo, funcao, linha, kind, target, array_to_string(list_sort(m), '; ') AS metadata, trim(line) AS snippet FROM t"""


def documentation(spark, d):
    """Documentation blocks with their parameters as text."""
    rows = facts.doc_blocks(X.sources(spark, d, facts.doc_blocks))
    params = F.array_join(F.transform("params", lambda p: F.concat_ws("|", p["name"], p["type"], p["desc"], p["optional"].cast("string"))), ";")
    return rows.select("arquivo", "funcao", "linha_bloco_inicio", "linha_bloco_fim", "linha_funcao", "summary", "tipo", "author", "since", params.alias("params"), F.col("raw_tags")["nota"].alias("nota"))


QUERIES["fixture_docs"] = documentation
_TAG = r"(SELECT regexp_extract(o.line, '^@{0} (.*)$', 1) FROM l o WHERE o.arquivo = b.arquivo AND regexp_matches(o.line, '^@{0} ') ORDER BY o.linha LIMIT 1)"
ORACLES["fixture_docs"] = rf"""WITH l AS MATERIALIZED ({_LINES}), b AS (SELECT arquivo, linha AS first, regexp_extract(line, 'doc\}} (\w+)', 1) AS funcao,
  (SELECT min(o.linha) FROM l o WHERE o.arquivo = l.arquivo AND o.linha > l.linha AND o.line = '/*/') AS last FROM l WHERE contains(line, '{{Protheus.doc}}'))
SELECT arquivo, funcao, first AS linha_bloco_inicio, last AS linha_bloco_fim, (SELECT min(o.linha) FROM l o WHERE o.arquivo = b.arquivo AND o.linha > last AND contains(o.line, 'Function')) AS linha_funcao,
  (SELECT string_agg(o.line, chr(10) ORDER BY o.linha) FROM l o WHERE o.arquivo = b.arquivo AND o.linha > first AND o.linha < (SELECT min(i.linha) FROM l i WHERE i.arquivo = b.arquivo AND i.line LIKE '@%')) AS summary,
  {_TAG.format('type')} AS tipo, {_TAG.format('author')} AS author, {_TAG.format('since')} AS since,
  (SELECT string_agg(regexp_replace(trim(string_split(p, ',')[1]), '[\[\]\s]', '', 'g') || '|' || trim(string_split(p, ',')[2]) || '|' || trim(array_to_string(string_split(p, ',')[3:], ',')) || '|' || (p LIKE '[%')::VARCHAR, ';' ORDER BY linha)
     FROM (SELECT o.linha, regexp_extract(o.line, '^@param (.*)$', 1) AS p FROM l o WHERE o.arquivo = b.arquivo AND o.line LIKE '@param %')) AS params,
  (SELECT string_agg(regexp_extract(o.line, '^@nota (.*)$', 1), chr(10) ORDER BY o.linha) FROM l o WHERE o.arquivo = b.arquivo AND o.line LIKE '@nota %') AS nota FROM b"""


# The other rules across sources and dictionary.
_EXPRESSIONS = f"(SELECT X3_ARQUIVO, X3_CAMPO, unnest([X3_VALID, X3_VLDUSER, X3_RELACAO]) AS expr FROM {_SX3})"
_FINDING = "SELECT DISTINCT 'SX:' || X3_ARQUIVO AS arquivo, X3_CAMPO AS funcao, '{0}' AS regra_id, '{1}' AS severidade"
QUERIES["sx_missing_routine"] = _sx(lambda t, s: lint.sx001(t["campos"], facts.functions(s)), facts.functions)
ORACLES["sx_missing_routine"] = rf"""{_FINDING.format('SX-001', 'warning')} FROM (SELECT *, unnest(regexp_extract_all(upper(expr), '\bU_([A-Z][A-Z0-9_]*)', 1)) AS name FROM {_EXPRESSIONS})
WHERE name NOT IN (SELECT regexp_replace(upper(nome), '^U_', '') FROM ({ORACLES['fixture_functions']}))"""
QUERIES["sx_unused_question"] = _sx(lambda t, s: lint.sx004(t["perguntas"], facts.questions(s)), facts.questions)
ORACLES["sx_unused_question"] = f"""SELECT DISTINCT 'SX:SX1' AS arquivo, X1_GRUPO AS funcao, 'SX-004' AS regra_id, 'warning' AS severidade FROM {X.values_sql('sx1')} WHERE upper(X1_GRUPO) NOT IN (SELECT grupo FROM ({ORACLES['fixture_questions']}))"""
QUERIES["sx_unused_field"] = _sx(lambda t, s: lint.sx005(t["campos"], facts.chunks(s), t["gatilhos"]), facts.chunks)
ORACLES["sx_unused_field"] = rf"""WITH texts AS MATERIALIZED (SELECT upper(content) AS t FROM ({ORACLES['fixture_chunks']}) UNION ALL SELECT upper(expr) FROM {_EXPRESSIONS}
  UNION ALL SELECT upper(X7_REGRA || ' ' || X7_CONDIC || ' ' || X7_CHAVE) FROM {_SX7})
{_FINDING.format('SX-005', 'warning')} FROM {_SX3} WHERE (regexp_matches(X3_CAMPO, '^[^_]+_X') OR X3_PROPRI NOT IN ('', 'S')) AND NOT EXISTS (SELECT 1 FROM texts WHERE contains(t, upper(X3_CAMPO)))"""
QUERIES["sx_restricted_call"] = lambda spark, d: lint.sx007(X.dictionary(spark, d)[0]["campos"], restricted_functions(spark)).select("arquivo", "funcao", "regra_id", "severidade")
ORACLES["sx_restricted_call"] = rf"""{_FINDING.format('SX-007', 'critical')} FROM (SELECT *, unnest(regexp_extract_all(upper(expr), '\b([A-Z_]\w*)\s*\(', 1)) AS name FROM {_EXPRESSIONS}) WHERE list_contains({_RESTRICTED}, name)"""
QUERIES["sx_empty_required"] = _sx(lambda t, s: lint.sx009(t["campos"]))
ORACLES["sx_empty_required"] = rf"""{_FINDING.format('SX-009', 'warning')} FROM {_SX3} WHERE (lower(X3_OBRIGAT) LIKE 'x%' OR upper(X3_OBRIGAT) IN ('S', 'SIM', '1', '.T.')) AND regexp_matches(X3_RELACAO, '(?i)""|''''|\bSpace\(\d+\)|\bNil\b|\.F\.|\b0\s*$')"""
QUERIES["static_prefixes"] = lambda spark, d: lint.mod003(facts.functions(X.sources(spark, d, facts.functions))).select("arquivo", "funcao", "regra_id", "severidade")
ORACLES["static_prefixes"] = f"""WITH p AS (SELECT arquivo, lower(nome[1:n]) AS prefix, count(*) AS k FROM ({ORACLES['fixture_functions']}), (SELECT unnest(range(3, 7)) AS n) WHERE kind = 'static_function' AND length(nome) >= n GROUP BY ALL HAVING count(*) >= 3)
SELECT arquivo, '' AS funcao, 'MOD-003' AS regra_id, 'info' AS severidade FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.arquivo = p.arquivo AND q.prefix <> p.prefix AND starts_with(q.prefix, p.prefix))"""
QUERIES["unindexed_columns"] = lambda spark, d: lint.perf006(facts.sql_blocks(X.sources(spark, d, facts.sql_blocks)), X.dictionary(spark, d)[0]["indices"]).select("arquivo", "funcao", "regra_id", "severidade")
_COLUMN = "[A-Z][A-Z0-9]{1,2}_[A-Z][A-Z_0-9]*"
ORACLES["unindexed_columns"] = rf"""WITH q AS (SELECT DISTINCT arquivo, funcao, linha, unnest(regexp_extract_all(upper(snippet[strpos(upper(snippet), 'WHERE'):]), '\b{_COLUMN}', 0)) AS col FROM ({ORACLES['fixture_sql']}) WHERE operacao = 'select' AND contains(upper(snippet), 'WHERE')),
i AS (SELECT unnest(regexp_extract_all(upper(CHAVE), '{_COLUMN}', 0)) AS col FROM (SELECT arg_max(CHAVE, s_suppkey) AS CHAVE FROM {X.values_sql('six')} GROUP BY INDICE, ORDEM))
SELECT arquivo, funcao, 'PERF-006' AS regra_id, 'info' AS severidade FROM q WHERE col NOT IN (SELECT col FROM i) AND NOT ends_with(col, '_FILIAL') AND string_split(col, '_')[1] IN (SELECT string_split(col, '_')[1] FROM i)"""
_CROSS = ("sx_missing_routine", "sx_missing_destination", "sx_unused_parameter", "sx_unused_question", "sx_unused_field", "sx_sql_in_validation", "sx_restricted_call", "sx_shared_table_branch", "sx_empty_required",
          "sx_trigger_without_seek", "sx_missing_query", "static_prefixes", "unindexed_columns")


def cross_rules(spark, d):
    """All rules across sources and dictionary, whose tables are staged once."""
    tables = {k: staged(spark, v, k) for k, v in X.dictionary(spark, d)[0].items()}
    src = X.sources(spark, d, facts.functions, facts.parameters, facts.questions, facts.chunks, facts.sql_blocks)
    return cross_lint(spark, staged(spark, src, "sources"), tables).select("arquivo", "funcao", "regra_id", "severidade")


QUERIES["fixture_cross_lint"] = cross_rules
ORACLES["fixture_cross_lint"] = " UNION ALL ".join(f"SELECT arquivo, funcao, regra_id, severidade FROM ({ORACLES[n]})" for n in _CROSS)


_LISTS = ("capabilities", "pontos_entrada", "funcoes", "user_funcs", "tabelas_ref", "write_tables", "reclock_tables", "includes", "calls_u", "fields_ref")


def summaries(spark, d):
    """A row a source; its lists as text."""
    rows = facts.summaries(X.sources(spark, d, facts.summaries))
    return rows.select("arquivo", "encoding", "hash", "lines_of_code", "source_type", *[F.array_join(c, ",").alias(c) for c in _LISTS], "namespace")


QUERIES["fixture_summaries"] = summaries
_FLAGS = {
    "ENV_OPENER": "contains(text, 'RpcSetEnv(')", "EXEC_AUTO_CALLER": "regexp_matches(text, 'MSExecAuto\\(\\{')", "JOB": "contains(text, 'RpcSetEnv(') AND contains(text, 'Main Function')", "MULTI_FILIAL": "regexp_matches(text, 'xFilial|cEmpAnt')",
    "MVC": "contains(text, 'ModelDef')", "PE": "contains(text, 'PARAMIXB')", "REST_CLIENT": "regexp_matches(text, '(?i)\\bHttp(Get|Post)\\(')", "RPC": "contains(text, 'RpcSetEnv(')",
    "WS-REST": "regexp_matches(text, '(?m)^(@[A-Z][a-z]+\\(|WSRESTFUL)')", "WS-SOAP": "regexp_matches(text, '(?m)^WSSERVICE')",
}


def _list_of(column: str, source: str, where: str = "true") -> str:
    return f"coalesce((SELECT string_agg(DISTINCT {column}, ',' ORDER BY {column}) FROM {source} x WHERE x.arquivo = s.arquivo AND {where}), '')"


ORACLES["fixture_summaries"] = f"""WITH s AS MATERIALIZED (SELECT *, list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _FLAGS.items())}], lambda c: c IS NOT NULL) AS flags FROM {X.sources_sql()}),
f AS MATERIALIZED ({ORACLES['fixture_functions']}), t AS MATERIALIZED ({ORACLES['fixture_tables']}), i AS MATERIALIZED ({ORACLES['fixture_includes']}), c AS MATERIALIZED (SELECT *, arquivo_origem AS arquivo FROM ({ORACLES['fixture_calls']})),
e AS MATERIALIZED ({ORACLES['fixture_fields']}), n AS MATERIALIZED ({ORACLES['fixture_namespaces']})
SELECT s.arquivo, 'cp1252' AS encoding, sha1(text) AS hash, len(string_split(text, chr(10))) - 1 AS lines_of_code,
  CASE WHEN list_contains(flags, 'WS-REST') OR list_contains(flags, 'WS-SOAP') THEN 'webservice' WHEN list_contains(flags, 'MVC') THEN 'mvc' WHEN list_contains(flags, 'PE') THEN 'pe' WHEN contains(text, 'Main Function') THEN 'main_function'
       WHEN contains(text, 'User Function') THEN 'user_function' ELSE 'outro' END AS source_type,
  array_to_string(flags, ',') AS capabilities, CASE WHEN list_contains(flags, 'PE') THEN {_list_of('nome', 'f')} ELSE '' END AS pontos_entrada, {_list_of('nome', 'f')} AS funcoes,
  {_list_of('nome', 'f', "x.kind = 'user_function'")} AS user_funcs, {_list_of('tabela', 't', "x.modo = 'read'")} AS tabelas_ref, {_list_of('tabela', 't', "x.modo = 'write'")} AS write_tables,
  {_list_of('tabela', 't', "x.modo = 'reclock'")} AS reclock_tables, {_list_of('include', 'i')} AS includes, {_list_of('destino_norm', 'c', "x.tipo = 'user_func'")} AS calls_u, {_list_of('campo', 'e')} AS fields_ref, n.namespace
FROM s JOIN n ON n.arquivo = s.arquivo"""

_WORD = f"(^|[^A-Z0-9_]){_IMPACT}($|[^A-Z0-9_])"
_CONTEXT_OF = f"upper(trim(regexp_replace(substr(content, greatest(1, strpos(upper(content), '{_IMPACT}') - 60), 200), '[ \\t\\r\\n]+', ' ', 'g')))"
_MARKED = " OR ".join("contains({0}, '{1}')".format(_CONTEXT_OF, m.replace("'", "''")) for m in commands.CRITICAL_MARKS)
ORACLES["fixture_impact"] = f"""WITH RECURSIVE g AS {_SX7}, reach AS (
  SELECT DISTINCT node, 0 AS level FROM (SELECT X7_CAMPO AS node FROM g WHERE regexp_matches(upper(X7_REGRA), '{_WORD}') OR regexp_matches(upper(X7_CONDIC), '{_WORD}') OR X7_CAMPO = '{_IMPACT}' UNION SELECT '{_IMPACT}')
  UNION SELECT X7_CDOMIN, level + 1 FROM reach JOIN g ON X7_CAMPO = node WHERE level < 2)
SELECT 'fonte' AS tipo, arquivo || '::' || funcao AS local, CASE WHEN {_MARKED} THEN 'critical' ELSE 'warning' END AS severidade FROM ({ORACLES['fixture_chunks']}) WHERE regexp_matches(upper(content), '{_WORD}')
UNION ALL SELECT 'SX3', X3_ARQUIVO || '.' || X3_CAMPO, 'warning' FROM {_SX3} WHERE X3_CAMPO = '{_IMPACT}' OR regexp_matches(upper(X3_VALID || ' ' || X3_RELACAO || ' ' || X3_VLDUSER), '{_WORD}')
UNION ALL SELECT 'SX7', X7_CAMPO || '#' || X7_SEQUENC, 'critical' FROM g WHERE X7_CAMPO IN (SELECT node FROM reach)"""
