"""The query surface: find, callers, callees, tables, param, arch, lint, grep, impact, cascade, status, docs ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from . import relational as R

SOURCE_NAME = r"(?i)\.(prw|tlpp|prx|apw)$"
OPERATION_CODES = {"inc": 3, "inclusao": 3, "include": 3, "alt": 4, "alteracao": 4, "alter": 4, "exc": 5, "exclusao": 5, "exclude": 5, "delete": 5}  # fixed values
TRIGGER_KINDS = ("workflow", "schedule", "job_standalone", "mail_send")  # fixed values
CRITICAL_MARKS = ("RECLOCK", "REPLACE", "UPDATE ", "INSERT ", "MSEXECAUTO")  # fixed values


def normalize(name: str) -> str:
    """Upper case without one leading ``U_`` (exactly one, also for names that begin with U)."""
    return name.upper().removeprefix("U_")


def find(chunks: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """A function by name, else files by part of their path, else a text search."""
    columns = lambda df, name: df.select("arquivo", name.alias("nome"))
    return R.first_nonempty(
        [
            ("funcao", columns(chunks.where(F.col("funcao_norm") == normalize(text)), F.col("funcao"))),
            ("arquivo", columns(files.where(R.contains_nocase("arquivo", text) | R.contains_nocase("caminho_relativo", text)), F.col("caminho_relativo"))),
            ("texto", columns(chunks.where(R.contains_nocase("content", text)), F.col("funcao"))),
        ]
    )


def callers(calls: DataFrame, name: str) -> DataFrame:
    wanted = normalize(name)
    stem = F.upper(F.regexp_replace("arquivo_origem", r"\.[^.]*$", ""))
    own = (F.upper("funcao_origem") == wanted) | (stem == wanted)
    rows = calls.where(F.col("destino_norm") == wanted)
    return rows.select(F.col("arquivo_origem").alias("arquivo"), F.col("funcao_origem").alias("funcao"), F.col("linha_origem").alias("linha"), "tipo", "contexto", own.alias("is_self_call")).orderBy("arquivo", "linha")


def callees(calls: DataFrame, name: str) -> DataFrame:
    """Calls from a function, or from a whole source if the name has a source's extension."""
    import re

    if re.search(SOURCE_NAME, name):
        rows = calls.where(R.nocase_equal("arquivo_origem", name))
    else:
        rows = calls.where(R.normalized_name("funcao_origem") == normalize(name))
    return rows.select("destino", "tipo", F.col("linha_origem").alias("linha"), "contexto").orderBy("linha", "destino")


def tables_used(tables: DataFrame, table: str, mode: str | None = None) -> DataFrame:
    rows = tables.where(F.col("tabela") == table.upper())
    return (rows.where(F.col("modo") == mode) if mode else rows).orderBy("arquivo", "modo")


def parameter_used(parameters: DataFrame, name: str) -> DataFrame:
    return parameters.where(F.col("parametro") == name.upper()).orderBy("arquivo")


def arch(summaries: DataFrame, execautos: DataFrame, file: str) -> DataFrame:
    """A source's summary with the tables its automatic routine calls touch."""
    touched = execautos.groupBy("arquivo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables_resolved")))).alias("tables_via_execauto"))
    rows = summaries.where(R.nocase_equal("arquivo", file)).join(touched, "arquivo", "left")
    return rows.withColumn("tables_via_execauto", F.coalesce("tables_via_execauto", F.array().cast("array<string>")))


def lint(findings: DataFrame, file: str | None = None, severity: str | None = None, rule: str | None = None) -> DataFrame:
    rows = findings
    if file:
        rows = rows.where(R.nocase_equal("arquivo", file))
    if severity:
        rows = rows.where(F.col("severidade") == severity)
    if rule:
        rows = rows.where(F.col("regra_id") == rule)
    return rows.orderBy("arquivo", "linha", "regra_id")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("chave"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def doctor(files: DataFrame, chunks: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Health checks: check, status, count, detail."""

    def check(name: str, n: DataFrame, detail: str) -> DataFrame:
        return n.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, "warn").otherwise("ok").alias("status"), F.col("n").alias("count"), F.lit(detail).alias("detail"))

    count = lambda df, c=None: df.agg((F.count_if(c) if c is not None else F.count(F.lit(1))).alias("n"))
    parts = [
        check("encoding", count(files, F.coalesce("encoding", F.lit("")) == ""), "sources without a known encoding"),
        check("orphan_chunks", count(chunks.join(files.select("arquivo"), "arquivo", "left_anti")), "chunks whose source is gone"),
        check("errors", count(files, F.col("error").isNotNull()), "sources that couldn't be read"),
    ]
    if tokens is not None:
        parts.append(check("word_index", count(chunks.where("content <> ''").join(tokens.select("id").distinct(), "id", "left_anti")), "chunks the word index lacks"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grep(chunks: DataFrame, pattern: str, mode: str = "literal", limit: int = 0, tokens: DataFrame | None = None) -> DataFrame:
    """arquivo, funcao and snippet: by ``literal`` text, ``identifier`` or ``fts`` search (over stored ``tokens`` where given); 50 rows unless said otherwise."""
    from . import search

    if mode == "fts":
        words = [w for n in _terms(search.parse(pattern)) for w in n]
        hits = search.search(chunks, "content", pattern) if tokens is None else chunks.join(search.indexed(tokens, "id", pattern), "id", "left_semi")
        rows = hits.withColumn("snippet", search.highlight(F.col("content"), words))
    elif mode == "identifier":
        rows = chunks.where(F.contains(F.upper("content"), F.lit(normalize(pattern)))).withColumn("snippet", F.substring("content", 1, 200))
    elif mode == "literal":
        rows = chunks.where(R.contains_nocase("content", pattern)).withColumn("snippet", R.snippet_around(F.col("content"), pattern))
    else:
        rows = chunks.limit(0).withColumn("snippet", F.lit(""))
    return rows.orderBy("arquivo", "linha_inicio", "id").select("arquivo", "funcao", "snippet").limit(limit or 50)


def _terms(node) -> list[tuple[str, ...]]:
    if node.kind in ("and", "or", "not"):
        return [t for p in node.parts for t in _terms(p)]
    return [node.words]


def impact(chunks: DataFrame, campos: DataFrame, gatilhos: DataFrame, perguntas: DataFrame, field: str, depth: int = 3) -> DataFrame:
    """Where a field matters: sources, dictionary, trigger chain and question groups; the most severe first."""
    short = lambda c: R.collapse(c, 160)
    hit = lambda *cols: F.greatest(*[R.contains_word(c, field).cast("int") for c in cols]) == 1
    at = F.greatest(F.lit(1), F.instr(F.upper("content"), field.upper()) - 60)
    source = chunks.where(R.contains_word("content", field)).withColumn("ctx", short(F.substr("content", at, F.lit(200))))
    critical = F.lit(False)
    for mark in CRITICAL_MARKS:
        critical = critical | F.contains(F.upper("ctx"), F.lit(mark))
    parts = [source.select(F.lit("fonte").alias("tipo"), F.concat("arquivo", F.lit("::"), "funcao").alias("local"), F.col("ctx").alias("contexto"), F.when(critical, "critical").otherwise("warning").alias("severidade"))]
    own = campos.where(F.upper("campo") == field.upper())
    parts.append(own.select(F.lit("SX3").alias("tipo"), F.concat("tabela", F.lit("."), "campo").alias("local"), short(F.concat_ws(" ", "titulo", "descricao")).alias("contexto"), F.lit("warning").alias("severidade")))
    expr = F.concat_ws(" | ", "validacao", "inicializador", "vlduser", "when_expr")
    others = campos.where((F.upper("campo") != field.upper()) & hit("validacao", "inicializador", "vlduser", "when_expr"))
    parts.append(others.select(F.lit("SX3").alias("tipo"), F.concat("tabela", F.lit("."), "campo").alias("local"), short(expr).alias("contexto"), F.lit("warning").alias("severidade")))
    edges = gatilhos.select(F.upper("campo_origem").alias("src"), F.upper("campo_destino").alias("dst"))
    named = gatilhos.where(hit("regra", "condicao") | (F.upper("campo_origem") == field.upper())).select(F.upper("campo_origem").alias("node"))
    seeds = named.unionByName(gatilhos.sparkSession.createDataFrame([(field.upper(),)], "node string")).distinct()
    near = graph.reach(edges, seeds, depth).where(F.col("level") < graph.clamp_depth(depth)).select(F.col("node").alias("origin"))
    chain = gatilhos.join(near, F.upper("campo_origem") == F.col("origin"), "left_semi")
    parts.append(chain.select(F.lit("SX7").alias("tipo"), F.concat("campo_origem", F.lit("#"), "sequencia").alias("local"), short(F.concat("campo_origem", F.lit(" -> "), "campo_destino", F.lit(": "), "regra")).alias("contexto"), F.lit("critical").alias("severidade")))
    asked = perguntas.where(hit("validacao", "conteudo_padrao", "f3"))
    parts.append(asked.select(F.lit("SX1").alias("tipo"), F.concat("grupo", F.lit("/"), "ordem").alias("local"), short(F.concat_ws(" ", "pergunta", "validacao")).alias("contexto"), F.lit("warning").alias("severidade")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(R.severity_rank("severidade"), "tipo", "local")


def trigger_cascade(gatilhos: DataFrame, field: str, depth: int = 3) -> DataFrame:
    """Triggers around a field in either direction: nivel, origem, sequencia, destino, regra, condicao, tipo, alias, seek, via; each edge once, on its first level."""
    edges = gatilhos.select(F.upper("campo_origem").alias("src"), F.upper("campo_destino").alias("dst"))
    seeds = gatilhos.sparkSession.createDataFrame([(field.upper(),)], "node string")
    found = graph.cascade(edges, seeds, depth)
    rows = gatilhos.join(found, (F.upper("campo_origem") == F.col("src")) & (F.upper("campo_destino") == F.col("dst")))
    return rows.select(F.col("level").alias("nivel"), F.col("campo_origem").alias("origem"), "sequencia", F.col("campo_destino").alias("destino"), "regra", "condicao", "tipo", "alias", "seek", "via").orderBy("nivel", "origem", "sequencia")


def triggers(found: DataFrame, kind: str | None = None, file: str | None = None) -> DataFrame:
    """Execution triggers; an unknown kind has none."""
    if kind is not None and kind not in TRIGGER_KINDS:
        return found.limit(0)
    rows = found.where(F.col("kind") == kind) if kind else found
    rows = rows.where(R.nocase_equal("arquivo", file)) if file else rows
    return rows.orderBy("arquivo", "linha", "kind")


def execautos(found: DataFrame, routine: str | None = None, op: str | None = None, dynamic: bool | None = None) -> DataFrame:
    """Automatic routine calls; an unknown operation has none."""
    rows = found.where(F.col("routine") == routine.upper()) if routine else found
    if op is not None:
        code = OPERATION_CODES.get(op.lower()) or (int(op) if op.isdigit() else None)
        if code is None:
            return found.limit(0)
        rows = rows.where(F.col("op_code") == code)
    return (rows.where(F.col("dynamic_call") == dynamic) if dynamic is not None else rows).orderBy("arquivo", "linha")


def docs(found: DataFrame, module: str | None = None, author: str | None = None, deprecated: bool | None = None) -> DataFrame:
    rows = found.where(F.upper("module_inferido") == module.upper()) if module else found
    rows = rows.where(R.contains_nocase("author", author)) if author else rows
    return (rows.where(F.col("deprecated") == deprecated) if deprecated is not None else rows).orderBy("arquivo", "linha_bloco_inicio")


def doc_homonyms(found: DataFrame, function: str) -> DataFrame:
    """The sources that document a function of this name, by name; the first is shown by default."""
    return found.where(F.upper("funcao") == function.upper()).select("arquivo").distinct().orderBy("arquivo")


def undocumented(findings: DataFrame) -> DataFrame:
    return findings.where("regra_id = 'BP-007'").select("arquivo", "funcao", "linha", "snippet").orderBy("arquivo", "linha")


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out
