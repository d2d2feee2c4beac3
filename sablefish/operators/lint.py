"""Quality rules: 22 on a single source and 13 across sources and dictionary.

Single-source rules are array expressions over a source's occurrences, so all of them run in
one projection without a shuffle. Cross rules are joins, anti joins and aggregates over fact and
dictionary tables. Findings: arquivo, funcao, linha, regra_id, severidade, snippet, sugestao_fix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import RESERVED, RESTRICTED
from . import multipattern
from . import relational as R
from .facts import enclosing, of

SEVERITY = {
    "BP-001": "critical", "BP-002": "critical", "BP-002b": "warning", "BP-003": "error", "BP-004": "warning", "BP-005": "warning", "BP-006": "error", "BP-007": "info", "BP-008": "critical",
    "SEC-001": "critical", "SEC-002": "warning", "SEC-003": "warning", "SEC-004": "warning", "SEC-005": "critical", "PERF-001": "warning", "PERF-002": "error", "PERF-003": "error",
    "PERF-004": "warning", "PERF-005": "warning", "PERF-006": "info", "MOD-001": "warning", "MOD-002": "warning", "MOD-003": "info", "MOD-004": "info", "SX-001": "warning", "SX-002": "error",
    "SX-003": "warning", "SX-004": "warning", "SX-005": "warning", "SX-006": "warning", "SX-007": "critical", "SX-008": "warning", "SX-009": "warning", "SX-010": "error", "SX-011": "error",
}
ADVICE = {
    "BP-001": "Release every record lock with MsUnlock.", "BP-002": "Close every transaction.", "BP-002b": "Declare the variable Local.", "BP-003": "Check lMsErroAuto after the call.",
    "BP-004": "Read the MV_PAR variables after a silent question.", "BP-005": "Pass fewer parameters.", "BP-006": "Use one kind of lock in a function.", "BP-007": "Document the function.",
    "BP-008": "Don't redeclare a framework variable.", "SEC-001": "Don't open an environment inside a REST class.", "SEC-002": "Prefix the function's name.", "SEC-003": "Don't log personal data.",
    "SEC-004": "Move the credential out of the source.", "SEC-005": "Don't call a restricted function.", "PERF-001": "Name the columns.", "PERF-002": "Filter deleted rows with %notDel%.",
    "PERF-003": "Filter the branch with %xfilial%.", "PERF-004": "Gather parts in an array.", "PERF-005": "Test Eof() instead of counting.", "PERF-006": "Filter by an indexed column.",
    "MOD-001": "Use FwLogMsg.", "MOD-002": "Don't declare PUBLIC variables.", "MOD-003": "Make the functions a class.", "MOD-004": "Use MVC.",
}

RESTRICTED_NAMES = sorted({x.upper() for x in RESTRICTED})


# Accepted names of user functions.
CLIENT_PREFIX, ENTRY_POINT = r"(?i)^(MGF|MZF|ZZF|ZF|XX|XYZ|CLI)", r"^[A-Z]{2,4}\d{2,4}[A-Z_]*$"
MOST_PARAMETERS, DOC_WINDOW, CHECK_WINDOW, QUESTION_WINDOW = 6, 30, 10, 5


def _q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SCOPES = "IF(size(functions) = 0, array(struct('' AS name, 'file' AS kind, '' AS class, 1 AS start, 2147483647 AS stop)), functions)"
COMMA = _q(r",(?![^({\[]*[)}\]])")


def _lines(kind: str) -> str:
    return f"array_distinct(transform({of(kind)}, f -> f.line))"


def _beyond(opens: str, closes: str) -> str:
    """Opening lines beyond the number of closing ones, in each scope."""
    inside = "filter({0}, l -> l BETWEEN r.start AND r.stop)"
    return f"""flatten(transform({SCOPES}, r -> transform(array(struct(array_sort({inside.format(_lines(opens))}) AS o,
        size(filter({of(closes)}, c -> c.line BETWEEN r.start AND r.stop)) AS n)), x -> slice(x.o, x.n + 1, greatest(size(x.o) - x.n, 0)))[0]))"""


_ERP_SQL = f"exists(f.args, t -> rlike(t, {_q(r'^[SZNQD]\p{L}[\p{L}\p{N}]\d*$')})) AND rlike(f.g[0], {_q(r'(?i)\b(select|update|delete)\b')})"
_SINGLE: dict[str, str] = {
    "BP-001": _beyond("lock_open", "lock_close"),
    "BP-002": _beyond("trans_open", "trans_close"),
    "BP-002b": f"""transform(filter({of('private')}, f -> exists(split(f.g[0], {COMMA}), v -> NOT rlike(trim(v), {_q(r'(?i)^MV_PAR\d{2}')}) AND regexp_extract(trim(v), '^(\\\\w+)', 1) <> ''
        AND NOT array_contains(reserved, upper(regexp_extract(trim(v), '^(\\\\w+)', 1))))), f -> f.line)""",
    "BP-003": f"transform(filter({of('exec_auto_open')}, f -> NOT exists(facts, e -> e.kind = 'error_check' AND e.line BETWEEN f.line AND f.line + {CHECK_WINDOW})), f -> f.line)",
    "BP-004": f"transform(filter({of('question_silent')}, f -> NOT exists(facts, e -> e.kind = 'mv_par' AND e.line BETWEEN f.line AND f.line + {QUESTION_WINDOW})), f -> f.line)",
    "BP-005": f"transform(filter({of('signature')}, f -> trim(f.g[1]) <> '' AND size(split(f.g[1], {COMMA})) > {MOST_PARAMETERS}), f -> f.line)",
    "BP-006": f"transform(filter({SCOPES}, r -> exists(facts, f -> f.kind = 'lock_open' AND f.line BETWEEN r.start AND r.stop) AND exists(facts, f -> f.kind = 'raw_lock' AND f.line BETWEEN r.start AND r.stop)), r -> r.start)",
    "BP-007": f"transform(filter(functions, r -> NOT exists(facts, d -> d.kind = 'doc_open' AND d.line BETWEEN r.start - {DOC_WINDOW} AND r.start - 1)), r -> r.start)",
    "BP-008": f"transform(filter({of('variables')}, f -> exists(split(f.g[1], {COMMA}), v -> array_contains(reserved, upper(regexp_extract(trim(v), '^(\\\\w+)', 1))))), f -> f.line)",
    "SEC-001": f"""transform(filter({of('env_open')}, f -> exists(facts, c -> c.kind = 'rest_class' AND c.start < f.start
        AND NOT exists(facts, e -> e.kind = 'class_end' AND e.start > c.start AND e.start < f.start))), f -> f.line)""",
    "SEC-002": f"transform(filter(functions, r -> r.kind = 'user_function' AND NOT rlike(r.name, {_q(CLIENT_PREFIX)}) AND NOT rlike(upper(r.name), {_q(ENTRY_POINT)})), r -> r.start)",
    "SEC-003": f"transform({of('personal')}, f -> f.line)",
    "SEC-004": f"transform({of('credential')}, f -> f.line)",
    "SEC-005": f"""array_distinct(transform(filter({of('any_call')}, f -> array_contains(restricted, upper(f.g[0])) AND NOT exists(functions, r -> upper(r.name) = upper(f.g[0]))
        AND NOT exists(facts, d -> d.kind IN ('function', 'method', 'signature') AND d.line = f.line AND d.start <= f.start AND f.start < d.stop)), f -> struct(f.line AS line, upper(f.g[0]) AS name)))""",
    "PERF-001": f"transform(filter({of('sql')}, f -> rlike(f.g[0], {_q(r'(?i)\bSELECT\s+\*')})), f -> f.line)",
    "PERF-002": f"transform(filter({of('sql')}, f -> {_ERP_SQL} AND NOT rlike(f.g[0], '(?i)%notDel%')), f -> f.line)",
    "PERF-003": f"transform(filter({of('sql')}, f -> {_ERP_SQL} AND NOT rlike(f.g[0], {_q(r'(?i)%xfilial[^%]*%')})), f -> f.line)",
    "PERF-004": f"array_distinct(transform(filter({of('concat')}, f -> exists(facts, l -> l.kind = 'loop' AND f.line > l.line AND f.line < l.stop)), f -> f.line))",
    "PERF-005": f"transform({of('count_check')}, f -> f.line)",
    "MOD-001": f"transform({of('log_console')}, f -> f.line)",
    "MOD-002": f"transform({of('public')}, f -> f.line)",
    "MOD-004": f"transform(filter({of('legacy_ui')}, f -> NOT exists(facts, d -> d.kind = 'function' AND d.line = f.line)), f -> f.line)",
}
SINGLE_RULES = tuple(_SINGLE)


def advice(rule: str) -> str:
    return ADVICE.get(rule, "Mend the dictionary entry.")


def lint_sources(sources: DataFrame, alternatives: dict[str, str] | None = None) -> DataFrame:
    """The findings of all single-source rules; ``alternatives`` are what to use in place of restricted functions, by name.

    A restricted function gives one finding a line and name. Catalog names that no call can have (with blanks, brackets, slashes) match nothing.
    """
    reserved = F.array(*[F.lit(x.upper()) for x in RESERVED])
    restricted = F.array(*[F.lit(x) for x in RESTRICTED_NAMES])
    rows = sources.select("arquivo", "text", "functions", "facts", reserved.alias("reserved"), restricted.alias("restricted"))
    one = "struct('{0}' AS rule, '{1}' AS severity, {2} AS line, {3} AS name)"
    every = ", ".join(
        f"transform({sql}, l -> {one.format(rule, SEVERITY[rule], *(('l.line', 'l.name') if rule == 'SEC-005' else ('l', 'CAST(NULL AS STRING)')))})" for rule, sql in _SINGLE.items()
    )
    found = rows.selectExpr("arquivo", "functions", "split(text, '\\n') AS lines", f"explode(flatten(array({every}))) AS x")
    fix = F.create_map(*[F.lit(v) for r in _SINGLE for v in (r, advice(r))])
    out = found.selectExpr(
        "arquivo", f"{enclosing('x.line')} AS funcao", "x.line AS linha", "x.rule AS regra_id", "x.severity AS severidade", "substring(trim(lines[x.line - 1]), 1, 200) AS snippet", "x.name AS name"
    )
    other = F.create_map(*[F.lit(v) for k, a in (alternatives or {"": ""}).items() for v in (k.upper(), a)])
    other = F.try_element_at(other, F.coalesce("name", F.lit("")))
    fix = F.concat(F.try_element_at(fix, F.col("regra_id")), F.when(F.col("name").isNotNull(), F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise(""), F.when(other != "", F.concat(F.lit(" Use instead: "), other)).otherwise(""))
    return out.withColumns({"snippet": R.redact(F.col("snippet")), "sugestao_fix": fix}).drop("name")


# Across tables


def _found(df: DataFrame, rule: str, table: str | Column, name: Column, snippet: Column) -> DataFrame:
    place = F.concat(F.lit("SX:"), F.lit(table) if isinstance(table, str) else table)
    return df.select(
        place.alias("arquivo"), name.alias("funcao"), F.lit(0).alias("linha"), F.lit(rule).alias("regra_id"), F.lit(SEVERITY[rule]).alias("severidade"),
        F.substring(snippet, 1, 500).alias("snippet"), F.lit(advice(rule)).alias("sugestao_fix"),
    )


def _expressions(campos: DataFrame) -> DataFrame:
    """Each field's expressions, one a row."""
    return campos.select("tabela", "campo", F.explode(F.array("validacao", "vlduser", "when_expr", "inicializador")).alias("expr")).where("expr <> ''")


def sx001(campos: DataFrame, functions: DataFrame) -> DataFrame:
    """User functions called in a field's expressions that no source has; the first of each field."""
    called = _expressions(campos).select("tabela", "campo", "expr", F.explode(F.regexp_extract_all(F.upper("expr"), F.lit(r"\bU_([A-Z][A-Z0-9_]{1,30})\b"), F.lit(1))).alias("name"))
    known = functions.select(R.normalized_name("nome").alias("name")).distinct()
    missing = called.join(known, "name", "left_anti").groupBy("tabela", "campo").agg(F.min(F.struct("name", "expr")).alias("m"))
    return _found(missing, "SX-001", F.col("tabela"), F.col("campo"), F.col("m.expr"))


def sx002(gatilhos: DataFrame, campos: DataFrame) -> DataFrame:
    rows = R.missing_target(gatilhos.where("campo_destino <> ''"), "campo_destino", campos, "campo")
    return _found(rows, "SX-002", "SX7", F.concat("campo_origem", F.lit("#"), "sequencia"), F.concat("campo_origem", F.lit(" -> "), "campo_destino"))


def sx003(parametros: DataFrame, used: DataFrame) -> DataFrame:
    rows = R.unused(parametros.where("custom"), used, "variavel", "parametro")
    return _found(rows, "SX-003", "SX6", F.col("variavel"), F.col("descricao"))


def sx004(perguntas: DataFrame, used: DataFrame) -> DataFrame:
    rows = R.unused(perguntas.select("grupo").distinct(), used, "grupo")
    return _found(rows, "SX-004", "SX1", F.col("grupo"), F.col("grupo"))


def sx005(campos: DataFrame, chunks: DataFrame, gatilhos: DataFrame) -> DataFrame:
    """Custom fields whose name occurs nowhere, ignoring case; a name inside a longer word counts as used. One pass over the texts for all names."""
    custom = campos.where("custom").select("tabela", "campo", "titulo", F.upper("campo").alias("name")).distinct()
    texts = chunks.select(F.upper("content").alias("t"))
    texts = texts.unionByName(_expressions(campos).select(F.upper("expr").alias("t")))
    texts = texts.unionByName(gatilhos.select(F.upper(F.concat_ws(" ", "regra", "condicao", "chave")).alias("t")))
    rows = custom.join(multipattern.found_needles(custom, "name", texts, "t"), "name", "left_anti")
    return _found(rows, "SX-005", F.col("tabela"), F.col("campo"), F.col("titulo"))


def sx006(campos: DataFrame) -> DataFrame:
    rows = campos.where(F.concat_ws(" ", "validacao", "vlduser").rlike(r"(?i)\b(?:BeginSql|TCQuery|TCSqlExec|MPSysOpenQuery)\b"))
    return _found(rows, "SX-006", F.col("tabela"), F.col("campo"), F.concat_ws(" ", "validacao", "vlduser"))


def sx007(campos: DataFrame, restricted: DataFrame) -> DataFrame:
    """Restricted functions in a field's expressions; the first of each field."""
    called = _expressions(campos).select("tabela", "campo", "expr", F.explode(F.regexp_extract_all(F.upper("expr"), F.lit(r"\b([A-Z_]\w*)\s*\("), F.lit(1))).alias("name"))
    # the catalog is as large as its owner makes it: its size on disk or after the exchange decides how it is joined
    hit = called.join(restricted.select(F.upper("nome").alias("name")).distinct(), "name", "left_semi").groupBy("tabela", "campo").agg(F.min(F.struct("name", "expr")).alias("m"))
    return _found(hit, "SX-007", F.col("tabela"), F.col("campo"), F.col("m.expr"))


def sx008(campos: DataFrame, tabelas: DataFrame) -> DataFrame:
    """Branch macros in validations of shared tables."""
    shared = tabelas.where("modo = 'C'").select(F.col("codigo").alias("tabela"))
    rows = campos.where(F.concat_ws(" ", "validacao", "vlduser").rlike(r"(?i)\bxFilial\b")).join(shared, "tabela")
    return _found(rows, "SX-008", F.col("tabela"), F.col("campo"), F.concat_ws(" ", "validacao", "vlduser"))


# What an initialiser may be that leaves a field empty.
EMPTY = "(?i)" + "|".join(
    (
        r"([\"'])\s*\1",  # an empty text
        r"\bSpace\s*\(\s*\d+\s*\)",
        r"\bCToD\s*\(\s*[\"']\s*[\"']\s*\)",
        r"\bNil\b",
        r"(?<!\w)\.F\.(?!\w)",
        r"\b0\s*$",
    )
)


def sx009(campos: DataFrame) -> DataFrame:
    rows = campos.where("obrigatorio AND inicializador <> ''").where(F.col("inicializador").rlike(EMPTY))
    return _found(rows, "SX-009", F.col("tabela"), F.col("campo"), F.col("inicializador"))


def sx010(gatilhos: DataFrame) -> DataFrame:
    rows = gatilhos.where("upper(tipo) = 'P' AND upper(seek) NOT IN ('S', '1', '.T.')")
    return _found(rows, "SX-010", "SX7", F.concat("campo_origem", F.lit("#"), "sequencia"), F.col("regra"))


def sx011(campos: DataFrame, consultas: DataFrame, tabelas: DataFrame | None = None) -> DataFrame:
    rows = R.missing_target(campos.where("f3 <> ''"), "f3", consultas, "alias")
    return _found(rows, "SX-011", F.col("tabela"), F.col("campo"), F.col("f3"))


def mod003(functions: DataFrame) -> DataFrame:
    """Static functions of a source with a common prefix."""
    rows = R.prefix_groups(functions.where("kind = 'static_function'"), "arquivo", "nome", "linha_inicio")
    return rows.select(
        "arquivo", F.lit("").alias("funcao"), F.col("first_line").alias("linha"), F.lit("MOD-003").alias("regra_id"), F.lit(SEVERITY["MOD-003"]).alias("severidade"),
        F.concat("prefix", F.lit(": "), F.concat_ws(", ", "names")).alias("snippet"), F.lit(advice("MOD-003")).alias("sugestao_fix"),
    )


PSEUDO_COLUMNS = ("D_E_L_E_T_", "R_E_C_N_O_", "R_E_C_D_E_L_")  # fixed values


#: What a field's name looks like.
FIELD = r"^[A-Z][A-Z0-9]{1,2}_[A-Z]\w*$"


def filter_columns(sql: Column) -> Column:
    """The names of fields behind WHERE, up to GROUP or HAVING, and behind ORDER, from a statement's words in their order."""
    words = F.regexp_extract_all(F.upper(sql), F.lit(r"\w+"), F.lit(0))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, word: Column) -> Column:
        on = F.when(word.isin("WHERE", "ORDER"), True).when(word.isin("GROUP", "HAVING"), False).otherwise(state["on"])
        return F.struct(on.alias("on"), F.when(state["on"] & word.rlike(FIELD), F.array_append(state["names"], word)).otherwise(state["names"]).alias("names"))

    return F.array_distinct(F.aggregate(words, start, step)["names"])


def perf006(sql: DataFrame, indices: DataFrame) -> DataFrame:
    """Columns in WHERE or ORDER BY that no index of their tables has; tables are those with an index column of the prefix."""
    used = sql.where("operacao = 'select'").select("arquivo", "funcao", "linha", F.explode(filter_columns(F.col("snippet"))).alias("col"))
    used = used.where(~F.col("col").isin(*PSEUDO_COLUMNS) & ~F.col("col").endswith("_FILIAL")).withColumn("prefix", F.substring_index("col", "_", 1))
    words = F.regexp_extract_all(F.upper("chave"), F.lit(r"\w+"), F.lit(0))
    own = indices.select("tabela", F.explode(F.filter(words, lambda w: w.rlike(FIELD))).alias("icol"))
    columns = own.select("icol").distinct()
    owners = own.groupBy(F.substring_index("icol", "_", 1).alias("prefix")).agg(F.min("tabela").alias("tabela"))
    rows = used.join(owners, "prefix").join(columns, F.col("col") == F.col("icol"), "left_anti").distinct()
    return rows.select(
        "arquivo", "funcao", "linha", F.lit("PERF-006").alias("regra_id"), F.lit(SEVERITY["PERF-006"]).alias("severidade"), F.concat("tabela", F.lit("."), "col").alias("snippet"), F.lit(advice("PERF-006")).alias("sugestao_fix")
    )


def cross_rules(tables: dict[str, DataFrame], sources: dict[str, DataFrame], restricted: DataFrame) -> DataFrame:
    """All cross rules whose tables are there; a missing dictionary skips its rules, any other error surfaces."""
    t, s = tables, sources
    rules = [
        (("campos",), lambda: sx001(t["campos"], s["functions"])), (("gatilhos", "campos"), lambda: sx002(t["gatilhos"], t["campos"])), (("parametros",), lambda: sx003(t["parametros"], s["parameters"])),
        (("perguntas",), lambda: sx004(t["perguntas"], s["questions"])), (("campos", "gatilhos"), lambda: sx005(t["campos"], s["chunks"], t["gatilhos"])), (("campos",), lambda: sx006(t["campos"])),
        (("campos",), lambda: sx007(t["campos"], restricted)), (("campos", "tabelas"), lambda: sx008(t["campos"], t["tabelas"])), (("campos",), lambda: sx009(t["campos"])),
        (("gatilhos",), lambda: sx010(t["gatilhos"])), (("campos", "consultas"), lambda: sx011(t["campos"], t["consultas"])), ((), lambda: mod003(s["functions"])), (("indices",), lambda: perf006(s["sql"], t["indices"])),
    ]
    found = [rule() for needed, rule in rules if all(n in t for n in needed)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with what the rule catalog says of their rule; the catalog has a row a rule."""
    known = rules.select("regra_id", F.col("categoria").alias("categoria"), F.col("fix_guidance").alias("fix_guidance"), "cross_file")
    return findings.join(known, "regra_id").orderBy("arquivo", "linha", "regra_id")


def persist(existing: DataFrame, fresh: DataFrame, rules: list[str]) -> DataFrame:
    """Stored findings with those of some rules replaced."""
    return existing.where(~F.col("regra_id").isin(rules)).unionByName(fresh.withColumn("snippet", F.substring("snippet", 1, 500)))
