"""Extraction: sources to an array of found occurrences, and fact tables from these.

One Arrow pass over the sources turns each into tokens (``functions.scanner``) and runs a catalog of
rules over them; it gives each source an array of occurrences (kind, line, offsets, what the rule keeps and, for
calls, the arguments). Everything after that (functions and their ranges, calls, tables,
parameters, endpoints, SQL, triggers, doc blocks, capabilities, lint) is array expressions
over a row or relational operators, without another look at Python.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as T
from ..functions import sql_names
from ..functions.charset import Model
from ..functions.fixed import OPERATIONS, ROUTINES
from ..functions.personal import names_a_person
from ..functions.scanner import Rule, Scanner, Shape
from . import relational as R

OCCURRENCE = "struct<kind:string,line:int,start:int,stop:int,g:array<string>,args:array<string>>"


def _word(s: str) -> bool:
    return bool(s) and s.replace("_", "a").isalnum()


def _when(test) -> Shape:
    return lambda s: s if test(s) else None


def _plain(s: str) -> bool:
    """No quote of the other kind inside."""
    return '"' not in s and "'" not in s


def _table_name(s: str) -> bool:
    return len(s) == 3 and s[0].upper() in "SZQND" and s[1].isascii() and s[1].isalpha() and s[2].isascii() and s[2].isalnum()


def _field_name(s: str) -> bool:
    return len(s) > 3 and s[0].isalpha() and s[1].isalnum() and s[2] == "_" and s.isascii()


def _numbered(prefix: str) -> Shape:
    return _when(lambda s: s.upper().startswith(prefix) and s[len(prefix) :].isdigit())


#: Shapes of names and of strings' contents.
SHAPES: dict[str, Shape] = {
    "name": _when(lambda s: True), "word": _when(_word), "ident": _when(lambda s: not s[0].isdigit()), "alias": _when(lambda s: _word(s) and 2 <= len(s) <= 3), "alias7": _when(lambda s: _word(s) and 2 <= len(s) <= 7),
    "table": _when(_table_name), "field": _when(_field_name), "any": _when(lambda s: bool(s) and _plain(s)), "any0": _when(_plain), "start": lambda s: s.replace("'", '"').partition('"')[0] or None, "pr": _when(lambda s: s.upper() in ("P", "R")),
    "mv": _when(lambda s: s.upper().startswith("MV_") and len(s) > 3 and _word(s)), "mvpar": _numbered("MV_PAR"), "mvrel": _when(lambda s: s.upper().startswith("MV_REL") and s[6:].isalpha()),
    "user": lambda s: s[2:] if s[:2].upper() == "U_" and len(s) > 2 else None, "text": _when(lambda s: s[:1] == "c" and s[1:2].isupper() and s.isascii()),
    "endws": lambda s: s[3:] if s.upper() in ("ENDWSSTRUCT", "ENDWSSERVICE", "ENDWSRESTFUL") else None, "pair": _when(lambda s: _plain(s) and 0 < s.find(":") < len(s) - 1 and s.count(":") == 1),
}

# The language's words.
READERS = "DbSelectArea|xFilial|FwxFilial|Posicione|MsSeek|dbSetOrder|ChkFile"
GETTERS = "SuperGetMV|GetMv|GetNewPar|GetMVDef|FWMVPar"
HOOKS = "bCommit|bCancel|bTudoOk|bLineOk|bPosVld|bPreVld|bWhen|bValid|bLoad"
VERBS = "GET|POST|PUT|DELETE"
SCOPE = "[ <Static|User|Main> ] Function"

#: Constructs that count as facts: kind, where they are sought (``code``, or ``text``: inside strings too), steps.
CATALOG = rf"""
function         code  ^ {SCOPE} $name
signature        code  ^ [ Static|User|Main ] Function $name ()
declaration      code  ^ [ Static|User|Main ] Function $name (
declaration      code  ^ Method $name (
method           code  ^ Method $name () Class $name
ws_method        code  ^ WsMethod [ <{VERBS}> ] $name WsReceive|WsSend|WsService
include          text  ^ \# Include 'any'
define           text  ^ \# Define $name *rest
namespace        code  ^ Namespace $dotted

table_read       text  {READERS} ( 'alias'
table_read       code  $table ->
table_lock       text  RecLock ( 'alias'
table_lock       code  $alias -> ( RecLock
table_write      code  $alias -> ( dbAppend|dbDelete
field            code  &alias -> $field
field            code  Replace $field

param_read       text  {GETTERS} ( 'mv' , 'any0' )
param_read/third text  {GETTERS} ( 'mv' , ~arg , 'any0'
param_read       text  {GETTERS} ( 'mv'
param_write      text  PutMV|PutMvFil ( 'mv'
question         text  Pergunte|FWGetSX1 ( 'word'

call_user_func   code  $user (
call_execauto    code  MsExecAuto ( {{ | ~| $name (
call_execblock   text  ExecBlock ( 'word'
call_fwloadmodel text  FWLoadModel ( 'word'
call_fwexecview  text  FWExecView ( ~arg , 'word'
call_method      code  $member (
call_method      code  $self (
call_mvc_hook    code  <{HOOKS}> :=
call_mvc_hook    code  <{HOOKS}> =

rest_classic     text  ^ WsMethod <{VERBS}|PATCH> $name WsService $name
rest_bare        text  ^ WsMethod <{VERBS}|PATCH> WsService $name
rest_annotation  text  ^ @ <{VERBS}|PATCH> ( 'any'
http             text  <HttpPost|HttpGet|HttpsPost|HttpsGet|MsAGetUrl> ( 'start'
ws_struct        text  ^ WsStruct $name
ws_service       text  ^ WsService $name
ws_restful       text  ^ WsRestful $name
ws_end           text  ^ End <WsStruct|WsService|WsRestful>
ws_end           text  ^ $endws
ws_data          text  ^ WsData $name As $name
ws_member        text  ^ WsMethod $name
ws_full          text  WsMethod $name WsReceive $name WsSend $name WsService $name

sql              text  BeginSql [ Alias % ] +EndSql
sql              text  TCQuery|TCSqlExec ( 'start'

has_browse       text  FWFormBrowse|FWBrowse
has_dialog       text  MsDialog|TDialog|FwDialogModal
has_modeldef     text  ModelDef|ViewDef
has_schedule     text  FWSchedule|StartSchedTask
has_workflow     text  WFPrepEnv|MsWorkflow|MailAuto
has_webview      text  TWebEngine|TWebChannel
has_report       text  TReport ( ) : New
has_report       text  oReport : Print
has_upd_var      text  __cUpdName
has_unit_test    text  @ Test
has_unit_test    text  tlpp . unit
has_json         text  JsonObject ( ) : New
has_json         text  FWJsonSerialize|FWJsonDeserialize
has_multi_filial text  xFilial|FwxFilial|cFilAnt|cEmpAnt
paramixb         code  PARAMIXB \[

wf_process       text  TWFProcess ( ) : New ( 'any0' [ , 'any0' ]
wf_legacy        text  MsWorkflow (
wf_prepenv       text  WFPrepEnv (
wf_callback      text  : <bReturn|bTimeOut> := {{ | ~| $ident (
wf_task          text  : NewTask ( 'any0' , 'any0'
wf_to            text  : cTo := 'any0'
wf_subject       text  : cSubject := 'any0'
schedule         text  ^ Static Function SchedDef ( )
schedule_array   text  {{ 'pr' , 'any0' , 'any0' , {{}} , 'any0' }}
job_main         text  ^ Main Function $name (
job_no_licence   text  RpcSetType ( 3 )
job_sleep        text  Sleep ( # [ \* # ] )
job_stop         text  File ( 'any0' )
mail_auto        text  MailAuto (
mail_udc         text  ^ Send Mail
mail_message     text  TMailMessage (
mail_manager     text  TMailManager (
mail_attach      text  Attachment
mail_attach      text  : AttachFile (
mail_mv_rel      text  $mvrel

lock_open        code  RecLock ( 'alias7'
lock_open        code  RecLock ( $ident ,
lock_open        code  RecLock ( $ident )
lock_open        code  $alias7 -> ( RecLock
lock_close       code  MsUnlock (
trans_open       code  Begin Transaction
trans_close      code  End Transaction
exec_auto_open   code  MsExecAuto (
error_check      code  lMsErroAuto
question_silent  text  Pergunte ( 'word' , .F. )
mv_par           code  $mvpar
raw_lock         code  DbRLock (
raw_lock         code  dbAppend ( )
rest_class       code  ^ Class $name From WsRestful
class_end        code  ^ End Class
class_end        code  ^ EndClass
credential       text  RpcSetEnv ( % , % , 'any' , 'any'
credential       text  Prepare Environment ~Password 'any'
credential       text  SMTPAuth|MailAuth ( 'any' , 'any'
credential       text  Encode64 ( 'pair'
private          code  ^ Private *rest
public           code  ^ Public $word
variables        code  ^ <Local|Static|Private|Public> *rest
legacy_ui        code  !member <AxCadastro|Modelo2|Modelo3|MsNewGetDados> (
any_call         code  !member $ident (
concat           code  $text +=
concat           code  $text := $same +
"""
CATALOG += "".join(f"count_check code RecCount|LastRec ( ) {close} {test}\n" for close in ("", ")") for test in ("> 0", ">= 1", "!= 0", "<> 0"))
#: Calls whose arguments are kept.
CALLS = """
env_open         text  RpcSetEnv (
log_message      text  FwLogMsg (
log_console      text  ConOut (
log_any          text  ConOut|FwLogMsg|MsgLog|LogMsg|UserException (
exec_auto        code  MsExecAuto|ExecAuto (
"""


def _rules(lines: str, arguments: bool) -> list[Rule]:
    parts = [x.split(None, 2) for x in lines.splitlines() if x]
    return [Rule(kind, where == "text", steps, SHAPES, arguments) for kind, where, steps in parts]


@cache
def scanner(kinds: frozenset[str] | None = None) -> Scanner:
    """The scanner of all rules, or of those that find some kinds."""
    return Scanner([r for r in _rules(CATALOG, False) + _rules(CALLS, True) if kinds is None or r.family in kinds or (r.family == "log_any" and "personal" in kinds)])


DOC_OPEN, DOC_NAME = "/*/", "protheus.doc"


def _docs(text: str) -> Iterator[tuple[int, int, str, str | None]]:
    """Start, stop, id and body of each documentation block; body None where it isn't closed by a line of its own."""
    at = text.find(DOC_OPEN)
    while at >= 0:
        brace = at + 3 + len(text[at + 3 :]) - len(text[at + 3 :].lstrip())
        close = text.find("}", brace) if text[brace : brace + 1] == "{" else -1
        stop = at + 3
        if close >= 0 and text[brace + 1 : close].strip().lower() == DOC_NAME:
            name_end = name = close + 1 + len(text[close + 1 :]) - len(text[close + 1 :].lstrip(" \t"))
            while name_end < len(text) and (_word(text[name_end]) or text[name_end] == ":"):
                name_end += 1
            end, stop = text.find(DOC_OPEN, name_end), close + 1
            while end >= 0 and text[text.rfind("\n", 0, end) + 1 : (text + "\n").find("\n", end)].strip(" \t") != DOC_OPEN:
                end = text.find(DOC_OPEN, end + 1)
            if end >= 0:
                stop = end + 3
            yield at, stop, text[name:name_end], text[name_end : text.rfind("\n", 0, end) + 1] if end >= 0 else None
        at = text.find(DOC_OPEN, stop)


#: An occurrence: kind, line, start, stop, what is kept, arguments.
Occurrence = tuple[str, int, int, int, list[str], list[str] | None]


def occurrences(text: str) -> tuple[str, str, list[dict]]:
    """The text without comments and strings, without comments only, and all occurrences by place."""
    strict, keep, found = _occurrences(text)
    return strict, keep, [dict(zip(("kind", "line", "start", "stop", "g", "args"), f, strict=True)) for f in found]


def _occurrences(text: str, kinds: frozenset[str] | None = None) -> tuple[str, str, list[Occurrence]]:
    """As ``occurrences``, all or those of some kinds."""
    strict, keep = T.blank(text), T.blank(text, strings=False)
    newlines = [at for at, c in enumerate(text) if c == "\n"]
    found = []

    def add(kind: str, line: int, start: int, stop: int, kept: list[str], args: list[str] | None = None) -> None:
        if kinds is None or kind in kinds:
            found.append((kind, line, start, stop, kept, args))

    for rule, line, start, stop, kept in scanner(kinds).find(text, strict, keep):
        if not rule.arguments:
            if rule.family == "param_read":
                # its default is in the second or the third place
                kept = [kept[0], "", kept[1]] if rule.kind != rule.family else [*kept, *[""] * (3 - len(kept))]
            add(rule.family, line, start, stop, kept, sql_names.tables(kept[0]) if rule.kind == "sql" else None)
            continue
        inner = T.call_arguments(keep if rule.inside else strict, stop)
        if inner is not None:
            args = T.split_arguments(inner[0])
            add(rule.kind, line, start, inner[1], kept, args)
            if rule.kind == "log_any" and names_a_person(", ".join(args)):
                add("personal", line, start, inner[1], [])
        elif rule.kind == "log_console":
            add(rule.kind, line, start, stop, kept, [])
    for start, stop, name, body in _docs(text) if kinds is None or kinds & {"doc", "doc_open"} else ():
        line = bisect_left(newlines, start) + 1
        add("doc_open", line, start, stop, [])
        if body is not None:
            add("doc", line, start, stop, [name, body])
    for first, last in T.loops(strict) if kinds is None or "loop" in kinds else ():
        add("loop", first, first, last, [])
    found.sort(key=lambda f: f[2])
    return strict, keep, found


def _lists(values: list[list | None]) -> pa.Array:
    """Lists of strings; a list that is None is null."""
    ends, total = [0], 0
    for v in values:
        total += len(v) if v else 0
        ends.append(total)
    nulls = pa.array([v is None for v in values]) if None in values else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values if v for x in v], pa.string()), mask=nulls)


def _column(found: list[list[Occurrence]]) -> pa.Array:
    """The occurrences of some sources, column by column."""
    ends, total = [0], 0
    for rows in found:
        total += len(rows)
        ends.append(total)
    kind, line, start, stop, kept, args = zip(*(f for rows in found for f in rows), strict=True) if total else ((),) * 6
    fields = [pa.array(kind, pa.string()), pa.array(line, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), _lists(list(kept)), _lists(list(args))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "line", "start", "stop", "g", "args"]))


#: Sources that are read at once at most, and their bytes: what a Python worker holds stays the same however many there are.
BLOCK_SOURCES, BLOCK_BYTES = 256, 4 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column("content")]
        first = total = 0
        for at, size in enumerate(sizes):
            if at > first and (at - first == BLOCK_SOURCES or total + size > BLOCK_BYTES):
                yield batch.slice(first, at - first)
                first, total = at, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first)


#: What the ranges of functions are made of, which all scans find.
FUNCTION_KINDS = frozenset({"function", "ws_method", "method", "rest_bare"})


def scan_sources(files: DataFrame, charsets: Model | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """``files`` (arquivo, caminho_relativo, content as binary, ...) with text, encoding and occurrences.

    A source that can't be read gets its error and no occurrences; it never fails the job. Bytes that aren't UTF-8 are cp1252 where they can be, or what ``charsets`` finds likeliest.
    Where only some kinds of occurrences are asked for (``KINDS`` has those of each fact table), the rules for others aren't run.
    """
    detect = charsets.detect if charsets is not None else None
    wanted = None if kinds is None else frozenset(kinds) | FUNCTION_KINDS
    names = [c for c in files.columns if c != "content"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in _blocks(batches):
            texts, encodings, hashes, found, errors = [], [], [], [], []
            for value in batch.column("content"):
                raw = value.as_py() or b""
                hashes.append(hashlib.sha1(raw).hexdigest())
                try:
                    text, encoding = T.decode(raw, detect)
                    rows, error = _occurrences(text, wanted)[2], None
                except Exception as e:  # noqa: BLE001 - one bad source is a row, not a failure
                    text, encoding, rows, error = "", "", [], f"{type(e).__name__}: {e}"
                texts.append(text)
                encodings.append(encoding)
                found.append(rows)
                errors.append(error)
            columns = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(encodings, pa.string()), pa.array(hashes, pa.string()), _column(found), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "encoding", "hash", "facts", "error"])

    out = files.mapInArrow(run, f"{kept}, text string, encoding string, hash string, facts array<{OCCURRENCE}>, error string")
    return out.withColumn("functions", F.expr(FUNCTIONS))


def of(*kinds: str) -> str:
    """SQL for a row's occurrences of some kinds."""
    return f"filter(facts, f -> f.kind IN ({', '.join(repr(k) for k in kinds)}))"


TOTAL_LINES = "(size(split(text, '\\n')) - IF(text LIKE '%\\n', 1, 0))"
# A verb alone is named after its class. Ranges end before the next function.
_NAMED = f"""transform({of('function', 'ws_method', 'method')}, f -> struct(
    CASE WHEN f.kind = 'ws_method' AND exists(facts, b -> b.kind = 'rest_bare' AND b.start = f.start)
         THEN filter(facts, b -> b.kind = 'rest_bare' AND b.start = f.start)[0].g[1] || '.' || upper(filter(facts, b -> b.kind = 'rest_bare' AND b.start = f.start)[0].g[0])
         WHEN f.kind = 'method' THEN f.g[0] ELSE f.g[1] END AS name,
    CASE WHEN f.kind <> 'function' THEN f.kind WHEN f.g[0] = '' THEN 'function' ELSE lower(f.g[0]) || '_function' END AS kind,
    CASE WHEN f.kind = 'method' THEN f.g[1] WHEN f.kind = 'ws_method' AND exists(facts, b -> b.kind = 'rest_bare' AND b.start = f.start)
         THEN filter(facts, b -> b.kind = 'rest_bare' AND b.start = f.start)[0].g[1] ELSE '' END AS class,
    f.line AS start))"""
FUNCTIONS = f"""transform(array({_NAMED}), n -> transform(n, (f, i) -> struct(f.name AS name, f.kind AS kind, f.class AS class, f.start AS start,
    IF(i + 1 < size(n), greatest(f.start, n[i + 1].start - 1), {TOTAL_LINES}) AS stop)))[0]"""


def enclosing(line: str) -> str:
    """SQL for the name of the smallest function range around a line (the first of equals), or nothing."""
    return f"""coalesce(array_min(transform(filter(functions, r -> r.start <= {line} AND {line} <= r.stop),
        (r, i) -> struct(r.stop - r.start AS w, i AS i, r.name AS name))).name, '')"""


def exploded(sources: DataFrame, *kinds: str) -> DataFrame:
    """arquivo, pos and f for each occurrence of some kinds."""
    return sources.selectExpr("arquivo", "text", "functions", f"posexplode({of(*kinds)}) AS (pos, f)")


def valid_table(column: Column) -> Column:
    return column.rlike(r"^[SZNQD]\p{L}.$")


# Fact tables


def functions(sources: DataFrame) -> DataFrame:
    rows = sources.selectExpr("arquivo", "explode(functions) AS f")
    return rows.selectExpr("arquivo", "f.name AS nome", "f.kind AS kind", "f.class AS classe", "f.start AS linha_inicio", "f.stop AS linha_fim")


def chunks(sources: DataFrame, with_content: bool = True) -> DataFrame:
    rows = sources.selectExpr("arquivo", "split(text, '\\n') AS lines", "explode(functions) AS f").where("f.kind <> 'mvc_hook'")
    content = "array_join(slice(lines, f.start, greatest(0, f.stop - f.start + 1)), '\\n')" if with_content else "''"
    out = rows.selectExpr(
        "concat(arquivo, '::', f.name, '@', f.start) AS id", "arquivo", "f.name AS funcao", "upper(f.name) AS funcao_norm", "f.kind AS tipo_simbolo", "f.class AS classe", "f.start AS linha_inicio",
        "f.stop AS linha_fim", "substring(trim(lines[f.start - 1]), 1, 500) AS assinatura", f"{content} AS content", "'' AS modulo",
    )
    return out.withColumn("content", R.redact(F.col("content")))


CALL_KINDS = ("call_user_func", "call_execauto", "call_execblock", "call_fwloadmodel", "call_fwexecview", "call_method", "call_mvc_hook")
_HOOKS = ("bCommit", "bCancel", "bTudoOk", "bLineOk", "bPosVld", "bPreVld", "bWhen", "bValid", "bLoad")


def calls(sources: DataFrame) -> DataFrame:
    """The call graph's edges with the function each lies in."""
    rows = exploded(sources, *CALL_KINDS).selectExpr("arquivo", "f", "text", f"{enclosing('f.line')} AS funcao_origem")
    hooks = F.create_map(*[F.lit(x) for h in _HOOKS for x in (h.lower(), h)])
    kind = F.regexp_replace("f.kind", "^call_", "")
    target = F.when(kind == "mvc_hook", F.try_element_at(hooks, F.lower(F.col("f.g")[0]))).when(kind == "method", F.col("f.g")[0]).otherwise(F.upper(F.col("f.g")[0]))
    context = F.substring(F.substr(F.col("text"), F.greatest(F.lit(1), F.col("f.start") - 29), F.col("f.stop") - F.col("f.start") + 60), 1, 200)
    return rows.select(
        F.col("arquivo").alias("arquivo_origem"), "funcao_origem", F.col("f.line").alias("linha_origem"), kind.alias("tipo"), target.alias("destino"),
        R.normalized_name(target).alias("destino_norm"), R.redact(context).alias("contexto"),
    )


def tables(sources: DataFrame) -> DataFrame:
    """arquivo, tabela and modo (read, write, reclock; a lock is a write too)."""
    modes = F.when(F.col("f.kind") == "table_read", F.array(F.lit("read"))).when(F.col("f.kind") == "table_lock", F.array(F.lit("reclock"), F.lit("write"))).otherwise(F.array(F.lit("write")))
    rows = exploded(sources, "table_read", "table_lock", "table_write").select("arquivo", F.upper(F.col("f.g")[0]).alias("tabela"), F.explode(modes).alias("modo"))
    return rows.where(valid_table(F.col("tabela"))).distinct()


def parameters(sources: DataFrame) -> DataFrame:
    """Parameters of each source: how they are used and their first default."""
    read = F.col("f.kind") == "param_read"
    default = F.when(read, F.when(F.col("f.g")[1] != "", F.col("f.g")[1]).otherwise(F.col("f.g")[2]))
    rows = exploded(sources, "param_read", "param_write").groupBy("arquivo", F.upper(F.col("f.g")[0]).alias("parametro")).agg(
        F.bool_or(read).alias("r"), F.bool_or(~read).alias("w"), R.first_filled(default, F.col("f.start")).alias("d")
    )
    mode = F.when(F.col("r") & F.col("w"), "read_write").when(F.col("w"), "write").otherwise("read")
    return rows.select("arquivo", "parametro", mode.alias("modo"), F.coalesce("d", F.lit("")).alias("default_decl"))


def _distinct(sources: DataFrame, kind: str, name: str, upper: bool = True) -> DataFrame:
    value = F.col("f.g")[0]
    return exploded(sources, kind).select("arquivo", (F.upper(value) if upper else value).alias(name)).distinct()


def questions(sources: DataFrame) -> DataFrame:
    return _distinct(sources, "question", "grupo")


def includes(sources: DataFrame) -> DataFrame:
    return _distinct(sources, "include", "include", upper=False)


def fields(sources: DataFrame) -> DataFrame:
    return _distinct(sources, "field", "campo")


def endpoints(sources: DataFrame) -> DataFrame:
    """REST endpoints of three styles; a bare one is left out where a classic one of its class, verb and line is."""
    # told within the source's row, so that sources are read once
    same = "exists(facts, c -> c.kind = 'rest_classic' AND c.g[2] = f.g[1] AND upper(c.g[0]) = upper(f.g[0]) AND c.line = f.line)"
    rows = sources.selectExpr("arquivo", "facts", f"explode({of('rest_classic', 'rest_annotation', 'rest_bare')}) AS f").where(f"f.kind <> 'rest_bare' OR NOT {same}")
    kind, g = F.col("f.kind"), F.col("f.g")
    return rows.select(
        "arquivo", F.when(kind == "rest_classic", g[2]).when(kind == "rest_bare", g[1]).otherwise("").alias("classe"), F.when(kind == "rest_classic", g[1]).otherwise("").alias("funcao"),
        F.upper(g[0]).alias("verbo"), F.when(kind == "rest_annotation", g[1]).otherwise("").alias("path"),
        F.when(kind == "rest_classic", "wsmethod_classico").when(kind == "rest_bare", "wsmethod_restful").otherwise("@verb_tlpp").alias("annotation_style"), F.col("f.line").alias("linha"),
    )


_HTTP = ("HttpPost", "HttpGet", "HttpsPost", "HttpsGet", "MsAGetUrl")


def http_calls(sources: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for h in _HTTP for x in (h.lower(), h)])
    rows = exploded(sources, "http").selectExpr("arquivo", "f", f"{enclosing('f.line')} AS funcao")
    return rows.select("arquivo", "funcao", F.col("f.line").alias("linha"), F.try_element_at(names, F.lower(F.col("f.g")[0])).alias("metodo"), R.redact(F.col("f.g")[1]).alias("url_literal"))


def _arg(k: int) -> Column:
    return F.coalesce(F.regexp_extract(F.get("f.args", F.lit(k)), r"""^["']([^"']*)["']$""", 1), F.lit(""))


def env_openers(sources: DataFrame) -> DataFrame:
    rows = exploded(sources, "env_open").selectExpr("arquivo", "f", f"{enclosing('f.line')} AS funcao")
    return rows.select("arquivo", "funcao", F.col("f.line").alias("linha"), _arg(0).alias("empresa"), _arg(1).alias("filial"), _arg(4).alias("environment"), _arg(5).alias("modulo"))


def log_calls(sources: DataFrame) -> DataFrame:
    rows = exploded(sources, "log_message", "log_console").selectExpr("arquivo", "f", f"{enclosing('f.line')} AS funcao")
    message = F.col("f.kind") == "log_message"
    return rows.select("arquivo", "funcao", F.col("f.line").alias("linha"), F.when(message, _arg(0)).otherwise("conout").alias("nivel"), F.when(message, _arg(3)).otherwise("").alias("categoria"))


def defines(sources: DataFrame) -> DataFrame:
    return exploded(sources, "define").selectExpr("arquivo", "f.g[0] AS nome", "trim(f.g[1]) AS valor", "f.line AS linha")


def namespaces(sources: DataFrame) -> DataFrame:
    return sources.selectExpr("arquivo", f"coalesce(get({of('namespace')}, 0).g[0], '') AS namespace")


SQL_SNIPPET = 8000
def sql_blocks(sources: DataFrame, macros: bool = False) -> DataFrame:
    """Embedded SQL with its operation and tables; ``macros`` also counts ``%table:X%``."""
    rows = exploded(sources, "sql").selectExpr("arquivo", f"{enclosing('f.line')} AS funcao", "f.line AS linha", "trim(BOTH ' \t\r\n' FROM f.g[0]) AS sql", "f.args AS tables")
    upper = F.upper("sql")
    op = F.lit("")
    for name in ("DELETE", "INSERT", "UPDATE", "SELECT"):
        op = F.when(F.contains(upper, F.lit(name)), name.lower()).otherwise(op)
    for name in ("DELETE", "INSERT", "UPDATE", "SELECT"):
        op = F.when(F.startswith(upper, F.lit(name)), name.lower()).otherwise(op)
    found = F.transform("tables", lambda t: F.ltrim(t, F.lit("%"))) if macros else F.filter("tables", lambda t: ~t.startswith("%"))
    return rows.select("arquivo", "funcao", "linha", op.alias("operacao"), F.array_sort(F.array_distinct(found)).alias("tabelas"), R.redact(F.substring("sql", 1, SQL_SNIPPET)).alias("snippet"))


_WS_RESERVED = ("WSSTRUCT", "WSSERVICE", "WSMETHOD", "WSDATA", "WSRECEIVE", "WSSEND", "ENDWSSERVICE", "ENDWSSTRUCT")  # fixed values


def ws_structures(sources: DataFrame) -> DataFrame:
    """Structures, services and REST services with their members, one row each."""
    reserved = ", ".join(repr(x) for x in _WS_RESERVED)
    rows = sources.selectExpr("arquivo", "facts", f"explode({of('ws_struct', 'ws_service', 'ws_restful')}) AS f").where(f"upper(f.g[0]) NOT IN ({reserved})")
    end = "coalesce(array_min(transform(filter(facts, e -> e.kind = 'ws_end' AND e.start >= f.stop AND upper(e.g[0]) = upper(replace(f.kind, '_', ''))), e -> e.start)), 2147483647)"
    inside = "filter(facts, x -> x.kind = '{0}' AND x.start >= f.stop AND x.start < stop)"
    rows = rows.selectExpr("*", f"{end} AS stop")
    return rows.selectExpr(
        "arquivo", "f.kind AS kind", "f.g[0] AS nome", f"IF(f.kind = 'ws_struct', array(), transform({inside.format('ws_member')}, x -> x.g[0])) AS metodos",
        f"transform({inside.format('ws_data')}, x -> struct(x.g[0] AS nome, x.g[1] AS tipo)) AS dados",
    )


def ws_signatures(sources: DataFrame) -> DataFrame:
    return exploded(sources, "ws_full").selectExpr("arquivo", "f.g[0] AS nome", "f.g[1] AS receive", "f.g[2] AS send", "f.g[3] AS service")


# Fixed value: names of entry points.
PE_NAME = r"^[A-Z]{2,4}\d{2,4}[A-Z_]{2,}$"


def _has(*kinds: str) -> str:
    return f"exists(facts, f -> f.kind IN ({', '.join(repr(k) for k in kinds)}))"


ENTRY_POINTS = f"""array_sort(array_distinct(transform(filter(functions, u -> u.kind = 'user_function' AND (rlike(upper(u.name), '{PE_NAME.replace(chr(92), chr(92) * 2)}')
    OR exists(facts, p -> p.kind = 'paramixb' AND p.line BETWEEN u.start AND u.stop))), u -> u.name)))"""

CAPABILITIES = {
    "BROWSE": _has("has_browse"),
    "COMPATIBILIZADOR": f"{_has('has_upd_var')} OR exists(functions, u -> upper(u.name) LIKE 'U@_UPD%' ESCAPE '@')",
    "DIALOG": _has("has_dialog"),
    "ENV_OPENER": _has("env_open"),
    "EXEC_AUTO_CALLER": _has("call_execauto"),
    "JOB": f"exists(functions, u -> u.kind = 'main_function') AND {_has('env_open')}",
    "JSON_AWARE": _has("has_json"),
    "MULTI_FILIAL": _has("has_multi_filial"),
    "MVC": f"{_has('has_modeldef')} OR exists(facts, f -> f.kind = 'call_mvc_hook' AND lower(f.g[0]) IN ('bcommit', 'btudook', 'blineok'))",
    "PE": f"size({ENTRY_POINTS}) > 0",
    "REPORT_TR": _has("has_report"),
    "REST_CLIENT": f"{_has('http')} AND NOT {_has('rest_classic', 'rest_bare', 'rest_annotation')}",
    "RPC": _has("env_open"),
    "SCHEDULE": _has("has_schedule"),
    "TELA_CLASSICA": f"{_has('has_dialog')} AND NOT {_has('has_modeldef')}",
    "TESTE_UNITARIO": _has("has_unit_test"),
    "WEBVIEW": _has("has_webview"),
    "WORKFLOW": _has("has_workflow"),
    "WS-REST": _has("rest_bare", "rest_annotation", "ws_restful"),
    "WS-SOAP": _has("rest_classic", "ws_service"),
}


def summaries(sources: DataFrame) -> DataFrame:
    """One row per source: its sorted lists, capabilities and type by precedence."""
    flags = "array_compact(array(" + ", ".join(f"IF({c}, '{k}', NULL)" for k, c in CAPABILITIES.items()) + "))"
    rows = sources.selectExpr("*", f"{flags} AS capabilities", f"{ENTRY_POINTS} AS pontos_entrada")

    def has_kind(kind: str) -> str:
        return f"exists(functions, u -> u.kind = '{kind}')"

    kind = f"""CASE WHEN {_has('rest_classic', 'rest_bare', 'rest_annotation', 'ws_service', 'ws_restful')} THEN 'webservice' WHEN array_contains(capabilities, 'MVC') THEN 'mvc'
        WHEN array_contains(capabilities, 'PE') THEN 'pe' WHEN {has_kind('main_function')} THEN 'main_function' WHEN {has_kind('user_function')} THEN 'user_function'
        WHEN {has_kind('static_function')} THEN 'static_function' WHEN {has_kind('method')} THEN 'class' ELSE 'outro' END"""

    def lists(*kinds: str) -> str:
        return f"array_sort(array_distinct(transform({of(*kinds)}, f -> upper(f.g[0]))))"

    valid = "t -> rlike(t, '^[SZNQD]\\\\p{L}.$')"
    return rows.selectExpr(
        "arquivo", "encoding", "hash", "error", f"{TOTAL_LINES} AS lines_of_code", f"{kind} AS source_type", "capabilities", "pontos_entrada",
        "array_sort(array_distinct(transform(functions, u -> u.name))) AS funcoes", "array_sort(array_distinct(transform(filter(functions, u -> u.kind = 'user_function'), u -> u.name))) AS user_funcs",
        f"filter({lists('table_read')}, {valid}) AS tabelas_ref", f"filter({lists('table_lock', 'table_write')}, {valid}) AS write_tables", f"filter({lists('table_lock')}, {valid}) AS reclock_tables",
        f"array_sort(array_distinct(transform({of('include')}, f -> f.g[0]))) AS includes", f"{lists('call_user_func')} AS calls_u", f"{lists('call_execblock')} AS calls_execblock",
        f"{lists('field')} AS fields_ref", f"coalesce(get({of('namespace')}, 0).g[0], '') AS namespace",
    )


# Indirect execution

def routine_catalog(spark) -> DataFrame:
    return spark.createDataFrame(list(ROUTINES), "routine string, module string, routine_type string, tables array<string>")


def execauto_calls(sources: DataFrame) -> DataFrame:
    """Automatic routine calls with their routine, operation and the routine's tables."""
    block = r"^\{\s*\|[^|]*\|(?s)(.*?)\}"
    rows = exploded(sources, "exec_auto").selectExpr("arquivo", f"{enclosing('f.line')} AS funcao", "f.line AS linha", "f.args AS args", "f.start AS at", "text")
    body = F.regexp_extract(F.get("args", F.lit(0)), block, 1)
    name = F.regexp_extract(body, r"([A-Za-z_]\w*)\s*\(", 1)
    numbers = F.filter(F.slice("args", 2, 1000), lambda a: a.rlike(r"^\s*\d+\s*$"))
    rows = rows.select(
        "arquivo", "funcao", "linha", F.when(name != "", F.upper(name)).alias("routine"), F.greatest(F.size("args") - 1, F.lit(0)).alias("arg_count"),
        F.element_at(F.when(F.size(numbers) > 0, numbers), -1).try_cast("int").alias("op_code"), R.collapse(F.substr("text", F.col("at") + 1, F.lit(200))).alias("snippet"),
    )
    catalog = F.broadcast(routine_catalog(sources.sparkSession))  # thirty rows
    labels = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    out = rows.join(catalog, "routine", "left").withColumn("op_label", F.try_element_at(labels, F.coalesce("op_code", F.lit(-1))))
    return out.select("arquivo", "funcao", "linha", "routine", "module", "routine_type", "op_code", "op_label", F.coalesce("tables", F.array()).alias("tables_resolved"), F.col("routine").isNull().alias("dynamic_call"), "arg_count", "snippet")


def execution_triggers(sources: DataFrame) -> DataFrame:
    """What starts code indirectly: workflow, schedule, standalone job and mail; metadata as a map."""
    base = sources.selectExpr("arquivo", "text", "functions", "facts")
    line = "transform(split(text, '\\n'), x -> trim(x))"

    # what each kind is made of, an expression for rows of its number; sources are read once for all of them
    made: list[tuple[str, str, str, str, str]] = []

    def trigger(kind: str, occurrence: str, target: str, metadata: str, where: str = "true") -> None:
        made.append((kind, occurrence, target, f"map_filter({metadata}, (k, v) -> v IS NOT NULL AND v <> '')", where))

    # a process' scope ends at the next one, the last at most 5000 characters on
    until = "least(coalesce(array_min(transform(filter(facts, n -> n.kind = 'wf_process' AND n.start > f.start), n -> n.start)), f.start + 5000), 2147483647)"

    def scoped(kind: str, k: int, extra: str = "true") -> str:
        return f"get(filter(facts, x -> x.kind = '{kind}' AND x.start > f.start AND x.start < {until} AND {extra}), 0).g[{k}]"

    trigger("workflow", of("wf_process"), "f.g[0]", f"""map('process_id', f.g[0], 'description', f.g[1], 'return', {scoped('wf_callback', 1, "lower(x.g[0]) = 'breturn'")},
        'timeout', {scoped('wf_callback', 1, "lower(x.g[0]) = 'btimeout'")}, 'template', {scoped('wf_task', 1)}, 'to', {scoped('wf_to', 0)}, 'subject', {scoped('wf_subject', 0)})""")
    trigger("workflow", of("wf_legacy", "wf_prepenv"), "''", "map('style', substring(f.kind, 4))")
    array = "filter(facts, x -> x.kind = 'schedule_array' AND x.start > f.start AND x.start < f.start + 3000)"
    trigger("schedule", of("schedule"), f"coalesce(get({array}, 0).g[1], '')", f"map('type', get({array}, 0).g[0], 'group', get({array}, 0).g[1], 'alias', get({array}, 0).g[2], 'orders', get({array}, 0).g[3], 'title', get({array}, 0).g[4])")
    end = "coalesce(array_min(transform(filter(facts, n -> n.kind = 'job_main' AND n.start > f.start), n -> n.start)), 2147483647)"

    def within(kind: str) -> str:
        return f"filter(facts, x -> x.kind = '{kind}' AND x.start > f.start AND x.start < {end})"

    sleep = f"CAST(get({within('job_sleep')}, 0).g[0] AS BIGINT) * coalesce(try_cast(get({within('job_sleep')}, 0).g[1] AS BIGINT), 1)"
    seconds = f"CAST(IF({sleep} >= 1000, {sleep} DIV 1000, {sleep}) AS STRING)"
    quoted = "regexp_extract(coalesce(get(get({0}, 0).args, {1}), ''), '^[\"\\']([^\"\\']*)[\"\\']$', 1)"
    trigger("job_standalone", of("job_main"), "f.g[0]", f"""map('main', f.g[0], 'empresa', {quoted.format(within('env_open'), 0)}, 'filial', {quoted.format(within('env_open'), 1)}, 'modulo', {quoted.format(within('env_open'), 4)},
        'sleep_seconds', {seconds}, 'stop_file', get({within('job_stop')}, 0).g[0], 'no_licence', IF(size({within('job_no_licence')}) > 0, 'true', ''))""", f"size({within('env_open')}) + size({within('job_no_licence')}) > 0")
    flags = f"'attach', IF({_has('mail_attach')}, 'true', ''), 'mv_rel', IF({_has('mail_mv_rel')}, 'true', '')"
    mails = f"IF({_has('mail_auto', 'mail_udc', 'mail_message')}, {of('mail_auto', 'mail_udc', 'mail_message')}, {of('mail_manager')})"
    first_of_line = f"transform(array({mails}), m -> filter(m, (x, i) -> i = 0 OR m[i - 1].line <> x.line))[0]"
    trigger("mail_send", first_of_line, "''", f"map('variant', substring(f.kind, 6), {flags})")
    every = ", ".join(f"transform({occurrence}, f -> struct({n} AS n, f AS f))" for n, (_, occurrence, *_) in enumerate(made))

    def by_number(k: int) -> str:
        return "CASE n " + " ".join(f"WHEN {n} THEN {m[k]}" for n, m in enumerate(made)) + " END"

    rows = base.selectExpr("*", f"inline(concat({every}))").where(by_number(4))
    kinds = "CASE n " + " ".join(f"WHEN {n} THEN '{m[0]}'" for n, m in enumerate(made)) + " END"
    return rows.selectExpr("arquivo", f"{enclosing('f.line')} AS funcao", "f.line AS linha", f"{kinds} AS kind", f"{by_number(2)} AS target", f"{by_number(3)} AS metadata", f"substring({line}[f.line - 1], 1, 200) AS snippet")


DOC_DISTANCE = 80


def doc_blocks(sources: DataFrame) -> DataFrame:
    """Documentation blocks: id, summary, tags, the declaration that follows within ``DOC_DISTANCE`` lines."""
    rows = sources.selectExpr("arquivo", "caminho_relativo", "text", f"{of('declaration')} AS decls", f"explode({of('doc')}) AS f")
    last = "f.line + size(split(substring(text, f.start + 1, f.stop - f.start), '\\n')) - 1"
    body = "split(f.g[1], '(?m)^[ \\\\t]*@')"
    rows = rows.selectExpr("*", f"{last} AS last_line", f"{body} AS parts")
    # a match may begin on the blank lines before its declaration
    decl = """get(filter(transform(decls, d -> struct(d.g[0] AS name, d.line + length(regexp_replace(regexp_extract(substring(text, d.start + 1, d.stop - d.start), '^\\\\s*', 0), '[^\\n]', '')) AS line)),
        d -> d.line > last_line AND d.line - last_line <= {0}), 0)""".format(DOC_DISTANCE)
    tags = "transform(filter(slice(parts, 2, greatest(size(parts) - 1, 0)), p -> p <> ''), p -> struct(lower(regexp_extract(p, '^(\\\\w+)', 1)) AS tag, trim(BOTH ' \t\r\n' FROM regexp_replace(p, '^\\\\w+[ \\\\t]*', '')) AS value))"
    rows = rows.selectExpr("*", f"{decl} AS decl", f"{tags} AS tags")

    def one(tag: str) -> str:
        return f"get(filter(tags, t -> t.tag = '{tag}'), 0).value"

    def all_of(*names: str) -> str:
        return f"transform(filter(tags, t -> t.tag IN ({', '.join(repr(n) for n in names)})), t -> t.value)"

    known = "'type', 'author', 'since', 'version', 'description', 'language', 'param', 'return', 'example', 'history', 'see', 'table', 'todo', 'obs', 'link', 'deprecated'"
    params = """transform({0}, v -> transform(array(split(v, ',', 3)), a -> struct(regexp_replace(trim(a[0]), '[\\\\[\\\\]\\\\s]', '') AS name, trim(coalesce(get(a, 1), '')) AS type,
        trim(coalesce(get(a, 2), '')) AS desc, trim(a[0]) LIKE '[%' AS optional))[0])""".format(all_of("param"))
    pairs = "transform({0}, v -> transform(array(split(v, ',', {1})), a -> struct({2}))[0])"
    out = rows.selectExpr(
        "arquivo", "caminho_relativo", "nullif(f.g[0], '') AS funcao_id", "coalesce(decl.name, nullif(f.g[0], '')) AS funcao", "f.line AS linha_bloco_inicio", "last_line AS linha_bloco_fim",
        "decl.line AS linha_funcao", "nullif(trim(BOTH ' \t\r\n' FROM parts[0]), '') AS summary", f"{one('description')} AS description", f"{one('type')} AS tipo", f"{one('author')} AS author",
        f"{one('since')} AS since", f"{one('version')} AS version", f"{one('language')} AS language", "exists(tags, t -> t.tag = 'deprecated') AS deprecated",
        f"nullif({one('deprecated')}, '') AS deprecated_reason", f"{params} AS params",
        pairs.format(all_of("return"), 2, "trim(a[0]) AS type, trim(coalesce(get(a, 1), '')) AS desc") + " AS returns",
        pairs.format(all_of("history"), 3, "trim(a[0]) AS date, trim(coalesce(get(a, 1), '')) AS author, trim(coalesce(get(a, 2), '')) AS desc") + " AS history",
        f"{all_of('example')} AS examples", f"{all_of('see')} AS see", f"{all_of('table')} AS tables", f"{all_of('todo')} AS todos", f"{all_of('obs')} AS obs", f"{all_of('link')} AS links",
        f"""map_from_entries(transform(array_distinct(transform(filter(tags, t -> t.tag NOT IN ({known})), t -> t.tag)),
            k -> struct(k, array_join(transform(filter(tags, t -> t.tag = k), t -> t.value), '\\n')))) AS raw_tags""",
    )
    path = F.upper(F.regexp_extract("caminho_relativo", r"(?i)\b(SIGA\w{3,4})\b", 1))
    names = routine_catalog(sources.sparkSession).select(F.col("routine").alias("catalog_name"), F.col("module").alias("module_inferido"))
    out = out.withColumn("lookup", F.coalesce("funcao", F.lit("")))
    out = R.exact_or_prefix(out, "lookup", names, "catalog_name", "module_inferido").drop("lookup")
    return out.withColumn("module_inferido", F.when(path != "", path).otherwise(F.col("module_inferido"))).drop("caminho_relativo")


#: The kinds of occurrences that each fact table reads; functions and chunks need the ranges of functions only, the others all.
KINDS: dict[object, frozenset[str]] = {
    functions: frozenset(), chunks: frozenset(), calls: frozenset(CALL_KINDS), tables: frozenset({"table_read", "table_lock", "table_write"}), parameters: frozenset({"param_read", "param_write"}),
    questions: frozenset({"question"}), includes: frozenset({"include"}), fields: frozenset({"field"}), endpoints: frozenset({"rest_classic", "rest_annotation", "rest_bare"}),
    http_calls: frozenset({"http"}), env_openers: frozenset({"env_open"}), log_calls: frozenset({"log_message", "log_console"}), defines: frozenset({"define"}), namespaces: frozenset({"namespace"}),
    sql_blocks: frozenset({"sql"}), ws_structures: frozenset({"ws_struct", "ws_service", "ws_restful", "ws_end", "ws_member", "ws_data"}), ws_signatures: frozenset({"ws_full"}),
    execauto_calls: frozenset({"exec_auto"}), doc_blocks: frozenset({"doc", "declaration"}),
    execution_triggers: frozenset({"wf_process", "wf_legacy", "wf_prepenv", "wf_callback", "wf_task", "wf_to", "wf_subject", "schedule", "schedule_array", "job_main", "job_no_licence", "job_sleep", "job_stop", "env_open",
                                   "mail_auto", "mail_udc", "mail_message", "mail_manager", "mail_attach", "mail_mv_rel"}),
}


def kinds_of(*made: object) -> frozenset[str] | None:
    """The kinds that some fact tables read together, None where one of them reads all."""
    return frozenset().union(*(KINDS[m] for m in made)) if all(m in KINDS for m in made) else None
