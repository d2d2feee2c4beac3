"""The ERP data dictionary: eleven CSV exports to typed tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import relational as R
from . import spreadsheet

#: cp1252 differs from latin-1 in these places.
_LATIN = "".join(map(chr, [*range(0x80, 0xA0)]))
_CP1252 = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0))


class WrongShapeError(ValueError):
    """A file that isn't the dictionary export its name says."""


@dataclass(frozen=True)
class Export:
    """How a file becomes a table. ``columns`` maps names to headers (several: the first that is filled)."""

    table: str
    columns: dict[str, str]
    keys: tuple[str, ...]
    required: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)
    prefix: str = ""


_CUSTOM_FIELD = "rlike({0}, '^[^_]+_X')"
# Headers, names and keys of the exports.
EXPORTS: dict[str, Export] = {
    "sx2": Export("tabelas", {"codigo": "X2_CHAVE", "nome": "X2_NOME", "modo": "X2_MODO"}, ("codigo",), ("codigo",), extra={"custom": "rlike(codigo, '^(SZ.|Q[A-Z].|Z..)')"}),
    "sx3": Export(
        "campos",
        {"tabela": "X3_ARQUIVO", "campo": "X3_CAMPO", "tipo": "X3_TIPO", "tamanho": "X3_TAMANHO", "decimal": "X3_DECIMAL", "titulo": "X3_TITULO", "descricao": "X3_DESCRIC", "validacao": "X3_VALID",
         "inicializador": "X3_INIT X3_RELACAO", "obrigatorio": "X3_OBRIGAT", "f3": "X3_F3", "cbox": "X3_CBOX", "vlduser": "X3_VLDUSER", "when_expr": "X3_WHEN", "proprietario": "X3_PROPRI",
         "browse": "X3_BROWSE", "trigger_flag": "X3_TRIGGER", "visual": "X3_VISUAL", "context": "X3_CONTEXT", "folder": "X3_FOLDER", "grpsxg": "X3_GRPSXG"},
        ("tabela", "campo"), ("campo",), ("tamanho", "decimal"),
        {"custom": f"{_CUSTOM_FIELD.format('campo')} OR (proprietario <> '' AND proprietario <> 'S')", "obrigatorio": "lower(obrigatorio) LIKE 'x%' OR upper(obrigatorio) IN ('S', 'SIM', '1', '.T.')"},
    ),
    "six": Export("indices", {"tabela": "INDICE", "ordem": "ORDEM", "chave": "CHAVE", "descricao": "DESCRICAO", "proprietario": "PROPRI", "f3": "F3", "nickname": "NICKNAME", "showpesq": "SHOWPESQ"},
                  ("tabela", "ordem"), ("tabela", "ordem"), extra={"custom": "proprietario <> '' AND proprietario <> 'S'"}),
    "sx7": Export("gatilhos", {"campo_origem": "X7_CAMPO", "sequencia": "X7_SEQUENC", "campo_destino": "X7_CDOMIN", "regra": "X7_REGRA", "tipo": "X7_TIPO", "tabela": "X7_ALIAS X7_ARQUIVO", "condicao": "X7_CONDIC",
                               "proprietario": "X7_PROPRI", "seek": "X7_SEEK", "alias": "X7_ALIAS", "ordem": "X7_ORDEM", "chave": "X7_CHAVE"},
                  ("campo_origem", "sequencia"), ("campo_origem",), extra={"custom": f"{_CUSTOM_FIELD.format('campo_destino')} OR (proprietario <> '' AND proprietario <> 'S')"}),
    "sx6": Export("parametros", {"filial": "X6_FIL", "variavel": "X6_VAR", "tipo": "X6_TIPO", "descricao": "X6_DESCRIC", "descricao2": "X6_DESC1", "conteudo": "X6_CONTEUD", "proprietario": "X6_PROPRI", "validacao": "X6_VALID", "init": "X6_INIT"},
                  ("filial", "variavel"), ("variavel",), extra={"descricao": "trim(concat(descricao, ' ', descricao2))", "custom": "proprietario <> 'S'"}),
    "sx1": Export("perguntas", {"grupo": "X1_GRUPO", "ordem": "X1_ORDEM", "pergunta": "X1_PERGUNT", "variavel": "X1_VARIAVL", "tipo": "X1_TIPO", "tamanho": "X1_TAMANHO", "decimal": "X1_DECIMAL", "f3": "X1_F3", "validacao": "X1_VALID", "conteudo_padrao": "X1_DEF01"},
                  ("grupo", "ordem"), ("grupo", "ordem"), ("tamanho", "decimal")),
    "sx5": Export("tabelas_genericas", {"filial": "X5_FILIAL", "tabela": "X5_TABELA", "chave": "X5_CHAVE", "descricao": "X5_DESCRI"}, ("filial", "tabela", "chave"), ("tabela", "chave"), extra={"custom": "rlike(tabela, '^[ZX]')"}),
    "sx9": Export("relacionamentos", {"tabela_origem": "X9_DOM", "identificador": "X9_IDENT", "tabela_destino": "X9_CDOM", "expressao_origem": "X9_EXPDOM", "expressao_destino": "X9_EXPCDOM", "proprietario": "X9_PROPRI", "condicao_sql": "X9_CONDSQL"},
                  ("tabela_origem", "identificador", "tabela_destino"), ("tabela_origem", "tabela_destino"), extra={"custom": "proprietario <> 'S'"}),
    "sxa": Export("pastas", {"alias": "XA_ALIAS", "ordem": "XA_ORDEM", "descricao": "XA_DESCRIC", "proprietario": "XA_PROPRI", "agrupamento": "XA_AGRUP"}, ("alias", "ordem"), ("alias", "ordem")),
    "sxb": Export("consultas", {"alias": "XB_ALIAS", "tipo": "XB_TIPO", "sequencia": "XB_SEQ", "coluna": "XB_COLUNA", "descricao": "XB_DESCRI", "conteudo": "XB_CONTEM"}, ("alias", "tipo", "sequencia", "coluna"), ("alias", "sequencia")),
    "sxg": Export("grupos_campo", {"grupo": "XG_GRUPO", "descricao": "XG_DESCRIC", "tamanho_max": "XG_TAMMAX", "tamanho_min": "XG_TAMMIN", "tamanho": "XG_TAMANHO"}, ("grupo",), ("grupo",), ("tamanho_max", "tamanho_min", "tamanho"), prefix="XG_"),
}


def read_csv(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A CSV export with all columns as text: separator and encoding found from the file, ``_row`` for its order.

    UTF-8 where every line is valid UTF-8, else cp1252 (read as latin-1, the 32 differing characters mapped). A spreadsheet under a CSV file's name
    is read as one. Raises where its first header lacks ``prefix``, or a spreadsheet can't be read.
    """
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    head = first[0][0].lstrip("\ufeff") if first else ""
    if head.startswith(spreadsheet.SIGNATURE):
        try:
            rows = spreadsheet.table(spark, path)
        except PythonException as e:
            raise WrongShapeError(f"{path} is an archive, but no spreadsheet that can be read") from e
        if prefix and not rows.columns[-1 if len(rows.columns) < 2 else 1].upper().startswith(prefix):
            raise WrongShapeError(f"the first header of {path} doesn't start with {prefix}")
        return rows
    if prefix and not head.strip('"').upper().startswith(prefix):
        raise WrongShapeError(f"the first header of {path} doesn't start with {prefix}")
    utf8 = not lines.where(~F.expr("is_valid_utf8(value)")).limit(1).count()
    sep = ";" if ";" in head else ","
    names = [h.strip().strip('"') for h in head.rstrip("\r\n").split(sep)]
    schema = StructType([StructField(n or f"_c{i}", StringType()) for i, n in enumerate(names)])
    rows = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8" if utf8 else "ISO-8859-1", enforceSchema=True)
    if not utf8:
        rows = rows.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _CP1252).alias(c) for c in rows.columns])
    return rows.withColumn("_row", F.monotonically_increasing_id())


def typed(rows: DataFrame, export: Export) -> tuple[DataFrame, DataFrame]:
    """An export's table (deleted rows and rows without keys left out, the last of a key kept), and its number of lost rows."""
    have = set(rows.columns)

    def value(headers: str) -> Column:
        parts = [F.trim(F.coalesce(F.col(f"`{h}`"), F.lit(""))) for h in headers.split() if h in have]
        if not parts:
            return F.lit("")
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = F.when(p != "", p).otherwise(out)
        return out

    live = rows.where(value("D_E_L_E_T_") != "*")
    out = live.select("_row", *[value(h).alias(c) for c, h in export.columns.items()])
    for c in export.required:
        out = out.where(F.col(c) != "")
    out = out.withColumns({c: R.safe_int(c) for c in export.numbers})
    out = out.withColumns({c: F.expr(e) for c, e in export.extra.items()}) if export.extra else out
    out = out.drop("descricao2")
    kept = R.last_wins(out, list(export.keys), ["_row"])
    lost = kept.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("lost")).select(F.lit(export.table).alias("table_name"), "lost")
    return kept.drop("_row", "lost"), lost


def load(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str], DataFrame | None]:
    """Tables by name from files by export name; what failed and why; rows lost to equal keys."""
    tables, failed, lost = {}, {}, None
    for name, path in paths.items():
        export = EXPORTS[name]
        try:
            rows = read_csv(spark, path, export.prefix)
        except WrongShapeError as e:
            failed[name] = str(e)
            continue
        tables[export.table], one = typed(rows, export)
        lost = one if lost is None else lost.unionByName(one)
    if "grupos_campo" in tables and "campos" in tables:
        tables["grupos_campo"] = R.with_total(tables["grupos_campo"], "total_campos", tables["campos"].where("grpsxg <> ''"), "grupo", "grpsxg")
    return tables, failed, lost


def find_files(names: list[str]) -> dict[str, str]:
    """Export names to file names of a listing: the exact name first, else ignoring case."""
    out = {}
    for key in EXPORTS:
        exact = [n for n in names if n == f"{key}.csv"] or sorted(n for n in names if n.lower() == f"{key}.csv")
        if exact:
            out[key] = exact[0]
    return out
