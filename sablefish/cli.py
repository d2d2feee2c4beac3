"""Command line over a folder of fact tables: ``python -m sablefish.cli --store DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import commands, cookbook, facts, lint, render
from .sources import catalogs, dictionary, files
from .streaming import batches, refresh


class NotIngestedError(RuntimeError):
    """The store has no such table yet."""


#: The entry of the pointer file for the folder of the tables that ingest writes in batches, and those of them that aren't fact tables.
FACTS = "_facts"
BY_SOURCE = (refresh.WORDS, "arquivos", "funcoes", "lint_single")


class Store:
    """Tables as Parquet below a folder, and a file of pointers that is written last.

    What hangs on sources (facts, their word index, findings in single sources) is written in batches: an incremental ingest writes the rows of changed sources only, a
    full one begins a new folder. Other tables are written whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def pointers(self) -> dict[str, str]:
        path = f"{self.folder}/_current"
        if not self._exists(path):
            return {}
        return {r["name"]: r["path"] for r in self.spark.read.schema("name string, path string").json(path).collect()}

    def point(self, to: dict[str, str]) -> None:
        rows = self.spark.createDataFrame(sorted((self.pointers() | to).items()), "name string, path string").coalesce(1)
        rows.write.mode("overwrite").json(f"{self.folder}/_current")

    def names(self) -> list[str]:
        """The tables that there are."""
        known = self.pointers()
        inside = [*refresh.FACT_TABLES, *(n for n in BY_SOURCE if n != "lint_single"), "lint_findings"] if FACTS in known else []
        return sorted({*inside, *(n for n in known if n not in (FACTS, "cross_findings"))})

    def table(self, name: str) -> DataFrame:
        known = self.pointers()
        if name == "lint_findings":
            single = self.table("lint_single")
            return single.unionByName(self.table("cross_findings")) if "cross_findings" in known else single
        if name in refresh.FACT_TABLES or name in BY_SOURCE:
            if FACTS in known:
                return refresh.load(self.spark, known[FACTS], name)
        elif name in known:
            return self.spark.read.parquet(known[name])
        raise NotIngestedError(f"{name} isn't in {self.folder}; ingest first")

    def write(self, tables: dict[str, DataFrame]) -> None:
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        self.point(paths)


def ingest(store: Store, root: str, incremental: bool = False, only: str | None = None, with_content: bool = True) -> DataFrame:
    """All sources of a tree, only new and changed ones, or ``only`` one by name, into the store; with a word index of their texts."""
    found = files.scan(store.spark, root)
    folder = store.pointers().get(FACTS) if incremental or only is not None else None
    if only is not None:
        found = found.where(F.lower("arquivo") == only.lower())
    elif folder is not None:
        found = files.changed(found, store.table("arquivos"))
    batch = 0 if folder is None else batches.last(store.spark, folder) + 1
    if folder is None or not found.isEmpty():
        sources = facts.scan_sources(found).cache()
        listing = sources.select("arquivo", "caminho_relativo", "tipo_arquivo", "mtime_ns", "size_bytes", "encoding", "error").withColumn("indexed_at", F.current_timestamp())
        more = {"arquivos": listing, "funcoes": facts.functions(sources), "lint_single": lint.lint_sources(sources)}
        place = folder or f"{store.folder}/{FACTS}/{uuid.uuid4().hex}"
        refresh.write(sources, place, batch, with_content, more)
        sources.unpersist()
        if folder is None:
            store.point({FACTS: place})
    return commands.status({n: store.table(n) for n in ("arquivos", "fonte_chunks", "chamadas_funcao", "lint_findings")})


def ingest_dictionary(store: Store, folder: str) -> tuple[DataFrame, dict[str, str]]:
    place = store.spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = place.getFileSystem(store.spark._jsc.hadoopConfiguration()).listStatus(place)
    names = dictionary.find_files([x.getPath().getName() for x in listing])
    tables, failed, lost = dictionary.load(store.spark, {k: f"{folder}/{v}" for k, v in names.items()})
    store.write(tables)
    return lost, failed


def cross_lint(store: Store) -> DataFrame:
    known = store.names()
    names = [e.table for e in dictionary.EXPORTS.values() if e.table in known]
    chunks = store.table("fonte_chunks")
    made = {
        "functions": chunks.selectExpr("arquivo", "funcao AS nome", "tipo_simbolo AS kind", "linha_inicio"), "parameters": store.table("parametros_uso"),
        "questions": store.table("perguntas_uso"), "chunks": chunks, "sql": store.table("sql_embedado"),
    }
    found = lint.cross_rules({n: store.table(n) for n in names}, made, catalogs.restricted(store.spark))
    cross = [r for r in lint.SEVERITY if r not in lint.SINGLE_RULES]
    store.write({"cross_findings": lint.persist(store.table("lint_single").limit(0), found, cross)})
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sablefish")
    p.add_argument("--store", default=".sablefish")
    p.add_argument("--format", choices=("table", "json", "md"), default="table")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--offset", type=int, default=0)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    command("version")
    command("init")
    command("ingest", "root", incremental={"action": "store_true"}, no_content={"action": "store_true"})
    command("reindex", "root", "name")
    command("sql", "statement")
    command("ingest-sx", "folder")
    command("status", check_stale={"metavar": "ROOT"})
    command("sx-status")
    command("doctor")
    for name in ("find", "callers", "callees", "param", "arch"):
        command(name, "name")
    command("tables", "name", mode={"choices": ("read", "write", "reclock")})
    command("lint", file={}, severity={}, rule={}, cross_file={"action": "store_true"})
    command("grep", "pattern", mode={"choices": ("literal", "identifier", "fts"), "default": "literal"})
    for name in ("impacto", "gatilho"):
        command(name, "field", depth={"type": int, "default": 3})
    command("workflow", kind={}, file={})
    command("execauto", routine={}, op={}, dynamic={"action": "store_const", "const": True})
    command("docs", module={}, author={}, show={}, orphans={"action": "store_true"}, deprecated={"action": "store_const", "const": True})
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | str:
    store = Store(spark, args.store)
    t, c = store.table, args.command
    if c == "version":
        return __version__
    if c == "ingest":
        return ingest(store, args.root, args.incremental, with_content=not args.no_content)
    if c == "init":
        store.write({})
        return store.folder
    if c == "reindex":
        return ingest(store, args.root, only=args.name)
    if c == "sql":
        return cookbook.run(spark, {n: t(n) for n in store.names()}, args.statement)
    if c == "ingest-sx":
        lost, failed = ingest_dictionary(store, args.folder)
        for name, why in failed.items():
            print(f"{name}: {why}", file=sys.stderr)
        return lost if lost is not None else "no dictionary export found"
    if c == "status":
        if args.check_stale:
            from .operators import relational as R

            return R.snapshot_diff(t("arquivos"), files.scan(spark, args.check_stale, content=False), "arquivo", "mtime_ns")
        return commands.status({n: t(n) for n in store.names()})
    if c == "sx-status":
        return commands.status({e.table: t(e.table) for e in dictionary.EXPORTS.values() if e.table in store.names()})
    if c == "doctor":
        return commands.doctor(t("arquivos"), t("fonte_chunks"), t("palavras"))
    if c == "find":
        return commands.find(t("fonte_chunks"), t("arquivos"), args.name)
    if c == "callers":
        return commands.callers(t("chamadas_funcao"), args.name)
    if c == "callees":
        return commands.callees(t("chamadas_funcao"), args.name)
    if c == "param":
        return commands.parameter_used(t("parametros_uso"), args.name)
    if c == "arch":
        return commands.arch(t("fontes"), t("execauto_calls"), args.name)
    if c == "tables":
        return commands.tables_used(t("fonte_tabela"), args.name, args.mode)
    if c == "lint":
        if args.cross_file:
            cross_lint(store)
        return commands.lint(t("lint_findings"), args.file, args.severity, args.rule)
    if c == "grep":
        return commands.grep(t("fonte_chunks"), args.pattern, args.mode, args.limit, t("palavras") if args.mode == "fts" else None)
    if c == "impacto":
        return commands.impact(t("fonte_chunks"), t("campos"), t("gatilhos"), t("perguntas"), args.field, args.depth)
    if c == "gatilho":
        return commands.trigger_cascade(t("gatilhos"), args.field, args.depth)
    if c == "workflow":
        return commands.triggers(t("execution_triggers"), args.kind, args.file)
    if c == "execauto":
        return commands.execautos(t("execauto_calls"), args.routine, args.op, args.dynamic)
    if args.orphans:
        return commands.undocumented(t("lint_findings"))
    if args.show:
        first = commands.doc_homonyms(t("protheus_docs"), args.show).limit(1)
        rows = t("protheus_docs").where(f"upper(funcao) = upper('{args.show.replace(chr(39), '')}')").join(first, "arquivo", "left_semi").limit(1).collect()
        return render.doc_page(rows[0].asDict(recursive=True)) if rows else f"{args.show} isn't documented"
    return commands.docs(t("protheus_docs"), args.module, args.author, args.deprecated)


def show(result: DataFrame | str, args: argparse.Namespace) -> str:
    if isinstance(result, str):
        return result
    return {"json": render.as_json, "md": render.as_markdown, "table": render.as_table}[args.format](result, args.limit, args.offset)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sablefish").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(show(run(spark, args), args))
    except NotIngestedError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
