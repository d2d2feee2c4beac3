"""Incremental ingest: new and changed sources replace their facts, as a batch or from a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from ..operators import relational as R
from ..operators import search
from ..sources import files
from . import batches

FACT_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fontes": facts.summaries, "fonte_chunks": facts.chunks, "chamadas_funcao": facts.calls, "fonte_tabela": facts.tables, "parametros_uso": facts.parameters, "perguntas_uso": facts.questions,
    "rest_endpoints": facts.endpoints, "http_calls": facts.http_calls, "env_openers": facts.env_openers, "log_calls": facts.log_calls, "defines": facts.defines, "sql_embedado": facts.sql_blocks,
    "execution_triggers": facts.execution_triggers, "execauto_calls": facts.execauto_calls, "protheus_docs": facts.doc_blocks,
}
_KEYS = {"chamadas_funcao": "arquivo_origem"}
WORDS = "palavras"


def build(sources: DataFrame, with_content: bool = True) -> dict[str, DataFrame]:
    """All fact tables of scanned sources; chunks without their text where ``with_content`` is False."""
    out = {name: make(sources) for name, make in FACT_TABLES.items()}
    return out if with_content else out | {"fonte_chunks": facts.chunks(sources, with_content=False)}


def refresh(stored: dict[str, DataFrame], sources: DataFrame, with_content: bool = True) -> dict[str, DataFrame]:
    """Stored fact tables with all rows of the given sources replaced."""
    names = sources.select("arquivo")
    out = {}
    for name, fresh in build(sources, with_content).items():
        key = _KEYS.get(name, "arquivo")
        out[name] = R.replace_by_key(stored[name], fresh, key, names.withColumnRenamed("arquivo", key)) if name in stored else fresh
    return out


def write(sources: DataFrame, folder: str, batch: int, with_content: bool = True, more: dict[str, DataFrame] | None = None) -> None:
    """A batch of all fact tables below ``folder``, of their word index and of ``more`` tables by ``arquivo``: the rows of the given sources only, which replace those of earlier batches.

    A batch that is run again replaces itself.
    """
    tables = build(sources, with_content)
    words = search.token_table(tables["fonte_chunks"].where("content <> ''").withColumn("chunk", F.struct("arquivo", "id")), "chunk", "content")
    tables[WORDS] = words.select("chunk.arquivo", "chunk.id", "pos", "token")
    batches.put(tables | (more or {}), sources.select("arquivo").distinct(), folder, batch)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fact table, or the word index, as the batches so far leave it."""
    return batches.current(spark, folder, name, "arquivo", _KEYS.get(name, "arquivo")).drop("batch")


def stream(spark: SparkSession, root: str, folder: str, checkpoint: str):
    """A stream over new files of a tree: each batch's sources replace theirs. Runs what is there, then stops."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def each(batch: DataFrame, number: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        rows = batch.where(F.lower(name).rlike(rf"\.({'|'.join(files.EXTENSIONS)})$") & (F.col("length") > 0) & (F.col("length") <= files.MOST_BYTES))
        rows = rows.select(name.alias("arquivo"), F.col("path").alias("caminho_relativo"), "content")
        if not rows.isEmpty():
            sources = facts.scan_sources(rows).persist()
            write(sources, folder, number)
            sources.unpersist()

    return found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
