"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import discard, remove, shared_dir, shared_path, staged

__all__ = ["arrow_map", "blocks", "crc_fold", "discard", "documents", "pages", "remove", "shared_dir", "shared_path", "sifted", "sole", "staged"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most_bytes`` of ``column`` each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    ends = np.cumsum(sizes)
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start, total = stop, int(ends[stop - 1])


def regrouped(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many bytes, where larger blocks save work."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if some and size + batch.nbytes > most_bytes:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, size = [], 0
        some.append(batch)
        size += batch.nbytes
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _libc():
    return ctypes.CDLL(None)


def release() -> None:
    """Gives memory that this process holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@cache
def lean() -> None:
    """Lets numpy and Arrow share one heap, which keeps blocks of usual size for the next use and gives large ones back at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    option = getattr(_libc(), "mallopt", None)  # glibc only
    if option is not None:
        option(-3, 4 << 20)  # M_MMAP_THRESHOLD
        option(-1, 16 << 20)  # M_TRIM_THRESHOLD


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory given back after each task: Python workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


#: Bounds of an Arrow batch, the same for all operators. Spark's own bound, 10,000 rows, makes tens of MB of texts
#: of a few KB, which both sides hold at once, several times over while buffers grow.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with memory given back after tasks and batches of a few MB."""
    for key, value in BATCH_CONF.items():
        df.sparkSession.conf.set(key, value)
    return df.mapInArrow(tidy(run), schema)


_sole: dict[str, object] = {}


def sole(key: str, make: Callable[[], object]):
    """This process's object under a key, kept between tasks; those of other operators are dropped for it."""
    if key not in _sole:
        _sole.clear()
        release()
        _sole[key] = make()
    return _sole[key]


#: Bits of a sieve for each key, and at most (32 MB); words of 64 bits in one of its rows.
SIEVE_BITS, SIEVE_MOST, SIEVE_WORDS = 32, 1 << 28, 128


def sifted(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``wanted``, and few others; keys are 64-bit hashes.

    For a join of many rows with few keys: a bitmap of the keys is broadcast, so that rows without a partner are not
    shuffled. No row with one is lost, whatever the number of keys; the join that follows decides.
    """
    bits = min(max(1, wanted.count()) * SIEVE_BITS, SIEVE_MOST)
    words = wanted.selectExpr(f"pmod({wanted_key}, {bits}L) AS bit").groupBy(F.expr("bit DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("mask"))
    found = words.groupBy(F.expr(f"word DIV {SIEVE_WORDS}").alias("sieve_row")).agg(F.expr(f"map_from_entries(collect_list(struct(CAST(word % {SIEVE_WORDS} AS INT), mask)))").alias("masks"))
    sieve = found.selectExpr("sieve_row", f"transform(sequence(0, {SIEVE_WORDS - 1}), i -> coalesce(masks[i], 0L)) AS sieve_words")
    bit = f"pmod({key}, {bits}L)"
    met = df.join(F.broadcast(sieve), F.expr(f"{bit} DIV {64 * SIEVE_WORDS} = sieve_row"))
    return met.where(f"getbit(sieve_words[CAST({bit} DIV 64 % {SIEVE_WORDS} AS INT)], CAST({bit} % 64 AS INT)) = 1").drop("sieve_row", "sieve_words")


#: A 0-based residue of crc32 of the decimal text of an id; null ids count as the empty text.
def crc_fold(column: str, folds: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
