"""Many literal needles in many texts, in one pass over each text.

An Aho-Corasick automaton finds all needles of a set at once, in time linear in a text, however many needles there are. Needles travel to the
tasks in blocks of ``NEEDLE_BYTES`` (counted by Spark before anything is collected), texts stay where they are: no shuffle of texts and no pairs of needles and texts.
A set of more than one block costs a further pass for each.

Null needles and null texts take no part. The empty needle is found in every text, at place 1 only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Bytes of needles that the driver holds and sends to the tasks at a time.
NEEDLE_BYTES = 16 << 20


def automaton(needles: list[str]):
    """An Aho-Corasick automaton over needles that aren't empty; its values are the needles."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for n in needles:
        out.add_word(n, n)
    out.make_automaton()
    return out


def needle_blocks(needles: DataFrame, needle: str, most_bytes: int | None = None) -> Iterator[list[str]]:
    """The distinct needles, in blocks of about ``most_bytes``."""
    most_bytes = most_bytes or NEEDLE_BYTES
    distinct = needles.select(F.col(needle).cast("string").alias("needle")).where("needle IS NOT NULL").distinct()
    size = distinct.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    count = -(-size // most_bytes)
    for k in range(count):
        part = distinct if count == 1 else distinct.where(F.pmod(F.xxhash64("needle"), F.lit(count)) == k)
        yield [r["needle"] for r in part.collect()]


def found_needles(needles: DataFrame, needle: str, texts: DataFrame, text: str, most_bytes: int | None = None) -> DataFrame:
    """``needle``: the distinct needles that occur in some text. A task sends each needle once."""
    rows = texts.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    out = None
    for block in needle_blocks(needles, needle, most_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            full, left = [n for n in block if n], set(block)
            machine = automaton(full) if full else None
            for batch in batches:
                fresh: set[str] = set()
                for value in batch.column(0).to_pylist():
                    if not left:
                        break
                    if machine is not None:
                        fresh.update(n for _, n in machine.iter(value) if n in left)
                    if "" in left:
                        fresh.add("")
                left -= fresh
                yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], names=[needle])

        part = rows.mapInArrow(run, StructType([StructField(needle, StringType())]))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return needles.select(F.col(needle).cast("string").alias(needle)).limit(0)
    return out.distinct()


def found_inside(needles: DataFrame, key: str, needle: str, texts: DataFrame, text: str, most_bytes: int | None = None) -> DataFrame:
    """Keys of the needles that occur inside some text."""
    found = found_needles(needles.select(F.col(needle).alias("_needle")), "_needle", texts, text, most_bytes)
    return needles.select(key, F.col(needle).cast("string").alias("_needle")).join(found, "_needle", "left_semi").select(key).distinct()


def occurrences(needles: DataFrame, needle: str, texts: DataFrame, text: str, most_bytes: int | None = None) -> DataFrame:
    """The columns of ``texts`` but the text, and for each needle in it ``needle`` and ``places``: where it begins (from 1), overlaps included.

    One row for a text and needle that it holds.
    """
    kept = [c for c in texts.columns if c != text]
    rows = texts.where(F.col(f"`{text}`").isNotNull())
    schema = StructType([texts.schema[c] for c in kept] + [StructField("needle", StringType()), StructField("places", ArrayType(LongType()))])
    out = None
    for block in needle_blocks(needles, needle, most_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            full, empty = [n for n in block if n], "" in block
            machine = automaton(full) if full else None
            for batch in batches:
                row, names, places = [], [], []
                for k, value in enumerate(batch.column(text).to_pylist()):
                    found: dict[str, list[int]] = {"": [1]} if empty else {}
                    if machine is not None:
                        for end, n in machine.iter(value):
                            found.setdefault(n, []).append(end - len(n) + 2)
                    for n, at in found.items():
                        row.append(k)
                        names.append(n)
                        places.append(at)
                picked = batch.take(pa.array(row, pa.int64()))
                columns = [picked.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int64()))], names=[*kept, "needle", "places"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias("needle"), F.lit(None).cast("array<bigint>").alias("places")).limit(0)
    return out
