"""Inverted tables: word postings with BM25 ranking, and trigram postings for substring search.

Postings are plain tables (a row for a token and a text), so they can be staged, partitioned and refreshed in batches (``streaming.batches``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.staging import staged
from . import multipattern, search

K1, B = 1.2, 0.75
#: Texts of a block of postings, about: a block's bounds are all that is read of texts that can't be among the best.
BLOCK_TEXTS = 64
#: Rows of candidate pairs (ids only) up to which texts aren't shuffled for the recheck.
BROADCAST_PAIRS = 200_000
GRAM = 3


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and n_tokens, a row for each text (null ones have none)."""
    return df.select(key, F.coalesce(F.size(search.token_array(text)), F.lit(0)).cast("long").alias("n_tokens")).withColumn("n_tokens", F.greatest("n_tokens", F.lit(0)).cast("long"))


def word_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, tf and n_tokens, the length of the text; counts are combined before the shuffle."""
    tokens = df.select(key, search.token_array(text).alias("_t")).select(key, F.size("_t").cast("long").alias("n_tokens"), F.explode("_t").alias("token"))
    return tokens.groupBy(key, "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf")).select(key, "token", "tf", "n_tokens")


def bm25(postings: DataFrame, sizes: DataFrame, key: str, terms: list[str], k: int, texts_a_block: int = BLOCK_TEXTS) -> DataFrame:
    """The ``k`` best texts for any of the terms: key and score (6 places), best first, equals by key.

    Exact, without scoring every hit. Texts fall into blocks by a hash. A block's bound is the sum, over the terms, of what its largest tf and its least length
    would score; the ``k`` blocks of the largest bounds are scored in full, and the k-th score found there is what a further block's bound has to reach to be scored at all.
    """
    spark, wanted = postings.sparkSession, sorted({search.fold_text(t) for t in terms})
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    n, mean = total["n"], total["mean"] or 1.0
    block = F.pmod(F.xxhash64(key), F.lit(max(1, n // texts_a_block)))
    hits = staged(spark, postings.where(F.col("token").isin(wanted)).select(key, "token", "tf", "n_tokens", block.alias("block")), "hits")
    rarity = {r["token"]: math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term
    if not rarity:
        return hits.select(key, F.lit(0.0).alias("score"))
    idf = F.create_map(*[F.lit(x) for kv in sorted(rarity.items()) for x in kv])[F.col("token")]
    impact = lambda tf, size: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    bounds = hits.groupBy("block", "token").agg(F.max("tf").alias("tf"), F.min("n_tokens").alias("size")).withColumn("most", impact(F.col("tf"), F.col("size")))
    bounds = staged(spark, bounds.groupBy("block").agg(F.sum("most").alias("most")), "bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        some = hits.join(blocks.select("block"), "block", "left_semi").withColumn("part", impact(F.col("tf"), F.col("n_tokens")))
        # parts are summed in the order of the terms, so that equal texts have equal scores
        parts = F.array_sort(F.collect_list(F.struct("token", "part")))  # a part a term at most
        summed = some.groupBy(key).agg(parts.alias("parts")).select(key, F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))
        return summed.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)

    first = scored(bounds.orderBy(F.desc("most"), "block").limit(k)).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).first()
    least = first["least"] if first["found"] == k else 0.0
    return scored(bounds.where(F.col("most") >= least - 1e-6))


#: Characters of texts whose trigrams are found at once, about.
BLOCK_CHARACTERS = 1 << 19


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts (the second column), of about so many characters each, one text at least."""
    for batch in batches:
        texts, first, size = [], 0, 0
        for at, value in enumerate(batch.column(1)):
            text = value.as_py() or ""
            if texts and size + len(text) > BLOCK_CHARACTERS:
                yield batch.slice(first, at - first), texts
                texts, first, size = [], at, 0
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(first), texts


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The distinct runs of three characters of each text: the text's place and the run's, and the runs."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = of[:-2] == of[2:]
    runs, which = np.unique((codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42))[inside], return_inverse=True)
    pairs = np.unique(of[:-2][inside] * max(1, len(runs)) + which)
    letters = np.stack([runs >> np.uint64(k) & np.uint64((1 << 21) - 1) for k in (0, 21, 42)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return pairs // max(1, len(runs)), pairs % max(1, len(runs)), pa.array([letters[k : k + GRAM] for k in range(0, len(letters), GRAM)], pa.string())


#: Grams up to which postings for a search leave out all others as they are made.
WANTED_GRAMS = 100_000


def grams_of(needles: DataFrame, needle: str) -> list[str] | None:
    """All grams of some needles, None where they are many."""
    found = needles.select(F.explode(search.trigrams(needle)).alias("gram")).distinct().limit(WANTED_GRAMS + 1).collect()
    return [r["gram"] for r in found] if len(found) <= WANTED_GRAMS else None


def trigram_postings(df: DataFrame, key: str, text: str, wanted: list[str] | None = None) -> DataFrame:
    """key and gram: the distinct runs of three characters of each text, in lower case; or those of them that are wanted."""
    rows = df.select(key, F.lower(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches):
            of, which, runs = _trigrams(texts)
            if wanted is not None:
                kept = pc.is_in(runs, value_set=pa.array(wanted, pa.string())).to_numpy(zero_copy_only=False)[which]
                of, which = of[kept], which[kept]
            for k in range(0, len(of), 1 << 16):  # a long text has many
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[part])), runs.take(pa.array(which[part]))], names=[key, "gram"])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("gram", StringType())]))


def trigram_counts(df: DataFrame, text: str) -> DataFrame:
    """gram and n, the texts that have it; counted in each block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches):
            _, which, runs = _trigrams(texts)
            yield pa.RecordBatch.from_arrays([runs, pa.array(np.bincount(which, minlength=len(runs)), pa.int64())], names=["gram", "n"])

    found = df.select(F.lit(0).alias("_"), F.lower(text).alias("_text")).mapInArrow(run, "gram string, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def substring_search(spark: SparkSession, postings: DataFrame, texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str, most: int = 3) -> DataFrame:
    """Pairs of needles and texts that hold them, ignoring case: needle_key and key.

    Of each needle's trigrams the ``most`` rarest are looked up, the rarest first: its postings are the candidates, and each further one keeps those that it has too. The texts of the candidates are then read
    to check. Needles of fewer than three characters have no trigram and are sought in all texts by one pass.
    """
    asked = needles.select(F.col(needle_key).alias("_id"), F.lower(needle).alias("_needle")).where("_needle IS NOT NULL")
    grams = staged(spark, asked.select("_id", F.explode(search.trigrams("_needle")).alias("gram")), "grams")
    lists = staged(spark, postings.join(grams.select("gram").distinct(), "gram", "left_semi").select("gram", key), "postings")
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    chosen = staged(spark, grams.join(sizes, "gram", "left").withColumn("place", place).where(F.col("place") <= most).select("_id", "gram", "place"), "rarest")
    pairs = chosen.where("place = 1").join(lists, "gram").select("_id", key)
    for k in range(2, most + 1):
        more = chosen.where(F.col("place") == k)
        # needles with fewer grams keep what they have
        met = pairs.join(more.select("_id", "gram"), "_id", "left")
        pairs = met.where("gram IS NOT NULL").join(lists, ["gram", key], "left_semi").select("_id", key).unionByName(met.where("gram IS NULL").select("_id", key))
    pairs = staged(spark, pairs.join(asked, "_id"), "candidates")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    checked = texts.select(key, F.lower(text).alias("_text")).join(F.broadcast(pairs) if few else pairs, key).where(F.contains("_text", "_needle")).select("_id", key)
    short = asked.where(F.length("_needle") < GRAM)
    found = multipattern.occurrences(short, "_needle", texts.select(key, F.lower(text).alias("_text")), "_text").select(key, F.col("needle").alias("_needle"))
    return checked.unionByName(short.join(found, "_needle").select("_id", key)).withColumnRenamed("_id", needle_key).distinct()
