"""A training-data pipeline over ``documents``: language, lines, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``.

What a stage drops: the first, documents without a letter (no language can be told), and those whose best language
has a share below ``LEAST_SCORE`` of the network's pooled distribution, where there is something to learn from; the
second, repeated lines, and documents that hold nothing else; the third, all but one document
of each near-duplicate component; the fourth, what the mixture doesn't sample; the last, nothing.
Null texts go in the first stage; rows equal in id and text are one document from the third stage on, rows of one id and
different texts are different documents; further columns are passed through the first four stages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefish.llm import langid, linededup, mixing, neardup, packing
from sablefish.llm.common import documents, shared_path, staged

#: Texts of sf0.1 have 0.34 at least, random characters, base64 and hexadecimal runs 0.05 at most.
LEAST_SCORE = 0.15
#: Ids of dropped documents up to this number are anti-joined by broadcast, more by a shuffle.
BROADCAST_IDS = 200_000


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others as one, ``doc_row``: these can't clash with its own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(F.struct(*(others or [F.lit(1).alias("none")])).alias("doc_row"), *needed)


def _unpacked(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return out.select(*[F.col(c) if c in needed else F.col("doc_row").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, packed = langid.learn(spark, docs), _packed(docs, "text")
    if model is None:
        # without a model every text is predicted as unknown
        return _unpacked(langid.lettered(packed), docs, "text")
    named = langid.predict(packed, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(named, docs, "text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(spark, _packed(docs, "doc_id", "text")).where("NOT (n_lines > 0 AND n_exact + n_near = n_lines)")
    out = _unpacked(out, docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = staged(spark, counts.where("n > 1").select(F.col("doc_id").alias("repeated_id")), "repeated-ids")
    rows = _packed(docs, "text").withColumns({"doc_id": F.col("doc_row.doc_id").cast("long"), "again": F.lit(False)})
    if repeated.limit(1).count():
        # rows of one id are told apart by their texts
        again = F.col("repeated_id").isNotNull()
        met = rows.join(repeated, F.col("doc_id") == F.col("repeated_id"), "left").withColumn("again", again)
        rows = met.withColumn("doc_id", F.when(again, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop("repeated_id")
    classes = neardup.classes(spark, rows.select("doc_id", "text"))
    gone = staged(spark, classes.where(~F.col("kept")).select("doc_id").distinct(), "near-duplicates")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if repeated.limit(1).count():
        kept = kept.where("NOT again").unionByName(kept.where("again").dropDuplicates(["doc_id"]))
    return _unpacked(kept, docs, "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    needed = ("doc_id", "text", "source", "lang")
    return _unpacked(mixing.mix(spark, _packed(docs, *needed)), docs, *needed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, packing.token_pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The network of the first stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
