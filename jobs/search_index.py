"""Keeps a search index of a table of texts: word postings with lengths (for ranking), and trigram postings if wanted.

Incremental: a file stream takes the files that its checkpoint doesn't know yet, in batches, and stops when all are read. A batch writes its own
postings only; what it holds of an id replaces what the index had of it (a null or empty text leaves the id without words). A batch that fails is read again with the same
number and overwrites itself; a run without new files writes nothing.

    python -m jobs.search_index --input TABLE --output FOLDER --checkpoint FOLDER [--config FILE] [--search WORDS]

Output below the folder: ``words`` (id, token, tf, n_tokens), partitioned by batch and bucket, ``trigrams`` (id, gram) likewise, and ``keys`` (id, n_tokens), partitioned by batch.
Config: the columns of the key and the text, ``buckets`` (parts of a batch, by a hash of the id) and ``files_per_bucket`` (at least; more for a large batch), ``files_per_batch``, and ``trigrams``.

Rows without an id are left out (and counted in the log); of several rows of an id in one batch the largest text counts.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from sablefish.operators import postings
from sablefish.sources.staging import staged
from sablefish.streaming import batches

PARTITIONS = ("bucket",)


#: Bytes of texts whose postings make a file of a bucket, about: what a task reads stays the same however large a batch is.
BYTES_PER_FILE = 8 << 20


def _spread(df: DataFrame, key: str, by: str, options: dict, size: int) -> DataFrame:
    """``df`` with ``bucket``, dealt out so that a bucket has so many files: those of the options, or more where the batch's texts are large."""
    files = max(options["files_per_bucket"], -(-size // (options["buckets"] * BYTES_PER_FILE)))
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(options["buckets"])).cast("int"))
    # by number, as hashes of few pairs would put several into one task and none into others
    part = F.col("bucket") * files + F.pmod(F.xxhash64(by), F.lit(files)).cast("int")
    return out.repartitionById(options["buckets"] * files, part)


#: Ids that a batch has several times, up to which its texts aren't shuffled to make them one.
BROADCAST_REPEATED = 200_000


def one_a_key(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and text, each key once, with its largest text. Only the texts of repeated keys are brought together."""
    known = rows.select(key, text).where(F.col(key).isNotNull())
    repeated = staged(rows.sparkSession, known.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated-keys")
    some = repeated.limit(BROADCAST_REPEATED + 1).count()
    if not some:
        return known
    near = F.broadcast(repeated) if some <= BROADCAST_REPEATED else repeated
    several = known.join(near, key, "left_semi").groupBy(key).agg(F.max(text).alias(text))
    return known.join(near, key, "left_anti").unionByName(several)


def write_batch(rows: DataFrame, output: str, number: int, options: dict) -> None:
    """The postings of a batch of rows (key and text)."""
    key, text = options["key"], options["text"]
    read = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("none"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    texts = one_a_key(rows, key, text)
    tables = {"words": _spread(postings.word_postings(texts, key, text), key, "token", options, read["size"])}
    if options["trigrams"]:
        tables["trigrams"] = _spread(postings.trigram_postings(texts, key, text), key, "gram", options, read["size"])
    batches.put(tables, postings.lengths(texts, key, text), output, number, dict.fromkeys(tables, PARTITIONS))
    written = rows.sparkSession.read.parquet(f"{output}/{batches.KEYS}/batch={number}").count()
    common.log.info("search_index: batch %d read %d rows, %d without an id, and wrote the postings of %d texts", number, read["n"], read["none"], written)


def run(spark: SparkSession, table: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes all new files of a Parquet table into the index; the number of batches."""
    options = common.config("search_index") | (config or {})
    schema = spark.read.parquet(table).select(options["key"], options["text"]).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", options["files_per_batch"]).option("maxFileAge", "36500d").parquet(common.bracketed(table))
    done = []

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, output, number, options)
        done.append(number)

    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    common.log.info("search_index: %d batches of %s went to %s", len(done), table, output)
    return len(done)


def words(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """The word postings as all batches so far leave them."""
    options = common.config("search_index") | (config or {})
    return batches.current(spark, output, "words", options["key"], columns="token string, tf long, n_tokens long, bucket int").select(options["key"], "token", "tf", "n_tokens")


def trigrams(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    options = common.config("search_index") | (config or {})
    return batches.current(spark, output, "trigrams", options["key"], columns="gram string, bucket int").select(options["key"], "gram")


def best(spark: SparkSession, output: str, terms: list[str], k: int = 10, config: dict | None = None) -> DataFrame:
    """The best texts for some words, from the index alone."""
    key = (common.config("search_index") | (config or {}))["key"]
    return postings.bm25(words(spark, output, config), batches.keys(spark, output, key), key, terms, k)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.search_index")
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    p.add_argument("--search", help="words to look up afterwards")
    args = p.parse_args(argv)
    options = common.config("search_index", args.config)
    spark = common.session("search_index")
    try:
        run(spark, args.input, args.output, args.checkpoint, options)
        if args.search:
            best(spark, args.output, args.search.split(), config=options).show(truncate=False)
    finally:
        spark.stop()


def oracle_sql(accented: str, plain: str) -> str:
    """The index of ``documents`` in DuckDB's SQL."""
    tokens = rf"list_filter(regexp_split_to_array(translate(lower(text), '{accented}', '{plain}'), '[^\p{{L}}\p{{N}}_-]+'), lambda t: t <> '')"
    return f"""WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), k AS (SELECT doc_id, {tokens} AS k FROM d),
t AS (SELECT doc_id, len(k) AS n_tokens, unnest(k) AS token FROM k) SELECT doc_id, token, count(*) AS tf, n_tokens FROM t GROUP BY doc_id, token, n_tokens"""


if __name__ == "__main__":
    main()
