"""Tables that grow by batches: each batch is a partition of its own, and what it holds of a key replaces what earlier batches held.

Written with Spark's writers, each batch to the path of its partition in overwrite mode (a batch that runs again replaces itself), read with one anti join. A batch writes
its own rows only, whatever the tables hold already. The key table ``KEYS`` is written last: a batch counts from then on, and a key without other rows in its last batch is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "keys"
#: Replaced (key, batch) pairs up to this number are anti-joined by broadcast, more by a shuffle.
BROADCAST_REPLACED = 200_000


def _write(df: DataFrame, path: str, batch: int, partitions: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(f"{path}/batch={batch}")


def put(tables: dict[str, DataFrame], keys: DataFrame, folder: str, batch: int, partitions: dict[str, tuple[str, ...]] | None = None) -> None:
    """A batch of some tables; ``keys`` has each key that it replaces once."""
    for name, df in tables.items():
        _write(df, f"{folder}/{name}", batch, (partitions or {}).get(name, ()))
    _write(keys, f"{folder}/{KEYS}", batch)


def keys(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The rows of the key table that count: of each key, those of its last batch."""
    found = spark.read.parquet(f"{folder}/{KEYS}")
    last = found.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last"))
    return found.join(last, (F.col(key) == F.col("_key")) & (F.col("batch") == F.col("_last")), "left_semi")


def last(spark: SparkSession, folder: str) -> int:
    """The number of the last batch."""
    return spark.read.parquet(f"{folder}/{KEYS}").agg(F.max("batch")).first()[0]


def current(spark: SparkSession, folder: str, name: str, key: str, table_key: str | None = None, columns: str | None = None) -> DataFrame:
    """The rows of a table that count, with their ``batch``. The table itself isn't shuffled where few keys were replaced.

    ``columns`` beside the key, as a schema, are needed where a table with partitions of its own may be empty and so has no file to tell them.
    """
    every = spark.read.parquet(f"{folder}/{KEYS}")
    logged = every.select(F.col(key).alias("_key"), F.col("batch").alias("_batch"))
    reader = spark.read if columns is None else spark.read.schema(f"{table_key or key} {every.schema[key].dataType.simpleString()}, {columns}, batch long")
    found = reader.parquet(f"{folder}/{name}")
    # what a batch has written before its keys doesn't count yet
    counted = [r["_batch"] for r in logged.select("_batch").distinct().collect()]
    found = found.where(F.col("batch").isin(counted))
    if len(counted) == 1:
        return found
    last = logged.groupBy(F.col("_key").alias("_again")).agg(F.max("_batch").alias("_last"))
    replaced = logged.join(last, (F.col("_key") == F.col("_again")) & (F.col("_batch") < F.col("_last")), "left_semi")
    few = replaced.limit(BROADCAST_REPLACED + 1).count() <= BROADCAST_REPLACED
    at = F.col(table_key or key)
    return found.join(F.broadcast(replaced) if few else replaced, (at == F.col("_key")) & (F.col("batch") == F.col("_batch")), "left_anti")


def compact(spark: SparkSession, folder: str, target: str, names: dict[str, str], key: str, partitions: dict[str, tuple[str, ...]] | None = None) -> None:
    """All that counts, as one batch of another folder; ``names`` has the key column of each table."""
    rows = keys(spark, folder, key)
    batch = rows.agg(F.max("batch")).first()[0]
    put({n: current(spark, folder, n, key, k).drop("batch") for n, k in names.items()}, rows.drop("batch"), target, batch, partitions)
