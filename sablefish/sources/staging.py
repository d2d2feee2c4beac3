"""Tables staged between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on a single machine (tests) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sablefish-"))
    return context.getCheckpointDir().rstrip("/")


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{shared_dir(spark)}/sablefish-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(spark: SparkSession, df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder, or to a folder in it, and read again.

    Cuts the lineage, so a lost executor costs only the tasks of the current step, and
    puts a plain scan under later joins, which lets adaptive execution split hot keys.
    """
    path = f"{folder}/{name}" if folder else shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a staged table, or a folder of such, that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def discard(spark: SparkSession) -> None:
    """Removes all tables staged so far; for callers that have stored their results."""
    while _made:
        remove(spark, _made[-1])
