"""Static catalogs: JSON lists as tables, a hash of a bundle of files, rules and routines that are built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import facts, lint
from ..operators import relational as R


def read_catalog(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON file holding a list of objects, a row each; lists stay arrays."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def upsert(stored: DataFrame | None, fresh: DataFrame, key: str) -> DataFrame:
    """Stored catalog rows with those of the same key replaced."""
    return fresh if stored is None else R.replace_by_key(stored, fresh, key)


def bundle_hash(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row with the SHA-256 of the given (small) files, joined in the order of their names."""
    files = spark.read.format("binaryFile").load(paths)
    parts = F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), F.hex("content").alias("hex"))))
    return files.agg(parts.alias("parts")).select(F.sha2(F.unhex(F.array_join(F.col("parts.hex"), "")), 256).alias("bundle"))


def rules(spark: SparkSession) -> DataFrame:
    """The rule catalog: regra_id, severidade, categoria, fix_guidance and whether it looks across tables."""
    rows = [(r, s, r.split("-")[0], lint.advice(r), r not in lint.SINGLE_RULES) for r, s in lint.SEVERITY.items()]
    return spark.createDataFrame(rows, "regra_id string, severidade string, categoria string, fix_guidance string, cross_file boolean")


def routines(spark: SparkSession) -> DataFrame:
    return facts.routine_catalog(spark)


def restricted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in lint.RESTRICTED_NAMES], "nome string")
