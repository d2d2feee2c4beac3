"""Source trees: recursive scan with the reference's skip rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a source and what is skipped.
EXTENSIONS = ("prw", "tlpp", "prx", "apw")
SKIPPED_SUFFIXES = (".bak", ".corrupted.bak", ".old", ".bak2", ".tmp", "~")
SKIPPED_FOLDERS = (".git", "node_modules", ".venv")
MOST_BYTES = 5_000_000


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Sources below a folder: arquivo (the name, unique ignoring case: the first path wins), relative path, type, size, time and bytes.

    Names are filtered on the listing (a glob of the reader), so nothing else is opened; paths are relative to the folder, and only folders
    below it are skipped.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    either = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(root)
    relative = F.substring("path", len(base) + 2, 1 << 30)
    name, folders = F.element_at(F.split("path", "/"), -1), F.split(relative, "/")
    kept = files.where(F.lower(name).rlike(rf"\.({'|'.join(EXTENSIONS)})$")).where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES))
    for s in SKIPPED_SUFFIXES:
        kept = kept.where(~F.endswith(name, F.lit(s)))
    for f in SKIPPED_FOLDERS:
        kept = kept.where(~F.array_contains(folders, f))
    first = kept.groupBy(F.lower(name).alias("key")).agg(F.min("path").alias("path")).select("path")
    columns = [
        name.alias("arquivo"), relative.alias("caminho_relativo"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("tipo_arquivo"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"),
    ]
    return kept.join(first, "path", "left_semi").select(*columns, *(["content"] if content else []))


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found sources that are new by name or newer than stored."""
    known = stored.select(F.col("arquivo").alias("known"), F.col("mtime_ns").alias("known_ns"))
    return found.join(known, F.col("arquivo") == F.col("known"), "left").where("known IS NULL OR mtime_ns > known_ns").drop("known", "known_ns")
