"""The jobs as queries: each runs twice into a new folder of the shared directory; what is read back is the output after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import findings, search_index
from sablefish.operators import search
from sablefish.sources.staging import shared_path


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job1")
    for _ in range(2):
        search_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return search_index.words(spark, f"{folder}/index")


def job2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job2")
    for _ in range(2):
        findings.run(spark, sf_dir, folder)
    return findings.read(spark, folder)


QUERIES = {"job1_search_index": job1_search_index, "job2_findings": job2_findings}
ORACLES = {"job1_search_index": search_index.oracle_sql(search.ACCENTED, search.PLAIN), "job2_findings": findings.oracle_sql()}
