"""Checks tables of texts against a list of rules and stores the findings, a row for each rule and line that it is found in.

A rule has literals (all literals of all rules are sought in one pass by an automaton), a pattern, or a length that lines mustn't exceed. The job writes

    findings (table_name, rule_id, severity, key, line, n, snippet), partitioned by table_name and rule_id, and
    summary (table_name, rule_id, severity, lines, texts, n), as CSV,

both anew in each run, so that a rerun has the same result and no finding outlives its text or rule. Snippets are redacted.

    python -m jobs.findings --input FOLDER --output FOLDER [--config FILE] [--fail-on SEVERITY]

The folder has a Parquet table for each name under ``tables`` in the config, which says what columns are its key and text. Null texts have no findings; a rule that finds several things in a line counts
them in ``n`` (literals with overlaps). With ``--fail-on`` the exit code is 1 where something of that severity or a higher one was found.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from sablefish.operators import multipattern
from sablefish.operators import relational as R
from sablefish.sources import spread

COLUMNS = ("table_name", "rule_id", "severity", "key", "line", "n", "snippet")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1) and the line's text; null texts have none."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "content"))
    return rows.select("key", (F.col("at") + 1).alias("line"), "content")


def found_by_expressions(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """Patterns and lengths: one projection, which keeps lines with a finding only."""
    hits = [F.lit(None).cast("struct<rule_id:string,n:bigint>")]
    for r in rules:
        n = F.regexp_count("content", F.lit(r["pattern"])) if "pattern" in r else (F.length("content") > r["longer_than"]).cast("int")
        hits.append(F.when(n > 0, F.struct(F.lit(r["id"]).alias("rule_id"), n.cast("long").alias("n"))))
    return lines.select("key", "line", "content", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("key", "line", "content", "hit.*")


def found_by_literals(spark: SparkSession, lines: DataFrame, rules: list[dict]) -> DataFrame:
    """All literals of all rules in one pass over the lines."""
    pairs = sorted({(r["id"], x) for r in rules for x in r["literals"] if x})
    needles = spark.createDataFrame(pairs, "rule_id string, literal string")
    found = multipattern.occurrences(needles, "literal", lines.withColumn("searched", F.col("content")), "searched")
    named = found.join(F.broadcast(needles), F.col("needle") == F.col("literal"))  # as many rows as the config has
    return named.groupBy("key", "line", "content", "rule_id").agg(F.sum(F.size("places")).alias("n"))


def findings(spark: SparkSession, tables: dict[str, DataFrame], options: dict) -> DataFrame:
    """The findings in some tables."""
    severity = F.create_map(*[F.lit(x) for r in options["rules"] for x in (r["id"], r["severity"])])
    literal, other = [r for r in options["rules"] if "literals" in r], [r for r in options["rules"] if "literals" not in r]
    out = None
    for name, df in tables.items():
        lines = lines_of(spread(df), options["tables"][name]["key"], options["tables"][name]["text"])
        parts = [found_by_expressions(lines, other)] if other else []
        parts += [found_by_literals(spark, lines, literal)] if literal else []
        for part in parts:
            rows = part.withColumns({"table_name": F.lit(name), "severity": severity[F.col("rule_id")], "snippet": R.collapse(R.redact(F.col("content")), options["snippet"])})
            out = rows.select(*COLUMNS) if out is None else out.unionByName(rows.select(*COLUMNS))
    return out


def run(spark: SparkSession, folder: str, output: str, config: dict | None = None) -> DataFrame:
    """Writes findings and summary of the folder's tables below ``output``; returns the summary."""
    options = common.config("findings") | (config or {})
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet").select(t["key"], t["text"]) for n, t in options["tables"].items()}
    for name, df in tables.items():
        common.log.info("findings: read %d rows of %s/%s.parquet", df.count(), folder, name)
    rows = findings(spark, tables, options)
    # one layout for all partitions: a file or few each, large ones split by lines
    rows = rows.repartition("table_name", "rule_id", F.pmod(F.xxhash64("key", "line"), F.lit(options.get("files_per_rule", 8))))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("table_name", "rule_id").parquet(f"{output}/findings")
    stored = read(spark, output)
    summary = stored.groupBy("table_name", "rule_id", "severity").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("key").alias("texts"), F.sum("n").alias("n"))
    summary.coalesce(1).orderBy("table_name", R.severity_rank("severity"), "rule_id").write.mode("overwrite").csv(f"{output}/summary", header=True)
    out = spark.read.csv(f"{output}/summary", header=True, schema="table_name string, rule_id string, severity string, lines long, texts long, n long")
    for r in out.collect():  # a row a table and rule
        common.log.info("findings: wrote %d lines of %d texts for %s (%s) in %s", r["lines"], r["texts"], r["rule_id"], r["severity"], r["table_name"])
    return out


def read(spark: SparkSession, output: str) -> DataFrame:
    """The stored findings."""
    schema = "severity string, key string, line int, n long, snippet string, table_name string, rule_id string"
    return spark.read.schema(schema).parquet(f"{output}/findings").select(*COLUMNS)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.findings")
    for name in ("input", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    p.add_argument("--fail-on", choices=R.SEVERITIES)
    args = p.parse_args(argv)
    options = common.config("findings", args.config)
    spark = common.session("findings")
    try:
        summary = run(spark, args.input, args.output, options)
        bad = R.SEVERITIES[: R.SEVERITIES.index(args.fail_on) + 1] if args.fail_on else ()
        return int(not summary.where(F.col("severity").isin(*bad)).isEmpty()) if bad else 0
    finally:
        spark.stop()


def oracle_sql() -> str:
    """The findings in DuckDB's SQL."""
    options = common.config("findings")
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for name, t in options["tables"].items():
        parts.append(f"l_{name} AS (SELECT key, i AS line, ls[i] AS content FROM (SELECT key, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT {t['key']}::VARCHAR AS key, string_split({t['text']}, chr(10)) AS ls FROM {name})))")
    found = []
    for name in options["tables"]:
        for r in options["rules"]:
            if "pattern" in r:
                n = f"len(regexp_extract_all(content, {q(r['pattern'])}))"
            elif "longer_than" in r:
                n = f"(length(content) > {r['longer_than']})::BIGINT"
            else:
                n = " + ".join(f"CASE WHEN contains(content, {q(x)}) THEN len(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, {len(x)}) = {q(x)})) ELSE 0 END" for x in r["literals"])
            found.append(f"SELECT {q(name)} AS table_name, {q(r['id'])} AS rule_id, {q(r['severity'])} AS severity, key, line, {n} AS n, content FROM l_{name}")
    redacted = r"regexp_replace(regexp_replace(content, 'https?://[^\s:@/]+:[^\s@/]+@', 'https://[REDACTED]@', 'g'), '\b[0-9a-fA-F]{40,}\b', '[REDACTED]', 'g')"
    cut = options["snippet"]
    return f"""WITH {', '.join(parts)}, f AS ({' UNION ALL '.join(found)}), s AS (SELECT *, trim(regexp_replace({redacted}, '[ \\t\\r\\n]+', ' ', 'g')) AS s FROM f WHERE n > 0)
SELECT table_name, rule_id, severity, key, line, n, CASE WHEN length(s) > {cut} THEN s[1:{cut - 1}] || '…' ELSE s END AS snippet FROM s"""


if __name__ == "__main__":
    sys.exit(main())
