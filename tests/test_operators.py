"""Relational, positional, graph and search operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from sablefish.operators import commands, graph, positional, render, search
from sablefish.operators import relational as R


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_one_prefix_is_stripped():
    assert commands.normalize("U_UPDFOO") == "UPDFOO"


def test_contains_word_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("A1XCOD",), ("x A1_COD,",), ("BA1_CODE",), (None,)], "t string")
    assert values(df.where(R.contains_word("t", "a1_cod"))) == [("x A1_COD,",)]


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert values(R.last_wins(df, ["k"], ["o"]), "k", "v", "lost") == [(1, "b", 1), (2, "c", 0)]


def test_missing_target_needs_a_catalog(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    known = spark.createDataFrame([("a",)], "k string")
    assert values(R.missing_target(df, "t", known, "k")) == [("b",)]
    assert values(R.missing_target(df, "t", known.limit(0), "k")) == []


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "k string, v int")
    assert values(R.snapshot_diff(old, new, "k", "v")) == [("b", "stale"), ("c", "deleted"), ("d", "new")]


def test_first_nonempty(spark):
    none, some = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,)], "x int")
    assert values(R.first_nonempty([("a", none), ("b", some), ("c", some)])) == [(1, "b")]


def test_exact_or_prefix(spark):
    catalog = spark.createDataFrame([("MATA010", "EST"), ("MATA020", "COM"), ("FINA040", "FIN")], "r string, module string")
    df = spark.createDataFrame([("mata010",), ("MATA999",), ("FINA999",), ("X",)], "n string")
    assert sorted((r["n"], r["module"]) for r in R.exact_or_prefix(df, "n", catalog, "r", "module").collect()) == [("FINA999", "FIN"), ("MATA999", None), ("X", None), ("mata010", "EST")]


def test_prefix_groups_suppress_covered_prefixes(spark):
    df = spark.createDataFrame([("f", n, i) for i, n in enumerate(["PedIncA", "PedIncB", "PedIncC", "PedX"])], "s string, n string, l int")
    assert values(R.prefix_groups(df, "s", "n", "l"), "prefix", "n") == [("pedinc", 3)]


def test_redact(spark):
    df = spark.createDataFrame([("http://u:p@h/x " + "a" * 40,)], "t string")
    assert values(df.select(R.redact(F.col("t")))) == [("https://[REDACTED]@h/x [REDACTED]",)]


def test_page(spark):
    df = spark.range(10)
    assert values(R.page(df, [F.col("id")], 8, 5)) == [(8, 10, False), (9, 10, False)]


def test_innermost(spark):
    points = spark.createDataFrame([(5,), (15,), (99,)], "p int")
    ranges = spark.createDataFrame([(0, 20, "big"), (4, 6, "small"), (10, 12, "other")], "s int, e int, name string")
    assert values(positional.innermost(points, "p", ranges, "s", "e", "name", 4)) == [(5, "small"), (15, "big"), (99, None)]


def test_unmatched_and_ranges(spark):
    opens = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "s string, o int")
    closes = spark.createDataFrame([("a", 3)], "s string, o int")
    assert values(positional.unmatched(opens, closes, ["s"], "o")) == [("a", 5), ("b", 2)]
    assert values(positional.range_ends(opens, ["s"], "o", F.lit(9))) == [("a", 1, 4), ("a", 5, 9), ("b", 2, 9)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reach(edges, seeds, 9)) == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]
    assert values(graph.cascade(edges, seeds, 2)) == [(1, "a", "b", "a"), (1, "b", "a", "a"), (2, "b", "c", "b")]
    assert graph.clamp_depth(0) == 1


@pytest.mark.parametrize(
    ("query", "hits"),
    [("foo bar", [1]), ("foo OR baz", [1, 2, 3]), ("foo NOT bar", [3]), ('"bar foo"', []), ('"foo bar"', [1]), ("ba*", [1, 2]), ("(foo OR baz) AND bar", [1]), ("acao", [4]), ("a-b", [4])],
)
def test_search(spark, query, hits):
    df = spark.createDataFrame([(1, "Foo, bar!"), (2, "baz"), (3, "foo"), (4, "Ação a-b"), (5, None)], "id int, t string")
    assert [r[0] for r in values(search.search(df, "t", query), "id")] == hits


def test_search_syntax():
    for bad in ("", "foo AND", "(foo", "->", "NOT x"):
        with pytest.raises(search.SearchSyntaxError):
            search.parse(bad)


def test_highlight(spark):
    df = spark.createDataFrame([("one two three foo bar four five",)], "t string")
    assert values(df.select(search.highlight(F.col("t"), ["foo", "bar"], 3))) == [("...[foo] [bar] four...",)]


def test_phrase_count_and_index_gap(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "c")], "id int, t string")
    assert values(df.select("id", search.phrase_count(search.token_array("t"), "a b"))) == [(1, 2), (2, 0)]
    tokens = search.token_table(df.where("id = 1"), "id", "t")
    assert values(search.index_gap(df, tokens, "id"), "id") == [(2,)]


def test_render(spark):
    df = spark.createDataFrame([(1, "a|b\nc", ["x"]), (2, None, [])], "k int, t string, l array<string>").orderBy("k")
    assert json.loads(render.as_json(df, 1)) == {"rows": [{"k": 1, "t": "a|b\nc", "l": ["x"]}], "total": 2, "shown": 1, "truncated": True}
    assert render.as_markdown(df).splitlines()[2] == '| 1 | a\\|b c | ["x"] |'
    assert render.as_table(df, 1).splitlines()[-1] == "(1 of 2 rows)"
    assert "# F" in render.doc_page({"funcao": "F", "params": [{"name": "a", "optional": True, "type": "x", "desc": "y"}], "deprecated": True})


def test_innermost_looks_each_place_up_once(spark):
    points = spark.range(2000).selectExpr("id", "CAST(id % 10 AS INT) AS p").unionByName(spark.createDataFrame([(-1, None)], "id long, p int"))
    ranges = spark.createDataFrame([(0, 20, "big"), (4, 6, "small"), (9, 3, "none")], "s int, e int, name string")
    found = positional.innermost(points, "p", ranges, "s", "e", "name", 4)
    assert found.count() == 2001 and {(r.p, r.name) for r in found.collect()} == {(p, "small" if p and 4 <= p <= 6 else "big" if p is not None else None) for p in [*range(10), None]}
    # points come to the join of ranges as distinct places: no id is in it or in an aggregate
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("id#" in line for line in plan.splitlines() if "Aggregate" in line)
