"""The reference's query shapes on the relational test tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, multipattern, positional, postings, search
from ..operators import relational as R
from ..sources import TABLES, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Predicates and cascades


@query("""SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog') ORDER BY url, page_id LIMIT 50""")
def find_file(spark, d):
    """The first fifty pages by address whose address holds a text in any case."""
    return table(spark, d, "pages").where(R.contains_nocase("url", "BLOG")).select("page_id", "url").orderBy("url", "page_id").limit(50)


_FIND_PARTS = """
SELECT 'page' AS _kind, 1 AS p, page_id::VARCHAR AS id, url AS name FROM pages WHERE upper(url) = 'NO SUCH PAGE'
UNION ALL SELECT 'url', 2, page_id::VARCHAR, url FROM pages WHERE contains(lower(url), 'casino')
UNION ALL SELECT 'text', 3, doc_id::VARCHAR, lang FROM documents WHERE contains(lower(text), 'casino')"""


@query(f"WITH u AS ({_FIND_PARTS}) SELECT _kind, id, name FROM u WHERE p = (SELECT min(p) FROM u)")
def find_cascade(spark, d):
    """Exact name, else address, else text: the first that finds anything."""
    pages, docs = table(spark, d, "pages"), table(spark, d, "documents")
    named = lambda df, key, name: df.select(F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
    return R.first_nonempty(
        [
            ("page", named(pages.where(R.nocase_equal("url", "no such page")), "page_id", "url")),
            ("url", named(pages.where(R.contains_nocase("url", "Casino")), "page_id", "url")),
            ("text", named(docs.where(R.contains_nocase("text", "Casino")), "doc_id", "lang")),
        ]
    )


@query("""SELECT doc_id, substr(text, greatest(1, strpos(text, 'and the') - 30), 200) AS snippet FROM documents WHERE contains(lower(text), 'and the')""")
def grep_literal(spark, d):
    docs = table(spark, d, "documents").where(R.contains_nocase("text", "And The"))
    return docs.select("doc_id", R.snippet_around(F.col("text"), "and the").alias("snippet"))


@query("""SELECT doc_id, left(text, 200) AS snippet FROM documents WHERE contains(upper(text), 'THERE')""")
def grep_identifier(spark, d):
    """A name, without its leading ``U_``, in any case."""
    name = "U_There".upper().removeprefix("U_")
    return table(spark, d, "documents").where(F.contains(F.upper("text"), F.lit(name))).select("doc_id", F.substring("text", 1, 200).alias("snippet"))


@query(r"""SELECT doc_id FROM documents WHERE contains(lower(text), 'this') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])this($|[^\p{L}\p{N}_])')""")
def grep_boundary(spark, d):
    return table(spark, d, "documents").where(R.contains_word("text", "This")).select("doc_id")


# Word search

_FOLD = f"translate(lower(text), '{search.ACCENTED}', '{search.PLAIN}')"
_TOKENS = rf"list_filter(regexp_split_to_array({_FOLD}, '[^\p{{L}}\p{{N}}_-]+'), lambda t: t <> '')"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents)
SELECT doc_id FROM t WHERE (list_contains(k, 'license') AND list_contains(k, 'under')) OR (list_contains(k, 'rights') AND NOT list_contains(k, 'the'))""")
def fts_and_or(spark, d):
    return search.search(table(spark, d, "documents"), "text", "(license AND under) OR (rights NOT the)").select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS s FROM documents) SELECT doc_id FROM t WHERE contains(s, ' all rights reserved ')""")
def fts_phrase(spark, d):
    return search.search(table(spark, d, "documents"), "text", '"All rights reserved"').select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents) SELECT doc_id, len(list_filter(k, lambda t: starts_with(t, 'licen'))) AS n
FROM t WHERE len(list_filter(k, lambda t: starts_with(t, 'licen'))) > 0""")
def fts_prefix(spark, d):
    docs = table(spark, d, "documents").withColumn("k", search.token_array("text")).where(search.matches("licen*", F.col("k")))
    return docs.select("doc_id", F.size(F.filter("k", lambda t: t.startswith("licen"))).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
tf AS (SELECT token, doc_id, count(*) AS tf FROM t WHERE token IN ('license', 'rights') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT doc_id, round(sum(tf * ln(1 + n / df)), 6) AS score FROM tf JOIN df USING (token), n GROUP BY doc_id""")
def fts_rank(spark, d):
    tokens = search.token_table(table(spark, d, "documents"), "doc_id", "text")
    return search.rank(tokens, "doc_id", ["License", "rights"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def term_topk(spark, d):
    """The fifty most frequent words."""
    tokens = search.token_table(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query("""SELECT page_id, len(list_distinct(list_transform(range(1, len(url) - 1), lambda i: substr(lower(url), i, 3)))) AS n_trigrams FROM pages""")
def trigram_index(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(search.trigrams("url")).cast("long").alias("n_trigrams"))


_TRIGRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr(lower({0}), i, 3)))"


@query("""SELECT b.item_id, d.doc_id FROM (SELECT item_id, lower(substr(text, 20, 24)) AS needle FROM benchmark) b JOIN documents d ON contains(lower(d.text), b.needle)""")
def trigram_search(spark, d):
    """Which texts hold a part of a declared text in any case, by the trigram postings of all texts."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    asked = table(spark, d, "benchmark").select("item_id", F.substring("text", 20, 24).alias("needle"))
    return postings.substring_search(spark, postings.trigram_postings(docs, "doc_id", "text", postings.grams_of(asked, "needle")), docs, "doc_id", "text", asked, "item_id", "needle")


@query(f"""SELECT gram, count(*) AS n FROM (SELECT unnest({_TRIGRAMS.format('text')}) AS gram FROM documents WHERE length(text) >= 3) GROUP BY gram""")
def trigram_counts(spark, d):
    """How many texts have each trigram."""
    return postings.trigram_counts(spread(table(spark, d, "documents").select("text")), "text")


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents), l AS (SELECT count(*) AS n, avg(coalesce(len(k), 0)) AS mean FROM t),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(k) AS size, unnest(k) AS token FROM t) WHERE token IN ('license', 'rights', 'the', 'und') GROUP BY doc_id, token),
f AS (SELECT token, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, l GROUP BY token)
SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) ORDER BY token), 6) AS score FROM p JOIN f USING (token), l GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_top(spark, d):
    """The fifty best texts for some words by BM25."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return postings.bm25(postings.word_postings(docs, "doc_id", "text"), postings.lengths(docs, "doc_id", "text"), "doc_id", ["License", "rights", "the", "und"], 50)


# Calls and impact

_CALLS = r"""SELECT page_id, url, i AS line, unnest(regexp_extract_all(lines[i], 'href="/([^"]*)"', 1)) AS target
FROM (SELECT page_id, url, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT page_id, url, string_split(html, chr(10)) AS lines FROM pages))"""


_UPPER = "translate(target, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _edges(spark, d):
    lines = table(spark, d, "pages").select("page_id", "url", F.posexplode(F.split("html", "\n")).alias("at", "text"))
    found = F.explode(F.regexp_extract_all("text", F.lit(r'href="/([^"]*)"'), F.lit(1)))
    return lines.select("page_id", "url", (F.col("at") + 1).cast("long").alias("line"), found.alias("target"))


@query(f"""WITH e AS ({_CALLS}) SELECT page_id, line, target, contains(upper(url), 'THE') AS is_self_call FROM e WHERE upper(target) = 'THE'""")
def callers(spark, d):
    edges = _edges(spark, d).where(R.nocase_equal("target", "the"))
    return edges.select("page_id", "line", "target", F.contains(F.upper("url"), F.lit("THE")).alias("is_self_call"))


@query(f"""WITH e AS ({_CALLS}) SELECT url, line, {_UPPER} AS target, count(*) AS n FROM e WHERE contains(lower(url), '.org') GROUP BY ALL""")
def callees(spark, d):
    edges = _edges(spark, d).where(R.contains_nocase("url", ".ORG"))
    return edges.groupBy("url", "line", R.normalized_name("target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS ({_CALLS}) SELECT {_UPPER} AS target, count(*) AS calls, count(DISTINCT page_id) AS pages FROM e GROUP BY 1 ORDER BY calls DESC, target LIMIT 20""")
def most_called(spark, d):
    """The twenty most called targets."""
    rows = _edges(spark, d).groupBy(R.ascii_upper("target").alias("target")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("page_id").alias("pages"))
    return rows.orderBy(F.desc("calls"), "target").limit(20)


_IMPACT = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text")]
_IMPACT_HARD = ("LICENSE", "TOKEN =")


def _impact_sql(term: str) -> str:
    hit = rf"regexp_matches(lower({{0}}), '(^|[^\p{{{{L}}}}\p{{{{N}}}}_]){term}($|[^\p{{{{L}}}}\p{{{{N}}}}_])')"
    parts = []
    for t, key, text in _IMPACT:
        flat = f"trim(regexp_replace(substr({text}, greatest(1, strpos(lower({text}), '{term}') - 60), 160), '[ \\t\\r\\n]+', ' ', 'g'))"
        parts.append(f"SELECT '{t}' AS tipo, {key}::VARCHAR AS local, {flat} AS contexto FROM {t} WHERE contains(lower({text}), '{term}') AND {hit.format(text)}")
    union = " UNION ALL ".join(parts)
    hard = " OR ".join(f"contains(upper(contexto), '{w}')" for w in _IMPACT_HARD)
    return f"""WITH u AS ({union}), s AS (SELECT tipo, local, contexto, CASE WHEN {hard} THEN 'critical' ELSE 'warning' END AS severidade FROM u)
SELECT *, CASE severidade WHEN 'critical' THEN 0 ELSE 2 END AS rank FROM s"""


@query(_impact_sql("license"))
def impact_union(spark, d):
    """Where a term occurs in any text table, with context and severity, most severe first."""
    term = "license"
    out = None
    for name, key, text in _IMPACT:
        at = F.greatest(F.lit(1), F.instr(F.lower(text), term) - 60)
        rows = table(spark, d, name).where(R.contains_word(text, term)).select(
            F.lit(name).alias("tipo"), F.col(key).cast("string").alias("local"), R.collapse(F.substr(F.col(text), at, F.lit(160))).alias("contexto")
        )
        out = rows if out is None else out.unionByName(rows)
    hard = F.lit(False)
    for w in _IMPACT_HARD:
        hard = hard | F.contains(F.upper("contexto"), F.lit(w))
    out = out.withColumn("severidade", F.when(hard, "critical").otherwise("warning"))
    return out.withColumn("rank", R.severity_rank("severidade")).orderBy("rank", "tipo", "local")


def _supply(spark, d):
    items = table(spark, d, "lineitem")
    return items.select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst")).distinct()


_SUPPLY = "SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem"


_CASCADE_STEPS = f"WITH e AS ({_SUPPLY}) SELECT src, dst FROM e UNION SELECT dst, src FROM e"


def _levels_sql(steps: str, seed: str, depth: int) -> str:
    """Nodes by level with the smallest parent, level by level (deduplicated on both sides)."""
    parts = [f"step AS MATERIALIZED ({steps})", f"n0 AS (SELECT '{seed}' AS node, 0 AS level, NULL::VARCHAR AS via)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM n{j}" for j in range(k))
        parts.append(f"n{k} AS MATERIALIZED (SELECT dst AS node, {k} AS level, min(src) AS via FROM step JOIN n{k - 1} ON src = node WHERE dst NOT IN ({seen}) GROUP BY dst)")
    return ", ".join(parts)


@query(f"WITH {_levels_sql(_CASCADE_STEPS, 'P1', 3)} SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3")
def impact_chain(spark, d):
    """What a part reaches through shared suppliers within three steps."""
    seeds = spark.createDataFrame([("P1",)], "node string")
    return graph.reach(_supply(spark, d), seeds, 3, both_ways=True)



@query(f"""WITH {_levels_sql(_CASCADE_STEPS, 'S5', 2)}, near AS (SELECT node, level FROM n0 UNION ALL SELECT node, level FROM n1), e AS ({_SUPPLY}),
taken AS (SELECT level + 1 AS level, src, dst, src AS via FROM e JOIN near ON src = node UNION ALL SELECT level + 1, src, dst, dst FROM e JOIN near ON dst = node),
best AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY level, via) AS k FROM taken) SELECT level, src, dst, via FROM best WHERE k = 1""")
def link_cascade(spark, d):
    """The edges around a supplier in either direction within two steps, each once."""
    seeds = spark.createDataFrame([("S5",)], "node string")
    return graph.cascade(_supply(spark, d), seeds, 2)


# Joins


@query("""SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'write' WHEN quality = 1 THEN 'read' ELSE 'reclock' END AS modo FROM documents JOIN labels USING (doc_id)
WHERE CASE WHEN toxic = 1 THEN 'write' WHEN quality = 1 THEN 'read' ELSE 'reclock' END <> 'read'""")
def tables_by_mode(spark, d):
    mode = F.when(F.col("toxic") == 1, "write").when(F.col("quality") == 1, "read").otherwise("reclock")
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", mode.alias("modo")), "doc_id")
    return rows.where("modo <> 'read'")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')""")
def unused_declared(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return R.unused(table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1)""")
def unused_group_distinct(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    used = table(spark, d, "part").join(items, "p_partkey", "left_semi").select("p_name")
    return R.unused(table(spark, d, "part").select("p_name").distinct(), used, "p_name")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND EXISTS (SELECT 1 FROM labels)""")
def dest_missing(spark, d):
    return R.missing_target(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id").select("doc_id")


@query("""SELECT n_nationkey, n_name, count(c_custkey) AS total_customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL""")
def corr_update_total(spark, d):
    return R.with_total(table(spark, d, "nation"), "total_customers", table(spark, d, "customer"), "n_nationkey", "c_nationkey").select("n_nationkey", "n_name", "total_customers")


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 AND c_acctbal < 0""")
def fk_mode_conflict(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 3")
    return table(spark, d, "customer").where("c_acctbal < 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""WITH c AS (SELECT p_brand AS name, min(p_type) AS module FROM part GROUP BY p_brand), x AS (SELECT upper(p_brand) AS e, min(module) AS v FROM (SELECT p_brand, p_type AS module FROM part) GROUP BY 1),
s AS (SELECT substr(upper(p_name), 1, 4) AS p, min(p_type) AS v FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1)
SELECT p_partkey, coalesce(x.v, s.v) AS p_type FROM part LEFT JOIN x ON upper(p_name) = x.e LEFT JOIN s ON substr(upper(p_name), 1, 4) = s.p""")
def prefix_fallback(spark, d):
    """A catalog value by exact name, else by a prefix that is unambiguous."""
    part = table(spark, d, "part")
    exact = part.select(F.col("p_brand").alias("name"), "p_type")
    both = part.select("p_partkey", "p_name")
    by_brand = exact.groupBy(F.upper("name").alias("_e")).agg(F.min("p_type").alias("_v"))
    by_name = R.exact_or_prefix(both, "p_name", part.select(F.substring("p_name", 1, 4).alias("n4"), "p_type"), "n4", "p_type")
    return by_name.join(by_brand, F.upper("p_name") == F.col("_e"), "left").select("p_partkey", F.coalesce("_v", "p_type").alias("p_type"))


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_totalprice > 490000""")
def dimension_lookup(spark, d):
    """Facts with two dimensions; the small one is broadcast by its size."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 490000").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))""")
def substring_unused(spark, d):
    """Declared texts that occur whole inside no other text."""
    declared = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    texts = table(spark, d, "documents").select("text")
    used = multipattern.found_inside(declared, "item_id", "needle", texts, "text")
    return declared.join(used, "item_id", "left_anti").select("item_id")


@query("""SELECT b.item_id, d.doc_id, len(list_filter(range(1, length(d.text) - length(b.text) + 2), lambda i: substr(d.text, i, length(b.text)) = b.text)) AS n,
strpos(d.text, b.text) AS first_place FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text)""")
def substring_places(spark, d):
    """Where each declared text occurs: the texts that hold it, how often, and first where."""
    declared = table(spark, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("needle"))
    found = multipattern.occurrences(declared, "needle", table(spark, d, "documents").select("doc_id", "text"), "text")
    rows = found.select("doc_id", "needle", F.size("places").cast("long").alias("n"), F.array_min("places").alias("first_place"))
    return rows.join(declared, "needle").select("item_id", "doc_id", "n", "first_place")


# Aggregates


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def status_counts(spark, d):
    out = None
    for t in TABLES:
        rows = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_DOCTOR = {
    "documents_without_language": ("documents", "coalesce(lang, '') = ''"),
    "documents_length_mismatch": ("documents", "n_chars <> length(text)"),
    "pages_without_html": ("pages", "coalesce(html, '') = ''"),
}


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER ({c}) AS n, CASE WHEN count(*) FILTER ({c}) > 0 THEN 'warn' ELSE 'ok' END AS status FROM {t}" for k, (t, c) in _DOCTOR.items())
    + " UNION ALL SELECT 'orphan_labels', count(*), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"
)
def doctor_checks(spark, d):
    """Health checks: how many rows break each, and its status."""
    parts = [table(spark, d, t).agg(F.count_if(F.expr(c)).alias("n")).select(F.lit(k).alias("name"), "n") for k, (t, c) in _DOCTOR.items()]
    orphans = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    parts.append(orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_labels").alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("n") > 0, "warn").otherwise("ok"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type IN ('view', 'click')) AND bool_or(event_type IN ('purchase', 'signup')) THEN 'read_write'
WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 'write' WHEN bool_or(event_type IN ('view', 'click')) THEN 'read' ELSE '' END AS modo,
arg_min(json_extract_string(props, '$.k'), event_id) FILTER (coalesce(json_extract_string(props, '$.k'), '') <> '') AS default_decl FROM events GROUP BY user_id""")
def param_merge(spark, d):
    read, write = F.col("event_type").isin("view", "click"), F.col("event_type").isin("purchase", "signup")
    rows = table(spark, d, "events").groupBy("user_id").agg(
        F.bool_or(read).alias("r"), F.bool_or(write).alias("w"), R.first_filled(F.get_json_object("props", "$.k"), F.col("event_id")).alias("default_decl")
    )
    mode = F.when(F.col("r") & F.col("w"), "read_write").when(F.col("w"), "write").when(F.col("r"), "read").otherwise("")
    return rows.select("user_id", mode.alias("modo"), "default_decl")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) - 1 AS lost FROM (SELECT * FROM events) GROUP BY user_id, event_type""")
def pk_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value", "lost")


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts FROM lineitem GROUP BY l_orderkey""")
def sorted_sets(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return rows.select("l_orderkey", F.concat_ws(",", F.transform("parts", lambda x: x.cast("string"))).alias("parts"))


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def group_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_name, min(p_brand) AS first_brand, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def homonyms(spark, d):
    """Names with several owners, and the alphabetically first owner."""
    rows = table(spark, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("first_brand"), F.count_distinct("p_brand").alias("brands"))
    return rows.where("brands > 1")


@query("""SELECT p_name, min(p_brand) AS p_brand FROM (SELECT p_name, p_brand, bool_or(p_size >= 50) AS ok FROM part GROUP BY ALL) GROUP BY p_name HAVING NOT max(ok)""")
def indexed_candidates(spark, d):
    rows = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.bool_or(F.col("p_size") >= 50).alias("ok"))
    return R.indexed_nowhere(rows, "p_name", "p_brand", "ok").select("p_name", "p_brand")


@query("""WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), x AS (SELECT p_brand, p_name, s, substr(lower(p_name), 1, s) AS prefix FROM n, (SELECT unnest([3, 4, 5, 6]) AS s) WHERE len(p_name) >= s),
g AS (SELECT p_brand, prefix, s, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS names FROM x GROUP BY ALL HAVING count(*) >= 3)
SELECT p_brand, prefix, n, names FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.p_brand = g.p_brand AND h.s > g.s AND starts_with(h.prefix, g.prefix))""")
def prefix_groups(spark, d):
    names = table(spark, d, "part").select("p_brand", "p_name").distinct().withColumn("line", F.lit(1))
    return R.prefix_groups(names, "p_brand", "p_name", "line").select("p_brand", "prefix", "n", F.concat_ws(",", "names").alias("names"))


@query("""SELECT sha256(string_agg(r_name || '=' || r_regionkey, '|' ORDER BY r_regionkey)) AS bundle FROM region""")
def bundle_hash(spark, d):
    """One hash of a whole (small, fixed) catalog."""
    rows = table(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", F.concat("r_name", F.lit("="), "r_regionkey").alias("t")))).alias("all"))
    return rows.select(F.sha2(F.concat_ws("|", F.col("all.t")), 256).alias("bundle"))


# Ordered rows


@query("""SELECT conv_id, turn, greatest(turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, max(turn) OVER (PARTITION BY conv_id))) AS range_end FROM conversations WHERE role = 'user'""".replace("max(turn) OVER (PARTITION BY conv_id)", "last_turn").replace("FROM conversations", "FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)"))
def range_end_lead(spark, d):
    """A user turn's range ends before the next user turn, the last with its conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    rows = turns.where("role = 'user'").join(last, "conv_id")
    return positional.range_ends(rows, ["conv_id"], "turn", "last_turn").select("conv_id", "turn", "range_end")


@query("""WITH r AS (SELECT DISTINCT p_partkey AS s, p_partkey + p_size AS e, p_name AS n FROM part), b AS (SELECT o_orderkey, arg_min(n, (e - s, s, e, n)) AS owner FROM orders JOIN r ON o_custkey BETWEEN s AND e GROUP BY o_orderkey)
SELECT o.o_orderkey, owner FROM orders o LEFT JOIN b USING (o_orderkey)""")
def enclosing_innermost(spark, d):
    """The smallest range around each number."""
    ranges = table(spark, d, "part").select(F.col("p_partkey").alias("s"), (F.col("p_partkey") + F.col("p_size")).alias("e"), F.col("p_name").alias("owner"))
    points = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return positional.innermost(points, "o_custkey", ranges, "s", "e", "owner", 32).select("o_orderkey", "owner")


@query("""WITH u AS (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM conversations)
SELECT conv_id, turn, CASE WHEN nt - turn <= 2 THEN nt END AS answer FROM u WHERE role = 'user'""")
def next_following_cap(spark, d):
    """The next assistant turn of each user turn, at most two turns away."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return positional.next_following(turns, ["conv_id"], "turn", F.col("role") == "assistant", 2, "answer").where("role = 'user'").select("conv_id", "turn", "answer")


@query("""WITH e AS (SELECT event_id, event_type, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS f FROM events)
SELECT event_id FROM e WHERE event_type = 'error' AND NOT f""")
def lookahead_absent(spark, d):
    flag = positional.exists_ahead(F.col("event_type") == "purchase", ["user_id"], [F.col("ts"), F.col("event_id")], 10)
    return table(spark, d, "events").select("event_id", "event_type", flag.alias("f")).where("event_type = 'error' AND NOT f").select("event_id")


@query("""WITH e AS (SELECT event_id, event_type, coalesce(bool_or(event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), false) AS f FROM events)
SELECT event_id FROM e WHERE event_type = 'purchase' AND NOT f""")
def lookback_absent(spark, d):
    flag = positional.exists_behind(F.col("event_type") == "view", ["user_id"], [F.col("ts"), F.col("event_id")], 30)
    return table(spark, d, "events").select("event_id", "event_type", flag.alias("f")).where("event_type = 'purchase' AND NOT f").select("event_id")


@query("""WITH p AS (SELECT page_id, string_split(html, '<p>') AS parts, len(string_split(html, '</p>')) - 1 AS closed FROM pages)
SELECT page_id, len(array_to_string(parts[1:k], '<p>')) AS at FROM (SELECT page_id, parts, closed, unnest(range(1, len(parts))) AS k FROM p) WHERE k > closed""")
def unbalanced_open(spark, d):
    """Offsets of opening tags beyond the number of closing ones."""
    parts = table(spark, d, "pages").select("page_id", F.split("html", "<p>").alias("parts"), (F.size(F.split("html", "</p>")) - 1).alias("closed"))
    rows = parts.select("page_id", "parts", "closed", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("k")).where("k < size(parts) AND k > closed")
    return rows.select("page_id", F.length(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "<p>")).cast("long").alias("at"))


# Incremental refresh and rendering


@query("""WITH s AS (SELECT doc_id, quality AS v FROM labels), f AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS v FROM documents)
SELECT coalesce(s.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'deleted' WHEN s.doc_id IS NULL THEN 'new' ELSE 'stale' END AS status
FROM s FULL OUTER JOIN f ON s.doc_id = f.doc_id WHERE f.doc_id IS NULL OR s.doc_id IS NULL OR f.v > s.v""")
def stale_diff(spark, d):
    """Stored versions (labels) against found ones (documents)."""
    stored = table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    found = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("v"))
    return R.snapshot_diff(stored, found, "doc_id", "v")


@query("""SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 3000) UNION ALL SELECT doc_id, 9 FROM documents WHERE n_chars > 3000""")
def replace_changed(spark, d):
    """Stored rows replaced by key."""
    fresh = table(spark, d, "documents").where("n_chars > 3000").select("doc_id", F.lit(9).alias("quality"))
    return R.replace_by_key(table(spark, d, "labels").select("doc_id", "quality"), fresh, "doc_id")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text || ' http://bob:secret@host.example/x ' || sha1(text), 'https?://[^\s:@/]+:[^\s@/]+@', 'https://[REDACTED]@', 'g'), '\b[0-9a-fA-F]{40,}\b', '[REDACTED]', 'g') AS text FROM documents""")
def redact(spark, d):
    """Credentials in addresses and long hexadecimal tokens replaced."""
    text = F.concat("text", F.lit(" http://bob:secret@host.example/x "), F.sha1("text"))
    return table(spark, d, "documents").select("doc_id", R.redact(text).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 160 THEN s[1:159] || '…' ELSE s END AS short FROM t""")
def truncate_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", R.collapse(F.col("text"), 160).alias("short"))


@query("""SELECT event_id, coalesce(try_cast(trim(json_extract_string(props, '$.k')) AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events""")
def json_default(spark, d):
    parsed = F.from_json("props", "k string, missing string")
    rows = table(spark, d, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", R.safe_int("p.k").alias("k"), F.coalesce("p.missing", F.lit("")).alias("missing"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 120 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100""")
def paged(spark, d):
    """The sixth page of twenty orders by price."""
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 20).select("o_orderkey", "total", "truncated")


_FLAGS = {"AD": '<div class="ad">', "NAV": "<nav>", "SCRIPT": "<script>", "TABLE": " | "}


@query(f"""SELECT page_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(html, '{v}') THEN '{k}' END" for k, v in _FLAGS.items())}], lambda x: x IS NOT NULL), ',') AS capabilities,
CASE WHEN contains(html, ' | ') THEN 'table' WHEN contains(url, 'blog') THEN 'blog' WHEN contains(html, '<article>') THEN 'article' ELSE 'other' END AS source_type FROM pages""")
def arch_summary(spark, d):
    """Capability flags of each page, sorted, and its type by precedence."""
    html = F.col("html")
    flags = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(html, F.lit(v)), F.lit(k)) for k, v in _FLAGS.items()])))
    kind = F.when(F.contains(html, F.lit(" | ")), "table").when(F.contains(F.col("url"), F.lit("blog")), "blog").when(F.contains(html, F.lit("<article>")), "article").otherwise("other")
    return table(spark, d, "pages").select("page_id", F.concat_ws(",", flags).alias("capabilities"), kind.alias("source_type"))


@query(r"""SELECT doc_id, sha1(text) AS hash, len(string_split(text, chr(10))) AS lines_of_code, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'utf-8' ELSE 'cp1252' END AS encoding FROM documents""")
def encoding_hash(spark, d):
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return table(spark, d, "documents").select(
        "doc_id", F.sha1("text").alias("hash"), F.size(F.split("text", "\n")).cast("long").alias("lines_of_code"), F.when(ascii_only, "cp1252").otherwise("utf-8").alias("encoding")
    )
