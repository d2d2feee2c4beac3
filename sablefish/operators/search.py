"""Word search over texts: tokens, boolean queries, phrases, prefixes, grep and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with diacritics and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
SEPARATOR = r"[^\p{L}\p{N}\p{Co}_-]+"


def folded(column: Column | str) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(column), ACCENTED, PLAIN)


def token_array(column: Column | str) -> Column:
    """The folded tokens of a text: letters, digits, ``_`` and ``-``."""
    return F.filter(F.split(folded(column), SEPARATOR), lambda t: t != "")


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and token: materialise this once for many searches."""
    return df.select(key, F.posexplode(token_array(text)).alias("pos", "token"))


def trigrams(column: Column | str) -> Column:
    """The distinct three-character substrings of a text in lower case, in time linear in its length."""
    low = F.lower(column)
    # the characters are bound once: a column used inside a lambda would be worked out again for each place
    runs = F.transform(F.array(F.split(low, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2])))[0]
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array())


@dataclass(frozen=True)
class Node:
    """A parsed search: a ``term``, ``prefix`` or ``phrase`` with words, or ``and``/``or``/``not`` of parts."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()


class SearchSyntaxError(ValueError):
    pass


_LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|([\w-]+)(\*)?)', re.UNICODE)


def parse(query: str) -> Node:
    """Terms, "phrases", prefix*, AND (also by juxtaposition), OR, NOT and parentheses; NOT binds tightest, then AND, then OR."""
    lexemes: list[tuple[str, str]] = []
    at = 0
    query = query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if m is None:
            raise SearchSyntaxError(f"can't read {query[at:]!r}")
        at = m.end()
        if m[1] is not None:
            lexemes.append(("phrase", m[1].replace('""', '"')))
        elif m[2]:
            lexemes.append((m[2], m[2]))
        elif m[3] in ("AND", "OR", "NOT") and not m[4]:
            lexemes.append((m[3], m[3]))
        else:
            lexemes.append(("prefix" if m[4] else "term", m[3]))
    place = 0

    def peek() -> str:
        return lexemes[place][0] if place < len(lexemes) else ""

    def primary() -> Node:
        nonlocal place
        kind = peek()
        if kind == "(":
            place += 1
            inner = either()
            if peek() != ")":
                raise SearchSyntaxError("a parenthesis isn't closed")
            place += 1
            return inner
        if kind not in ("term", "prefix", "phrase"):
            raise SearchSyntaxError(f"a term is missing before {kind or 'the end'}")
        text = lexemes[place][1]
        place += 1
        words = tuple(w for w in re.split(r"[^\w-]+", fold_text(text)) if w)
        return Node(kind, words)

    def minus() -> Node:
        nonlocal place
        left = primary()
        while peek() == "NOT":
            place += 1
            left = Node("not", parts=(left, primary()))
        return left

    def both() -> Node:
        nonlocal place
        parts = [minus()]
        while peek() in ("AND", "term", "prefix", "phrase", "("):
            if peek() == "AND":
                place += 1
            parts.append(minus())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def either() -> Node:
        nonlocal place
        parts = [both()]
        while peek() == "OR":
            place += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    out = either()
    if place < len(lexemes):
        raise SearchSyntaxError(f"{lexemes[place][1]!r} is left over")
    return out


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def matches(query: str | Node, tokens: Column) -> Column:
    """Whether an array of folded tokens satisfies a search: one pass over each text, no shuffle."""
    node = parse(query) if isinstance(query, str) else query
    if node.kind == "and":
        out = matches(node.parts[0], tokens)
        for p in node.parts[1:]:
            out = out & matches(p, tokens)
        return out
    if node.kind == "or":
        out = matches(node.parts[0], tokens)
        for p in node.parts[1:]:
            out = out | matches(p, tokens)
        return out
    if node.kind == "not":
        return matches(node.parts[0], tokens) & ~matches(node.parts[1], tokens)
    if node.kind == "prefix":
        return F.exists(tokens, lambda t: t.startswith(node.words[-1]))
    if len(node.words) == 1:
        return F.array_contains(tokens, node.words[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(node.words)} "))


def search(df: DataFrame, text: str, query: str) -> DataFrame:
    """The rows whose text satisfies a search."""
    return df.where(matches(query, token_array(text)))


def indexed(tokens: DataFrame, key: str, query: str | Node) -> DataFrame:
    """The keys whose texts satisfy a search, from a stored token table: one equi-join or set operation a part, no text is read."""
    node = parse(query) if isinstance(query, str) else query
    if node.kind in ("and", "or", "not"):
        first, *rest = (indexed(tokens, key, p) for p in node.parts)
        for other in rest:
            first = first.join(other, key, "left_semi" if node.kind == "and" else "left_anti") if node.kind != "or" else first.unionByName(other).distinct()
        return first
    if node.kind == "prefix":
        found = tokens.where(F.col("token").startswith(node.words[-1]))
    else:
        found = tokens.where(F.col("token") == node.words[0])
        for k, word in enumerate(node.words[1:], 1):
            at = tokens.where(F.col("token") == word).select(key, (F.col("pos") - k).alias("pos"))
            found = found.join(at, [key, "pos"], "left_semi")
    return found.select(key).distinct()


def phrase_count(tokens: Column, phrase: str) -> Column:
    """How often a phrase occurs, overlaps of its last and first word not counted twice."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    wanted = " " + "  ".join(fold_text(phrase).split()) + " "
    return ((F.length(joined) - F.length(F.replace(joined, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def highlight(column: Column, terms: list[str], size: int = 16) -> Column:
    """A window of ``size`` words with the most of the terms (the first of equals), these in brackets."""
    words = F.filter(F.split(column, r"\s+"), lambda w: w != "")
    wanted = F.array(*[F.lit(fold_text(t)) for t in terms])

    def hit(w: Column) -> Column:
        return F.exists(F.split(folded(w), SEPARATOR), lambda t: F.array_contains(wanted, t))

    marked = F.transform(words, lambda w: F.struct(w.alias("w"), hit(w).cast("int").alias("h")))
    starts = F.filter(F.transform(marked, lambda m, i: F.when(m["h"] == 1, i)), lambda i: i.isNotNull())

    def score(i: Column) -> Column:
        return F.aggregate(F.slice(marked, i + 1, F.lit(size)), F.lit(0), lambda s, m: s + m["h"])

    best = F.coalesce(F.array_max(F.transform(starts, lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))["i"] * -1, F.lit(0))
    shown = F.transform(F.slice(marked, best + 1, F.lit(size)), lambda m: F.when(m["h"] == 1, F.concat(F.lit("["), m["w"], F.lit("]"))).otherwise(m["w"]))
    return F.concat(F.when(best > 0, F.lit("...")).otherwise(F.lit("")), F.array_join(shown, " "), F.when(best + size < F.size(words), F.lit("...")).otherwise(F.lit("")))


def rank(tokens: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key and a tf-idf score for any of the terms, from a token table; sums are combined before shuffles."""
    wanted = [fold_text(t) for t in terms]
    total = tokens.agg(F.count_distinct(key).alias("_n"))
    tf = tokens.where(F.col("token").isin(wanted)).groupBy("token", key).agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))  # a row a term
    scored = tf.join(F.broadcast(df), "token").join(F.broadcast(total), F.lit(True))
    return scored.groupBy(key).agg(F.sum(F.col("_tf") * F.log(1 + F.col("_n") / F.col("_df"))).alias("score"))


def index_gap(chunks: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Chunks with text that the token table lacks: what an out-of-date index misses."""
    return chunks.join(tokens.select(key).distinct(), key, "left_anti")
