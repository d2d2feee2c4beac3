"""Which code page a text's bytes are in, by the likelihood of what they decode to.

A model holds how often pairs of character classes follow each other, how often each letter beyond ASCII occurs and what stands beside it, counted over all of some texts. Bytes are decoded by every code page that can; the decoding
whose characters the model finds likeliest wins. All bytes count, not a first block. Valid UTF-8 with a character beyond ASCII is UTF-8, unless the model knows none of these and a code page shows only letters that it knows. Plain ASCII needs no choice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first of equals wins.
CODE_PAGES = ("cp1252", "cp850", "iso8859_15", "cp437")
PLAIN = "cp1252"
#: How many neighbours of a letter are taken for granted, dealt evenly to the letters.
SMOOTHING = 8
CLASSES = "luLUdspo"  # lower and upper ASCII letters, other lower and upper letters, digits, white space, punctuation, the rest


def class_of(c: str) -> int:
    if c.isascii():
        return 0 if c.islower() else 1 if c.isupper() else 4 if c.isdigit() else 5 if c.isspace() else 6
    return 2 if c.islower() else 3 if c.isupper() else 7


#: Characters beyond ASCII that bytes of some code page decode to: neighbours of others aren't counted, which bounds a model whatever texts it learns from.
CODED = frozenset(c for page in CODE_PAGES for c in bytes(range(128, 256)).decode(page, "ignore"))


def symbol(c: str) -> str:
    """A neighbour as a model knows it: a letter in lower case, else its class."""
    return c.lower()[0] if c.isalpha() and (c.isascii() or c in CODED) else str(class_of(c))


def counts(text: str) -> Counter:
    """Pairs of classes around characters beyond ASCII, these characters, and their neighbours on both sides."""
    out: Counter = Counter()
    known = [class_of(c) for c in text]
    for k, c in enumerate(text):
        if not c.isascii():
            out["1" + c] += 1
            for a, b in ((k - 1, k), (k, k + 1)):
                pair = [known[i] if 0 <= i < len(text) else 5 for i in (a, b)]
                out[f"2{pair[0]}{pair[1]}"] += 1
            if c in CODED:
                for place, at in (("<", k - 1), (">", k + 1)):
                    out[f"3{place}{c}{symbol(text[at]) if 0 <= at < len(text) else 5}"] += 1
    return out


class Model:
    """Log likelihoods with add-half smoothing."""

    def __init__(self, found: dict[str, int]):
        self.pairs = np.full((len(CLASSES), len(CLASSES)), 0.5)
        for k, n in found.items():
            if k[0] == "2":
                self.pairs[int(k[1]), int(k[2])] += n
        self.pairs = np.log(self.pairs / self.pairs.sum())
        letters = {k[1:]: n for k, n in found.items() if k[0] == "1"}
        # a letter's share of its own class: how often the class occurs is in the pairs already
        totals = Counter()
        for c, n in letters.items():
            totals[class_of(c)] += n
        self.letters = {c: math.log((n + 0.5) / (totals[class_of(c)] + 64)) for c, n in letters.items()}
        self.unseen = [math.log(0.5 / (totals[k] + 64)) for k in range(len(CLASSES))]
        # a neighbour's share of those of its class beside this letter, on this side
        self.beside = {k: n for k, n in found.items() if k[0] == "3"}
        self.around: Counter = Counter()
        for k, n in self.beside.items():
            self.around[self._of_class(k)] += n

    @staticmethod
    def _of_class(beside: str) -> str:
        c = beside[3]
        return beside[1:3] + ("a" if c.isascii() and c.isalpha() else "x" if c.isalpha() else c)

    def _beside(self, key: str) -> float:
        c = key[3]
        if not c.isalpha():
            return 0.0  # the class tells all
        return math.log((self.beside.get(key, 0) + SMOOTHING / 32) / (self.around[self._of_class(key)] + SMOOTHING))

    def score(self, text: str) -> float:
        total = 0.0
        for k, n in counts(text).items():
            if k[0] == "1":
                total += n * self.letters.get(k[1:], self.unseen[class_of(k[1:])])
            else:
                total += n * (float(self.pairs[int(k[1]), int(k[2])]) if k[0] == "2" else self._beside(k))
        return total

    def detect(self, raw: bytes) -> str:
        """The name of the encoding of some bytes."""
        if raw.isascii():
            return PLAIN
        best, name, known = -math.inf, "latin-1", False
        try:
            if not self.letters.keys().isdisjoint(raw.decode("utf-8")):
                return "utf-8"
            # by accident, maybe: then a page shows known letters only
            name, known = "utf-8", True
        except UnicodeDecodeError:
            pass
        for page in CODE_PAGES:
            try:
                text = raw.decode(page)
            except UnicodeDecodeError:
                continue
            if known and not all(c.isascii() or c in self.letters for c in text):
                continue
            score = self.score(text)
            if score > best:
                best, name = score, page
        return name


def learn(texts: DataFrame, text: str) -> Model:
    """A model of all texts; what comes to the driver is a row a class pair, a row a character that occurs and a row a pair of letters around those of code pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    found.update(counts(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["what", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    return Model({r["what"]: r["n"] for r in rows.collect()})


def detected(df: DataFrame, raw: str, model: Model) -> DataFrame:
    """``df`` without the column of bytes, with ``encoding``; null bytes count as none."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [c for c in df.columns if c != raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [model.detect(value or b"") for value in batch.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string())], names=[*kept, "encoding"])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], StructField("encoding", StringType())]))
