"""Operator 12, text quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (ASCII-lower-cased, hashed to ``WORDS`` slots, weighted by the log of their number and scaled to
length 1 in all), statistics of its structure (shares of character classes, lengths of words and lines, repetition, the shapes of word ends) and its
declared length as metadata. Statistics are cut into ``BINS`` soft bins each, so that a feature may help in the middle of its range; bins stand beside words
as features of their own. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

with ``RANK`` factors v: all pairs of features interact, in time linear in the features by the identity of squares. It is trained by
Adagrad on the log loss with weight decay, in numpy, by gradients of the same identity.

Training data: rows outside the held-out fold (crc32 of the id's text modulo 3 is 1) with a label, at most ``MAX_DOCUMENTS`` ids chosen by a hash. Executors
turn their whole texts to features, of which a row has ``WORDS`` + ``STATISTICS`` * ``BINS`` at most; the driver holds these only. An id with several labels has their mean,
and rows of one id count once.

Defined results: null and empty texts are texts without words and get a score like others; a null declared length counts as the text's own. Where nothing can be
learnt (no labels, empty tables) all scores are 0.5. Null ids are never trained on and belong to no held-out fold but that of the empty text (whose crc32 is 0).
Equal texts of equal declared length get equal scores (6 places). Texts of any length are read whole, block by block; repeated rows get a result each. Only the
id, the text and the declared length are read, the id for the fold alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, blocks, crc_fold
from .tokens import hashes, split_words

WORDS, BINS, RANK = 1 << 14, 4, 8
MAX_DOCUMENTS = 4_000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.08, 2e-5, 11
FOLDS, HELD_OUT = 3, 1
BLOCK_BYTES = 2 << 20
#: Where the bins of each statistic are centred, from the least to the largest usual value.
RANGES = {
    "lower": (0.4, 0.85), "upper": (0.0, 0.3), "digits": (0.0, 0.1), "marks": (0.0, 0.2), "spaces": (0.08, 0.25), "other": (0.0, 0.15), "breaks": (0.0, 0.02), "log_bytes": (2.0, 11.0),
    "word_bytes": (2.0, 10.0), "marked_ends": (0.0, 0.6), "distinct": (0.2, 1.0), "top_word": (0.0, 0.2), "line_words": (1.0, 60.0), "log_declared": (2.0, 11.0),
}
STATISTICS = len(RANGES)
SIZE = WORDS + STATISTICS * BINS

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 0, 1, 2, 4, 5, 6
#: Order of the classes above: lower, upper, digits, marks, spaces, breaks, other.
_SHARES = ("lower", "upper", "digits", "marks", "spaces", "breaks", "other")


class Rows:
    """Sparse rows: the features of row r are places ``at[start[r]:start[r + 1]]`` with ``value``s."""

    def __init__(self, start: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.start, self.at, self.value = start, at, value

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(start[-1]) - np.repeat(start[:-1] - self.start[rows], sizes)
        return Rows(start, self.at[places], self.value[places])


def _bins(name: str, values: np.ndarray) -> np.ndarray:
    """(rows, BINS): how near each value is to the centres of the bins; neighbours share what lies between them."""
    low, high = RANGES[name]
    place = np.clip((values - low) / (high - low), 0, 1) * (BINS - 1)
    return np.maximum(0.0, 1.0 - np.abs(place[:, None] - np.arange(BINS)))


def features(texts: pa.Array, declared: np.ndarray) -> Rows:
    """Rows of features of whole texts; ``declared`` lengths below 0 are unknown."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    data = np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    text_of = np.repeat(np.arange(n), size)
    classes = np.bincount(text_of * 7 + _CLASS[data], minlength=n * 7).reshape(n, 7)
    own = np.asarray(pc.utf8_length(texts)).astype(np.float64)
    coded, offsets = split_words(texts)
    count = np.diff(offsets)
    names = coded.dictionary
    code = np.asarray(coded.indices).astype(np.int64)
    owner = np.repeat(np.arange(n), count)
    # each text's distinct words and their numbers
    pairs, times = np.unique(owner * max(len(names), 1) + code, return_counts=True)
    who, what = np.divmod(pairs, max(len(names), 1))
    word_size = np.asarray(pc.binary_length(names)).astype(np.int64)
    marked = np.asarray(pc.match_substring_regex(names, r"[^\pL\pN.,]$"))
    total, words = np.maximum(size, 1), np.maximum(count, 1)
    stats = {name: classes[:, k] / total for k, name in enumerate(_SHARES)}
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    stats |= {
        "log_bytes": np.log1p(size), "log_declared": np.log1p(np.where(declared < 0, own, declared)),
        "word_bytes": np.bincount(owner, word_size[code], n) / words, "marked_ends": np.bincount(owner, marked[code], n) / words,
        "distinct": np.bincount(who, minlength=n) / words, "top_word": np.where(count >= 10, top / words, 0.0), "line_words": count / (classes[:, 5] + 1),
    }
    slot = (hashes(names) % np.uint64(WORDS)).astype(np.int64)
    cells, inverse = np.unique(who * WORDS + slot[what], return_inverse=True)
    weight = np.log1p(np.bincount(inverse, times, len(cells)))
    row, at = np.divmod(cells, WORDS)
    weight /= np.sqrt(np.maximum(np.bincount(row, weight**2, n), 1e-12))[row]
    dense = np.concatenate([_bins(name, stats[name]) for name in RANGES], axis=1) / np.sqrt(STATISTICS)
    r, c = np.nonzero(dense)
    row, at, weight = np.concatenate([row, r]), np.concatenate([at, c + WORDS]), np.concatenate([weight, dense[r, c]])
    order = np.argsort(row, kind="stable")
    return Rows(np.searchsorted(row[order], np.arange(n + 1)), at[order].astype(np.int32), weight[order].astype(np.float32))


class Machine:
    """A factorisation machine for two classes."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank))

    def logits(self, rows: Rows) -> np.ndarray:
        """The sum of squares identity, in time linear in the features of the rows."""
        owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
        out = self.bias + np.bincount(owner, self.w[rows.at] * rows.value, len(rows))
        for f in range(self.v.shape[1]):
            part = self.v[rows.at, f] * rows.value
            out += 0.5 * (np.bincount(owner, part, len(rows)) ** 2 - np.bincount(owner, part**2, len(rows)))
        return out

    def scores(self, rows: Rows) -> np.ndarray:
        return 0.5 * np.tanh(0.5 * self.logits(rows)) + 0.5

    def gradients(self, rows: Rows, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the mean log loss: by bias, and by w and v of each stored feature (repeated places aren't summed yet)."""
        owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
        error = (self.scores(rows) - labels) / len(rows)
        x, e = rows.value.astype(np.float64), error[owner]
        v = self.v[rows.at]
        sums = np.stack([np.bincount(owner, v[:, f] * x, len(rows)) for f in range(v.shape[1])], axis=1)
        return float(error.sum()), e * x, (e * x)[:, None] * (sums[owner] - v * x[:, None])

    def train(self, rows: Rows, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                part = rows.take(some)
                b, w, v = self.gradients(part, labels[some])
                places, inverse = np.unique(part.at, return_inverse=True)
                w = np.bincount(inverse, w, len(places)) + decay * self.w[places]
                v = np.stack([np.bincount(inverse, v[:, f], len(places)) for f in range(v.shape[1])], axis=1) + decay * self.v[places]
                gb, gw[places], gv[places] = gb + b * b, gw[places] + w * w, gv[places] + v * v
                self.bias -= rate * b / np.sqrt(gb)
                self.w[places] -= rate * w / np.sqrt(gw[places])
                self.v[places] -= rate * v / np.sqrt(gv[places])


def _narrow(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n.alias("declared"))


def feature_table(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and the features of each row, as two binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                rows = features(part.column("text"), np.asarray(part.column("declared")))
                cut = [slice(a, b) for a, b in zip(rows.start[:-1], rows.start[1:], strict=True)]
                packed = [pa.array([a[c].tobytes() for c in cut], pa.binary()) for a in (rows.at, rows.value)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *packed], names=[*kept, "at", "value"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([docs.schema[c] for c in kept] + [StructField("at", BinaryType()), StructField("value", BinaryType())])
    return docs.transform(arrow_map, run, schema)


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCUMENTS) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most ``most`` documents outside the held-out fold, chosen by a hash of the id."""
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    given = given.where(crc_fold("label_id", FOLDS) != HELD_OUT)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = given.join(ids, F.col("label_id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64(F.lit("quality"), "label_id"), "label_id").limit(most)
    rows = _narrow(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = feature_table(rows, ["doc_id", "label"]).groupBy("doc_id").agg(F.min(F.struct("label", "at", "value")).alias("row"))
    found = sorted((r["doc_id"], r["row"]) for r in found.collect())
    at, value = [np.frombuffer(r["at"], np.int32) for _, r in found], [np.frombuffer(r["value"], np.float32) for _, r in found]
    start = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
    empty = np.zeros(0)
    return Rows(start, np.concatenate([*at, empty.astype(np.int32)]), np.concatenate([*value, empty.astype(np.float32)])), np.array([r["label"] for _, r in found])


def learn(docs: DataFrame, labels: DataFrame, **options) -> Machine | None:
    """A machine trained on the sample; None where there are no labels."""
    rows, given = sample(docs, labels)
    if not len(rows):
        return None
    machine = Machine()
    machine.train(rows, given, **options)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    narrow = _narrow(docs).withColumn("held_out", crc_fold("doc_id", FOLDS) == HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                own = np.full(part.num_rows, 0.5)
                if machine is not None:
                    own = np.round(machine.scores(features(part.column("text"), np.asarray(part.column("declared")))), 6)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(own), pa.array((own >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    return arrow_map(narrow, run, SCHEMA)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
