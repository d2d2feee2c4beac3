"""Operator 6, language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text, forwards and backwards, and gives every position (letters, digits, white
space alike) a distribution over the learned languages. It is written and trained in numpy by backpropagation through
time. A text is read in segments of ``SEGMENT`` bytes, each with the ``CONTEXT`` bytes before and behind it, so that many
segments run side by side and a position's states know at least so much of its surroundings; only the segment's own
positions are counted, each byte of a text once. A document's distribution is the mean over all
its positions; the language of the largest share is predicted, with that share as score.

Training data: labelled rows outside the held-out fold, at most ``MAX_DOCUMENTS`` distinct texts
(one of each language at least), chosen by a hash evenly over the languages, each of at most ``MAX_CHARS``
characters (longer ones give an excerpt from a place that the hash chooses, anywhere in the text, for training only). The driver holds
this sample only. Beside the languages the network learns a class of its own from ``NOISE`` made texts (random printable characters, base64 and hexadecimal runs), so that what is no
language gets a low share of every language; it is never predicted. Each step draws languages alike, then texts, then a run of ``CROP`` bytes of each.

Defined results: ``und`` with score 0 for null texts and texts without a letter; also for
all texts where there is nothing to learn from (no labelled rows, empty tables). Equal texts
get equal predictions (a fixed number of rows runs at a time, so a row's numbers don't depend on other rows; scores have 6 places). Ties go to the first
language by name. Very long texts are many segments and take memory block by block. Only the id, the text and
the label are read; predictions use the text alone.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, blocks, crc_fold

SEGMENT, CONTEXT, CROP = 512, 32, 96
HIDDEN, STEPS, BATCH, RATE, SEED = 8, 400, 96, 0.02, 7
#: Segments that run side by side, and numbers of a block of distributions.
ROWS, BLOCK_NUMBERS = 512, 1 << 20
MAX_DOCUMENTS, MAX_CHARS, SALTS = 1200, 20_000, 16
NOISE, NOISE_BYTES = 150, 400
UNKNOWN = "und"
PAD = 256

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
GATES = "zrn"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(time, rows) numbers with the first ``n[i]`` of column i reversed."""
    at = np.arange(x.shape[0])[:, None]
    return np.take_along_axis(x, np.where(at < n, n - 1 - at, at), axis=0)


class Network:
    """Two gated recurrent layers (one a direction) and a softmax over both states.

    Parameters by name: x (bytes to a gate), u (state to a gate) and b (bias of the candidate's state part),
    each with a gate (z update, r reset, n candidate) and a direction (f, b); o and ob make the labels.
    """

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for g in GATES:
                self.p[f"x{g}{d}"] = rng.normal(0, 0.3, (257, hidden)).astype(np.float32)
                self.p[f"u{g}{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(hidden, np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden, n_labels)).astype(np.float32)
        self.p["ob"] = np.zeros(n_labels, np.float32)

    def states(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of one direction over bytes ``x`` (time, rows)."""
        time, rows = x.shape
        p = self.p
        kind = p["ob"].dtype
        # sigmoid(v) is half of tanh(v / 2) and one; the halves go into the parameters
        tables = [p[f"x{g}{d}"] * (1 if g == "n" else kind.type(0.5)) for g in GATES]
        us = [p[f"u{g}{d}"] * (1 if g == "n" else kind.type(0.5)) for g in GATES]
        bias = p[f"b{d}"]
        out = np.empty((time, rows, self.hidden), kind)
        h = np.zeros((rows, self.hidden), kind)
        z, r, n, t = (np.empty_like(h) for _ in range(4))
        for k in range(time):
            at = x[k]
            for gate, table, u in ((z, tables[0], us[0]), (r, tables[1], us[1])):
                np.take(table, at, axis=0, out=gate, mode="clip")
                np.matmul(h, u, out=t)
                gate += t
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            inner = np.matmul(h, us[2], out=t)
            inner += bias
            if keep is not None:
                kept = (h.copy(), z.copy(), r.copy(), inner.copy())
            inner *= r
            np.take(tables[2], at, axis=0, out=n, mode="clip")
            n += inner
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((*kept, n.copy()))
            new = out[k]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return out

    def _back(self, d: str, x: np.ndarray, keep: list, dout: np.ndarray, grads: dict) -> None:
        u = {g: self.p[f"u{g}{d}"] for g in GATES}
        gu = {g: np.zeros_like(u[g]) for g in GATES}
        gb = np.zeros_like(self.p[f"b{d}"])
        inputs = {g: np.empty_like(dout) for g in GATES}
        dh = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, inner, n = keep[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dinner = dn * r
            for g, v in (("z", dz), ("r", dr), ("n", dn)):
                inputs[g][t] = v
            for g, v in (("z", dz), ("r", dr), ("n", dinner)):
                gu[g] += h.T @ v
            gb += dinner.sum(axis=0)
            dh = dh * z + dz @ u["z"].T + dr @ u["r"].T + dinner @ u["n"].T
        order = np.argsort(x.ravel(), kind="stable")
        sorted_x = x.ravel()[order]
        starts = np.flatnonzero(np.diff(sorted_x, prepend=-1))
        for g in GATES:
            gx = np.zeros_like(self.p[f"x{g}{d}"])
            gx[sorted_x[starts]] = np.add.reduceat(inputs[g].reshape(len(order), -1)[order], starts)
            grads[f"x{g}{d}"], grads[f"u{g}{d}"] = gx, gu[g]
        grads[f"b{d}"] = gb

    def train_step(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean loss a position, and gradients by backpropagation through time; ``x`` is (time, rows)."""
        back = turned(x, n)
        kf: list = []
        kb: list = []
        time, rows = np.arange(len(x)), np.arange(len(n))
        turn = np.where(time[:, None] < n, n - 1 - time[:, None], time[:, None])[:, :, None]
        hf = self.states("f", x, kf)
        hb = np.take_along_axis(self.states("b", back, kb), turn, axis=0)
        h = np.concatenate([hf, hb], axis=2)
        d = self._distributions(h)
        mask = (time[:, None] < n).astype(h.dtype)
        total = mask.sum()
        loss = -(np.log(d[:, rows, label] + 1e-9) * mask).sum() / total
        d[:, rows, label] -= 1
        d *= (mask / total)[:, :, None]
        grads = {"o": np.einsum("trh,trl->hl", h, d, optimize=True), "ob": d.sum(axis=(0, 1))}
        dh = d @ self.p["o"].T
        k = self.hidden
        self._back("f", x, kf, dh[:, :, :k], grads)
        self._back("b", back, kb, np.take_along_axis(dh[:, :, k:], turn, axis=0), grads)
        return float(loss), grads

    def _distributions(self, h: np.ndarray) -> np.ndarray:
        d = h @ self.p["o"] + self.p["ob"]
        d -= d.max(axis=-1, keepdims=True)
        np.exp(d, out=d)
        d /= d.sum(axis=-1, keepdims=True)
        return d

    def train(self, texts: list[bytes], label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Steps of Adam over runs of bytes of the texts."""
        rng = np.random.default_rng(seed)
        whole = np.frombuffer(b"".join(texts) + bytes(CROP), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        order = np.argsort(label, kind="stable")
        count = np.bincount(label)
        first = np.cumsum(count) - count
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        time = np.arange(CROP)[:, None]
        loss = 0.0
        for step in range(1, steps + 1):
            lang = rng.permutation(np.arange(batch) % len(count)) if len(count) <= batch else rng.integers(0, len(count), batch)
            pick = order[first[lang] + (rng.random(batch) * count[lang]).astype(np.int64)]
            n = np.minimum(CROP, size[pick])
            at = start[pick] + (rng.random(batch) * (size[pick] - n + 1)).astype(np.int64)
            x = np.where(time < n, whole[np.minimum(at + time, len(whole) - 1)], PAD)
            loss, grads = self.train_step(x, n, label[pick])
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return loss

    def shares(self, texts: pa.Array) -> np.ndarray:
        """(texts, labels): the mean distribution over all positions of each text; zeros for texts without a byte."""
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        whole = np.frombuffer(b"".join([t for t in texts.cast(pa.binary()).to_pylist() if t]), np.uint8)
        start = np.cumsum(size) - size
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        # from, to: a segment's own bytes; low, high: with its context
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        stop = np.minimum(begin + SEGMENT, size[owner])
        low, high = np.maximum(begin - CONTEXT, 0), np.minimum(stop + CONTEXT, size[owner])
        length = high - low
        total = np.zeros((len(size), len(self.p["ob"])))
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), ROWS):
            some = order[k : k + ROWS]
            n = np.zeros(ROWS, np.int64)
            n[: len(some)] = length[some]
            time = np.arange(int(n.max()))[:, None]
            at = np.zeros(ROWS, np.int64)
            at[: len(some)] = (start[owner] + low)[some]
            x = np.where(time < n, whole[np.minimum(at + time, len(whole) - 1)], np.uint8(0)).astype(np.intp)
            hf = self.states("f", x)
            hb = turned_states(self.states("b", turned(x, n)), n)
            lead, last = np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)
            lead[: len(some)], last[: len(some)] = (begin - low)[some], (stop - low)[some]
            sums = np.zeros((ROWS, total.shape[1]))
            each = max(1, BLOCK_NUMBERS // (ROWS * total.shape[1]))
            for t in range(0, len(time), each):
                d = self._distributions(np.concatenate([hf[t : t + each], hb[t : t + each]], axis=2))
                own = (time[t : t + each] >= lead) & (time[t : t + each] < last)
                sums += np.einsum("trl,tr->rl", d, own.astype(d.dtype))
            np.add.at(total, owner[some], sums[: len(some)])
        return total / np.maximum(size, 1)[:, None]


def turned_states(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States (time, rows, hidden) with the first ``n[i]`` of row i in reverse."""
    at = np.arange(len(h))[:, None]
    return h[np.where(at < n, n - 1 - at, at), np.arange(h.shape[1])]


def sample_rows(labelled: DataFrame, most: int = MAX_DOCUMENTS, chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """At most ``most`` (text, lang), one of each language at least: distinct texts, evenly over the languages, chosen by a hash."""
    usable = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull()).select("text", "lang", F.xxhash64(F.lit("train"), "text").alias("mark"))
    langs = usable.select("lang").distinct().count()
    if not langs:
        return []
    point = F.pmod("mark", F.lit(1 << 30))
    each, salt = max(1, most // langs), F.pmod(F.shiftright("mark", 32), F.lit(SALTS))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(point, "mark"))
    # copies are one text before places are given; a language is thinned out in parts first, so that none is a hot key
    chosen = usable.select("lang", "mark").distinct().withColumn("salt", salt).withColumn("place", place("lang", "salt")).where(F.col("place") <= each)
    chosen = chosen.withColumn("place", place("lang")).where(F.col("place") <= each).select("lang", "mark")
    met = usable.join(F.broadcast(chosen) if langs <= most else chosen, ["lang", "mark"])
    start = F.pmod(F.shiftright("mark", 16), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    rows = met.groupBy("lang", "mark").agg(F.min(F.substr("text", start, F.lit(chars))).alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["mark"] % (1 << 30), r["mark"], r["lang"]))]


def noise(n: int = NOISE, size: int = NOISE_BYTES, seed: int = SEED) -> list[bytes]:
    """Runs of bytes that are no language: printable characters, base64 and hexadecimal digits in turn."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        raw = rng.bytes(size)
        if k % 3 == 0:
            codes = np.frombuffer(raw, np.uint8) % 94 + 33
            codes[rng.random(size) < 0.15] = 32
            out.append(codes.astype(np.uint8).tobytes())
        else:
            out.append((b64encode(raw) if k % 3 == 1 else raw.hex().encode())[:size])
    return out


def fit(rows: list[tuple[str, str]], **options) -> tuple[Network, list[str]] | None:
    """A trained network and its languages; None where there is nothing to learn."""
    given = [(t, lang) for text, lang in rows if (t := text.encode("utf-8", "surrogatepass"))]
    langs = sorted({lang for _, lang in given})
    if not langs:
        return None
    net, other = Network(len(langs) + 1), noise()
    net.train([*(t for t, _ in given), *other], np.array([langs.index(lang) for _, lang in given] + [len(langs)] * len(other)), **options)
    return net, langs


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()), bool, len(texts))


def lettered(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col, 3 << 20):
                yield part.filter(pa.array(has_letter(part.column(text_col))))

    return df.transform(arrow_map, run, df.schema)


def predict(df: DataFrame, model: tuple[Network, list[str]] | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (rounded to 6 places)."""
    fields = df.schema.names
    names = [f for f in fields if f not in ("lang_pred", "score")]
    if model is None:
        return df.select(*[F.col(f"`{c}`") for c in names], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    net, langs = model
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([df.schema[c] for c in names] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    values = np.array([*langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col, 4 << 20):
                texts = part.column(text_col)
                share = net.shares(texts)[:, : len(langs)]
                best = share.argmax(axis=1)
                letter = has_letter(texts)
                pred = values[np.where(letter, best, len(langs))]
                score = np.where(letter, np.round(np.clip(share[np.arange(len(best)), best], 0, 1), 6), 0.0)
                kept = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in names]).transform(arrow_map, run, schema)


def learn(spark: SparkSession, docs: DataFrame, folds: int = 5, held_out: int = 0, **options):
    """A model of the labelled rows outside fold ``held_out`` (crc32 of the id's text modulo ``folds``)."""
    seen = docs.where(crc_fold("doc_id", folds) != held_out).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return fit(sample_rows(seen), **options)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    model = learn(spark, docs)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score")
