"""Operator 5, best-fit packing with large-item matching.

Texts become token pieces of at most ``capacity`` tokens. Pieces of more than a third of
the capacity are large: at most two share a bin, and the largest remaining one is matched
greedily with the largest partner that still fits. Smaller pieces then go, largest first,
each into the bin with the smallest remaining gap that takes it; where none does, a new bin
is opened.

Lengths are integers of at most ``capacity``, so all of this is decided on the histogram of
lengths, a table of at most ``capacity`` rows whatever the input. The plan is a list of runs
(length, first rank, bins, pieces a bin, first bin, offset); its size depends on the
capacity alone. Every piece then finds its place from its rank among pieces of its length.
Ranks come from counts per (length, bucket of ids), so that a length that a third of all
pieces have is still ranked by many tasks.

Defined results: a null or empty text has the end token alone; an empty table gives an empty
result; pieces of repeated rows are packed like any others; only texts above the capacity are
cut. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, blocks, regrouped, sole, staged

CAPACITY, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class WordTokenizer:
    """Token ids of texts, word by word.

    The vocabulary drops white space before it looks at anything else, so the ids of a text
    are those of its words between ASCII white space, one after the other. Distinct words of
    a block are encoded once, many to a call with a special token between them; the first
    ``REMEMBERED`` distinct words of a process are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between, self.between_id = next((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special)
        self.places: dict[str, int] = {}
        self.sizes = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        mark = f" {self.between} "
        found, runs = [], []
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        for start in range(0, len(plain), 16_000):
            chunk = plain[start : start + 16_000]
            joined = [mark.join([words[i] for i in chunk[k : k + 400]]) for k in range(0, len(chunk), 400)]
            for k, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array([*e.ids, self.between_id], dtype=np.uint32)
                ends = np.flatnonzero(ids == self.between_id)
                runs.append(np.diff(ends, prepend=-1) - 1)
                found.append(ids[ids != self.between_id])
                assert len(ends) == len(chunk[400 * k : 400 * k + 400])
        if len(plain) < len(words):  # a word may hold the text of a special token itself
            sizes = np.zeros(len(words), dtype=np.int64)
            sizes[plain] = np.concatenate(runs) if runs else 0
            pool, stop = (np.concatenate(found) if found else np.empty(0, np.uint32)), np.cumsum(sizes)
            odd = {i: np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32) for i in sorted(set(range(len(words))) - set(plain))}
            parts, at = [], 0
            for i, ids in odd.items():
                parts += [pool[at : stop[i]], ids]
                at = stop[i]
                sizes[i] = len(ids)
            return np.concatenate([*parts, pool[at:]]), sizes
        return (np.concatenate(found), np.concatenate(runs)) if found else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words, ends = split.flatten(), np.asarray(split.offsets)[1:].astype(np.int64) - split.offsets[0].as_py()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        place = np.fromiter((self.places.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        ids, sizes = self.ids, self.sizes
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [distinct[i] for i in missing]
            own, n = self._encode_words(new)
            place[missing] = len(sizes) + np.arange(len(new))
            ids, sizes = np.concatenate([ids, own]), np.concatenate([sizes, n])
            room = min(len(new), REMEMBERED - len(self.places))
            if room > 0:
                self.places.update(zip(new[:room], range(len(self.places), len(self.places) + room), strict=True))
                self.sizes = sizes[: len(self.places)].copy()
                self.ids = ids[: int(self.sizes.sum())].copy()
        # a block's ids are far fewer than 2^31
        starts = (np.cumsum(sizes) - sizes).astype(np.int32)
        word = place.astype(np.int32)[np.asarray(coded.indices)] if len(distinct) else np.empty(0, dtype=np.int32)
        n = sizes.astype(np.int32)[word]
        total = np.cumsum(n, dtype=np.int64)
        at = np.arange(int(total[-1]) if len(total) else 0, dtype=np.int32)
        at += np.repeat(starts[word] - (total - n).astype(np.int32), n)
        until = np.concatenate([[0], total])
        return ids[at], until[ends]


def tokenizer_at(path: str | None) -> WordTokenizer:
    """This process's tokenizer for a vocabulary file; by default the public one installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return sole(f"packing {path}", lambda: WordTokenizer(path))


def piece_rows(doc_id: pa.Array, texts: pa.Array, tokenizer: WordTokenizer, capacity: int) -> pa.RecordBatch:
    ids, ends = tokenizer.encode(texts)
    n_texts = len(texts)
    lengths = np.diff(np.concatenate([[0], ends])) + 1
    stream = np.full(len(ids) + n_texts, END_ID, dtype="<u4")
    keep = np.ones(len(stream), dtype=bool)
    stops = np.cumsum(lengths)
    keep[stops - 1] = False
    stream[keep] = ids
    n_pieces = -(-lengths // capacity)
    parent = np.repeat(np.arange(n_texts), n_pieces)
    piece = np.arange(len(parent)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = piece * capacity
    length = np.minimum(lengths[parent] - start, capacity)
    at = (stops - lengths)[parent] + start
    raw = memoryview(stream.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [doc_id.take(pa.array(parent)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
        schema=_PIECE,
    )


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per token piece: the id, the piece's number, start, length and crc32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(vocabulary)
        for batch in regrouped(batches, 4 << 20):
            for part in blocks(batch, "text", 4 << 20):
                yield piece_rows(part.column(0), part.column(1), tokenizer, capacity)

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.transform(arrow_map, cut, PIECE_SCHEMA)


class Gaps:
    """Open bins by their remaining gap, as runs of consecutive bin numbers."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, gap: int, first: int, count: int) -> None:
        if not count:
            return
        if not self.runs[gap]:
            insort(self.sizes, gap)
        self.runs[gap].append((first, count))

    def tightest(self, size: int) -> int | None:
        at = bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` bins with this gap."""
        first, count = self.runs[gap].pop()
        if count > most:
            self.runs[gap].append((first + most, count - most))
            count = most
        if not self.runs[gap]:
            self.sizes.remove(gap)
        return first, count


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, bins, pieces a bin, first bin, offset) and the number of bins.

    The piece of rank ``first + k`` goes to bin ``first bin + k // pieces a bin``, at
    ``offset + (k % pieces a bin) * length``.
    """
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps, bins = Gaps(), 0
    third = capacity / 3

    def place(length: int, count: int, each: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], count, each, first_bin, offset))
        used[length] += count * each
        left[length] -= count * each

    large = sorted(n for n in left if n > third)
    while large:
        a = large[-1]
        partners = [n for n in large if n <= capacity - a and (n < a or left[a] > 1)]
        if not partners:
            count = left[a]
            place(a, count, 1, bins, 0)
            gaps.add(capacity - a, bins, count)
        elif (b := partners[-1]) == a:
            count = left[a] // 2
            place(a, count, 2, bins, 0)
            gaps.add(capacity - 2 * a, bins, count)
        else:
            count = min(left[a], left[b])
            place(a, count, 1, bins, 0)
            place(b, count, 1, bins, a)
            gaps.add(capacity - a - b, bins, count)
        bins += count
        large = [n for n in large if left[n]]
    for size in sorted((n for n in left if n <= third and left[n]), reverse=True):
        while left[size]:
            gap = gaps.tightest(size)
            if gap is None:
                each = capacity // size
                full, rest = divmod(left[size], each)
                if full:
                    place(size, full, each, bins, 0)
                    gaps.add(capacity - each * size, bins, full)
                    bins += full
                if rest:
                    place(size, 1, rest, bins, 0)
                    gaps.add(capacity - rest * size, bins, 1)
                    bins += 1
                continue
            each = min(gap // size, left[size])
            first, count = gaps.take(gap, left[size] // each)
            place(size, count, each, first, capacity - gap)
            gaps.add(gap - each * size, first, count)
    return runs, bins


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    pieces = staged(spark, pieces, "pieces")
    buckets = buckets or 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    # at most capacity * buckets rows, summed on the map side first
    counts = staged(spark, marked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan_bins(histogram, capacity)
    by: dict[int, list] = defaultdict(list)
    for run in runs:
        by[run[0]].append(run)
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}
    plan = spark.sparkContext.broadcast(table)  # its size depends on the capacity, not on the input

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plan.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                _, first, _, each, first_bin, at = known[int(length[rows[0]])]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - first[run]
                sequence[rows] = first_bin[run] + k // each[run]
                offset[rows] = at[run] + k % each[run] * length[rows]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (
        marked.join(counts.select("length", "bucket", before.alias("before")), ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    return ranked.transform(arrow_map, seat, f"{PIECE_SCHEMA}, sequence_id long, offset long")
