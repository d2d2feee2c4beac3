"""Operator 9, language-model scoring by subword lattice likelihood.

A text is a lattice, and its score the log of the summed weight of all ways through it. There are three kinds of arcs:

- Pieces. Within a word (ASCII-lower-cased, between ASCII white space) the arcs are the pieces of an existing subword
  vocabulary, and the vocabulary's scores weight them: the file holds ranks (score -r), which give the weights of a Zipf
  law 1 / (ZIPF - score). Characters without a piece take byte arcs. One half of a piece's weight (``OWN``) is the
  vocabulary's own at any size of the corpus; the other half is the piece's share in the training words, its expected number over
  all segmentations by the vocabulary's weights. A forward recursion in log space sums over all segmentations.
- Words. A training word has an arc over the whole word, by absolute discounting: (c - D) / N, where c, N and V are
  the counts of the contract. The segmentations share D * V / N; D = n1 / (n1 + 2 n2) from the numbers of words seen once and
  twice. The end of a text has (c - D) / N.
- Lines. A line of a text that other training texts have too has an arc over all its words: ``LINE_SHARE`` * (k - D) / K, with k its
  occurrences in training texts but this one, K the number of all training lines and D as for words. Each word arc pays
  1 - ``LINE_SHARE`` in return. A training text's own lines don't count for itself, so its score can be compared with that of a held-out one.

Beside it stands ``lattice_score``, the marginal over the segmentations by the vocabulary's existing scores alone: no counts, words or lines of the corpus but the share of ends among
the training tokens, which bounds the number of words. It is one model for all texts.

As words and lines bound the ways through, the marginal of a text is the product of its lines' marginals, and a line's the
sum of its own arc and the product of its words' marginals. The weights of all texts sum to one at most.

How it runs: words and lines are counted over all documents in blocks and summed in a shuffle. Each distinct word goes through
its lattice once. Words and lines above a count that at most ``HEAD`` of them reach (so their tables are bounded whatever the
input; they are looked up by hash) are scored where the texts are read. Every other word and line is joined with its table and summed by line
and text; none of these is frequent, so no key is hot.

Defined results: null and empty texts have the end token only. Without training texts P(w) is
L(w) / 2 and the end has 1 / 2. Repeated rows get a result each; ids may repeat or be null.
A text may be of any length: it is one row, its words are handled in arrays. Other
columns aren't read. Words, lines and rows are told apart by 64-bit hashes where they are looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, blocks, crc_fold, sole, staged
from .tokens import MIX, hashes, line_keys, split_lines

VOCABULARY = "piece_bpe_32k.model"
ZIPF, BYTE_SHARE, STOP, OWN, LINE_SHARE = 2.7, 1e-3, 0.25, 0.5, 0.02
PER_CHARACTER = 20.0
HEAD = 1 << 17
BLOCK_BYTES = 2 << 20
SPACE = "▁"
LOG10 = math.log(10)


def vocabulary_weights(path: str | None = None) -> dict[str, float]:
    """The share of each piece of a vocabulary file (the public one installed beside Python) by its scores."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        score = model.get_score(i)
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) and score > -1e8:
            weights[model.id_to_piece(i)] = 1.0 / (ZIPF - score)
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def adapted(weights: dict[str, float], expected: dict[str, float]) -> dict[str, float]:
    """``OWN`` parts of the vocabulary's own weights and the rest by expected numbers."""
    total = sum(expected.values())
    return {k: OWN * v + (1 - OWN) * expected.get(k, 0.0) / total for k, v in weights.items()} if total else weights


#: Words of one length that are few go through the lattice one by one, others side by side.
FEW, SLOT_BITS, WORDS = 24, 20, 1 << 15


def _onward(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hashes of beginnings that are a character longer."""
    h = (h + c + np.uint64(1)) * MIX
    return h ^ (h >> np.uint64(29))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their places and (words, characters) code points."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(at):
            codes = np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield at, codes.reshape(len(at), -1).astype(np.uint64)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.Table]:
    """Batches put together to about so many rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


class Lattice:
    """Marginal log probabilities of words under weighted pieces."""

    def __init__(self, weights: dict[str, float]):
        go_on = math.log1p(-STOP)
        self.byte = math.log(BYTE_SHARE / 256) + go_on
        self.end = math.log(STOP) - go_on
        self.byte_weight = math.exp(self.byte)
        self.longest = max(map(len, weights))
        self.arcs: dict[str, float | None] = {k: math.log(v * (1 - BYTE_SHARE)) + go_on for k, v in weights.items()}
        # None for a beginning of a piece that is none itself; what isn't here begins no piece
        self.arcs.update(dict.fromkeys({k[:n] for k in weights for n in range(1, len(k))} - weights.keys()))
        self._table()

    def log_probability(self, word: str, share: float = 0.0, own: float | None = None) -> float:
        """Natural log of the summed weight of all ways through a word.

        ``share`` is the log weight of being spelled by pieces, ``own`` that of the arc over the whole word (None: there is none).
        """
        s = SPACE + word
        n = len(s)
        arcs, longest, byte = self.arcs.get, self.longest, self.byte
        incoming: list[list[float]] = [[] for _ in range(n + 1)]
        incoming[0].append(share)
        exp, log = math.exp, math.log
        for i in range(n):
            terms = incoming[i]
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + log(sum([exp(t - top) for t in terms]))
            incoming[i] = ()
            for j in range(i + 1, min(n, i + longest) + 1):
                w = arcs(s[i:j], 0)
                if w:
                    incoming[j].append(here + w)
                elif w == 0:
                    break
            c = s[i]
            incoming[i + 1].append(here + byte * (1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))))
        terms = incoming[n]
        if own is not None:
            terms.append(own - self.end)  # this arc leads past the end
        top = max(terms)
        return top + log(sum([exp(t - top) for t in terms])) + self.end

    def expect(self, word: str, counts: dict[str, float]) -> None:
        """Adds each piece's expected number over the segmentations of a word to ``counts``.

        Every segmentation covers all characters, so a factor for each character changes no
        expectation; with it the sums of words of usual length stay in range as plain numbers.
        Where they don't, they are taken in log space.
        """
        s = SPACE + word
        n = len(s)
        arcs, longest, exp = self.arcs.get, self.longest, math.exp
        alpha = [0.0] * (n + 1)
        alpha[0] = 1.0
        found: list[tuple[int, int, str | None, float]] = []
        for i in range(n):
            here = alpha[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = s[i:j]
                w = arcs(piece, 0)
                if w:
                    w = exp(w) * PER_CHARACTER ** (j - i)
                    alpha[j] += here * w
                    found.append((i, j, piece, w))
                elif w == 0:
                    break
            c = s[i]
            w = self.byte_weight ** (1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))) * PER_CHARACTER
            alpha[i + 1] += here * w
            found.append((i, i + 1, None, w))
        whole = alpha[n]
        if not 1e-250 < whole < 1e250 or not all(1e-250 < a < 1e250 for a in alpha):
            self._expect_logs(s, found, counts)
            return
        beta = [0.0] * (n + 1)
        beta[n] = 1.0 / whole
        for i, j, piece, w in reversed(found):
            t = w * beta[j]
            beta[i] += t
            if piece is not None:
                counts[piece] = counts.get(piece, 0.0) + alpha[i] * t

    def _table(self) -> None:
        """All beginnings of pieces by the hash of their characters: slots of neighbouring entries."""
        entries = list(self.arcs)
        self._piece_weight = np.array([np.nan if w is None else w for w in self.arcs.values()])
        self._names = entries
        keys = np.empty(len(entries), np.uint64)
        for at, chars in _by_length(entries):
            h = np.zeros(len(at), np.uint64)
            for k in range(chars.shape[1]):
                h = _onward(h, chars[:, k])
            keys[at] = h
        order = np.argsort(keys)
        self._keys, self._order = keys[order], order
        slots = np.searchsorted(self._keys, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        self._start, self._count = slots, np.diff(np.append(slots, len(keys)))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the sorted keys, or -1."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        start, left = self._start[slot], self._count[slot]
        found = np.where((left > 0) & (self._keys[np.minimum(start, len(self._keys) - 1)] == h), start, -1)
        step = 1
        rest = np.flatnonzero((left > step) & (found < 0))
        while len(rest):
            at = start[rest] + step
            hit = self._keys[at] == h[rest]
            found[rest[hit]] = at[hit]
            step += 1
            rest = rest[~hit & (left[rest] > step)]
        return found

    def _forward(self, chars: np.ndarray, share: float = 0.0, arcs: list | None = None) -> np.ndarray:
        """(places, words) log sums of all ways from the beginning, for words of one length; ``arcs`` gets the pieces' arcs."""
        m, n = chars.shape
        byte = self.byte * (1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF))
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = share
        for i in range(n):
            a = alpha[i]
            alpha[i + 1] = np.logaddexp(alpha[i + 1], a + byte[:, i])
            rows, h = np.arange(m), np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = _onward(h, chars[rows, j - 1])
                at = self._find(h)
                alive = at >= 0
                rows, h, at = rows[alive], h[alive], at[alive]
                if not len(rows):
                    break
                entry = self._order[at]
                w = self._piece_weight[entry]
                real = w == w
                r, w = rows[real], w[real]
                alpha[j, r] = np.logaddexp(alpha[j, r], a[r] + w)
                if arcs is not None:
                    arcs.append((i, j, r, entry[real], w))
        return alpha

    def log_probabilities(self, words: list[str], share: float = 0.0, own: np.ndarray | None = None) -> np.ndarray:
        """``log_probability`` of many words; ``own`` has -inf where a word has no arc of its own."""
        out = np.empty(len(words))
        own = np.full(len(words), -np.inf) if own is None else own
        for at, chars in _by_length([SPACE + w for w in words]):
            if len(at) < FEW:
                out[at] = [self.log_probability(words[k], share, None if own[k] == -np.inf else own[k]) for k in at]
            else:
                out[at] = np.logaddexp(self._forward(chars, share)[-1] + self.end, own[at])
        return out

    def expect_all(self, words: list[str], counts: dict[str, float]) -> None:
        """``expect`` of many words."""
        total = np.zeros(len(self._names))
        for at, chars in _by_length([SPACE + w for w in words]):
            if len(at) < FEW:
                for k in at:
                    self.expect(words[k], counts)
                continue
            arcs: list = []
            alpha = self._forward(chars, 0.0, arcs)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = -alpha[-1]
            byte = self.byte * (1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF))
            for i in range(len(alpha) - 2, -1, -1):
                beta[i] = byte[:, i] + beta[i + 1]
                while arcs and arcs[-1][0] == i:
                    _, j, r, entry, w = arcs.pop()
                    t = w + beta[j, r]
                    beta[i, r] = np.logaddexp(beta[i, r], t)
                    total += np.bincount(entry, np.exp(alpha[i, r] + t), len(total))
        for k in np.flatnonzero(total):
            counts[self._names[k]] = counts.get(self._names[k], 0.0) + float(total[k])

    @staticmethod
    def _expect_logs(s: str, found: list[tuple[int, int, str | None, float]], counts: dict[str, float]) -> None:
        n = len(s)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for i, j, _, w in found:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + math.log(w))
        for i, j, piece, w in reversed(found):
            t = math.log(w) + beta[j]
            beta[i] = np.logaddexp(beta[i], t)
            if piece is not None:
                counts[piece] = counts.get(piece, 0.0) + math.exp(alpha[i] + t - alpha[n])


def lattice_at(path: str | None = None) -> Lattice:
    """This process's lattice with a vocabulary's own weights."""
    return sole(f"lattice {path}", lambda: Lattice(vocabulary_weights(path)))


class Discounted:
    """Absolute discounting over counted units: ``total`` units, ``distinct`` ones, those seen once and twice."""

    def __init__(self, total: int, distinct: int, once: int, twice: int):
        self.total, self.distinct = total, distinct
        self.discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.spread = self.discount * distinct / total if total else 0.5

    def own(self, c: int) -> float | None:
        """Natural log of a unit's own arc."""
        return math.log((c - self.discount) / self.total) if c else None


def count_units(rows: DataFrame) -> DataFrame:
    """Words (``word``) and lines (``line``, a key): c (occurrences in training rows) and n (in all rows)."""

    def counted(codes: np.ndarray, size: int, held: np.ndarray) -> list[pa.Array]:
        n = np.bincount(codes, minlength=size)
        return [pa.array(np.bincount(codes[~held], minlength=size), pa.int64()), pa.array(n, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "line", "c", "n"]
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                coded, starts, text = split_lines(part.column("text"))
                words, index = coded.dictionary, np.asarray(coded.indices)
                if not len(words):
                    continue
                held = np.asarray(part.column("held_out"))[text]
                yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), *counted(index, len(words), np.repeat(held, np.diff(starts)))], names=names)
                lines, line = np.unique(line_keys(hashes(words)[index], starts), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(lines), pa.string()), pa.array(lines), *counted(line, len(lines), held)], names=names)

    units = rows.select("text", "held_out").transform(arrow_map, run, "word string, line long, c long, n long")
    return units.groupBy("word", "line").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def expected_pieces(words: DataFrame, vocabulary: str | None = None) -> dict[str, float]:
    """Expected numbers of pieces over the distinct training words: as many rows as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_at(vocabulary)
        counts: dict[str, float] = {}
        for some in gathered(batches):
            lattice.expect_all(some.column("word").to_pylist(), counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], names=["piece", "n"])

    found = words.where(F.col("c") > 0).select("word").transform(arrow_map, run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("piece").to_pylist(), np.round(np.asarray(found.column("n")), 6).tolist(), strict=True))


def with_lattice(spark: SparkSession, words: DataFrame, counts: Discounted, vocabulary: str | None = None) -> DataFrame:
    """``words`` with ``hash``, ``score``, the log10 of the word's marginal, and ``pure``, that by the vocabulary's own weights without other arcs."""
    weights = adapted(vocabulary_weights(vocabulary), expected_pieces(words, vocabulary))
    shared, name = spark.sparkContext.broadcast(weights), f"adapted {hash(tuple(weights.values()))}"
    share = math.log(counts.spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, plain = sole(name, lambda: (Lattice(shared.value), Lattice(vocabulary_weights(vocabulary))))
        for some in gathered(batches):
            some = some.combine_chunks()
            c = np.asarray(some.column("c"))
            with np.errstate(divide="ignore"):
                own = np.log(np.where(c > 0, c - counts.discount, 0) / max(1, counts.total))
            texts = some.column("word").to_pylist()
            found, pure = lattice.log_probabilities(texts, share, own) / LOG10, plain.log_probabilities(texts) / LOG10
            whole = some.append_column("hash", pa.array(hashes(some.column("word")).view(np.int64))).append_column("score", pa.array(found, pa.float64())).append_column("pure", pa.array(pure, pa.float64()))
            yield from whole.to_batches()

    return words.select("word", "c", "n").transform(arrow_map, run, "word string, c long, n long, hash long, score double, pure double")


def least_count(units: DataFrame, most: int) -> float:
    """A count that at most ``most`` units reach, from a table of at most 64 * 8 rows."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["level"], r["k"]) for r in units.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, reached = math.inf, 0
    for at, k in levels:
        reached += k
        if reached > most:
            break
        least = 2 ** ((at - 1e-6) / 8)
    return least


class Table:
    """Values by a 64-bit key."""

    def __init__(self, found: pa.Table, key: str):
        keys = np.asarray(found.column(key))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = {k: np.asarray(found.column(k))[order] for k in found.column_names if k != key}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or the number of keys where it isn't here."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))


PARTS = "owner long, line_no int, doc_id long, held_out boolean, word string, times long, line long, k long, own long, n_tokens long, n_known long, base double, score double, pure double"


def parts_of(rows: DataFrame, words: Table, lines: Table) -> DataFrame:
    """What is known of each line of each row: a row for the line, one for the text (line_no -1), and one for each word that isn't in ``words``."""
    shared = rows.sparkSession.sparkContext.broadcast((words, lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lines = shared.value
        known, base, score, pure = (np.append(words.values[k], 0) for k in ("known", "base", "score", "pure"))
        occurrences = np.append(lines.values["c"], -1)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                coded, starts, text = split_lines(part.column("text"))
                hashed, index = hashes(coded.dictionary), np.asarray(coded.indices).astype(np.int64)
                owner, doc, held = (part.column(k) for k in ("owner", "doc_id", "held_out"))
                line_no = np.arange(len(text)) - np.searchsorted(text, text)

                def rows(of: np.ndarray | None, n: int, owner=owner, doc=doc, held=held, text=text, line_no=line_no, **columns) -> pa.RecordBatch:
                    at = None if of is None else pa.array(text[of])
                    taken = [x if at is None else x.take(at) for x in (owner, doc, held)]
                    place = np.full(n, -1) if of is None else line_no[of]
                    arrays = {"owner": taken[0], "line_no": pa.array(place, pa.int32()), "doc_id": taken[1], "held_out": taken[2]} | columns
                    return pa.RecordBatch.from_arrays([arrays.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

                yield rows(None, part.num_rows, n_tokens=pa.array(np.ones(part.num_rows, np.int64)))
                if not len(text):
                    continue
                found = words.find(hashed.view(np.int64))
                at = found[index]
                key = line_keys(hashed[index], starts)
                k = occurrences[lines.find(key)]
                # a training text's own occurrences of a line
                order = np.lexsort((key, text))
                fresh = np.append(True, (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0))
                group = np.cumsum(fresh) - 1
                own = np.empty(len(text), np.int64)
                own[order] = np.bincount(group)[group]
                own[np.asarray(held)[text]] = 0
                every = np.arange(len(text))
                total = lambda x, at=at, starts=starts: pa.array(np.add.reduceat(x[at], starts[:-1]))
                yield rows(
                    every, len(text), line=pa.array(key), k=pa.array(k, mask=k < 0), own=pa.array(own), n_tokens=pa.array(np.diff(starts)), n_known=total(known.astype(np.int64)), base=total(base), score=total(score), pure=total(pure)
                )
                rare = np.flatnonzero(at == len(words.keys))
                if len(rare):
                    line_of = np.repeat(every, np.diff(starts))[rare]
                    pair, n = np.unique(line_of * len(hashed) + index[rare], return_counts=True)
                    yield rows(pair // len(hashed), len(pair), word=coded.dictionary.take(pa.array(pair % len(hashed))), times=pa.array(n, pa.int64()))

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PARTS.split(", ")])
    return rows.transform(arrow_map, run, PARTS)


def log_sum(a: Column, b: Column) -> Column:
    """log10 of the sum of two numbers given by log10."""
    top = F.greatest(a, b)
    return top + F.log10(F.pow(F.lit(10.0), a - top) + F.pow(F.lit(10.0), b - top))


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 10, held_out: int = 0, vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", folds) == held_out).alias("held_out"), F.col("text").cast("string").alias("text")
    ).withColumn("owner", F.xxhash64("doc_id", "text"))
    units = staged(spark, count_units(rows), "units")
    is_word = F.col("word").isNotNull()
    ends = rows.where(~F.col("held_out")).count()

    def count(kind: Column, more: int = 0) -> Discounted:
        sums = units.where(kind).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
        return Discounted((sums["n"] or 0) + more, sums["v"] + (more > 0), sums["n1"], sums["n2"])

    words_seen, lines_seen = count(is_word, ends), count(~is_word)
    total, distinct = words_seen.total, words_seen.distinct
    words = staged(spark, with_lattice(spark, units.where(is_word), words_seen, vocabulary), "words")
    # a line matters where another text may have it
    lines = units.where(~is_word & (F.col("n") > 1) & (F.col("c") > 0)).select("line", "c", "n")

    least_word, least_line = least_count(words, head), least_count(lines, head)
    top = words.where(F.col("n") >= least_word).select("hash", "c", "score", "pure").toArrow()
    base = lambda c: np.log10((np.asarray(c) + 0.1) / (total + 0.1 * (distinct + 1)))
    top = pa.table({"hash": top.column("hash"), "known": pa.array(np.asarray(top.column("c")) > 0), "base": base(top.column("c")), "score": top.column("score"), "pure": top.column("pure")})
    top_lines = lines.where(F.col("n") >= least_line).select("line", "c").toArrow()
    parts = staged(spark, parts_of(rows, Table(top, "hash"), Table(top_lines, "line")), "parts")

    rare = parts.where(is_word).select("owner", "line_no", "word", "times").join(words.where(F.col("n") < least_word).select("word", "c", "score", "pure"), "word")
    rare_base = F.log10((F.col("c") + 0.1) / (float(total) + 0.1 * (distinct + 1)))
    null = lambda kind: F.lit(None).cast(kind)
    rare = rare.select(
        "owner", "line_no", null("long").alias("doc_id"), null("boolean").alias("held_out"), null("long").alias("line"), null("long").alias("k"), null("long").alias("own"), null("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * rare_base).alias("base"), (F.col("times") * F.col("score")).alias("score"),
        (F.col("times") * F.col("pure")).alias("pure"),
    )
    both = parts.where(~is_word).select(rare.columns).unionByName(rare)
    # rows equal in id and text come together; copies counts them
    sums = both.groupBy("owner", "line_no").agg(
        *[F.max(k).alias(k) for k in ("doc_id", "held_out", "line", "k", "own")], F.count("n_tokens").alias("copies"), *[F.sum(k).alias(k) for k in ("n_tokens", "n_known", "base", "score", "pure")]
    )
    sums = staged(spark, sums, "lines")
    asked = F.col("k").isNull() & F.col("line").isNotNull()
    tail = lines.where(F.col("n") < least_line).select("line", F.col("c").alias("tail_k"))
    met = sums.where(asked).join(tail, "line", "left").withColumn("k", F.coalesce("k", "tail_k")).select(sums.columns).unionByName(sums.where(~asked))

    whole = F.greatest(F.coalesce(F.col("k") - F.col("own"), F.lit(0)) - lines_seen.discount, F.lit(0.0))
    spelled = F.col("score") / F.col("copies") + F.col("n_tokens") / F.col("copies") * math.log10(1 - LINE_SHARE)
    line = F.when(whole > 0, log_sum(F.log10(LINE_SHARE * whole / max(1, lines_seen.total)), spelled)).otherwise(spelled)
    out = met.groupBy("owner").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("copies").alias("copies"), F.sum(F.col("n_tokens") / F.col("copies")).alias("n_tokens"),
        F.sum(F.col("n_known") / F.col("copies")).alias("n_known"), F.sum(F.col("base") / F.col("copies")).alias("base"), F.sum(F.when(F.col("line_no") >= 0, line)).alias("score"),
        F.sum(F.col("pure") / F.col("copies")).alias("pure"),
    )
    end = words_seen.own(ends)
    end_score = (math.log(0.5) if end is None else end) / LOG10 + math.log10(1 - LINE_SHARE)
    share = ends / total if total else 0.5
    lengths = (F.round("n_tokens") - 1) * (math.log10(1 - share) if share < 1 else 0.0) + math.log10(share or 0.5)
    return out.select(
        "doc_id", "held_out", F.round("n_tokens").cast("long").alias("n_tokens"), (F.round(F.coalesce("n_known", F.lit(0))).cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.coalesce("base", F.lit(0.0)) + float(base(ends))).alias("base_score"), (F.coalesce("score", F.lit(0.0)) + end_score).alias("score"),
        (F.coalesce("pure", F.lit(0.0)) + lengths).alias("lattice_score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
