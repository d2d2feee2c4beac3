"""Words and lines of texts as numbers, for whole Arrow arrays of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, dictionary-coded, and the offsets of each text in them.

    Splitting may leave empty words at the ends of a text; these are dropped.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(split.offsets).astype(np.int64)
    words = split.flatten()
    offsets -= offsets[0]
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        dropped = np.concatenate([[0], np.cumsum(empty)])
        offsets = offsets - dropped[offsets]
        words = words.filter(pa.array(~empty))
    return words.dictionary_encode(), offsets


def split_lines(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of all texts, dictionary-coded; the start of each line with words in them, with one end; each line's text."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lines.offsets)))
    coded, offsets = split_words(lines.flatten())
    full = np.diff(offsets) > 0
    return coded, np.append(offsets[:-1][full], offsets[-1]), text[full]


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def line_keys(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each line's sequence of words, from the words' hashes."""
    n = np.diff(starts)
    if not len(n):
        return np.zeros(0, np.int64)
    place = (np.arange(len(word)) - np.repeat(starts[:-1], n) + 1).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(word + place * MIX), starts[:-1]) + n.astype(np.uint64)).view(np.int64)
