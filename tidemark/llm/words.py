"""Words of many texts at once, as numpy arrays over Arrow batches.

A block is a run of whole texts. Its bytes are laid end to end with one space after each
text, so no word spans two texts, and every word is a byte span of that buffer. Word hashes
are 64-bit polynomials over random byte values; a span of words gets a polynomial over its
word hashes, so any span hash costs two lookups in a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words of ``[^\x20\x09-\x0D]+``, and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding A-Z.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=16)
def _powers(base: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(1 << bits, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(10, int(n).bit_length()))[:n]


@lru_cache(maxsize=16)
def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Whole texts ``rows`` of a batch: padded bytes and the words' byte spans.

    ``first[i]:first[i + 1]`` are the words of text i, ``text`` is each word's text."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def span(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by one space."""
        return " ".join(self.word(k) for k in range(i, j))

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        values, inverse = _byte_values(seed), np.uint64(_inverse(int(_BASE)))
        lo = 0
        while lo < len(out):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + BLOCK_BYTES, "right")))
            piece = self.data[base : self.ends[hi - 1]]
            s, e = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(values[piece] * powers(_BASE, len(piece)), out=sums[1:])
            out[lo:hi] = mix((sums[e] - sums[s]) * powers(inverse, len(piece))[s] + (e - s).astype(np.uint64))
            lo = hi
        return out


class Spans:
    """Hashes of spans of words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray, base: int = 0xD6E8FEB86659FD93):
        self.inverse = powers(np.uint64(_inverse(base)), len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(np.uint64(base), len(hashes)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length)


def blocks(texts: pa.Array, word_bytes: np.ndarray, fold: np.ndarray | None = None) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES`` of whole texts (one longer text is a block of its own).
    A null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, raw = texts.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + BLOCK_BYTES, "right")) - 1)
        rel = where[lo : hi + 1] - where[lo]
        data = np.insert(raw[where[lo] : where[hi]], rel[1:], 0x20)
        if fold is not None:
            data = fold[data]
        step = np.diff(word_bytes[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        rel = rel + np.arange(len(rel))
        yield Block(range(lo, hi), data, rel, starts, ends, np.searchsorted(starts, rel))
        lo = hi


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, where its smallest one stands, the first if equal."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right, left = best[step:], best[: len(best) - step]
        less = right < left
        at = np.where(less, at[step:], at[: len(at) - step])
        best = np.where(less, right, left)
        have += step
    return at[:n]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values dealt out to rows of ``counts`` each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
