"""Whole-batch text work on the bytes of an Arrow string column.

Words and their 64-bit hashes come from array operations over the UTF-8 bytes of many documents at a time; nothing loops
over words in Python. Work goes in slices of about ``SLICE`` bytes so that memory stays bounded; one longer document makes
one longer slice.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20


def process_cache(name: str, make: Callable):
    """A value made once per worker process; code shipped by value has no lasting module of its own."""
    home = sys.modules.setdefault("_gapfill_llm_cache", types.ModuleType("_gapfill_llm_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def separators_white() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def separators_alnum() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing A-Z)."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code for each byte; A-Z share the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_STEP = 0x2545F4914F6CDD1D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    cache = process_cache("powers", dict)
    if len(cache.get("up", ())) < n:
        n = max(n, 2 * SLICE)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["up"], cache["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of documents ``lo`` to ``hi`` of a batch."""

    lo: int
    hi: int
    data: np.ndarray       # bytes of these documents
    offsets: np.ndarray    # byte offset of each document, and the end
    first: np.ndarray      # first byte of each word
    last: np.ndarray       # one past its last byte
    hashes: np.ndarray     # hash of its lower-cased bytes
    starts: np.ndarray     # first word of each document, and the end

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        """The document (0-based in this slice) of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; only meaningful while they stay in one document."""
        h = self.hashes
        n = max(0, len(h) - k + 1)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out *= np.uint64(0x9FB21C651E98DF25)
            out += h[j:j + n]
        return mix(out)

    def hash_of(self, at: int, k: int) -> np.uint64:
        """The hash that ``windows(k)`` has at one position."""
        part = Words(0, 0, self.data, self.offsets, self.first, self.last, self.hashes[at:at + k], self.starts)
        return part.windows(k)[0]

    def complete(self, k: int) -> np.ndarray:
        """Positions from which ``k`` words follow within the same document."""
        n = max(0, len(self.hashes) - k + 1)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))[:n]
        return np.flatnonzero(np.arange(n) + k <= ends)


def _hash_words(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    codes = process_cache("codes", byte_codes)
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        base = int(first[at])
        # as many words as end within SLICE bytes, one at least
        stop = max(at + 1, int(np.searchsorted(last, base + SLICE, "right")))
        a, b = first[at:stop] - base, last[at:stop] - base
        size = int(b[-1])
        up, down = _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[data[base:base + size]] * up[:size], out=sums[1:])
        out[at:stop] = (sums[b] - sums[a]) * down[a]
        at = stop
    return mix(out + (last - first).astype(np.uint64))


def find_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word; a document's start ends the word before it."""
    inside = keep[data]
    heads = offsets[:-1]
    heads = heads[heads < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def scan_words(column: pa.Array, keep: np.ndarray, size: int = SLICE) -> Iterator[Words]:
    """The words of a text column, slice by slice."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets, size):
        part = data[offsets[lo]:offsets[hi]]
        marks = offsets[lo:hi + 1] - offsets[lo]
        first, last = find_words(part, marks, keep)
        yield Words(lo, hi, part, marks, first, last, _hash_words(part, first, last), np.searchsorted(first, marks))


def word_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its ``k``-word shingles; fewer words make one shingle, none the empty set."""
    grams = words.windows(k)
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for h in words.hashes[a:b]:
                whole = np.uint64((int(whole) * 0x9FB21C651E98DF25 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal ``key``, from batches sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
