"""Vectorised word and n-gram hashing over Arrow batches of texts.

All functions work on one flat UTF-8 byte array of many texts. The hash of a
word is multilinear: every byte counts with a fixed random number for its
place in the word, so two given words share it with a chance of about 2**-57,
however they are built. The hash of a run of words is put together by doubling
from hashes of half its length and mixed at each step; its parts are never
summed up, so patterns of words have no hash in common either.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_coefficients: dict[int, np.ndarray] = {}
#: What empties the caches that an operator's tasks keep in a worker for one another.
caches: list[Callable[[], None]] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

#: Word separators: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def coefficients(family: int, n: int) -> np.ndarray:
    """Random numbers of a hash family for places 0 to n - 1 (at least)."""
    have = _coefficients.get(family)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = mix(mix(np.arange(1, size + 1, dtype=U64) * _GOLDEN + U64(family)) * _GOLDEN)
        if size <= 1 << 22:
            _coefficients[family] = have
    return have


def give_back(cached: bool = True) -> None:
    """Memory that this worker's tasks have freed goes back to the system, else it stays with the worker; with ``cached``, caches too."""
    if cached:
        for clear in caches:
            clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1_000_000, cached: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``limit`` bytes of text, so that a task's memory has a bound; a longer text comes alone. First the worker gives back what earlier tasks left, caches too unless they are ``cached`` for this one."""
    give_back(not cached)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null as empty) and the offsets of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _runs_of_bytes(values: np.ndarray, lengths: np.ndarray, family: int) -> np.ndarray:
    """A hash of each of the byte strings that stand one after the other in ``values`` (none is empty)."""
    first = np.cumsum(lengths) - lengths
    numbers = coefficients(family, int(lengths.max()))
    out = np.empty(len(lengths), U64)
    at = 0
    while at < len(lengths):  # some strings at a time, so that what is in between stays small
        to = max(at + 1, int(np.searchsorted(first, first[at] + 250_000)))
        begin, end = int(first[at]), int(first[to - 1] + lengths[to - 1])
        starts = first[at:to] - begin
        place = np.arange(end - begin) - np.repeat(starts, lengths[at:to])
        out[at:to] = np.add.reduceat(numbers[place] * (values[begin:end].astype(U64) + U64(1)), starts)
        at = to
    return mix(out)


class Words:
    """Words of many texts: byte starts and ends, text of each, and a 64-bit hash of each (``others``: of a second, independent family)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, hashes: int = 1):
        n = len(buf)
        word = ~IS_SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[off] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: Words of text i are bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.bounds)
        if hashes:
            empty = np.empty(0, U64)
            values = (LOWER[buf] if lower else buf)[word]
            self.hashes, self.others = (_runs_of_bytes(values, self.ends - self.starts, k) if k <= hashes and len(values) else empty for k in (1, 2))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD1342543DE82EF97) + (b ^ _GOLDEN))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each place on that has as many after it (across texts, too)."""
    have = 1
    while 2 * have <= size:
        hashes = _joined(hashes[:-have], hashes[have:]) if len(hashes) > have else hashes[:0]
        have *= 2
    if rest := size - have:
        hashes = _joined(hashes[:-rest], hashes[rest:]) if len(hashes) > rest else hashes[:0]
    return hashes


def distinct_words(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of one occurrence of each (text, hash), in ascending order."""
    _, at = np.unique(mix(hashes + owner.astype(U64) * _GOLDEN), return_index=True)
    at.sort()
    return at
