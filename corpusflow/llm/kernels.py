"""Vectorised text kernels over Arrow batches.

A batch of texts is seen as one byte buffer with document offsets.  Words are
maximal runs of bytes outside 0x20 and 0x09-0x0D.  Substring hashes come from
prefix sums of a polynomial modulo 2**64 whose base is odd, hence invertible;
word hashes are mixed before they enter a second polynomial over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U = np.uint64
_BASE_BYTE = U(0x9E3779B97F4A7C15 | 1)
_BASE_WORD = U(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x += U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


_BYTE_VALUE = mix(np.arange(256, dtype=U), 7)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U(base))
        out[:1] = 1
        return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); grown in powers of two so that calls share."""
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(int(base) & (2**64 - 1), size)[:n]


def inverse(base: int) -> int:
    return pow(int(base), -1, 2**64)


class Prefix:
    """Hashes of any slice of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: U):
        self.base, n = int(base), len(values)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum(values * powers(self.base, n), out=self.sums[1:])
        self.inv = powers(inverse(self.base), n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[hi] - self.sums[lo]) * self.inv[lo]

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all slices of n values, by their start."""
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:-n]) * self.inv[: len(self.sums) - n]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


PART_BYTES = 256 << 10
PART_ROWS = 4096

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: Of text handed to a worker at once; Spark's own limit is 64 MB, which JVM and worker hold several times.
BATCH_BYTES = "4m"


def lean(run: Run) -> Run:
    """run for mapInArrow(), with batches of 4 MB for plans made from now on, giving back after each batch what
    Arrow's pool keeps, and at its end what the C library keeps: Spark keeps a worker for later stages, and
    what it holds then is lost to them."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            pa.default_memory_pool().release_unused()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            _powers.cache_clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return lean_run


def parts(batch: pa.RecordBatch, column: int, limit: int = PART_BYTES, rows: int = PART_ROWS, beside: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows, whose texts have at most ``limit`` bytes in all, or one text:
    kernels use some hundred bytes of memory for a byte of text, so batches of long texts are cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if beside is not None:
        size = size + pc.fill_null(pc.binary_length(batch.column(beside)), 0).to_numpy(zero_copy_only=False) // 8
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, done + limit, side="right"))))
        yield batch.slice(at, end - at)
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a batch: start, end in bytes, doc index, and bounds by document."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs, n = raw, offs, len(offs) - 1
        inside = ~_SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offs[:-1][offs[:-1] < len(raw)]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = offs[1:][(offs[1:] > 0)] - 1
        last[at] = inside[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))

    def __len__(self):
        return len(self.start)

    def hashes(self, raw: np.ndarray | None = None) -> np.ndarray:
        return mix(Prefix(_BYTE_VALUE[self.raw if raw is None else raw], _BASE_BYTE).of(self.start, self.end), 1)


def word_prefix(values: np.ndarray) -> Prefix:
    return Prefix(values, _BASE_WORD)


def byte_prefix(raw: np.ndarray) -> Prefix:
    return Prefix(_BYTE_VALUE[raw], _BASE_BYTE)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of all runs of n items that lie within one document."""
    total = int(bounds[-1]) if len(bounds) else 0
    ok = np.zeros(total + 1, np.int64)
    lo, hi = bounds[:-1], bounds[1:] - n + 1
    keep = hi > lo
    np.add.at(ok, lo[keep], 1)
    np.add.at(ok, hi[keep], -1)
    return np.flatnonzero(np.cumsum(ok)[:total] > 0)


def distinct_by_doc(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, value) pairs."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new]


def shingle_sets(texts: pa.Array, n: int = 5, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as sorted 64-bit hashes: (doc index, hash).

    A text of fewer words gives its whole sequence as one shingle; a text
    without words gives none.  A-Z are lower-cased if fold.
    """
    raw, offs = buffer(texts)
    if fold:
        raw = lower_ascii(raw)
    w = Words(raw, offs)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, U)
    p = word_prefix(w.hashes())
    at = window_starts(w.bounds, n)
    doc, val = w.doc[at], p.of(at, at + n)
    count = np.diff(w.bounds)
    few = np.flatnonzero((count > 0) & (count < n))
    doc = np.concatenate([doc, few])
    val = np.concatenate([val, mix(p.of(w.bounds[few], w.bounds[few + 1]), 3) + count[few].astype(U)])
    return distinct_by_doc(doc, mix(val, 5))
