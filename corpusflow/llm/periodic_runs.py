"""Periodic runs of words: stretches that repeat with a period, found on a harmonic grid.

For every period q the multiples of q are grid points.  A run of period q and at least 2 * q words
holds two neighbouring points i and i + q; from there the longest common extensions to the right
and to the left give the whole run.  The grids of all periods have n/1 + n/2 + ... points for n
words.  Extensions are binary-searched for all (period, point) pairs at once over prefix hashes
of two primes; a point whose two words differ has none and leaves first.  Runs are verified word
by word; one with a collision has its document done again with another base.  The same stretch
is found from several points and under multiples of its period: the smallest period stays.

A document is one row of one task, so nothing is shuffled; texts are cut into parts of bounded
size, and the pairs of a part into chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MIN_LENGTH = 12
#: Pairs (period, grid point) that are searched at once.
CHUNK = 1 << 18
_PRIMES = (np.int64(2147483647), np.int64(2147483629))


class _Hashes:
    """Prefix hashes modulo two primes below 2**31, of which no pattern of values makes all bases collide."""

    def __init__(self, values: np.ndarray, seed: int):
        self.sums, self.powers = [], []
        for k, prime in enumerate(_PRIMES):
            base = int(K.mix(np.array([seed * 2 + k], K.U), 17)[0] % K.U(int(prime) - 1000)) + 500
            x = (K.mix(values.astype(K.U), 31 + seed * 2 + k) % K.U(prime)).astype(np.int64)
            power = np.ones(len(values) + 1, np.int64)
            done = 1
            while done < len(power):  # powers by doubling
                some = min(done, len(power) - done)
                power[done : done + some] = power[:some] * pow(base, done, int(prime)) % prime
                done += some
            self.sums.append(np.concatenate([[0], np.cumsum(x * power[:-1] % prime) % prime]))
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n values from a and from b (a < b) have equal hashes."""
        out = np.ones(len(a), bool)
        for sums, power, prime in zip(self.sums, self.powers, _PRIMES):
            left, right = (sums[a + n] - sums[a]) % prime, (sums[b + n] - sums[b]) % prime
            out &= left * power[b - a] % prime == right
        return out


def _longest(most: np.ndarray, holds) -> np.ndarray:
    """The largest n <= most for which holds(index, n), for all entries at once; n = 0 always does."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_] + 1) >> 1
        ok = holds(open_, mid)
        low[open_[ok]], high[open_[~ok]] = mid[ok], mid[~ok] - 1
    return low


def _found(words: np.ndarray, bounds: np.ndarray, hashes: _Hashes, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, period) of the stretches found from all grid points, repeats and multiples included."""
    sizes = np.diff(bounds)
    periods = np.maximum(sizes // 2, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[doc] - 1) // q  # i = 0, q, 2q, ... with i + q inside
    before, out, at = np.concatenate([[0], np.cumsum(points)]), [], 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
        for skip in range(0, int(before[end] - before[at]), CHUNK):  # one period may have more points than a chunk
            pair = np.arange(before[at] + skip, min(before[end], before[at] + skip + CHUNK))
            grid = np.searchsorted(before, pair, side="right") - 1
            step = q[grid]
            a = bounds[doc[grid]] + (pair - before[grid]) * step
            same = words[a] == words[a + step]
            grid, step, a = grid[same], step[same], a[same]
            if not len(a):
                continue
            lo, hi = bounds[doc[grid]], bounds[doc[grid] + 1]
            right = _longest(hi - a - step, lambda k, n: hashes.equal(a[k], a[k] + step[k], n))
            # a stretch long enough needs so much to the left
            near = right + step + (a - lo) >= np.maximum(min_length, 2 * step)
            grid, step, a, lo, right = grid[near], step[near], a[near], lo[near], right[near]
            left = _longest(a - lo, lambda k, n: hashes.equal(a[k] - n, a[k] - n + step[k], n))
            long = left + right + step >= np.maximum(min_length, 2 * step)
            out.append(np.stack([doc[grid], a - left, a + step + right, step])[:, long])
        at = end
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 4


def _verified(words: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.array([np.array_equal(words[s : e - p], words[s + p : e]) for s, e, p in zip(start.tolist(), end.tolist(), q.tolist())], bool)


def runs(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, period) of every run, by document, start and period.

    words are ids, those of document d from bounds[d] to bounds[d + 1]; starts and ends are places in words.
    """
    doc, start, end, q = _found(words, bounds, _Hashes(words, seed), min_length)
    order = np.lexsort((q, end, start, doc))
    doc, start, end, q = doc[order], start[order], end[order], q[order]
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch comes first
    doc, start, end, q = doc[new], start[new], end[new], q[new]
    wrong = np.unique(doc[~_verified(words, start, end, q)])
    if len(wrong):  # a collision can only make a stretch too long, so what is verified is right
        fine = ~np.isin(doc, wrong)
        parts = [(doc[fine], start[fine], end[fine], q[fine])]
        for d in wrong.tolist():
            lo, hi = bounds[d], bounds[d + 1]
            _, s, e, p = runs(words[lo:hi], np.array([0, hi - lo]), min_length, seed + 1)
            parts.append((np.full(len(s), d), s + lo, e + lo, p))
        doc, start, end, q = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], end[order], q[order]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): word i >= a of this document becomes word a + (i - a) % p; None for most documents."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given words, a space after each, and where each begins there."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.append(raw, np.uint8(32))[np.minimum(np.repeat(start - at[:-1], size) + np.arange(at[-1]), len(raw))]
    out[at[1:] - 1] = 32
    return out, at


def _digests(ids: pa.Array, texts: pa.Array, min_length: int, tails: bool, with_texts: bool) -> pa.RecordBatch:
    raw, offs = K.buffer(texts)
    w, n_docs = K.Words(raw, offs), len(offs) - 1
    letters, at = _joined(raw, w.start, w.end)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
    code = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(w))
    for d, i in enumerate(ids.to_pylist() if tails else []):
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        if (tail := repeated_tail(i, hi - lo)) is not None:
            a, p = tail
            place[lo + a : hi] = lo + a + np.arange(hi - lo - a) % p
    doc, start, end, q = runs(code[place], w.bounds, min_length)
    gone = np.zeros(len(w) + 1, np.int64)
    late = np.minimum(start + q, end)
    np.add.at(gone, late, 1)
    np.add.at(gone, end, -1)
    stays = np.cumsum(gone)[:-1] == 0
    kept = place[stays]
    collapsed, at = _joined(raw, w.start[kept], w.end[kept])
    cut = at[np.concatenate([[0], np.cumsum(stays)])[w.bounds]]
    start, length, of_doc = start - w.bounds[doc], end - start, np.searchsorted(doc, np.arange(n_docs + 1))
    rows = []
    for d in range(n_docs):
        mine = slice(of_doc[d], of_doc[d + 1])
        found = list(zip(start[mine].tolist(), length[mine].tolist(), q[mine].tolist()))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        text = collapsed[cut[d] : max(cut[d], cut[d + 1] - 1)].tobytes()
        rows.append((len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), *((text.decode(),) if with_texts else ())))
    kinds = [pa.int64()] * 5 + [pa.string()] * (3 if with_texts else 2)
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=_COLUMNS[: 1 + len(kinds)])


_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "text"]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, tails: bool = False, texts: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, text) for every row of docs.

    A run is a stretch of consecutive words with smallest period q and at least max(min_length, 2 * q)
    words, that no word beside it extends.  The longest run is given by its first word's number, its words,
    its period and 1000 * length // period (the first of equally long ones).  text: the words joined by
    one space without those that a run contains after its first q words.  ``tails`` puts a periodic tail
    into a tenth of the documents first, chosen by their ids; texts=False leaves text out.

    Defined cases: a null or empty text has no words and no run, four nulls, and the digests of ''; a null
    doc_id gets no tail; rows that repeat are done each for itself; other columns aren't read; no rows, no output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 1):
                yield _digests(b.column(0), b.column(1), min_length, tails, texts)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + (", text string" if texts else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), schema)
