"""Substring dedup by relative Lempel-Ziv parsing.

The corpus itself is the reference, in blocks that hold every stretch which may
match (see repeats).  A block indexes all its windows; each stretch is then parsed
greedily against the whole block: at a start, the longest factor that also lies in
another stretch; a factor of at least a window's length is a duplicate span and the
parse goes on at its boundary, window by window where a factor ends, since a window
across the boundary may lie elsewhere in the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats

WORDS = 35
GRAM = 8
UNIT = repeats.Unit(words=True, length=WORDS, gram=GRAM, earlier=False)


def longest_matches(prefix: K.Prefix, starts: np.ndarray, owner: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the longest prefix, of ``length`` units at least, that lies in another context too, and where; 0 and -1 if none.

    All starts are grouped by the hash of their first m units, for m from ``length`` on; a start stays while another
    context is in its group, so that few are left after some rounds.
    """
    longest, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    live, m = np.arange(len(starts)), length
    while True:
        live = live[starts[live] + m <= end[live]]
        if not len(live):
            return longest, source
        h = prefix.of(starts[live], starts[live] + m)
        order = np.lexsort((starts[live], h))
        live, h = live[order], h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        last = np.append(first[1:], len(live)) - 1
        size = last - first + 1
        # contexts lie one after the other, so a group's first and last tell whether it has two of them
        several = np.repeat(owner[live[first]] != owner[live[last]], size)
        other = np.where(owner[live] != np.repeat(owner[live[first]], size), np.repeat(live[first], size), np.repeat(live[last], size))
        live, other = live[several], other[several]
        longest[live], source[live] = m, starts[other]
        m += 1


def parse(rows: np.ndarray, words: np.ndarray, offs: np.ndarray, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors (start in the block, length, reference place) of all contexts, each the longest at its start and at least ``length`` long."""
    prefix = K.word_prefix(K.mix(words, 51))
    span = rows["span"].astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), span + 1)
    starts = np.repeat(offs[:-1] - np.cumsum(span + 1) + span + 1, span + 1) + np.arange(len(owner))
    longest, source = longest_matches(prefix, starts, owner, offs[1:][owner], length)
    # all contexts step together: factor at the place, then on to its boundary
    place = np.cumsum(span + 1) - span - 1
    end = np.cumsum(span + 1)
    live = np.arange(len(rows))
    found = []
    while len(live):
        at = place[live]
        n = longest[at]
        hit = n >= length
        found.append(at[hit])
        place[live] = at + np.where(hit, np.maximum(n - length + 1, 1), 1)
        live = live[place[live] < end[live]]
    at = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
    return at, longest[at], source[at]


def compare(rows: np.ndarray, words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which windows lie in a factor."""
    at, n, _ = parse(rows, words, offs)
    total = int((rows["span"].astype(np.int64) + 1).sum())
    ends = np.cumsum(rows["span"].astype(np.int64) + 1)
    stop = np.minimum(at + n - WORDS + 1, ends[np.searchsorted(ends, at, side="right")])
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, stop, -1)
    return np.cumsum(cover)[:-1] > 0


def finish(texts: pa.Array, spans: list) -> dict[str, list]:
    raw, offs = K.buffer(texts)
    w = K.Words(raw, offs)
    data = raw.tobytes()
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
    for i, own in enumerate(spans):
        a, b = int(w.bounds[i]), int(w.bounds[i + 1])
        keep = np.ones(b - a, bool)
        for lo, hi in zip(*own, strict=True) if own else ():
            keep[lo:hi] = False
        out["n_words"].append(b - a)
        out["n_removed"].append(b - a - int(keep.sum()))
        s, e = w.start[a:b][keep].tolist(), w.end[a:b][keep].tolist()
        out["kept_text"].append(b" ".join(data[x:y] for x, y in zip(s, e, strict=True)).decode())
    return out


def digest(texts: pa.Array, spans: list) -> dict[str, list]:
    made = finish(texts, spans)
    made["kept_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in made.pop("kept_text")]
    return made


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): word ranges that windows of 35 words cover which also start elsewhere; may overlap."""
    return repeats.repeated_ranges(docs, UNIT, compare)


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text or kept_sha256) for every row of docs.

    Each word goes that lies in a window of 35 consecutive words whose sequence also
    starts anywhere else, in any document or the same; kept words are joined by a space.

    Defined cases: null text has no words; a text of fewer than 35 words stays; a null
    doc_id is neither compared nor cut; rows of one doc_id are compared with each other
    like any documents, and what goes from one goes from all of them; other columns
    aren't read.
    """
    out = "kept_text string" if texts else "kept_sha256 string"
    return repeats.with_ranges(docs, repeated_words(docs), finish if texts else digest, f"n_words long, n_removed long, {out}")
