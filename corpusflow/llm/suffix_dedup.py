"""Suffix-array dedup by two-stage sorting.

Reference blocks (see repeats) are sorted as one text of contexts.  Stage one sorts
directly only the suffixes that are smaller than their successors.  Stage two scans
the buckets of first bytes upwards: a suffix larger than its successor follows from
it, since its bucket fills in the order in which successors are met.  Adjacent common
prefixes of at least a window's length make intervals; of each interval's windows the
earliest in the corpus stays.  Order matters to the depth of one window only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats

BYTES = 100
GRAM = 32
UNIT = repeats.Unit(words=False, length=BYTES, gram=GRAM, earlier=True)
#: Contexts sorted at once: an anchor's contexts stay together, and memory is bounded.
SORT_BYTES = 1 << 22


def suffix_array(text: np.ndarray, depth: int = BYTES) -> np.ndarray:
    """Suffixes of text (values below 255; a final 0 is implied) in order of their first ``depth`` values.

    Ties beyond that depth are in no particular order.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.append(text.astype(np.int16) + 1, 0)
    # smaller than the successor: t[i] < t[i+1], or equal and the next suffix is
    differ = np.flatnonzero(t[1:] != t[:-1])
    rises = t[differ + 1] > t[differ]
    small = rises[np.searchsorted(differ, np.arange(n))]
    direct = np.flatnonzero(small)
    padded = np.append(text.astype(np.uint8) + 1, np.zeros(depth, np.uint8))
    windows = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    keys = np.ascontiguousarray(windows[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    head = t[direct]
    # buckets of first values: larger-than-successor suffixes first, then the others
    begin = np.searchsorted(head, np.arange(257 + 1))
    large: list[list[np.ndarray]] = [[] for _ in range(257)]
    if not small[n - 1]:
        large[t[n - 1]].append(np.array([n - 1]))  # its successor is the end, the least of all
    out = []
    for c in range(1, 257):
        i = 0
        while i < len(large[c]):  # grows while suffixes induce their predecessors in this bucket
            at = large[c][i]
            before = at[at > 0] - 1
            _induce(t, before[~small[before]], large)
            i += 1
        own = direct[begin[c] : begin[c + 1]]
        before = own[own > 0] - 1
        _induce(t, before[~small[before]], large)
        out += [*large[c], own]
    return np.concatenate(out)


def _induce(t: np.ndarray, suffixes: np.ndarray, large: list[list[np.ndarray]]) -> None:
    if len(suffixes):
        c = t[suffixes]
        order = np.argsort(c, kind="stable")
        c, suffixes = c[order], suffixes[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=True):
            large[int(c[i])].append(suffixes[i:j])


def common_prefixes(prefix: K.Prefix, order: np.ndarray, n: int, depth: int = BYTES) -> np.ndarray:
    """The longest common prefix of each suffix in order with the one before, to the depth: bisection on hashes."""
    a, b = order[1:], order[:-1]
    low, high = np.zeros(len(a), np.int64), np.minimum(depth, n - np.maximum(a, b))
    live = np.arange(len(a))
    while len(live):
        mid = (low[live] + high[live] + 1) // 2
        same = prefix.of(a[live], a[live] + mid) == prefix.of(b[live], b[live] + mid)
        low[live[same]], high[live[~same]] = mid[same], mid[~same] - 1
        live = live[low[live] < high[live]]
    return np.concatenate([np.zeros(min(1, len(order)), np.int64), low])


def _compare(rows: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n_rows = len(rows)
    # one text: contexts with an end mark after each, which no context holds
    size = np.diff(offs)
    shift = np.arange(n_rows)
    text = np.zeros(len(raw) + n_rows, np.uint8)
    place = np.arange(len(raw)) + np.repeat(shift, size)
    text[place] = raw + 1  # UTF-8 has no byte above 0xF4
    begin = offs[:-1] + shift
    span = rows["span"].astype(np.int64)
    owner = np.repeat(np.arange(n_rows), span + 1)
    starts = np.repeat(begin - np.cumsum(span + 1) + span + 1, span + 1) + np.arange(len(owner))
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = suffix_array(text)
    order = order[number[order] >= 0]  # starts of windows; those between them only helped to sort
    same = common_prefixes(K.byte_prefix(text), order, len(text)) >= BYTES  # intervals of the array
    w = number[order]
    group = np.cumsum(~same)
    doc = rows["doc"][owner[w]]
    at = rows["lo"][owner[w]] + (starts[w] - begin[owner[w]])
    rank = np.lexsort((at, doc, group))
    first = np.append(True, group[rank][1:] != group[rank][:-1])
    hit = np.zeros(len(starts), bool)
    hit[w[rank[~first]]] = True
    return hit


def compare(rows: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which windows have an earlier copy in the block; sorted in pieces that keep each anchor together."""
    order = np.argsort(rows["ah"], kind="stable")
    size = np.diff(offs)[order]
    new = np.append(True, rows["ah"][order][1:] != rows["ah"][order][:-1])
    total = np.cumsum(size)
    begin = np.flatnonzero(new)
    cuts, done = [0], 0
    for i, before in zip(begin[1:].tolist(), total[begin[1:] - 1].tolist(), strict=True):
        if before - done > SORT_BYTES:
            cuts.append(i)
            done = before
    cuts.append(len(order))
    starts = rows["span"].astype(np.int64) + 1
    base = np.cumsum(starts) - starts
    out = np.zeros(int(starts.sum()), bool)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[i:j]
        n = np.diff(offs)[own]
        where = np.repeat(offs[:-1][own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = _compare(rows[own], raw[where], np.concatenate([[0], np.cumsum(n)]))
        s = starts[own]
        out[np.repeat(base[own] - np.cumsum(s) + s, s) + np.arange(s.sum())] = hit
    return out


def finish(texts: pa.Array, spans: list) -> dict[str, list]:
    raw, offs = K.buffer(texts)
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for i, own in enumerate(spans):
        data = raw[offs[i] : offs[i + 1]]
        keep = np.ones(len(data), bool)
        for lo, hi in zip(*own, strict=True) if own else ():
            keep[lo:hi] = False
        out["n_bytes"].append(len(data))
        out["n_removed"].append(len(data) - int(keep.sum()))
        out["n_spans"].append(int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum()))
        out["kept"].append(data[keep].tobytes() if own else data.tobytes())
    return out


def digest(texts: pa.Array, spans: list) -> dict[str, list]:
    made = finish(texts, spans)
    made["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in made.pop("kept")]
    return made


def with_text(texts: pa.Array, spans: list) -> dict[str, list]:
    made = finish(texts, spans)
    made["kept_text"] = [t.decode(errors="replace") for t in made.pop("kept")]
    return made


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): byte ranges covered by 100-byte strings that also start earlier; may overlap."""
    return repeats.repeated_ranges(docs, UNIT, compare)


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text or kept_sha256) for every row of docs.

    Each byte goes that lies in a 100-byte string which also starts in a document of smaller
    doc_id, or earlier in the same.  kept_text replaces what a cut leaves of a character.

    Defined cases: null text counts as empty; a text of fewer than 100 bytes stays; a null
    doc_id is neither compared nor cut; rows of one doc_id are compared with each other (ties:
    by place), and what goes from one goes from all of them; other columns aren't read.
    """
    out = "kept_text string" if texts else "kept_sha256 string"
    return repeats.with_ranges(docs, repeated_bytes(docs), with_text if texts else digest, f"n_bytes long, n_removed long, n_spans long, {out}")
