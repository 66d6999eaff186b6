"""Document fingerprints: invertible Bloom lookup sketches of paragraph cells.

A text is cut into paragraph cells: at line ends, after sentence ends, and inside
long stretches after words whose hash says so, so that cuts depend on the content
near them.  A cell's key is its hash and its number among equal cells of the text.
A sketch of m cells adds every key to three of them: count, sum of keys, sum of
check values.  A fingerprint is a sketch with the number of its keys.  Two of them
subtract; what is left peels: a cell that holds one key gives it away, which frees
others.  Likeness is the Jaccard similarity of the key sets, from the numbers of keys
and of recovered ones, so that two fingerprints suffice (compared()).  Only if
something stays are both texts sketched anew, four times as large.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import partition_keys

CELLS = 24
GROW = 4
TRIES = 12
#: One word of so many ends a cell.
CUT_WORDS = 12


def cell_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all paragraph cells of a batch, in document order."""
    raw, offs = K.buffer(texts)
    n = len(offs) - 1
    w = K.Words(raw, offs)
    cut = np.zeros(len(raw), bool)
    cut[1:] = ((raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)) & (raw[1:] == 32)
    cut[offs[:-1][offs[:-1] < len(raw)]] = False  # the byte before is another document's
    cut |= raw == 10
    chosen = (w.hashes() % K.U(CUT_WORDS) == 0) & (w.end < offs[w.doc + 1])
    cut[w.end[chosen]] = True
    bounds = np.unique(np.concatenate([offs, np.flatnonzero(cut) + 1]))
    bounds = bounds[bounds <= len(raw)]
    start, end = bounds[:-1], bounds[1:]
    doc = np.searchsorted(offs, start, side="right") - 1
    h = K.mix(K.byte_prefix(raw).of(start, end) + (end - start).astype(K.U), 31)
    order = np.lexsort((np.arange(len(h)), h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
    out = np.empty(len(h), K.U)
    out[order] = K.mix(v + nth.astype(K.U), 32)
    assert not n or not len(doc) or doc.max() < n
    return doc, out


def _places(keys: np.ndarray, m: int, seed: int) -> np.ndarray:
    third = m // 3
    return np.stack([(K.mix(keys, 41 + j + 8 * seed) % K.U(third)).astype(np.int64) + j * third for j in range(3)])


def _check(keys: np.ndarray) -> np.ndarray:
    return K.mix(keys, 40)


def sketch(doc: np.ndarray, keys: np.ndarray, n: int, m: int = CELLS, sign: np.ndarray | None = None, seed: int = 0):
    """Counts, key sums and check sums, each (n, m); sign subtracts the keys where it is -1."""
    sign = np.ones(len(keys), np.int64) if sign is None else sign
    count, total, check = np.zeros(n * m, np.int64), np.zeros(n * m, K.U), np.zeros(n * m, K.U)
    up = sign.astype(K.U)
    with np.errstate(over="ignore"):
        for at in _places(keys, m, seed) if len(keys) else ():
            at = at + doc * m
            np.add.at(count, at, sign)
            np.add.at(total, at, keys * up)
            np.add.at(check, at, _check(keys) * up)
    return count.reshape(n, m), total.reshape(n, m), check.reshape(n, m)


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recovered (pair, key) and which pairs are empty afterwards.  The arrays are used up."""
    n, m = count.shape
    count, total, check = count.ravel(), total.ravel(), check.ravel()
    pairs, keys = [], []
    with np.errstate(over="ignore"):
        while True:
            one = np.flatnonzero(np.abs(count) == 1)
            sign = count[one].astype(K.U)
            key = total[one] * sign
            pure = check[one] * sign == _check(key)
            one, key, step = one[pure], key[pure], count[one][pure]
            if not len(one):
                break
            pair = one // m
            order = np.lexsort((key, pair))
            pair, key, step = pair[order], key[order], step[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
            pair, key, step = pair[new], key[new], step[new]
            pairs.append(pair)
            keys.append(key)
            up = step.astype(K.U)
            for at in _places(key, m, seed):
                at = at + pair * m
                np.subtract.at(count, at, step)
                np.subtract.at(total, at, key * up)
                np.subtract.at(check, at, _check(key) * up)
    empty = ((count == 0) & (total == 0) & (check == 0)).reshape(n, m).all(1)
    return np.concatenate([*pairs, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, K.U)]), empty


def differences(sketches, left: np.ndarray, right: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each pair of documents left[i], right[i], how many keys are in one only.

    sketches: those of all documents, with CELLS cells, which are subtracted and peeled; of
    pairs of which something stays larger ones are made from (doc, key), sorted by doc,
    until all peel.
    """
    n = len(left)
    out = np.full(n, -1, np.int64)
    with np.errstate(over="ignore"):
        pair, _, empty = peel(*((x[left] - x[right]).copy() for x in sketches))
    got = np.bincount(pair, minlength=n)
    out[empty] = got[empty]
    open_, m = np.flatnonzero(~empty), CELLS
    ends = np.searchsorted(doc, np.arange(len(sketches[0]) + 1))
    for attempt in range(1, TRIES):
        if not len(open_):
            return out
        a, b = left[open_], right[open_]
        size = ends[1:] - ends[:-1]
        own, other = size[a], size[b]
        at = np.concatenate([np.repeat(ends[a] - np.cumsum(own) + own, own) + np.arange(own.sum()), np.repeat(ends[b] - np.cumsum(other) + other, other) + np.arange(other.sum())])
        slot = np.concatenate([np.repeat(np.arange(len(open_)), own), np.repeat(np.arange(len(open_)), other)])
        sign = np.concatenate([np.ones(own.sum(), np.int64), -np.ones(other.sum(), np.int64)])
        # no larger than the keys at hand ask for
        m = min(m * GROW, max(CELLS, 3 * int(np.ceil((own + other).max() * 0.75)) + 3 * CELLS))
        pair, _, empty = peel(*sketch(slot, key[at], len(open_), m, sign, attempt), attempt)
        got = np.bincount(pair, minlength=len(open_))
        out[open_[empty]] = got[empty]
        open_ = open_[~empty]
    for i in open_.tolist():  # not seen in practice: exact, without a sketch
        x, y = key[ends[left[i]] : ends[left[i] + 1]], key[ends[right[i]] : ends[right[i] + 1]]
        out[i] = len(np.setxor1d(x, y))
    return out


def likeness(n_a: np.ndarray, n_b: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Jaccard similarity; two empty texts are alike."""
    both = (n_a + n_b - different) / 2
    union = both + different
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def serial(count: np.ndarray, total: np.ndarray, check: np.ndarray, keys: np.ndarray) -> list[str]:
    """Fingerprints as text: little-endian number of keys (32 bits), then of each cell count (32 bits), key sum, check sum (64), in base 64."""
    each = zip(keys, count, total, check, strict=True)
    return [base64.b64encode(np.int32(n).tobytes() + c.astype("<i4").tobytes() + t.astype("<u8").tobytes() + k.astype("<u8").tobytes()).decode() for n, c, t, k in each]


def parse(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    m = (len(raw) - 4) // 20
    return int(np.frombuffer(raw, "<i4", 1)[0]), np.frombuffer(raw, "<i4", m, 4).astype(np.int64), np.frombuffer(raw, "<u8", m, 4 + 4 * m).astype(K.U), np.frombuffer(raw, "<u8", m, 4 + 12 * m).astype(K.U)


def recovered(a: str, b: str) -> np.ndarray | None:
    """Keys of paragraph cells that differ between two fingerprints; None if they are too many for the sketch."""
    x, y = parse(a)[1:], parse(b)[1:]
    with np.errstate(over="ignore"):
        _, keys, empty = peel(*((p - q)[None].copy() for p, q in zip(x, y, strict=True)))
    return keys if empty[0] else None


def compared(a: str, b: str) -> float | None:
    """The likeness of two fingerprints; None if they differ in too much for the sketch: then larger ones are needed."""
    keys = recovered(a, b)
    return None if keys is None else float(likeness(np.array([parse(a)[0]]), np.array([parse(b)[0]]), np.array([len(keys)]))[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_cells) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            doc, key = cell_keys(b.column(1))
            size = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(serial(*sketch(doc, key, b.num_rows), size)), pa.array(size)], names=["doc_id", "fingerprint", "n_cells"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), "doc_id long, fingerprint string, n_cells long")


#: Texts of a range of ids, in bytes: it is handled by one task.
RANGE_BYTES = 16 << 20


def _range_of(cuts: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The range of each id: how many cuts are at most the id; null ids are in the first."""
    known = np.asarray(ids.is_valid())
    return np.where(known, np.searchsorted(cuts, np.asarray(ids.fill_null(0)), side="right"), 0)


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(g, copy, doc_id, text), sorted, a range g in one partition: each row is followed by the next document.

    Ids are cut into narrow ranges at approximate quantiles, which are joined while their texts
    have less than range_bytes: as many ranges are made as the texts ask for, and as many partitions
    (up to a bound, beyond which ranges share them).  The first document of each range is also sent, as a copy, behind the last of
    the range before (the first of all: behind the last of all).  One shuffle of the texts; the
    driver holds a few numbers for each narrow range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.select(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).first().n or 0
    narrow = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    cuts = np.array(sorted({int(x) for x in rows.approxQuantile("doc_id", [i / narrow for i in range(1, narrow)], 0.1 / narrow)}), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_range_of(cuts, b.column(0)))], names=["doc_id", "n", "g"])

    sized = rows.select("doc_id", (F.octet_length("text") + 64).cast("long").alias("n")).mapInArrow(K.lean(place), "doc_id long, n long, g long")
    found = sized.groupBy("g").agg(F.min(F.struct("doc_id")).alias("first"), F.sum("n").alias("n")).orderBy("g").collect()
    starts: list = []  # first row of each range: g of its first narrow range, first id
    held = 0
    for r in found:
        if not starts or held + r.n > range_bytes:
            starts.append((r.g, r.first.doc_id))
            held = 0
        held += r.n
    k = max(1, len(starts))
    keys = partition_keys(spark, k)
    of_narrow = np.searchsorted([g for g, _ in starts], np.arange(len(cuts) + 1), side="right") - 1
    before = {i: (n - 1) % k for n, (_, i) in enumerate(starts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = of_narrow[_range_of(cuts, b.column(0))]
            ids = b.column(0).to_pylist()
            twice = [i for i, x in enumerate(ids) if x in before]
            for at, g, copy in ((np.arange(len(ids)), own, 0), (np.array(twice, np.int64), np.array([before[ids[i]] for i in twice], np.int64), 1)):
                if len(at):
                    some = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[g % len(keys)]), pa.array(g), pa.array(np.full(len(at), copy, np.int32)), *some.columns], names=["part", "g", "copy", "doc_id", "text"])

    dealt = rows.mapInArrow(K.lean(deal), "part long, g long, copy int, doc_id long, text string")
    return dealt.withColumn("h", F.xxhash64("text")).repartition(len(keys), "part").sortWithinPartitions("g", "copy", "doc_id", "h").drop("h", "part")


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each of docs.

    The edited text is the document's, its last floor(n_chars/2) code points replaced by the
    first as many (or all) of the next document's by ascending doc_id; the first follows the last.

    Defined cases: null text counts as empty, and so may its edited text be; two empty texts
    are alike (1.0); a single document follows itself; null ids come first; rows of one doc_id
    follow each other in the order of a hash of their texts; other columns aren't read.
    """

    def rows(group: list[tuple], ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        edited = []
        for own, after in zip(texts[:-1], texts[1:], strict=True):
            half = len(own) // 2
            edited.append(own[: len(own) - half] + after[:half])
        doc, key = cell_keys(pa.array([*texts, *edited], pa.large_string()))
        size, each, at = np.bincount(doc, minlength=2 * n + 1), sketch(doc, key, 2 * n + 1), np.arange(n)
        far = differences(each, np.concatenate([at, at]), np.concatenate([at + n + 1, at + 1]), doc, key)
        prints = serial(*each, size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(prints[:n], pa.string()), pa.array(prints[n + 1 :], pa.string()),
                pa.array(likeness(size[:n], size[n + 1 :], far[:n])), pa.array(likeness(size[:n], size[1 : n + 1], far[n:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        last: tuple | None = None  # the row whose successor hasn't come yet
        for b in (p for batch in batches for p in K.parts(batch, 3)):
            for g, copy, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == g:
                    ids.append(last[1])
                    texts.append(last[2])
                elif ids:
                    raise AssertionError("a range ended without the next document")
                if copy:
                    if ids:
                        yield from rows([], ids, [*texts, text])
                    ids, texts, last = [], [], None
                else:
                    last = (g, i, text)
            if ids:
                yield from rows([], ids, [*texts, last[2]])
                ids, texts = [], []

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(K.lean(run), schema)
