"""Repeated windows of a corpus: what substring dedup and suffix-array dedup share.

Units are words or bytes; a window is L consecutive units of one document.  Every
window has one anchor: its k-unit gram of least hash, the leftmost of equal ones.
Equal windows have equal anchors at equal places, so all copies of a window meet
where their anchor's hash leads, though only one gram in some thirty or seventy units
is an anchor.  The windows that share one anchor occurrence are consecutive starts
lo..lo+span; the units from lo to lo+span+L are its stretch.

index()   each task hashes its stretches, settles those that repeat within the task,
          and hands on one row for each distinct stretch, packed by bucket of its hash.
settle()  each bucket settles stretches that repeat between tasks and hands on one
          occurrence, the earliest, of each.  Buckets are by stretch, not by anchor, so that
          an anchor that very many documents share is spread; copies of one stretch come
          once from a task.
asked()   anchors are counted by partial aggregates and joined back: one that has several
          distinct stretches is ambiguous, since copies end or differ near it, and each of
          its stretches becomes a request.
contexts  requests fetch their units from the documents and are dealt out by anchor
          into reference blocks, where an operator's own method compares them.  An
          anchor with more than HOT stretches (a line in a third of all documents) would
          fill a block without bound: its windows are dealt by their hash instead, once
          from a task, and settled as above.

The number of buckets and blocks follows from the bytes of texts and of requested units.
Stretches count as equal if two 64-bit hashes and their lengths are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap_position, id_bitmap, partition_keys, stored, tested

HOT = 256
#: Texts whose stretches make a bucket, and requested units that make a block, in bytes.
BUCKET_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Distinct stretches that a task gathers before it hands them on.
TASK_ROWS = 1 << 20
PART_BYTES = K.PART_BYTES

#: A stretch: anchor hash, stretch hash, document, first start, number of starts less one, occurrences (2: two or more).
ROW = np.dtype([("ah", "<u8"), ("sh", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("span", "<i2"), ("many", "u1")])
RANGES = "kind int, doc_id long, lo int, hi int, ah long, many int"


@dataclass(frozen=True)
class Unit:
    """words: units are words, else bytes; length of a window; gram of an anchor; earlier: only later copies go."""

    words: bool
    length: int
    gram: int
    earlier: bool


def sequence(unit: Unit, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all units of a batch and the documents' bounds."""
    raw, offs = K.buffer(texts)
    if not unit.words:
        return K._BYTE_VALUE[raw], offs
    w = K.Words(raw, offs)
    return w.hashes(), w.bounds


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of h[i:i+w], by its upper 32 bits, leftmost if equal, for every i."""
    n = len(h)
    key = (h & K.U(0xFFFFFFFF00000000)) | np.arange(n, dtype=K.U)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, K.U)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & K.U(0xFFFFFFFF)).astype(np.int64)


def stretches(unit: Unit, values: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """All stretches of a batch as ROWs."""
    starts = K.window_starts(bounds, unit.length)
    if not len(starts):
        return np.zeros(0, ROW)
    prefix = K.word_prefix(K.mix(values, 51))
    gram = K.mix(prefix.windows(unit.gram), 52)
    anchor = sliding_least(gram, unit.length - unit.gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    doc = np.searchsorted(bounds, lo, side="right") - 1
    out = np.zeros(len(first), ROW)
    out["ah"] = gram[anchor[first]]
    with np.errstate(over="ignore"):
        out["sh"] = K.mix(prefix.of(lo, hi + unit.length) + (hi - lo).astype(K.U) * K.U(0x9E3779B97F4A7C15), 53)
    out["doc"], out["lo"], out["span"], out["many"] = ids[doc], lo - bounds[doc], hi - lo, 1
    return out


def grouped(unit: Unit, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct stretches (their earliest occurrence, many raised) and the occurrences that are settled: they go."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["sh"], rows["ah"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["ah"][1:] != rows["ah"][:-1]) | (rows["sh"][1:] != rows["sh"][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    many = np.minimum(np.add.reduceat(rows["many"].astype(np.int64), first), 2) if len(first) else first
    head = rows[first]
    head["many"] = many
    gone = ~new if unit.earlier else np.repeat(many > 1, size)
    return head, rows[gone]


def merged(unit: Unit, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, lo, hi): the units that stretches cover, touching ones of a document as one."""
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((gone["lo"], gone["doc"]))
    doc, lo = gone["doc"][order], gone["lo"][order].astype(np.int64)
    return union(doc, lo, lo + gone["span"][order] + unit.length)


def union(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that are sorted by document and lo."""
    if not len(doc):
        return doc, lo, hi
    run = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    nth = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(doc))))
    reach = np.maximum.accumulate(hi + nth * (1 << 33)) - nth * (1 << 33)
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


PACKED = "bucket long, part long, blob binary"


def _blobs(bucket: np.ndarray, blobs: list[bytes], keys: np.ndarray) -> pa.RecordBatch:
    """(bucket, part, blob) rows; part: the number that brings the bucket to its partition, of as many as keys."""
    at = np.where(bucket >= 0, bucket, -1 - bucket) % len(keys)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(keys[at]), pa.array(blobs, pa.binary())], names=["bucket", "part", "blob"])


def _packed(bucket: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by bucket; columns lie one after the other in a blob, which compresses better."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, int)
    blobs = [b"".join(np.ascontiguousarray(rows[i:j][name]).tobytes() for name in ROW.names) for i, j in zip(first, np.append(first[1:], len(rows)), strict=True)]
    if blobs:
        yield _blobs(bucket[first], blobs, keys)


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // ROW.itemsize
    out, at = np.zeros(n, ROW), 0
    for name in ROW.names:
        out[name] = np.frombuffer(blob, ROW[name], n, at)
        at += n * ROW[name].itemsize
    return out


def _pieces(spark, size: int, piece: int) -> int:
    """How many buckets: one for each piece, two for each shuffle partition at least."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // piece))


def index(docs: DataFrame, unit: Unit, n: int, keys: np.ndarray) -> DataFrame:
    """Packed distinct stretches by one of n buckets of their hash; below 0, ranges settled within a task."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, gone = grouped(unit, np.concatenate(held))
        yield from _packed((rows["sh"] % K.U(n)).astype(np.int64), rows, keys)
        yield from _packed_ranges(unit, gone, n, keys, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            rows = stretches(unit, *sequence(unit, b.column(1)), np.asarray(b.column(0)))
            held.append(rows)
            count += len(rows)
            if count > TASK_ROWS:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    return texts_of(docs).mapInArrow(K.lean(run), PACKED)


def _packed_ranges(unit: Unit, gone: np.ndarray, n: int, keys: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Settled occurrences as ranges (lo to sh), in buckets from top downwards."""
    if len(gone):
        doc, lo, hi = merged(unit, gone)
        out = np.zeros(len(doc), ROW)
        out["doc"], out["lo"], out["sh"] = doc, lo, hi
        yield from _packed(top - doc % n, out, keys)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _ranges(kind: int, doc, lo, hi, ah=None, many=None) -> pa.RecordBatch:
    n = len(doc)
    cols = [np.full(n, kind, np.int32), doc, np.asarray(lo).astype(np.int32), np.asarray(hi).astype(np.int32)]
    cols.append(np.zeros(n, np.int64) if ah is None else np.ascontiguousarray(ah).view(np.int64))
    cols += [np.zeros(n, np.int32) if many is None else np.asarray(many).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc_id", "lo", "hi", "ah", "many"])


GONE, REQUEST, HOT_REQUEST = 0, 1, 2


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Groups consecutive rows (bucket, blob) of a sorted partition."""
    now, held = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(blob)
    if held:
        yield now, held


def settle(packed: DataFrame, unit: Unit, partitions: int) -> DataFrame:
    """Ranges that go (kind GONE), and one row (kind REQUEST) for each distinct stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches):
            rows = np.concatenate([_unpacked(x) for x in blobs])
            if bucket < 0:
                yield _ranges(GONE, rows["doc"], rows["lo"], rows["sh"].astype(np.int64))
                continue
            heads, gone = grouped(unit, rows)
            doc, lo, hi = merged(unit, gone)
            if len(doc):
                yield _ranges(GONE, doc, lo, hi)
            if len(heads):
                yield _ranges(REQUEST, heads["doc"], heads["lo"], heads["lo"] + heads["span"].astype(np.int64), heads["ah"], heads["many"])

    return _dealt(packed, partitions).mapInArrow(K.lean(run), RANGES)


def _dealt(blobs: DataFrame, partitions: int) -> DataFrame:
    """(bucket, blob) sorted by bucket, each bucket in one partition."""
    return blobs.repartition(partitions, "part").sortWithinPartitions("bucket").select("bucket", "blob")


def asked(settled: DataFrame) -> DataFrame:
    """One row for each stretch of an ambiguous anchor; kind tells those of hot anchors."""
    heads = settled.where(f"kind = {REQUEST}")
    several = heads.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select(F.col("ah").alias("__ah"), (F.col("n") > HOT).alias("hot"))
    kind = F.when(F.col("hot"), HOT_REQUEST).otherwise(REQUEST)
    return heads.join(several, F.col("ah") == F.col("__ah")).withColumn("kind", kind.cast("int")).drop("__ah", "hot")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that may be among ids: a test of bounded size before an exact join."""
    wanted = id_bitmap(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.filter(pa.array(tested(wanted, np.asarray(b.column(2)))))
            yield pa.RecordBatch.from_arrays(out.columns[:2], names=["doc_id", "text"])

    return texts_of(docs).withColumn("p", bitmap_position("doc_id")).mapInArrow(K.lean(run), "doc_id long, text string")


#: A request's units: where they come from, then the units themselves.
CONTEXT = np.dtype([("ah", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("span", "<i2"), ("many", "u1")])


def contexts(docs: DataFrame, requests: DataFrame, unit: Unit, n: int, keys: np.ndarray) -> DataFrame:
    """Packed: n reference blocks (bucket >= 0), and for hot anchors packed windows (bucket < 0: -1 - bucket) and
    ranges that are settled within a task (bucket < -n).

    A block's blob is a count, CONTEXT rows, then their units (8 bytes a word, 1 a byte).
    """
    wants = requests.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "ah", "many", "kind")).alias("asked")).withColumnRenamed("doc_id", "__id")
    joined = only(docs, requests).join(wants, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "asked")

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Windows of hot anchors, each once; the task's other occurrences are settled."""
        heads, gone = grouped(unit, np.concatenate(held))
        yield from _packed(-1 - (heads["ah"] % K.U(n)).astype(np.int64), heads, keys)
        yield from _packed_ranges(unit, gone, n, keys, -1 - n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            values, bounds = sequence(unit, b.column(1))
            stored_units = values if unit.words else K.buffer(b.column(1))[0]
            lists = b.column(2)
            flat = lists.flatten()
            sizes = np.diff(np.asarray(lists.offsets))
            at = np.repeat(np.arange(b.num_rows), sizes)
            lo, hi, ah, many, kind = (np.asarray(flat.field(k)) for k in ("lo", "hi", "ah", "many", "kind"))
            ids = np.asarray(b.column(0))[at]
            lo, hi = lo.astype(np.int64) + bounds[at], hi.astype(np.int64) + bounds[at]
            hot = kind == HOT_REQUEST
            if hot.any():
                span = hi[hot] - lo[hot] + 1
                start = np.repeat(lo[hot] - np.cumsum(span) + span, span) + np.arange(span.sum())
                prefix = K.word_prefix(K.mix(values, 51))
                h = prefix.of(start, start + unit.length)
                rows = np.zeros(len(start), ROW)
                rows["ah"], rows["sh"] = K.mix(h, 54), K.mix(h, 55) ^ np.repeat(ah[hot].view(K.U), span)
                rows["doc"], rows["many"] = np.repeat(ids[hot], span), np.repeat(many[hot], span)
                rows["lo"] = start - np.repeat(bounds[at[hot]], span)
                held.append(rows)
                count += len(rows)
                if count > TASK_ROWS:
                    yield from flush(held)
                    held, count = [], 0
            cold = np.flatnonzero(~hot)
            if not len(cold):
                continue
            rows = np.zeros(len(cold), CONTEXT)
            rows["ah"], rows["doc"], rows["lo"] = ah[cold].view(K.U), ids[cold], lo[cold] - bounds[at[cold]]
            rows["span"], rows["many"] = hi[cold] - lo[cold], many[cold]
            bucket = (rows["ah"] % K.U(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            size = rows["span"].astype(np.int64) + unit.length
            blobs = []
            for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
                own = order[i:j]
                n_own = size[own]
                where = np.repeat(lo[cold[own]] - np.cumsum(n_own) + n_own, n_own) + np.arange(n_own.sum())
                blobs.append(np.int64(len(own)).tobytes() + rows[own].tobytes() + stored_units[where].tobytes())
            yield _blobs(bucket[order][first], blobs, keys)
        if count:
            yield from flush(held)

    return joined.mapInArrow(K.lean(run), PACKED)


Compare = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def compared(blocks: DataFrame, unit: Unit, compare: Compare, n_blocks: int, partitions: int) -> DataFrame:
    """Ranges that go, from reference blocks.  compare(rows, units, offsets) returns, for each start of each
    context (its span + 1 starts, one context after the other), whether that window goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches):
            if bucket < -n_blocks:
                rows = np.concatenate([_unpacked(x) for x in blobs])
                yield _ranges(GONE, rows["doc"], rows["lo"], rows["sh"].astype(np.int64))
                continue
            if bucket < 0:
                rows = np.concatenate([_unpacked(x) for x in blobs])
                _, gone = grouped(unit, rows)
            else:
                heads, units = [], []
                for x in blobs:
                    n = int(np.frombuffer(x, "<i8", 1)[0])
                    heads.append(np.frombuffer(x, CONTEXT, n, 8))
                    units.append(np.frombuffer(x, K.U if unit.words else np.uint8, -1, 8 + n * CONTEXT.itemsize))
                rows, flat = np.concatenate(heads), np.concatenate(units)
                size = rows["span"].astype(np.int64) + unit.length
                offs = np.concatenate([[0], np.cumsum(size)])
                hit = compare(rows, flat, offs)
                starts = rows["span"].astype(np.int64) + 1
                owner = np.repeat(np.arange(len(rows)), starts)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
                gone = np.zeros(int(hit.sum()), ROW)
                gone["doc"], gone["lo"] = rows["doc"][owner[hit]], rows["lo"][owner[hit]] + within[hit]
            doc, lo, hi = merged(unit, gone)
            if len(doc):
                yield _ranges(GONE, doc, lo, hi)

    return _dealt(blocks, partitions).mapInArrow(K.lean(run), RANGES)


def repeated_ranges(docs: DataFrame, unit: Unit, compare: Compare) -> DataFrame:
    """(doc_id, lo, hi): units that lie in a repeated window (or, if unit.earlier, in a later copy); may overlap."""
    spark = docs.sparkSession
    size = texts_of(docs).select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = _pieces(spark, size, BUCKET_BYTES)
    keys = partition_keys(spark, n)
    first = stored(settle(index(docs, unit, n, keys), unit, len(keys)))
    requests = stored(asked(first))
    units = requests.select(F.sum(F.col("hi") - F.col("lo") + unit.length).alias("n")).first().n or 0
    n = _pieces(spark, units * (8 if unit.words else 1), BLOCK_BYTES)
    keys = partition_keys(spark, n)
    last = compared(contexts(docs, requests, unit, n, keys), unit, compare, n, len(keys))
    return first.where(f"kind = {GONE}").select("doc_id", "lo", "hi").unionByName(last.select("doc_id", "lo", "hi"))


def with_ranges(docs: DataFrame, ranges: DataFrame, finish: Callable[[pa.Array, list], dict[str, list]], schema: str) -> DataFrame:
    """finish(texts, ranges of each) for every row of docs; documents without ranges never move.

    schema names what finish returns, after doc_id.
    """
    names = ["doc_id", *(c.split()[0] for c in schema.split(","))]
    whole = f"doc_id long, {schema}"
    spans = stored(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    wanted = id_bitmap(spans, "doc_id")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            out = b.filter(pa.array(~tested(wanted, np.asarray(b.column(2).fill_null(0))) | np.asarray(b.column(0).is_null())))
            yield _finished(out, [None] * out.num_rows, finish, names)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            lists = b.column(2)
            flat = lists.flatten()
            lo, hi = (np.asarray(flat.field(k)).astype(np.int64) for k in ("lo", "hi"))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            yield _finished(b, [(lo[i:j], hi[i:j]) if j > i else None for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], finish, names)

    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("p", bitmap_position("doc_id"))
    joined = only(docs, spans).join(spans.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "spans")
    return every.mapInArrow(K.lean(untouched), whole).unionByName(joined.mapInArrow(K.lean(touched), whole))


def _finished(b: pa.RecordBatch, spans: list, finish, names: list[str]) -> pa.RecordBatch:
    made = finish(b.column(1), spans)
    return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(made[k], pa.string() if k.endswith(("sha256", "text")) else pa.int64()) for k in names[1:])], names=names)
