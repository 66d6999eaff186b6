"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A text's set holds its distinct word shingles.  A sketch has T coordinates.  In
round i < T each element falls into a hashed bin with value i + fraction; a bin
keeps its least value; rounds stop once all bins are filled.  Rounds i >= T put
all elements into bin i - T, so that every coordinate fills after 2T rounds at
most.  Two sketches agree in a coordinate with probability equal to the Jaccard
similarity, and their agreement is as concentrated as with T independent
permutations, at the cost of a few passes over the set.

Texts of equal sets are one representative from here on.  Bands of R coordinates
give buckets; each member of a bucket is compared with the bucket's hub (its
smallest id) on the full sets.  Links make components, within which no pair needs a
comparison.  Members of a bucket that still lie in several components are compared
exactly, but not all with all: two of them share a rare shingle outside their hub's
set, found by a join on the first of those, or only shingles that lie inside it or are
frequent, whose number their counts bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap_position, id_bitmap, stored, tested, unused
from .components import components

SHINGLE = 5
SIMILARITY = (75, 100)
#: A pair at the threshold is missed by all bands with probability (1 - .75**5)**45 = 5e-6.
BANDS, ROWS = 45, 5
FREQUENCY_SLOTS = 1 << 22
#: Shingles of so many members or more bring no pairs together; what pairs share of them is bounded instead.
FREQUENT = 64
GROUPS = 64


def sketches(doc: np.ndarray, values: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """An (n_docs, size) matrix; rows of empty sets stay at the maximum."""
    none = np.iinfo(np.uint64).max
    out = np.full(n_docs * size, none, K.U)
    live_doc, live = doc, values
    for i in range(2 * size):
        if not len(live):
            break
        h = K.mix(live, 1000 + i)
        at = (h % K.U(size)).astype(np.int64) if i < size else np.full(len(h), i - size)
        key = live_doc * size + at
        value = (K.U(i) << K.U(48)) | (h >> K.U(16))
        np.minimum.at(out, key, value)  # values of earlier rounds are smaller
        full = (out.reshape(n_docs, size) != none).all(1)
        open_ = ~full[live_doc]
        live_doc, live = live_doc[open_], live[open_]
    return out.reshape(n_docs, size)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, key, bands): set size, 128-bit digest of the set, band hashes (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 1):
                n = b.num_rows
                doc, val = K.shingle_sets(b.column(1), shingle)
                size = np.bincount(doc, minlength=n)
                ends = np.concatenate([[0], np.cumsum(size)])
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(val, s))]) for s in (11, 12)]
                    key = [K.mix(s[ends[1:]] - s[ends[:-1]], 13) for s in sums]
                some = np.flatnonzero(size)
                sk = sketches(np.searchsorted(some, doc), val, len(some)).reshape(-1, BANDS, ROWS)
                band = K.mix(np.broadcast_to(np.arange(BANDS, dtype=K.U), sk.shape[:2]), 17)
                for r in range(ROWS):
                    band = K.mix(band ^ sk[:, :, r], 19)
                offs = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                pair = pa.StructArray.from_arrays([_signed(key[0]), _signed(key[1])], names=["hi", "lo"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pair, pa.ListArray.from_arrays(pa.array(offs), _signed(band.ravel()))], names=["doc_id", "n_shingles", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), "doc_id long, n_shingles long, key struct<hi:long,lo:long>, bands array<long>")


def _wanted_texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, text) of documents whose id may be wanted; the test is bounded in size, the join after it exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = tested(wanted, np.asarray(b.column(2).fill_null(0)))
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(out.columns[:2], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bitmap_position("doc_id").alias("p")).where("doc_id is not null").mapInArrow(K.lean(run), "doc_id long, text string")


def with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both texts last; b's text joins last, so that runs of one b stay together."""
    texts = _wanted_texts(docs, id_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"))
    with_a = pairs.join(texts.withColumnRenamed("doc_id", "a").withColumnRenamed("text", "ta"), "a")
    return with_a.join(texts.withColumnRenamed("doc_id", "b").withColumnRenamed("text", "tb"), "b").select(*pairs.columns, "ta", "tb")


def _with_hub_sets(b: pa.RecordBatch, ta: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and shingles of the a-texts, the same of the b-texts (each distinct text cut once), and the sizes of the latter."""
    da, va = K.shingle_sets(b.column(ta), shingle)
    right = b.column(ta + 1).dictionary_encode()
    ds, vs = K.shingle_sets(right.dictionary, shingle)
    code = np.asarray(right.indices)
    ends = np.searchsorted(ds, np.arange(len(right.dictionary) + 1))
    size = np.diff(ends)[code]
    at = np.repeat(ends[:-1][code] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return da, va, np.repeat(np.arange(b.num_rows), size), vs[at], size


def verified(docs: DataFrame, pairs: DataFrame, similarity=SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, linked): each pair's verdict on full shingle sets.

    a's text joins first, b's second; b should be the rarer (a hub), so that its
    set is built once for a run of pairs.
    """
    both = with_texts(docs, pairs)
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 2, beside=3):
                n = b.num_rows
                da, va, db, vb, size = _with_hub_sets(b, 2, shingle)
                d, v = np.concatenate([da, db]), np.concatenate([va, vb])
                union = np.bincount(K.distinct_by_doc(d, v)[0], minlength=n)
                sizes = np.bincount(da, minlength=n) + size
                linked = (den * (sizes - union) >= num * union) & (union > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return both.mapInArrow(K.lean(run), "a long, b long, linked boolean")


def open_members(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b, c): members with their hub and component, of buckets that lie in several components."""
    now = shared.join(label, shared.id == label.node, "left").select("bucket", "id", "hub", F.coalesce("component", "id").alias("c"))
    several = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return now.where("id <> hub").join(several, "bucket").select(F.col("id").alias("a"), F.col("hub").alias("b"), "c").distinct()


def shingle_frequencies(docs: DataFrame, wanted: np.ndarray, shingle: int) -> np.ndarray:
    """Upper bounds of the shingles' counts over the wanted documents, in 2**22 hashed counters (16 MB whatever the input)."""
    chunk = FREQUENCY_SLOTS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_SLOTS, np.uint32)
        for batch in batches:
            for b in K.parts(batch, 1):
                _, v = K.shingle_sets(b.column(1), shingle)
                at, n = np.unique((v % K.U(FREQUENCY_SLOTS)).astype(np.uint32), return_counts=True)
                total[at] += n.astype(np.uint32)
        used = np.flatnonzero(total)
        ends = np.searchsorted(used, np.arange(65) * chunk)
        for i in range(64):  # sparse, a row at a time: a task of few documents hands on little
            at = used[ends[i] : ends[i + 1]]
            if len(at):
                blob = (at - i * chunk).astype("<u4").tobytes() + total[at].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([blob], pa.binary())], names=["k", "blob"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.int64)
        for b in batches:
            for blob in b.column(1).to_pylist():
                at, n = np.frombuffer(blob, "<u4").reshape(2, -1)
                total[at] += n
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["k", "blob"])

    parts = _wanted_texts(docs, wanted).mapInArrow(K.lean(count), "k long, blob binary").groupBy("k").applyInArrow(add, "k long, blob binary").collect()
    out = np.zeros(FREQUENCY_SLOTS, np.uint32)
    for r in parts:
        out[r.k * chunk : (r.k + 1) * chunk] = np.frombuffer(bytes(r.blob), "<u4")
    return out


def beside_hub(docs: DataFrame, members: DataFrame, similarity=SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, c, n, inside, often, tokens, hub, lacks): a member's set size, its part inside hub b's set, how many of the
    rest are frequent, the first of those that are neither, the hub's size, and how many of the hub's shingles the
    member lacks, by 64 hashed groups.

    Order a member's shingles by whether they are rare and outside the hub.  Of n, a set of
    similarity s must share one of the first n - ceil(s * n) + 1 with the other; tokens are
    those of them that are rare and outside.
    """
    num, den = similarity
    counts = shingle_frequencies(docs, id_bitmap(members, "a"), shingle)
    frequency = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 3, beside=4):
                da, va, db, vb, size = _with_hub_sets(b, 3, shingle)
                n = np.bincount(da, minlength=b.num_rows)
                d, v = np.concatenate([da, db]), np.concatenate([va, vb])
                order = np.lexsort((np.arange(len(d)) >= len(da), v, d))  # of equal ones the member's comes first
                d, v, own = d[order], v[order], order < len(da)
                same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
                inside, lacking = np.append(same, False), ~own & np.append(True, ~same)
                lacks = np.bincount(d[lacking] * GROUPS + (v[lacking] % K.U(GROUPS)).astype(np.int64), minlength=b.num_rows * GROUPS)
                d, v, inside = d[own], v[own], inside[own]
                f = frequency.value[(v % K.U(FREQUENCY_SLOTS)).astype(np.int64)]
                often = ~inside & (f >= FREQUENT)
                held = inside | often
                order = np.lexsort((v, f, held, d))
                nth = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                keep = (nth < np.repeat(n - -(-num * n // den) + 1, n)) & ~held[order]
                ends = np.searchsorted(d[keep], np.arange(b.num_rows + 1)).astype(np.int32)
                cols = [*b.columns[:3], pa.array(n.astype(np.int64)), *(pa.array(np.bincount(d[x], minlength=b.num_rows).astype(np.int64)) for x in (inside, often)), pa.ListArray.from_arrays(pa.array(ends), _signed(v[order][keep]))]
                cols += [pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * GROUPS), pa.array(lacks.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "c", "n", "inside", "often", "tokens", "hub", "lacks"])

    return with_texts(docs, members).mapInArrow(K.lean(run), "a long, b long, c long, n long, inside long, often long, tokens array<long>, hub long, lacks array<int>")


_SIDE = ("a", "c", "n", "inside", "often", "hub", "lacks", "whole")


def _apart(rows: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """Pairs (columns of _SIDE with x and y, ax > ay) of rows of one key whose components differ and whose sizes may be similar.

    Sizes fall into classes of the ratio that similarity allows; a row meets its own class and the
    next ones.  Of each key the component with most rows is told from the others: its rows, which
    may be a third of all, meet the others' only, never each other.
    """
    num, den = similarity
    counts = rows.groupBy("key", "c").agg(F.count("*").alias("m"))
    largest = counts.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("several")).where("several > 1").select("key", F.col("top.c").alias("largest"))
    some = stored(rows.join(largest, "key").withColumn("class", F.floor(F.log("n") / float(np.log(den / num)) + 1e-9)))
    side = lambda df, x, meets: df.select("key", meets, *[F.col(k).alias(k + x) for k in _SIDE])
    rest = some.where("c <> largest")
    near = side(rest, "y", F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class"))
    first = side(some.where("c = largest"), "x", F.col("class")).join(near, ["key", "class"])
    turn = F.col("ax") > F.col("ay")
    first = first.select("key", *[F.when(turn, F.col(k + p)).otherwise(F.col(k + q)).alias(k + p) for k in _SIDE for p, q in (("x", "y"), ("y", "x"))])
    second = side(rest, "x", F.col("class")).join(near, ["key", "class"]).where((F.col("cx") != F.col("cy")) & turn)
    return first.unionByName(second.select(*first.columns))


def across(rows: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """(a, b), a > b: the pairs of one hub's members, of different components, that may be similar.

    They share a rare shingle outside the hub, or none.  Inside the hub they share at most
    the smaller part and at most what neither lacks; of frequent shingles beside it at most
    the smaller count; of rare ones the common tokens, if those are all, else at most the
    smaller rest.  Together that must suffice for their sizes.
    """
    num, den = similarity
    side = lambda df, x: df.select("key", *[F.col(k).alias(k + x) for k in _SIDE])
    differ = (F.col("cx") != F.col("cy")) & (F.col("ax") > F.col("ay"))
    wanted = num * (F.col("nx") + F.col("ny"))  # of the shared shingles, times num + den
    neither = F.col("hubx") - F.aggregate(F.zip_with("lacksx", "lacksy", lambda x, y: F.greatest(x, y)), F.lit(0), lambda total, x: total + x)
    often = F.least("oftenx", "ofteny")
    fits = lambda inside, rare: (num + den) * (inside + often + rare) >= wanted
    rest = F.least(F.col("nx") - F.col("insidex") - F.col("oftenx"), F.col("ny") - F.col("insidey") - F.col("ofteny"))

    def met(df: DataFrame, rare) -> DataFrame:
        several = df.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        some = stored(df.join(several, "key"))
        return side(some, "x").join(side(some, "y"), "key").where(differ & fits(F.least("insidex", "insidey"), rare) & fits(neither, rare))

    rows = rows.withColumn("whole", F.size("tokens") == F.col("n") - F.col("inside") - F.col("often"))
    columns = _SIDE
    tokens = rows.select(F.explode("tokens").alias("t"), "b", *columns).select(F.struct("b", "t").alias("key"), *columns)
    shared = met(tokens, rest).groupBy(F.col("key.b").alias("b"), "ax", "ay")
    shared = shared.agg(F.count("*").alias("s"), F.first(wanted).alias("wanted"), F.first(F.least(F.least("insidex", "insidey"), neither) + often).alias("held"), F.first(rest).alias("rest"), F.bool_and(F.col("wholex") & F.col("wholey")).alias("whole"))
    shared = shared.where((num + den) * (F.col("held") + F.when(F.col("whole"), F.col("s")).otherwise(F.col("rest"))) >= F.col("wanted"))
    alone = _apart(rows.where(den * (F.col("inside") + F.col("often")) >= num * F.col("n")).select(F.col("b").alias("key"), *columns), similarity)
    alone = alone.where(fits(F.least("insidex", "insidey"), F.lit(0)) & fits(neither, F.lit(0)))
    names = [F.col("ax").alias("a"), F.col("ay").alias("b")]
    return shared.select(*names).union(alone.select(*names)).distinct()


def near_duplicates(docs: DataFrame, similarity=SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the smallest doc_id reachable over links of at least the given
    similarity.  Defined cases: null, empty and blank texts have an empty set and are
    linked with nothing; a text of fewer words than a shingle has its whole sequence
    as one; a null doc_id is kept with a null component; rows of one doc_id but of
    different texts are one node with all their links, and their pairs are decided on
    any of the texts; other columns aren't read.
    """
    prints = stored(fingerprints(docs, shingle))
    sets = prints.where("n_shingles > 0 and doc_id is not null")
    heads = sets.groupBy("key").agg(F.min("doc_id").alias("head"))
    rows = stored(
        sets.join(heads.where("head is not null"), "key")
        .where("doc_id = head")
        .dropDuplicates(["doc_id", "key"])
        .select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    )
    hubs = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    shared = rows.join(hubs, "bucket")
    star = stored(shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    done = stored(verified(docs, star, similarity, shingle))
    same = sets.join(heads, "key").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    label = stored(components(done.where("linked").select("a", "b")))
    members = stored(open_members(shared, label))
    decided = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    beside = stored(beside_hub(docs, members, similarity, shingle))
    pairs = stored(across(beside, similarity).join(decided, ["a", "b"], "left_anti"))
    more = done.where("linked").select("a", "b")
    if pairs.limit(1).count():
        more = more.unionByName(verified(docs, pairs, similarity, shingle).where("linked").select("a", "b"))
    label = components(more.unionByName(same))
    out = prints.join(label, prints.doc_id == label.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, similarity=SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each component the document of smallest id, with docs' columns."""
    (its_id,) = unused(docs, "__id")
    gone = near_duplicates(docs, similarity, shingle).where("not kept").select(F.col("doc_id").alias(its_id)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(its_id), "left_anti")
