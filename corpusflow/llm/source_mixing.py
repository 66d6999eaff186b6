"""Mixing sources to target weights: Pfair scheduling by earliest deadline first.

Each source's rows are cut into blocks; block k (from 1) of a source with weight w
may not run before slot floor((k-1)/w) and must run before slot ceil(k/w), both from
the exact weights.  Each slot runs the released block of earliest deadline, which
keeps every source less than one block from its share at all times (weights sum to
one on one processor, where this rule is optimal).  The rule is sequential: the
driver runs it over blocks, never rows, in O(log sources) a block, and rows get
their slots by a join on (source, block).

DataFrame functions only.  Rows are numbered by one range sort of (source, hash, id),
so that a source holding a third of all rows is spread over many tasks; the rows of a
source in the parts before are summed by a window over a row for each (source, part).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

BLOCK_ROWS = 32
#: The driver schedules so many blocks at most: of more rows than that asks for, blocks are larger.
MOST_BLOCKS = 1 << 20


def earliest_deadline_first(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, k) in the order in which blocks run; k counts a source's blocks from 0.

    Weights are taken as the exact fractions that they are, in proportion over the
    sources that have blocks.  When a source has run out, the others keep their
    releases and deadlines; slots in which none of them is released are left out.
    """
    names = sorted(s for s in weights if blocks.get(s, 0) > 0)
    exact = [Fraction(weights[s]) for s in names]
    common = math.lcm(*[w.denominator for w in exact])
    share = [w.numerator * (common // w.denominator) for w in exact]
    total = sum(share)
    ready = [(-(-total // q), -q, i, 0) for i, q in enumerate(share)]  # deadline, then the larger weight
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []  # release, source, k
    t = 0
    while ready or waiting:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // share[i]), -share[i], i, k))
        _, _, i, k = heapq.heappop(ready)
        yield names[i], k
        if k + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((k + 1) * total // share[i], i, k + 1))
        t += 1


def tempered(docs: DataFrame, exponent: float = 0.5) -> dict[str, float]:
    """Weights that flatten the natural shares: rows of a source to a power, for every source that isn't null."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).count().where("source is not null")
    return {r["source"]: float(r["count"]) ** exponent for r in counts.collect()}


def _slots(spark, weights: dict[str, float], rows_of: dict[str | None, int], block_rows: int) -> DataFrame:
    """(__s, __block, slot) of every block of the sources counted in rows_of."""
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    blocks = {s: -(-n // block_rows) for s, n in rows_of.items()}
    source, block = [], []
    for s, k in earliest_deadline_first(weights, blocks):
        source.append(s)
        block.append(k)
    for s in sorted((s for s in blocks if s not in weights), key=lambda s: (s is not None, s)):
        source += [s] * blocks[s]
        block += range(blocks[s])
    slot = range(len(source))
    return spark.createDataFrame(pa.table({"__s": pa.array(source, pa.string()), "__block": pa.array(block, pa.int64()), "slot": pa.array(slot, pa.int64())}))


def block_size(rows: int) -> int:
    return max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))


def mix(docs: DataFrame, weights: dict[str, float], block_rows: int | None = None) -> DataFrame:
    """(doc_id, source, block, slot, position) for every row of docs, to be read in the order of position.

    slot is the block's place, one block in each; position orders all rows and is
    different for each: (slot, row within the block) packed as slot * block_rows + row.  Until a source
    runs out, each prefix of slots holds each source's share of the given weights
    to less than a block; afterwards the others go on in their proportions.  Within
    a source the order is by a hash of doc_id, then doc_id.  Without block_rows a block has
    32 rows, or a 2**20th of all rows if that is more, so that the driver's schedule is bounded.

    Defined cases: rows of a null source, or of one that weights doesn't name, come
    after the schedule in slots of their own (null, then source order, then rows),
    since they have no share, and so do all rows if there are no weights; weights of sources without rows don't count; null ids and
    repeated rows are numbered like any other; no rows, no output.  Text and other
    columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("doc_id")).alias("h"))
    rows_of = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    block_rows = block_rows or block_size(sum(rows_of.values()))
    # numbers by one range sort of (source, h, id), of which each task sorts its part, whatever the sources' sizes:
    # a row's place in its part less that of the source's first row there, plus the source's rows in parts before
    at = rows.repartitionByRange("source", "h", "doc_id").sortWithinPartitions("source", "h", "doc_id")
    at = stored(at.withColumn("at", F.monotonically_increasing_id()).drop("h")).withColumn("part", F.shiftright("at", 33))
    runs = at.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("source").alias("__s"), F.col("part").alias("__p"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = at.join(runs, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p"))).withColumn("n", F.col("before") + F.col("at") - F.col("first"))
    numbered = numbered.select("doc_id", "source", F.floor(F.col("n") / block_rows).cast("long").alias("block"), (F.col("n") % block_rows).alias("row"))
    placed = numbered.join(_slots(spark, weights, rows_of, block_rows), F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__block")))
    return placed.select("doc_id", "source", "block", "slot", (F.col("slot") * block_rows + F.col("row")).cast("long").alias("position"))


def places(docs: DataFrame, weights: dict[str, float], block_rows: int | None = None) -> DataFrame:
    """(__id, __position) of each doc_id that isn't null: rows of one doc_id share the smallest of their positions."""
    return mix(docs, weights, block_rows).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("position").alias("__position"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float], block_rows: int | None = None) -> DataFrame:
    """All rows of docs with their columns, range-partitioned and sorted by position: files are read in mixing order.

    Rows of one doc_id share the smallest of their positions; null ids come last.
    """
    its_id, position = unused(docs, "__id", "__position")
    place = places(docs, weights, block_rows).toDF(its_id, position)
    joined = docs.join(place, F.col("doc_id") == F.col(its_id), "left")
    return joined.orderBy(F.col(position).asc_nulls_last(), "doc_id").select(*docs.columns)
