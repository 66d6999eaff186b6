"""Helpers that the operators share: stored cuts, table access, bounded filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored  # noqa: F401


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names made of the stems that no column of df has, in any case: for what is joined beside a caller's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions of a shuffle that is dealt by number: more buckets than that share partitions, one after the other.
MOST_PARTITIONS = 1 << 14


def partition_keys(spark: SparkSession, buckets: int) -> np.ndarray:
    """As many numbers as buckets, MOST_PARTITIONS at most, that repartition(their count, number) deals to different partitions."""
    k = min(buckets, MOST_PARTITIONS)
    tries = spark.range(int(k * (np.log(k) + 10)) + 1).select("id", F.pmod(F.hash("id"), F.lit(k)).alias("p"))
    found = {r.p: r.id for r in tries.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return np.array([found.get(i, -1 - i) for i in range(k)], np.int64)


BITMAP_BITS = 1 << 23


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**23 hashed ids: 1 MB whatever the input, so that it may go to all executors.

    A set bit means "perhaps present"; exact joins follow, so that a full bitmap
    costs time, never rows.
    """
    found = (
        ids.where(F.col(column).isNotNull())
        .select((bitmap_position(column) + 1).alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in found:
        out[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def bitmap_position(column: str):
    """The bit of an id, for id_bitmap() and tested()."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAP_BITS))


def tested(bitmap: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bitmap[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1


def let(value, body):
    """body(value) with value computed once: lambdas over higher-order functions would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
