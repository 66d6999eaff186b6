"""Usage reports over a call log: (ts, backend, success, input_chars, output_chars, error)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policy import error_kind

c = F.col
SOFT_CAP_TOKENS, CHARS_PER_TOKEN = 1_000_000, 3


def band(ratio: Column) -> Column:
    return F.when(ratio > 0.7, "high").when(ratio > 0.4, "middle").otherwise("low")


def by_backend(calls: DataFrame, now: dt.datetime, hours: dict[str, int], otherwise: int = 24) -> DataFrame:
    """One row for each backend: calls in all and in its rolling window, sums, ratio to the soft cap, failures by kind."""
    table = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv]) if hours else None
    span = (F.coalesce(F.element_at(table, c("backend")), F.lit(otherwise)) if hours else F.lit(otherwise)) * 3600
    recent = c("ts").cast("timestamp").cast("double") >= F.lit(now).cast("timestamp").cast("double") - span
    kind = F.coalesce(c("error_category"), F.lit("other")) if "error_category" in calls.columns else F.coalesce(error_kind(c("error")), F.lit("other"))
    failed = ~c("success")
    ratio = c("recent_input_chars") / CHARS_PER_TOKEN / SOFT_CAP_TOKENS
    out = calls.groupBy("backend").agg(
        F.count("*").alias("calls"), F.count_if(recent).alias("recent_calls"), F.sum(F.when(recent, c("input_chars")).otherwise(0)).alias("recent_input_chars"),
        F.sum(F.when(recent, c("output_chars")).otherwise(0)).alias("recent_output_chars"), F.count_if(failed).alias("failures"),
        *[F.count_if(failed & (kind == k)).alias(f"failed_{k}") for k in ("quota", "timeout", "auth")], F.count_if(failed & ~kind.isin("quota", "timeout", "auth")).alias("failed_other"),
    )
    return out.withColumn("ratio", ratio).withColumn("band", band(ratio))


def last_failures(calls: DataFrame, k: int = 3, order: str = "seq") -> DataFrame:
    w = Window.partitionBy("backend").orderBy(F.desc(order))
    return calls.where(~c("success")).withColumn("__n", F.row_number().over(w)).where(c("__n") <= k).drop("__n").orderBy("backend", order)


def last_calls(calls: DataFrame, k: int = 10, order: str = "seq") -> DataFrame:
    return calls.orderBy(F.desc(order)).limit(k).orderBy(order)
