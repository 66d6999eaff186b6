"""Top-k, fair interleaving and capped selection, by windows over total orders.

Every order ends in a unique key.  Ranking windows are limited before anything
global is sorted: Spark stops a group at its limit while sorting (window group
limit), so a source holding most rows hands on k of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def top_k_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    keys = [group] if isinstance(group, str) else list(group)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c(name) <= k)


def interleaved(df: DataFrame, group: str, order: Sequence[Column], limit: int, first: str = "seq") -> DataFrame:
    """One row of each group in turn, groups in the order of their first row, until ``limit``.

    A row's turn is its rank in its group, so the order is (rank, group's least seq);
    ranks beyond the limit can't be taken.  place counts from 1.
    """
    firsts = df.groupBy(group).agg(F.min(first).alias("__first")).withColumnRenamed(group, "__g")
    ranked = top_k_per_group(df, group, order, limit, "__turn").join(firsts, c(group).eqNullSafe(c("__g"))).drop("__g")
    best = ranked.orderBy("__turn", "__first").limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy("__turn", "__first"))).drop("__turn", "__first")


def review_cap(df: DataFrame, limits: dict[str, int], limit: int, shared: Sequence[str], shared_limit: int, total: int, group: str = "source_id", first: str = "seq") -> DataFrame:
    """Rows in input order by source up to its own limit, interleaved, sources in ``shared`` up to one limit together."""
    own = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else None
    most = F.coalesce(F.element_at(own, c(group)), F.lit(limit)) if limits else F.lit(limit)
    firsts = df.groupBy(group).agg(F.min(first).alias("__first")).withColumnRenamed(group, "__g")
    turns = df.withColumn("__turn", F.row_number().over(Window.partitionBy(group).orderBy(first))).where((c("__turn") <= most) & (c("__turn") <= total))
    turns = turns.join(firsts, c(group) == c("__g")).drop("__g").withColumn("__shared", c(group).isin(*shared))
    # the shared group's rows have a limit over the interleaved order; rows of other sources have none
    in_shared = turns.where("__shared").orderBy("__turn", "__first").limit(shared_limit)
    best = in_shared.unionByName(turns.where("not __shared")).orderBy("__turn", "__first").limit(total)
    return best.withColumn("place", F.row_number().over(Window.orderBy("__turn", "__first"))).drop("__turn", "__first", "__shared")


def capped(df: DataFrame, group: str, order: Sequence[Column], per_group: int, total: int) -> DataFrame:
    """The greedy walk down a total order that skips groups at their cap: rank in group, then rank of all."""
    return top_k_per_group(df, group, order, per_group, "group_rank").orderBy(*order).limit(total)


def select_supplemental(ranked: DataFrame, minimum: int = 10, maximum: int = 15) -> DataFrame:
    """(seq, order, supplemental) from rows (seq, partition, place, group, limit, column, url_key).

    Priority rows by place, each group up to its limit, up to ``maximum``.  While these and the
    supplements are too few (priority rows under ``minimum``, both under ``maximum``), the best-placed
    supplemental row is added that is allowed (its group is below its limit, its URL isn't among the
    supplements) and shows a column that isn't shown yet, else the best-placed allowed one.  What is
    allowed depends on what was added, so that is one small task: it gets ``maximum`` priority rows, and
    of each (group, column) 2 * ``maximum`` supplemental ones, as no others can be reached.
    """
    own = Window.partitionBy("group").orderBy("place")
    near = ranked.where("partition = 'priority'").withColumn("__n", F.row_number().over(own)).where(c("__n") <= c("limit")).orderBy("place").limit(maximum)
    each = Window.partitionBy("group", "column").orderBy("place")
    rest = ranked.where("partition = 'supplemental'").withColumn("__n", F.row_number().over(each)).where(c("__n") <= 2 * maximum)
    columns = ("seq", "partition", "place", "group", "limit", "column", "url_key")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        shown, left = rows[rows["partition"] == "priority"], list(rows[rows["partition"] == "supplemental"].itertuples())
        used, columns_shown, added = dict(shown["group"].value_counts()), set(shown["column"]), []
        while len(shown) < minimum and len(shown) + len(added) < maximum:
            allowed = [r for r in left if used.get(r.group, 0) < r.limit and r.url_key not in {x.url_key for x in added}]
            if not allowed:
                break
            best = min(allowed, key=lambda r: (r.column in columns_shown, r.place))
            added.append(best)
            used[best.group] = used.get(best.group, 0) + 1
            columns_shown.add(best.column)
        seq = [*shown["seq"], *(r.seq for r in added)]
        return pd.DataFrame({"seq": seq, "order": range(1, len(seq) + 1), "supplemental": [False] * len(shown) + [True] * len(added)}).astype({"seq": "int64", "order": "int64", "supplemental": "bool"})

    few = near.select(*columns).unionByName(rest.select(*columns)).withColumn("all", F.lit(0))
    return few.groupBy("all").applyInPandas(fill, "seq long, order long, supplemental boolean")


def batches(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Adds batch (from 0): chunks of ``size`` rows of a bounded selection in the given order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("long"))


def grouped_top(items: DataFrame, groups: DataFrame, key: str, order: Sequence[Column], k: int, fields: Sequence[str]) -> DataFrame:
    """Every group, also without items, with its first k items as an array in order."""
    best = top_k_per_group(items, key, order, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("items")).withColumnRenamed(key, "__k")
    return groups.join(best, c(key) == c("__k"), "left").drop("__k")
