"""Streams whose micro-batches count exactly once, and papers resolved against kept state.

merge_stream() makes one commit of each micro-batch; its number is a mark in the same manifest as the
state.  A batch that is replayed, since the writer died after its commit, finds its number there and does
nothing; one that died before it left nothing.

absorb() resolves fetched papers against golden records of earlier batches through an index of their
identity keys.  A batch reads of the index what its keys name, of the records what these name, resolves
those and the new rows among themselves, and appends: cost follows the batch, not the state.  Rows and
index entries of records that were absorbed are named in a table of their own until compact() drops them.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import dedupe
from ..sinks import commits
from ..storage import stored

c = F.col

#: Keys and record numbers up to which a lookup is a list that Parquet's statistics and filters prune by; beyond, a join.
LISTED = 2000
#: Appended folders of a table after which compact() rewrites it.
MOST_FOLDERS = 16
#: Rows of a batch, by their seq, are fewer.
BATCH_ROWS = 1 << 40


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint folder: batch numbers count within it."""
    return json.loads(commits.read_text(spark, f"{checkpoint}/metadata"))["id"]


def merge_stream(rows: DataFrame, root: str, name: str, change: Callable[[commits.Snapshot, DataFrame], commits.Change], checkpoint: str) -> StreamingQuery:
    """Runs change(snapshot, batch) for each micro-batch of rows and commits it under root, once; ends when input does.

    change() may be asked again where another writer was faster, always with the state that it is to change.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        mark = f"stream {name} {query_id(spark, checkpoint)}"

        def once(s: commits.Snapshot) -> commits.Change | None:
            if int(s.marks.get(mark, "-1")) >= number:
                return None
            out = change(s, batch)
            out.marks[mark] = str(number)
            return out

        commits.commit(spark, root, once)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(df: DataFrame, column: str) -> list | None:
    """The values of a column with at most LISTED rows; None of more."""
    found = [r[0] for r in df.select(column).limit(LISTED + 1).collect()]
    return found if len(found) <= LISTED else None


def _among(table: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """Rows of table whose column is in wanted's: pruned by a list if that is short, else by a semi join."""
    values = _listed(wanted, name)
    if values is not None:
        return table.where(c(column).isin(values)) if values else table.where("false")
    return table.join(wanted.select(c(name).alias(column)), column, "left_semi")


def _keys(papers: DataFrame, number: str) -> DataFrame:
    return papers.select(F.explode(text.identity_keys(c("pmid"), c("doi"), c("title"))).alias("key"), c(number).alias("number"))


def absorb(spark: SparkSession, root: str, s: commits.Snapshot, fetched: DataFrame, now: dt.datetime, cache_days: int) -> commits.Change:
    """The change that merges fetched papers (seq from 0) into the records under root: the same records as state.merged() makes of all.

    Records are numbered so that later batches come first, and within a batch the order is that of seq.
    """
    batch = int(s.marks.get("batches", "0")) + 1
    new = stored(fetched.withColumn("seq", c("seq") - F.lit(batch * BATCH_ROWS)))
    marks = {"batches": str(batch), "kept_from": (now - dt.timedelta(days=cache_days)).isoformat()}
    both, hit = new, None
    if s.tables.get("records"):
        asked = stored(_keys(new, "seq").select("key").distinct())
        hit = stored(alive(spark, root, s, _among(commits.read(spark, root, s, "keys"), "key", asked, "key")).select("number").distinct())
        old = _among(commits.read(spark, root, s, "records"), "number", hit, "number").where(_kept(s))
        both = new.unionByName(old.withColumnRenamed("number", "seq").drop("members"), allowMissingColumns=True)
    groups = dedupe.paper_components(stored(both))
    records = stored(dedupe.merge_groups(groups, F.array_contains("source_kinds", "pubmed")).withColumnRenamed("component", "number").sortWithinPartitions("number"))
    out = commits.Change(append={"records": records, "keys": _keys(records, "number").sort("key")}, marks=marks)
    if hit is not None:
        out.append["gone"] = hit
    return out


def _kept(s: commits.Snapshot):
    return c("activity_at") >= F.lit(dt.datetime.fromisoformat(s.marks["kept_from"]))


def alive(spark: SparkSession, root: str, s: commits.Snapshot, rows: DataFrame) -> DataFrame:
    """Rows whose number isn't that of a record which was absorbed."""
    gone = commits.read(spark, root, s, "gone", "number bigint")
    return rows.join(gone, "number", "left_anti")


def records(spark: SparkSession, root: str, s: commits.Snapshot | None = None) -> DataFrame | None:
    """The golden records of a snapshot (the latest), as far as they are kept; None before the first batch."""
    s = s or commits.latest(spark, root)
    rows = commits.read(spark, root, s, "records")
    return None if rows is None else alive(spark, root, s, rows).where(_kept(s))


def compact(spark: SparkSession, root: str, most: int = MOST_FOLDERS) -> commits.Snapshot:
    """Rewrites records and index as one folder each once there are more than ``most``, without what was absorbed or isn't kept."""

    def change(s: commits.Snapshot) -> commits.Change | None:
        if len(s.tables.get("records", [])) <= most:
            return None
        rows = stored(records(spark, root, s))
        return commits.Change(replace={"records": rows.sort("number"), "keys": _keys(rows, "number").sort("key")}, remove=("gone",))

    return commits.commit(spark, root, change)
