"""De-duplication and entity resolution."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import discard, stored

c = F.col


def first_by(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in order; rows of a null key all stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", first).where((c("__n") == 1) | c(key).isNull()).drop("__n")


def components(keys: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component) of nodes that share keys, transitively; component is the least node.

    Each round a node takes the least label of its keys' nodes: two partial aggregates
    and a join.  Labels also jump to their label's label, so rounds grow with the
    logarithm of a chain's length.  Rounds are stored in the shared folder, and so are
    keys' least nodes: both sides of a join are shuffled for it, so that adaptive
    execution can split a key which very many nodes have.
    """
    pairs = keys.select(c(node).alias("n"), c(key).alias("k")).where("n is not null and k is not null")
    least = stored(pairs.groupBy("k").agg(F.min("n").alias("hub"), F.max("n").alias("last")).where("hub <> last").select("k", "hub"))
    links = stored(pairs.join(least, "k").where("n <> hub").select("n", "hub").distinct())
    discard(least)
    both = links.union(links.select(c("hub").alias("n"), c("n").alias("hub")))
    label = stored(both.groupBy("n").agg(F.least(F.min("hub"), F.min("n")).alias("l")))
    while True:
        near = both.join(label.select(c("n").alias("hub"), c("l").alias("lh")), "hub").groupBy("n").agg(F.min("lh").alias("lh"))
        step = label.join(near, "n").select("n", F.least("l", "lh").alias("l"))
        jump = step.join(label.select(c("n").alias("l"), c("l").alias("ll")), "l", "left").select("n", F.least("l", F.coalesce("ll", "l")).alias("l"))
        new = stored(jump)
        changed = new.join(label.withColumnRenamed("l", "old"), "n").where("l <> old").limit(1).count()
        discard(label)
        label = new
        if not changed:
            break
    discard(links)
    nodes = keys.select(c(node).alias("n")).where("n is not null").distinct()
    return nodes.join(label, "n", "left").select(c("n").alias(node), F.coalesce("l", "n").alias("component"))


def paper_components(papers: DataFrame, order: str = "seq") -> DataFrame:
    """papers with component: the least seq of papers that share number, DOI or title, transitively."""
    keys = stored(papers.select(order, F.explode(text.identity_keys(c("pmid"), c("doi"), c("title"))).alias("key")))  # read by several rounds
    found = components(papers.select(order, F.lit(None).cast("string").alias("key")).unionByName(keys), order, "key")
    found = found.withColumnRenamed(order, "__n")
    return papers.drop("component").join(found, c(order) == c("__n"), "left").drop("__n")


def merge_groups(papers: DataFrame, preferred: Column, order: str = "seq", locale_sort: bool = True) -> DataFrame:
    """One golden record for each component, in the order of first members.

    Blank fields of the preferred member (first with ``preferred``, else the first) are
    filled in order of seq; the newest dates win; number, then DOI, then the preferred
    member name it; arrays are united and sorted.  Aggregates only: min_by over seq.
    """
    rank = F.struct((~F.coalesce(preferred, F.lit(False))).alias("p"), c(order).alias("s"))

    def filled(name: str) -> Column:
        value = F.nullif(c(name), F.lit(""))
        own = F.min_by(value, rank)
        return F.coalesce(own, F.min_by(value, F.when(value.isNotNull(), c(order)))).alias(name)

    def united(name: str) -> Column:
        every = F.array_distinct(F.flatten(F.collect_list(F.filter(c(name), lambda x: F.coalesce(x, F.lit("")) != ""))))
        if locale_sort:
            return F.transform(F.array_sort(F.transform(every, lambda x: F.struct(F.collate(x, "UNICODE").alias("k"), x.alias("v")))), lambda s: s["v"]).alias(name)
        return F.array_sort(every).alias(name)

    texts = [n for n in ("pmid", "doi", "title", "abstract", "journal", "url") if n in papers.columns]
    arrays = [n for n in ("authors", "publication_types", "source_kinds", "matched_topic_ids") if n in papers.columns]
    dates = [n for n in ("published_at", "activity_at") if n in papers.columns]
    kept = [F.min_by(c(n), F.when(c(n).isNotNull(), F.struct((~F.coalesce(preferred, F.lit(False))).alias("p"), c(order).alias("s")))).alias(n) for n in ("summary", "summary_status", "summary_input_hash") if n in papers.columns]
    own_id = [F.min_by(c("id"), rank).alias("__id")] if "id" in papers.columns else []
    out = papers.groupBy("component").agg(*[filled(n) for n in texts], *[F.max(n).alias(n) for n in dates], *[united(n) for n in arrays], *kept, *own_id, F.count("*").alias("members"))
    if "doi" in texts:
        out = out.withColumn("doi", text.normalize_doi(c("doi")))
    if own_id:
        out = named(out, c("__id")).drop("__id")
    return out


def named(papers: DataFrame, own: Column, doi: Column | None = None) -> DataFrame:
    """papers with the id that a record has: by its number, else its DOI (in normal form), else its own."""
    names = [F.when(F.coalesce(c("pmid"), F.lit("")) != "", F.concat(F.lit("pmid:"), c("pmid")))] if "pmid" in papers.columns else []
    names += [F.concat(F.lit("doi:"), c("doi") if doi is None else doi)] if "doi" in papers.columns else []
    return papers.withColumn("id", F.coalesce(*names, own))


#: Rows of a component of conflicts, first in order, that one task folds at once; rounds before that.
FOLDED_ROWS, PARALLEL_ROUNDS = 100_000, 4


def greedy_two_keys(rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """Rows that stay if, in order, a row goes once an accepted one has its key a or its key b.

    A row that goes registers no key, so this isn't a window.  It is the
    lexicographically first independent set: rounds accept every open row that is
    first among the open rows of both of its keys, then drop open rows that share a
    key with an accepted one.  Rows of a blank key go.  Only keys and numbers move.

    First rows come from aggregates and meet by their numbers, which are unique; what is dropped
    meets the accepted keys in joins of stored tables, so a key that a third of the rows share is
    split or falls in one round.  A chain of conflicts would take a round a link; after four rounds
    the first FOLDED_ROWS open rows of each component of conflicts, which depend on nothing
    behind them, are folded in a task, so that rounds follow the largest component's rows over that number.
    """
    open_ = stored(rows.select(c(order).alias("o"), c(a).alias("a"), c(b).alias("b")).where("o is not null and a <> '' and b <> ''"))
    accepted, rounds = [], 0
    while open_.limit(1).count():
        rounds += 1
        if rounds <= PARALLEL_ROUNDS:
            first = lambda key: open_.groupBy(key).agg(F.min(F.struct("o", "a", "b")).alias("f")).select("f.*")
            now, done = stored(first("a").join(first("b").select("o"), "o")), None
        else:
            now, done = _folded(open_)
        accepted.append(now.select("o"))
        rest = open_ if done is None else open_.join(done, "o", "left_anti")
        left = stored(rest.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("o", "a", "b"))
        discard(open_)
        open_ = left
    out = rows.select(c(order).alias("o")).where("false")
    for x in accepted:
        out = out.union(x.select(c("o").cast(out.schema["o"].dataType)))
    return out.select(c("o").alias(order))


def _folded(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the first rows of each component of conflicts, some FOLDED_ROWS of them: those that stay, and all (o).

    A component's share of that size is the next lower power of 1/2; its last row comes from a quantile sketch,
    so that no task numbers a whole component.
    """
    keys = open_.select("o", F.concat(F.lit("a"), c("a")).alias("k")).unionByName(open_.select("o", F.concat(F.lit("b"), c("b")).alias("k")))
    found = stored(open_.join(components(keys, "o", "k"), "o"))
    halves = F.greatest(F.ceil(F.log2(F.count("*") / F.lit(FOLDED_ROWS))), F.lit(0)) + 1
    last = F.get(F.percentile_approx("o", [0.5**k for k in range(40)], 10_000), (F.least(halves, F.lit(40)) - 1).cast("int"))
    ends = stored(found.groupBy("component").agg(last.alias("last")))
    some = stored(found.join(ends, "component").where("o <= last").drop("last"))
    discard(found, ends)

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        return df.loc[df["o"].isin(greedy_fold(df)), ["o", "a", "b"]]

    return stored(some.groupBy("component").applyInPandas(fold, open_.schema)), some.select("o")


def greedy_fold(rows: pd.DataFrame) -> list[int]:
    """The same as a plain loop, for tests."""
    seen_a, seen_b, out = set(), set(), []
    for r in rows.sort_values("o").itertuples():
        if r.a and r.b and r.a not in seen_a and r.b not in seen_b:
            seen_a.add(r.a)
            seen_b.add(r.b)
            out.append(r.o)
    return out


def detail_candidates(rows: DataFrame, key: str, total: int = 16, per_source: int = 8, order: str = "seq") -> DataFrame:
    """First of each key, the first ``total`` of them, then at most ``per_source`` of a source: in that order."""
    some = first_by(rows, key, [c(order)]).orderBy(order).limit(total)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy(order))).where(c("__n") <= per_source).drop("__n")
