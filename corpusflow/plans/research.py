"""The research run, composed: sources, merged cache, history, selection, summaries, saved state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedupe, history, models, topics
from ..sources.registry import RunLimits
from ..storage import stored
from ..streaming import state

c = F.col
Status = list[tuple[str, bool, int, str | None]]


@dataclass
class Research:
    papers: DataFrame
    section: DataFrame
    cache: DataFrame
    status: Status
    cached_fallback: bool
    last_success: dt.datetime | None


def fingerprinted(papers: DataFrame) -> DataFrame:
    day = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if "published_at" in papers.columns else F.lit(None).cast("string")
    authors = c("authors") if "authors" in papers.columns else F.array().cast("array<string>")
    return papers.withColumn("input_hash", text.fingerprint(c("title"), c("abstract"), c("journal"), day, c("publication_types"), authors))


def run(
    fetch: dict[str, Callable[[dt.datetime, dt.datetime], DataFrame]], cached: DataFrame, last_success: dt.datetime | None, shown: DataFrame, wanted: Sequence[topics.Topic], now: dt.datetime,
    summarize: Callable[[DataFrame], DataFrame], limits: RunLimits = RunLimits(), selection: topics.Limits = topics.Limits(), save: Callable[[DataFrame], None] | None = None,
) -> Research:
    """fetch: source -> papers of a time span; cached papers carry summary and summary_input_hash; shown: (key).

    Every source fails for itself.  If all fail, the selection is from the cache alone, flagged, and nothing
    is saved.  Else fetched and cached papers merge, what was shown leaves, the best are selected, those
    without a summary of their present text go to summarize() (papers -> (chunk, answer)), whose failure only
    marks them, and the summaries go back into the cache, which is saved.
    """
    start = state.window_start(last_success, now, limits.overlap_hours, limits.lookback_days)
    fetched, status = state.discovered({k: (lambda f=f: f(start, now)) for k, f in fetch.items()})
    choose = lambda df: topics.select(history.unshown_papers(df, shown), wanted, now, selection)
    if fetched is None:
        papers = stored(choose(dedupe.named(cached, c("id"), text.normalize_doi(c("doi")))))  # ties fall by id, so by the names that merged records have
        return Research(papers, state.section(placed(papers), last_success, now, True), cached, status, True, last_success)
    merged = stored(state.merged(fetched, cached, now, limits.cache_days).withColumn("seq", c("component")))
    chosen = stored(fingerprinted(choose(merged)))
    chosen = chosen.withColumn("fresh", F.coalesce((c("summary_input_hash") == c("input_hash")) & c("summary").isNotNull(), F.lit(False)))
    lacking = chosen.where("not fresh")
    try:
        new = stored(models.summarized(lacking, summarize(lacking)))
    except Exception:  # the section ships without new summaries
        new = lacking.withColumn("summary", F.lit(None).cast(lacking.schema["summary"].dataType)).withColumn("summary_status", F.lit("failed"))
    done = new.withColumn("summary_input_hash", F.when(c("summary_status") == "success", c("input_hash")))
    papers = stored(chosen.where("fresh").withColumn("summary_status", F.lit("success")).unionByName(done, allowMissingColumns=True))
    back = papers.select(*[x for x in merged.columns if x in papers.columns])
    cache = stored(merged.join(back.select("seq"), "seq", "left_anti").unionByName(back, allowMissingColumns=True))
    if save is not None:
        save(cache)
    return Research(papers, state.section(placed(papers), now, now, False), cache, status, False, now)


def placed(papers: DataFrame) -> DataFrame:
    """Selected papers (some dozens at most) with their place."""
    from pyspark.sql import Window

    return papers.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), F.desc("evidence_rank"), F.desc("activity_at"), "id")))


def safely(run_: Callable[[], Research], warn: Callable[[str], None] = print) -> Research | None:
    """The run, or None if it fails as a whole: the daily run goes on without it."""
    try:
        return run_()
    except Exception as e:
        warn(f"research failed: {e}")
        return None


def dry_run(fetch: dict[str, Callable[[], DataFrame]], wanted: Sequence[topics.Topic], now: dt.datetime, selection: topics.Limits = topics.Limits()) -> DataFrame:
    """One row: sources that succeeded and failed, papers fetched, after merging, and selected."""
    fetched, status = state.discovered(fetch)
    good = sum(s[1] for s in status)
    if fetched is None:
        raise ValueError("no source could be read: " + "; ".join(f"{s[0]}: {s[3]}" for s in status))
    groups = stored(dedupe.paper_components(fetched))
    records = dedupe.merge_groups(groups, F.array_contains("source_kinds", "pubmed"))
    counts = groups.agg(F.count("*").alias("fetched"), F.countDistinct("component").alias("deduped"))
    chosen = topics.select(records, wanted, now, selection).agg(F.count("*").alias("selected"))
    head = counts.select(F.lit(good).alias("successful_sources"), F.lit(len(status) - good).alias("failed_sources"), "fetched", "deduped")
    return head.crossJoin(F.broadcast(chosen))  # one row each
