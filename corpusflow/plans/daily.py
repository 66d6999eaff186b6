"""The daily run, composed: filter, enrich, history, cap, review, select, digest.  Nothing here touches a network:
feeds, details and model answers are tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import rules
from ..operators import digest, history, models, rank, routing
from ..storage import stored
from ..streaming import state

c = F.col


@dataclass
class Run:
    judged: DataFrame
    matched: DataFrame
    fresh: DataFrame
    capped: DataFrame
    reviewed: DataFrame
    selected: DataFrame
    counters: dict[str, int]


def run(articles: DataFrame, sources: DataFrame, past: DataFrame, answers: DataFrame | Callable[[str], str], now: dt.datetime, date: str, details: DataFrame | None = None) -> Run:
    """articles with seq; answers: the model that reviews chunks of 30 candidates, or what one said, (chunk, answer).

    Chunks fail for themselves; if there are candidates and all fail, the run ends with an error.
    Each stage is stored as it is made, with its counters observed on the way.
    """
    rows = articles if details is None else state.enriched(articles, details)
    judged, seen = observed(routing.staged(rows, sources, now), fetched_total=F.count(F.lit(1)), deterministic_accepted=F.count_if(c("reason").isNull()))
    matched, by = observed(history.against(judged.where("reason is null"), past, date), **{f"history_rejected_by_{k}": F.count_if(F.coalesce(c("matched_by") == k, F.lit(False))) for k in history.KEYS})
    fresh = matched.where("matched_by is null").drop("matched_by", "matched_date")
    fresh = stored(routing.classified(routing.with_source(fresh, sources)))
    capped, reviewed = observed(rank.review_cap(fresh, rules.REVIEW_LIMITS, rules.REVIEW_LIMIT, rules.SHARED_QUOTA_SOURCES, rules.REVIEW_GROUP_LIMIT, rules.REVIEW_TOTAL), semantic_reviewed=F.count(F.lit(1)))
    said = models.checked_reviews(answers, reviewed["semantic_reviewed"]) if isinstance(answers, DataFrame) else models.review(capped.withColumn("source", F.coalesce("s_name", "source_id")), answers)
    accepted, passed = observed(digest.reviewed(capped, digest.reviews_of(said)), semantic_accepted=F.count(F.lit(1)))
    ranked = routing.selection_input(accepted.select(*articles.columns, "partition").withColumn("reason", F.lit(None).cast("string")), sources)
    chosen = rank.select_supplemental(ranked).join(accepted, "seq")
    label = routing.labelled_recent(c("meta"))
    selected = chosen.withColumn("meta", F.when(c("supplemental") | c("k_type").isin(*rules.RECENT_SELECTION_CONTENT), label).otherwise(c("meta")))
    selected, shown = observed(selected, priority_selected=F.count_if(~c("supplemental")), supplemental_selected=F.count_if(c("supplemental")), final_displayed=F.count(F.lit(1)))
    return Run(judged, matched, fresh, capped, accepted, selected, seen | by | reviewed | passed | shown)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """df, stored, and its counters, which are taken as its rows are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[x.cast("long").alias(k) for k, x in counters.items()]))
    return out, {k: seen.get[k] or 0 for k in counters}


def funnel(r: Run, key: str = "source_id") -> DataFrame:
    """Rows of each source at each stage."""
    stages = {"fetched": r.judged, "eligible": r.judged.where("reason is null"), "fresh": r.fresh, "capped": r.capped, "reviewed": r.reviewed, "selected": r.selected}
    return by_stage(stages, key)


def by_stage(stages: dict[str, DataFrame], key: str = "source_id") -> DataFrame:
    """(key, a count for each stage): one union of the stages' keys, counted once."""
    tagged = None
    for name, df in stages.items():
        one = df.select(c(key), F.lit(name).alias("stage"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).pivot("stage", list(stages)).count().fillna(0)


COUNTERS = ("fetched_total", "deterministic_accepted", *(f"history_rejected_by_{k}" for k in history.KEYS), "semantic_reviewed", "semantic_accepted", "priority_selected", "supplemental_selected", "final_displayed")


def statistics(r: Run) -> DataFrame:
    """One row of counters of the whole run, observed as its stages were written: at each stage, and what history rejected by which key."""
    row = {k: r.counters[k] for k in COUNTERS}
    row["semantic_rejected"] = row["semantic_reviewed"] - row["semantic_accepted"]
    return r.judged.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))
