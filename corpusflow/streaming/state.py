"""State across runs: incremental windows, merged caches, and the same as streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx, urls
from ..operators import dedupe, policy
from ..storage import stored

c = F.col


def window_start(last_success: dt.datetime | None, now: dt.datetime, overlap_hours: int = 48, lookback_days: int = 7) -> dt.datetime:
    """Where an incremental read begins: an overlap before the last success, else the look-back."""
    return last_success - dt.timedelta(hours=overlap_hours) if last_success else now - dt.timedelta(days=lookback_days)


def merged(fetched: DataFrame, cached: DataFrame, now: dt.datetime, cache_days: int) -> DataFrame:
    """Golden records of fetched and cached papers, fetched ones first, as far as they are kept.

    Both have seq; cached rows are numbered behind all fetched ones.
    """
    last = F.lit(1 << 40)
    both = fetched.unionByName(cached.withColumn("seq", c("seq") + last), allowMissingColumns=True)
    groups = dedupe.paper_components(both)
    records = dedupe.merge_groups(groups, F.array_contains("source_kinds", "pubmed"))
    return records.where(c("activity_at") >= F.lit(now - dt.timedelta(days=cache_days)))


def next_success(last: dt.datetime | None, succeeded: int, now: dt.datetime) -> dt.datetime | None:
    """Advances only if a source succeeded."""
    return now if succeeded else last


def as_of(last: dt.datetime | None, papers: DataFrame, now: dt.datetime) -> Column:
    """For a one-row aggregate over papers: the last success, else the newest activity, else now."""
    return F.coalesce(F.lit(last).cast("timestamp"), F.max("activity_at"), F.lit(now).cast("timestamp"))


def section(papers: DataFrame, last: dt.datetime | None, now: dt.datetime, fallback: bool) -> DataFrame:
    """One row: generated_at, data_as_of, is_cached_fallback, count and the first three titles, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s["title"])
    out = papers.agg(as_of(last, papers, now).alias("data_as_of"), F.count("*").alias("papers"), F.array_join(F.slice(ordered, 1, 3), "; ").alias("daily_signal"))
    return out.select(F.lit(now).cast("timestamp").alias("generated_at"), "data_as_of", F.lit(fallback).alias("is_cached_fallback"), "papers", "daily_signal")


def discovered(fetch: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[tuple[str, bool, int, str | None]]]:
    """Papers of all sources and (source_id, ok, fetched, error) of each: every source is read whole and stored, and fails for itself."""
    out, status = None, []
    for name, f in fetch.items():
        try:
            rows = stored(f())
            status.append((name, True, rows.count(), None))
        except Exception as e:  # a source's failure must not end the run
            status.append((name, False, 0, str(e).split("\n")[0][:200]))
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, status


def reuse_summaries(papers: DataFrame, cached: DataFrame) -> DataFrame:
    """papers (id, input_hash) with the cached summary where id and hash are equal."""
    old = cached.where("summary is not null").select(c("id").alias("__id"), c("summary_input_hash").alias("__h"), c("summary").alias("__s"))
    out = papers.join(old, (c("id") == c("__id")) & (c("input_hash") == c("__h")), "left").drop("__id", "__h")
    return out.withColumn("summary", c("__s")).drop("__s")


def enriched(articles: DataFrame, details: DataFrame) -> DataFrame:
    """Articles whose missing date, content type and (where there is no substantive one) excerpt are filled from details of
    the same canonical URL: one row of several, as a whole."""
    d = details.select(urls.canonical(c("url")).alias("__k"), c("published_at").alias("__at"), c("excerpt").alias("__x"), c("content_type").alias("__t"), c("content_type_evidence").alias("__e"))
    d = d.groupBy("__k").agg(F.min(F.struct("__at", "__x", "__t", "__e")).alias("__d"))
    out = articles.withColumn("__u", urls.canonical(c("url"))).join(d, c("__u") == c("__k"), "left").withColumn("__s", policy.substantive())
    out = out.withColumn("published_at", F.coalesce("published_at", "__d.__at")).withColumn("excerpt", F.when(c("__s"), c("excerpt")).otherwise(F.coalesce("__d.__x", "excerpt")))
    out = out.withColumn("content_type", F.coalesce(F.nullif("content_type", F.lit("")), "__d.__t")).withColumn("content_type_evidence", F.coalesce("content_type_evidence", "__d.__e"))
    return out.select(*articles.columns)


def says_something() -> Column:
    """Whether a page gave a date, an excerpt or a content type; one that gave nothing isn't an article's page."""
    return c("published_at").isNotNull() | (F.coalesce("excerpt", F.lit("")) != "") | (F.coalesce("content_type", F.lit("")) != "")


def with_details(articles: DataFrame, targets: Sequence[str], cache: DataFrame, extract: Callable[[DataFrame], DataFrame], now: dt.datetime, days: int = 14) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles with details, the cache, statistics): incomplete classified rows of the target sources are looked up by canonical URL.

    The first 16 URLs count, 8 of a source.  Details that the cache holds and that haven't expired are used; the
    rest goes to extract() (rows with source_id, url), whose rows (url, published_at, excerpt, content_type,
    content_type_evidence) are merged and kept ``days`` days.  Pages that give no row, or one that says nothing, count
    as failed and aren't kept.  Only articles of the URLs that were looked up are filled, whatever else the cache holds.
    """
    wanted = stored(needs_details(articles, targets).select("seq", "source_id", "url", "published_at", "subst", "content_type", urls.canonical(c("url")).alias("key")))
    chosen = stored(dedupe.detail_candidates(wanted, "key"))  # sixteen rows at most
    fresh = stored(cache.where(c("expires_at") > F.lit(now)).withColumn("__k", urls.canonical(c("url"))))
    mine = fresh.join(F.broadcast(chosen.select(c("key").alias("__k"))), "__k", "left_semi")
    hits = stored(chosen.join(mine, c("key") == c("__k"), "left_semi").select("seq"))
    misses = chosen.join(hits, "seq", "left_anti")
    got = stored(extract(misses).where(says_something()).withColumn("expires_at", F.lit(now + dt.timedelta(days=days))).withColumn("__k", urls.canonical(c("url"))))
    known = fresh.join(got.select("__k").distinct(), "__k", "left_anti").unionByName(got, allowMissingColumns=True).drop("__k")
    used = mine.unionByName(got.join(F.broadcast(misses.select(c("key").alias("__k"))), "__k", "left_semi"), allowMissingColumns=True).drop("__k")
    gave = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    answers = got.groupBy("__k").agg(F.lit(True).alias("answered"), gave(c("published_at").isNotNull()).alias("date"), gave(F.coalesce("excerpt", F.lit("")) != "").alias("excerpt"), gave(F.coalesce("content_type", F.lit("")) != "").alias("type"))
    asked = chosen.join(hits.withColumn("hit", F.lit(True)), "seq", "left").join(answers.withColumnRenamed("excerpt", "text"), c("key") == c("__k"), "left")
    lacks = {"dated": c("published_at").isNull() & c("date"), "excerpted": ~c("subst") & c("text"), "typed": (F.coalesce("content_type", F.lit("")) == "") & c("type")}
    return enriched(articles, used), known, detail_statistics(asked.withColumns(lacks))


def detail_statistics(asked: DataFrame) -> DataFrame:
    """(source_id, requested, cache_hits, succeeded, failed, date_enriched, excerpt_enriched, type_enriched) of each source
    and of all, from rows (source_id, hit, answered, dated, excerpted, typed): what the cache had wasn't requested, and
    enriches nothing that counts."""
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    fetched, answered = ~yes("hit"), ~yes("hit") & yes("answered")
    counts = asked.groupingSets([["source_id"], []], "source_id").agg(
        F.count_if(fetched).alias("requested"), F.count_if(yes("hit")).alias("cache_hits"), F.count_if(answered).alias("succeeded"), F.count_if(fetched & ~yes("answered")).alias("failed"),
        F.count_if(answered & yes("dated")).alias("date_enriched"), F.count_if(answered & yes("excerpted")).alias("excerpt_enriched"), F.count_if(answered & yes("typed")).alias("type_enriched"), F.grouping("source_id").alias("__all"),
    )
    return counts.withColumn("source_id", F.when(c("__all") == 1, "all").otherwise(c("source_id"))).drop("__all")


def needs_details(articles: DataFrame, targets: Sequence[str] = rules.DETAIL_SOURCES, excluded: Sequence[str] = rules.DETAIL_EXCLUDED) -> DataFrame:
    """Incomplete rows (no date, nothing substantive, no content type or an unknown document) of the target sources, on
    the web, neither hard-excluded nor of ordinary research; rows carry what routing.classified() adds."""
    lacks = c("published_at").isNull() | ~c("subst") | (F.coalesce("content_type", F.lit("")) == "") | (c("d_type") == "unknown")
    said = F.concat_ws("\n", *[F.nullif(c(x), F.lit("")) for x in ("title", "content_type", "document_type")])
    return articles.where(c("source_id").isin(*targets) & lacks & ~c("excluded") & rx.matches(c("url"), "^https?://") & ~rx.any_match(said, excluded))


# Streams (an extension: the batch forms above are what runs need)


def unique_stream(rows: DataFrame, key: str = "url", at: str = "published_at", overlap: str = "48 hours") -> DataFrame:
    """First row of each key within the overlap; state older than the watermark is dropped."""
    return rows.withWatermark(at, overlap).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
