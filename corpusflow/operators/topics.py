"""Scoring of papers against topics, and the selection under caps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx, scan, text
from ..functions.udf import once
from . import rank

c = F.col


@dataclass(frozen=True)
class Topic:
    id: str
    include: Sequence[str]
    exclude: Sequence[str] = ()
    publication_types: Sequence[str] = ()
    enabled: bool = True
    name: str = ""
    description: str = ""


@dataclass(frozen=True)
class Limits:
    """The shipped limits."""

    min_score: float = 40.0
    max_per_topic: int = 3
    max_papers: int = 5
    domain: Sequence[str] = field(default_factory=tuple)


def evidence_weight(types: Column, table: Sequence[tuple[float, str]] = rules.EVIDENCE, otherwise: float = rules.EVIDENCE_ELSE) -> Column:
    """The strongest of each type's first matching rule; ``otherwise`` only if none matches."""
    weights = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: rx.first_match(t, table).cast("double"))
    return F.coalesce(F.array_max(F.filter(weights, lambda w: w.isNotNull())), F.lit(otherwise))


def whole(types: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(c("title"), F.lit("")), F.coalesce(c("abstract"), F.lit("")), F.array_join(types, " "))


def recency_weight(at: Column, now: dt.datetime, bands=rules.RECENCY) -> Column:
    """By age in days, the future counting as now; 0 beyond the bands and without a date."""
    age = F.greatest(F.lit(0.0), (F.lit(now).cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 86400)
    out = None
    for top, w in bands:
        out = F.when(age <= top, w) if out is None else out.when(age <= top, w)
    return F.when(at.isNull(), 0.0).otherwise(out.otherwise(0.0))


#: Rules of the scores, over all of a paper's text in lower case.
_ACTIONABLE = scan.Hits(scan.Scanner([p for _, p in rules.ACTIONABILITY]), "__low_hits")


def phrases(topics: Sequence[Topic], domain: Sequence[str] = ()) -> scan.Hits:
    """One scan for the phrases of all topics and of the domain: what it doesn't find in a paper's whole normal form is in no part of it."""
    lists = {f"{what}{i}": [text.normal_phrase(w) for w in words] for i, t in enumerate(topics) if t.enabled for what, words in (("include", t.include), ("exclude", t.exclude))}
    return scan.Hits(scan.Scanner(lists=lists | {"domain": [text.normal_phrase(w) for w in domain]}), "__phrases")


def topic_match(topic: Topic, types: Column, title: Column, abstract: Column, excluded: Column, included: Column) -> Column:
    """50 for a hit in the title, 40 in the abstract, 10 more if a publication type is expected; 0 if excluded.

    All are normal forms.  excluded and included: whether the paper's whole normal form holds any of the topic's phrases.
    """
    any_of = lambda t, ws: _any([text.includes_phrase(t, w) for w in ws])
    expected = _any([F.array_contains(types, text.normal_phrase(w)) for w in topic.publication_types])
    score = F.when(excluded | ~included, 0).when(any_of(title, topic.include), 50).when(any_of(abstract, topic.include), F.when(expected, 50).otherwise(40)).otherwise(0)
    return (score if topic.enabled else F.lit(0)).cast("double")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | x
    return out


def candidates(papers: DataFrame, now: dt.datetime, types: Column, days: float = 7) -> DataFrame:
    """Abstract of 20 characters, at most a week old and not of the future, evidence above 0.1, no non-research type.

    Dates are looked at first, and the evidence's weight stays as evidence_rank.
    """
    age = F.lit(now).cast("timestamp").cast("double") - c("activity_at").cast("timestamp").cast("double")
    kind = F.concat_ws(" ", c("title"), F.array_join(types, " "))
    recent = papers.where((age >= 0) & (age <= days * 86400)).withColumn("evidence_rank", evidence_weight(types))
    return recent.where((c("evidence_rank") > 0.1) & (F.char_length(rx.trim(c("abstract"))) >= 20) & ~rx.matches(kind, rules.NON_RESEARCH, low=F.lower(kind)))


def scored(papers: DataFrame, topics: Sequence[Topic], now: dt.datetime, domain: Sequence[str] = ()) -> DataFrame:
    """papers × enabled topics that match, with the parts of the score.

    Topics are columns of one array, exploded after scoring: texts are normalised once
    for each paper, and nothing is joined.
    """
    types = F.coalesce(c("publication_types"), F.array().cast("array<string>"))
    texts = F.concat(F.array(*[F.coalesce(c(x), F.lit("")) for x in ("title", "abstract")]), F.filter(types, lambda t: t.isNotNull()))
    base = papers.withColumn("__w", once(text.marked(texts)))
    base = base.withColumn("__lw", once(F.lower("__w")))
    # in lower case marked and whole text differ by what stands between the parts, unless a part holds a mark
    low = F.when((F.size(texts) == 2) | F.exists(texts, lambda x: x.contains(text.MARK)), F.lower(whole(c("publication_types")))).otherwise(F.replace(c("__lw"), F.lit(text.MARK), F.lit(" ")))
    base = base.withColumns({"__p": once(text.normal_parts(c("__w"), c("__lw"))), "__low": once(low)})
    hits = phrases(topics, domain)
    # the normal form of the whole is that of its parts, joined: between them is a space; both scans are one worker's
    base = base.withColumns({hits.column: hits.scanner.bits(F.array_join(F.filter("__p", lambda x: x != ""), " ")), _ACTIONABLE.column: _ACTIONABLE.scanner.bits(c("__low"))})
    base = base.where(_any([hits.any(f"include{i}") for i, t in enumerate(topics) if t.enabled]))
    if domain:
        base = base.where(hits.any("domain"))
    if "evidence_rank" not in papers.columns:
        base = base.withColumn("evidence_rank", evidence_weight(types))
    base = base.withColumn("__act", rx.first_match(c("__low"), rules.ACTIONABILITY, rules.ACTIONABILITY_ELSE, _ACTIONABLE).cast("double")).withColumn("__rec", recency_weight(c("activity_at"), now))
    entries = [F.struct(F.lit(i).alias("topic_ord"), F.lit(t.id).alias("topic_id"), topic_match(t, F.slice("__p", 3, F.size("__p")), F.get("__p", F.lit(0)), F.get("__p", F.lit(1)), hits.any(f"exclude{i}"), hits.any(f"include{i}")).alias("topic_match")) for i, t in enumerate(topics) if t.enabled]
    out = base.withColumn("__s", F.explode(F.filter(F.array(*entries), lambda s: s["topic_match"] > 0)))
    out = out.select(*[x for x in papers.columns if x != "evidence_rank"], "evidence_rank", "__s.*", text.round2(c("evidence_rank") * 25).alias("evidence"), text.round2(c("__act") * 15).alias("actionability"), text.round2(c("__rec") * 10).alias("recency"))
    return out.withColumn("total", text.round2(c("topic_match") + c("evidence") + c("actionability") + c("recency")))


def matched_topics(scores: DataFrame, key: str = "id") -> DataFrame:
    """(key, matched_topic_ids) in topic order."""
    return scores.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_id"))), lambda s: s["topic_id"]).alias("matched_topic_ids"))


def select(papers: DataFrame, topics: Sequence[Topic], now: dt.datetime, limits: Limits = Limits(), valid: bool = True) -> DataFrame:
    """The best topic of each paper, a least score, caps by topic and in all; matched topics in score order."""
    some = candidates(papers, now, c("publication_types")) if valid else papers
    every = scored(some, topics, now, limits.domain)
    by_score = [F.desc("total"), F.desc("evidence_rank"), F.asc("topic_ord")]
    w = Window.partitionBy("id").orderBy(*by_score)
    matched = F.collect_list("topic_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = every.withColumn("matched_topic_ids", matched).withColumn("__n", F.row_number().over(w)).where((c("__n") == 1) & (c("total") >= limits.min_score)).drop("__n")
    order = [F.desc("total"), F.desc("evidence_rank"), F.desc("activity_at"), F.asc("id")]
    return rank.capped(best, "topic_id", order, limits.max_per_topic, limits.max_papers)
