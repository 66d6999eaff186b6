"""Routing to columns and the staged filter with one reason for each rejected row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx, text, urls
from ..storage import stored
from . import dedupe, policy, rank

c = F.col


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their source's columns, prefixed s_; s_known tells whether there is one.

    sources (a registry of some dozens of rows, checked to be at most 10,000) is broadcast.
    """
    if sources.limit(10_001).count() > 10_000:
        right = sources
    else:
        right = F.broadcast(sources)
    names = {"id": "s_id", "class": "s_class", "url": "s_url", "category": "s_category", "allowed_hosts": "s_allowed_hosts", "keywords": "s_keywords", "exclude_keywords": "s_exclude_keywords", "name": "s_name", "subcategory": "s_subcategory", "lang": "s_lang"}
    right = right.select(*[c(k).alias(v) for k, v in names.items()])
    return articles.join(right, c("source_id") == c("s_id"), "left").withColumn("s_known", c("s_id").isNotNull())


def classified(articles: DataFrame) -> DataFrame:
    """Adds excluded, d_type, k_type, k_evidence, official and subst, which routing reads several times."""
    return _with_types(policy.with_texts(articles).withColumn("excluded", policy.hard_excluded()))


def _with_types(out: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The types of rows with texts and excluded; only of wanted rows, so that others cost nothing."""
    wanted = F.lit(True) if wanted is None else wanted
    out = policy.with_content_type(out.withColumn("d_type", F.when(wanted, policy.document_type(c("excluded")))), wanted)
    return out.withColumn("official", F.when(wanted, policy.official_formal(c("d_type"), c("excluded")))).withColumn("subst", F.when(wanted, policy.substantive()))


def route() -> Column:
    """struct(category, reject): fifteen steps, first that decides wins."""
    item, kind = policy.item_has, policy.kind_has
    go = lambda category: F.struct(F.lit(category).alias("category"), F.lit(None).cast("string").alias("reject"))
    no = lambda reason: F.struct(F.lit(None).cast("string").alias("category"), F.lit(reason).alias("reject"))
    hit = lambda t, p: rx.matches(t, p, low=policy.HITS)
    k, d, sid = c("k_type"), c("d_type"), c("source_id")
    in_ = lambda x, names: F.coalesce(x.isin(*names), F.lit(False))
    topic = item(rules.SURGICAL_TOPIC)
    academic = F.coalesce(c("s_class") == "academic_journal", F.lit(False))
    opinion = in_(k, ("professional_review", "expert_commentary"))
    return (
        F.when(in_(sid, rules.PODCAST_SOURCES) & (item(rules.PODCAST_PROMOTION) | ~item(rules.PODCAST_PROFESSIONAL)), no("unsupported_content_type"))
        .when(in_(sid, rules.MIXED_FEED_SOURCES) & (item(rules.RESEARCH_NEWS) | item(rules.RESEARCH_WORD)) & ~item(rules.DYNAMICS) & ~item(rules.FORMAL_GUIDANCE), no("ordinary_research_article"))
        .when(in_(c("document_type"), rules.GUIDANCE_TYPES), go("tech"))
        .when((d == "policy") & c("official"), go("tech"))
        .when(F.coalesce(c("document_type") == "research_article", F.lit(False)) | kind(rules.ORDINARY_RESEARCH), no("ordinary_research_article"))
        .when(in_(k, rules.SURGERY_CONTENT) | hit(c("content_type"), rules.TECHNIQUE_LABEL) | hit(c("title"), rules.TECHNIQUE_TITLE), go("finance"))
        .when(in_(k, rules.GUIDANCE_CONTENT), go("tech"))
        .when(in_(k, rules.DYNAMICS_CONTENT) & academic & opinion & ~F.coalesce(policy.academic_exception(k, c("k_evidence")), F.lit(False)), no("unsupported_content_type"))
        .when(in_(k, rules.DYNAMICS_CONTENT), go("politics"))
        .when(in_(d, rules.GUIDANCE_TYPES) | kind(rules.FORMAL_GUIDANCE), go("tech"))
        .when(item(rules.SURGICAL_METHOD) | ((d == "video") & topic), go("finance"))
        .when(in_(sid, rules.GUIDANCE_WORD_SOURCES) & item(rules.GUIDANCE_WORDS), go("tech"))
        .when(in_(d, ("news", "safety_alert", "policy")) | item(rules.DYNAMICS), go("politics"))
        .when(academic, no("ordinary_research_article"))
        .when(in_(d, ("video", "education")) & ~topic, no("unsupported_content_type"))
        .otherwise(F.struct(c("s_category").alias("category"), F.lit(None).cast("string").alias("reject")))
    )


def routed(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of known sources that have a column, their category replaced."""
    out = classified(with_source(articles, sources)).where("s_known").withColumn("__r", route())
    return out.where("__r.reject is null").withColumn("category", c("__r.category")).select(*articles.columns)


def _age_hours(now: dt.datetime) -> Column:
    return (F.lit(now).cast("timestamp").cast("double") - c("published_at").cast("timestamp").cast("double")) / 3600


def window_part(category: Column, at: Column, now: dt.datetime, windows: dict[str, tuple[float, float]]) -> Column:
    """future, priority, supplemental or outside, by a category's two windows in hours; none for a category without."""
    hours = (F.lit(now).cast("timestamp").cast("double") - at.cast("double")) / 3600
    table = F.create_map(*[F.lit(x) for k, v in windows.items() for x in (k, F.array(F.lit(float(v[0])), F.lit(float(v[1]))))])
    own = F.element_at(table, category)
    return F.when(hours < 0, "future").when(own.isNull(), "none").when(hours <= F.get(own, F.lit(0)), "priority").when(hours <= F.get(own, F.lit(1)), "supplemental").otherwise("outside")


def staged(articles: DataFrame, sources: DataFrame, now: dt.datetime, windows: dict = rules.WINDOWS) -> DataFrame:
    """articles (with seq) plus reason (null: accepted), routed category and partition (priority or supplemental).

    All stages but the last are one ordered expression, so each row has the reason of
    the first stage that rejects it; the duplicate stage is the greedy two-key dedupe
    over what is left.
    """
    quota = rank.interleaved(articles.where(c("source_id").isin(*rules.SHARED_QUOTA_SOURCES)), "source_id", [c("seq")], rules.SHARED_QUOTA).select(c("seq").alias("__q"))
    base = policy.with_texts(with_source(articles, sources).join(F.broadcast(quota), c("seq") == c("__q"), "left"))
    item, low, hours = c(policy.ITEM), c(policy.LOW), _age_hours(now)
    window = F.create_map(*[F.lit(x) for k, v in windows.items() for x in (k, float(v[1]))])
    near = F.create_map(*[F.lit(x) for k, v in windows.items() for x in (k, float(v[0]))])
    dual = F.coalesce(c("source_id").isin(*rules.DUAL_KEYWORD_SOURCES), F.lit(False))
    none = F.array().cast("array<string>")
    both = policy.HITS.any("include") & rx.contains_any_of(item, F.coalesce(c("s_keywords"), none), low)
    # cheap stages first: types and routes are for rows that these leave
    early = (
        F.when(c("source_id").isin(*rules.SHARED_QUOTA_SOURCES) & c("__q").isNull(), "unsupported_content_type")
        .when(rx.blank(c("title")) | ~urls.is_http(c("url")), "invalid_item")
        .when(c("excluded") | policy.HITS.any("exclude"), "promotional")
        .when(~c("s_known") | c("published_at").isNull(), "invalid_item")
        .when(rx.contains_any_of(item, F.coalesce(c("s_exclude_keywords"), none), low), "source_excluded")
        .when(dual & ~both, "not_obgyn")
    )
    left = c("__early").isNull()
    base = _with_types(base.withColumn("excluded", policy.hard_excluded()).withColumn("__early", early), left).withColumn("__r", F.when(left, route()))
    reason = (
        F.when(~left, c("__early"))
        .when(c("__r.reject").isNotNull(), c("__r.reject"))
        .when((hours < 0) | (hours > F.element_at(window, c("__r.category"))), "outside_time_window")
        .when(~c("subst") & ~c("official"), "missing_excerpt")
        .when(F.coalesce(c("s_class") == "general_authority", F.lit(False)) & ~both, "not_obgyn")
    )
    judged = base.withColumn("reason", reason).withColumn("category", F.coalesce(c("__r.category"), c("category")))
    judged = judged.withColumn("partition", F.when(hours <= F.element_at(near, c("category")), "priority").otherwise("supplemental"))
    judged = stored(judged.select(*articles.columns, "reason", "partition"))  # the rules run once
    left = judged.where("reason is null").withColumn("__u", urls.canonical(c("url"))).withColumn("__t", text.normalize_content_title(c("title")))
    kept = dedupe.greedy_two_keys(left.select("seq", c("__u").alias("a"), c("__t").alias("b")), "seq", "a", "b").select(c("seq").alias("__kept"))
    out = judged.join(kept, c("seq") == c("__kept"), "left")
    out = out.withColumn("reason", F.when(c("reason").isNull() & c("__kept").isNull(), "duplicate").otherwise(c("reason"))).drop("__kept")
    return out.withColumn("partition", F.when(c("reason").isNull(), c("partition")))


def statistics(judged: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected and a counter for each kind of rejection."""
    counters: dict[str, list[str]] = {}
    for reason, name in rules.COUNTERS.items():
        counters.setdefault(name, []).append(reason)
    return judged.agg(
        F.count("*").alias("total"), F.count_if(c("reason").isNull()).alias("accepted"), F.count_if(c("reason").isNotNull()).alias("rejected"),
        *[F.count_if(c("reason").isin(*rs)).alias(n) for n, rs in counters.items()],
    )


def by_source(judged: DataFrame, key: str = "source_id") -> DataFrame:
    """(source, rejects): a map from reason to count for each source."""
    counts = judged.where("reason is not null").groupBy(key, "reason").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejects"))


def value_score() -> Column:
    """Worth of an article to professionals, by its source's class and its type."""
    by_class = F.lit(rules.CLASS_VALUE_ELSE)
    for k, v in rules.CLASS_VALUE.items():
        by_class = F.when(c("s_class") == k, v).otherwise(by_class)
    k = c("k_type")
    by_type = (
        F.when(c("d_type").isin(*rules.GUIDANCE_TYPES), 60).when(k.isin(*rules.GUIDANCE_CONTENT), 50).when(k.isin("safety_alert", "practice_change"), 45)
        .when(k.isin(*rules.SURGERY_CONTENT), 40).when(k.isin(*rules.DYNAMICS_CONTENT), 30).otherwise(0)
    )
    return by_class + by_type


def labelled_recent(meta: Column) -> Column:
    """meta with the recent-selection label in front, once."""
    label, own = rules.RECENT_SELECTION_LABEL, F.nullif(rx.trim(meta), F.lit(""))
    return F.when(own.startswith(label), meta).otherwise(F.concat_ws(" · ", F.lit(label), own))


def display_column() -> Column:
    return F.when(c("category") != "politics", c("category")).when((c("s_subcategory") == "china-obgyn") | (c("s_lang") == "zh"), "china-obgyn").otherwise("international-obgyn")


def selection_input(judged: DataFrame, sources: DataFrame) -> DataFrame:
    """Accepted rows with what select_supplemental() ranks by, as far as it can reach them: of each (partition,
    group, column) twice its total, which ranks in the group decide, before any rank over a whole partition."""
    out = classified(with_source(judged.where("reason is null"), sources))
    out = out.withColumn("score", value_score()).withColumn("column", display_column()).withColumn("url_key", urls.canonical(c("url")))
    group = F.when(c("source_id").isin(*rules.SHARED_QUOTA_SOURCES), "shared").otherwise(c("source_id"))
    limits = F.create_map(*[F.lit(x) for kv in rules.FILL_LIMITS.items() for x in kv])
    out = out.withColumn("group", group).withColumn("limit", F.coalesce(F.element_at(limits, c("source_id")), F.lit(rules.DIGEST_TOTAL)))
    order = [F.desc("score"), F.coalesce(c("published_at").cast("timestamp").cast("double"), F.lit(0.0)).desc(), F.asc("seq")]
    few = rank.top_k_per_group(out, ["partition", "group", "column"], order, 2 * rules.DIGEST_TOTAL, "__n").drop("__n")
    return few.withColumn("place", F.row_number().over(Window.partitionBy("partition").orderBy(*order)))
