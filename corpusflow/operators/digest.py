"""Model answers against candidates: reviews, summaries, digests.  Answers are a table; no model is called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx, text, urls
from ..storage import stored

c = F.col
REVIEWS = "struct<reviews:array<struct<url:string,status:string,summary:string>>>"
BRIEF = "array<struct<url:string,summary:string,importance:double,title:string,source:string>>"
DIGEST = f"struct<hero_headline:string,daily_overview:string,tech_briefs:{BRIEF},finance_briefs:{BRIEF},politics_briefs:{BRIEF},editor_note:string,keywords:array<string>>"
#: Fixed value: the summary of a formal document that is known by title only.
TITLE_ONLY = "原始页面暂未提供可解析摘要，请查看原文了解详细更新。"


def parsed(answer: Column, schema: str) -> Column:
    """The answer's JSON, strictly, else repaired; null if neither parses."""
    bare = text.extract_json(answer)
    strict = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.from_json(F.coalesce(strict, text.repair_json(F.when(strict.isNull(), bare))), schema)  # only broken ones pass through Python


def reviews_of(answers: DataFrame, answer: str = "answer", order: str = "chunk") -> DataFrame:
    """(url, status, summary, n): all reviews of all chunks' answers, in order."""
    out = answers.select(order, parsed(c(answer), REVIEWS).alias("p")).select(order, F.posexplode("p.reviews").alias("pos", "r"))
    return out.select("r.url", "r.status", "r.summary", F.struct(order, "pos").alias("n")).where("url is not null")


def last_of_url(candidates: DataFrame, order: str = "seq") -> DataFrame:
    """The candidate of each URL that counts for reviewed(): the last in order.  Taken before candidates are classified, rules run for these only."""
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def reviewed(candidates: DataFrame, reviews: DataFrame, order: str = "seq") -> DataFrame:
    """Candidates that a review accepts; they carry what routing.classified() adds.

    Of several candidates of one URL the last in order counts.  A rejection of a URL anywhere outweighs; of several accepting reviews the first that
    approves counts.  An uncertain one passes only for a formal document of an official
    authority; a document known by title gets the fixed summary and low priority.
    """
    reviews = stored(reviews.where("status in ('accepted', 'uncertain', 'rejected')"))  # read twice, and parsed once
    rejected = reviews.where("status = 'rejected'").select("url").distinct()
    open_ = reviews.where("status in ('accepted', 'uncertain')").join(rejected, "url", "left_anti")
    joined = last_of_url(candidates, order).where("s_known").join(open_.select(c("url").alias("__u"), c("status"), c("summary").alias("__summary"), "n"), c("url") == c("__u"))
    fallback = ~c("subst") & c("official") & ~c("d_type").isin("news", "video", "education") & ~rx.matches(c("title"), rules.VIDEO_TITLE)
    official = (c("s_class") == "official_authority") & c("official")
    fine = ((c("status") == "accepted") | official) & (c("subst") | fallback) & (fallback | ~rx.blank(c("__summary")))

    good = joined.where(fine & ~c("excluded")).withColumn("__f", fallback)
    first = good.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("n"))).where("__n = 1")
    status = F.when(c("__f"), "uncertain").otherwise(c("status"))
    out = first.withColumn("summary", F.when(c("__f"), TITLE_ONLY).otherwise(rx.trim(c("__summary")))).withColumn("review_status", status).withColumn("low_priority", status == "uncertain")
    return out.drop("__u", "status", "__summary", "n", "__n", "__f")


def llm_rejected(reviewed_: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reviewed candidates that no accepted one has the canonical URL of."""
    keys = accepted.select(urls.canonical(c("url")).alias("__k")).distinct()
    return reviewed_.withColumn("__k", urls.canonical(c("url"))).join(keys, "__k", "left_anti").drop("__k")


def sections(answer: Column, names: Sequence[str] = ("tech", "finance", "politics")) -> Column:
    """Array of (ord, category, item) of a digest's sections."""
    p = parsed(answer, DIGEST)

    def one(ord_: int, name: str) -> Column:
        items = F.coalesce(p[f"{name}_briefs"], F.array().cast(BRIEF))
        return F.transform(items, lambda b, i: F.struct(F.lit(ord_).alias("section"), F.lit(name).alias("category"), i.alias("pos"), b.alias("b")))

    return F.flatten(F.array(*[one(o, n) for o, n in enumerate(names)]))


def sanitized(items: DataFrame, candidates: DataFrame, limits: Sequence[tuple[str, int]] = rules.DIGEST_SECTIONS, total: int = rules.DIGEST_TOTAL) -> DataFrame:
    """(category, place, title, url, source, summary, importance, restored) of a digest.

    items: (section, category, pos, url, summary, importance) of the answer; candidates:
    (seq, url, title, source, category, summary, review_status, low_priority).  An item
    counts if a candidate of its URL and category exists and a summary is there; a URL
    counts once over all sections; importance is clamped to 1..10, 5 for low priority;
    sections are capped.  Accepted candidates left out come back, section by section,
    until there are ``total`` in all: at least one if any is left, as the total is looked
    at after each.
    """
    summary = F.coalesce(F.nullif(rx.trim(c("i_summary")), F.lit("")), F.nullif(c("summary"), F.lit("")))
    number = F.greatest(F.lit(1.0), F.least(F.lit(10.0), text.round_half_up(F.coalesce(F.nanvl(c("importance"), F.lit(5.0)), F.lit(5.0)), 0)))
    last = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("seq")))).where("__n = 1").drop("__n")
    given = items.select("section", c("category").alias("i_category"), "pos", rx.trim(c("url")).alias("i_url"), c("summary").alias("i_summary"), "importance")
    found = given.join(last, (c("i_url") == c("url")) & (c("i_category") == c("category"))).withColumn("text", summary).where("text is not null")
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("section", "pos"))).where("__n = 1")
    caps = F.create_map(*[F.lit(x) for kv in limits for x in kv])
    order = {n: i for i, (n, _) in enumerate(limits)}
    kept = found.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("pos"))).where(c("place") <= F.element_at(caps, c("category")))
    score = F.when(F.coalesce(c("low_priority"), F.lit(False)), F.least(F.lit(5.0), number)).otherwise(number)
    kept = kept.select("section", "category", c("place").cast("long").alias("place"), "title", "url", "source", c("text").alias("summary"), score.cast("int").alias("importance"), F.lit(False).alias("restored"))
    rank_of = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    left = candidates.where((c("review_status") == "accepted") & ~rx.blank(c("summary")) & c("category").isin(*order)).join(kept.select("url"), "url", "left_anti")
    left = left.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.element_at(rank_of, c("category")), "seq"))).where("__n = 1")
    n_kept = kept.agg(F.count("*").alias("n_kept"))
    best = left.withColumn("section", F.element_at(rank_of, c("category"))).orderBy("section", "seq").limit(total)
    back = best.withColumn("__i", F.row_number().over(Window.orderBy("section", "seq"))).crossJoin(F.broadcast(n_kept)).where(c("__i") <= F.greatest(F.lit(1), F.lit(total) - c("n_kept")))  # one row
    place = F.row_number().over(Window.partitionBy("section").orderBy("seq")) + 1000
    back = back.select("section", "category", place.cast("long").alias("place"), "title", "url", "source", rx.trim(c("summary")).alias("summary"), F.lit(5).alias("importance"), F.lit(True).alias("restored"))
    both = kept.unionByName(back)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("place")).cast("long")).drop("section")


def backfilled(rows: DataFrame, answers: DataFrame, key: str, field: str) -> DataFrame:
    """rows with ``field`` from the first answer of their key (pos), where there is one."""
    first = answers.groupBy(c(key).alias("__k")).agg(F.min_by(field, "pos").alias("__v"))
    return rows.join(first, c(key) == c("__k"), "left").withColumn(field, F.coalesce("__v", field)).drop("__k", "__v")


def review_payload(rows: DataFrame) -> DataFrame:
    """(batch, prompt): nine fields of each row as JSON, absent ones empty, an array for each batch."""
    text_of = lambda n: F.coalesce(c(n).cast("string"), F.lit("")).alias(n)
    item = F.struct(text_of("url"), text_of("title"), F.substring(F.coalesce(c("excerpt"), F.lit("")), 1, 500).alias("excerpt"), text_of("source"), text_of("category"), text_of("published_at"), text_of("content_type"), text_of("document_type"), text_of("meta"))
    return rows.groupBy("batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda s: s["item"])).alias("prompt"))


def digest_payload(rows: DataFrame, order: Sequence[Column], excerpt: int = 200) -> DataFrame:
    numbered = rows.withColumn("number", F.row_number().over(Window.orderBy(*order)))
    return numbered.select("number", "title", "url", "source", "category", F.substring(F.coalesce("excerpt", F.lit("")), 1, excerpt).alias("excerpt"), F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("published_at"))


def highlights(briefs: DataFrame, k: int = 5) -> DataFrame:
    """The k most important briefs of all sections, ties in section order."""
    ranks = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(rules.DIGEST_SECTIONS) for x in (n, i)])
    return briefs.orderBy(F.desc("importance"), F.element_at(ranks, c("category")), "place").limit(k)


def for_raw(briefs: DataFrame, texts: DataFrame, displayed: DataFrame, empty: str) -> tuple[DataFrame, DataFrame]:
    """(briefs, texts): briefs of displayed URLs; if none is left the report's texts (one row) say ``empty``."""
    kept = briefs.join(displayed.select("url").distinct(), "url", "left_semi")
    n = kept.agg(F.count("*").alias("__n"))
    blank = lambda name: F.when(c("__n") > 0, c(name)).otherwise(F.lit(empty)).alias(name)
    named = ("hero_headline", "daily_overview")
    out = texts.crossJoin(F.broadcast(n)).select(*[blank(x) if x in named else c(x) for x in texts.columns])  # one row
    return kept.select(*briefs.columns), out


def research_meta() -> Column:
    """Journal, day and numbers of a paper, as far as they are there, escaped and joined."""
    some = lambda x: F.nullif(x, F.lit(""))
    day = F.date_format("published_at", "yyyy-MM-dd")
    parts = [some(c("journal")), day, F.concat(F.lit("PMID "), some(c("pmid"))), F.concat(F.lit("DOI "), some(c("doi")))]
    return F.concat_ws(" · ", *[text.escape_html(x) for x in parts])


def column_counts(articles: DataFrame) -> DataFrame:
    """One row: guidelines, surgery, international, china, from rows with category and their source's s_subcategory and s_lang."""
    china = F.coalesce(c("s_subcategory") == "china-obgyn", F.lit(False)) | F.coalesce(c("s_lang") == "zh", F.lit(False))
    other = c("category") == "politics"
    return articles.agg(F.count_if(c("category") == "tech").alias("guidelines"), F.count_if(c("category") == "finance").alias("surgery"), F.count_if(other & ~china).alias("international"), F.count_if(other & china).alias("china"))


def completeness(articles: DataFrame, key: str = "source_id", least: int = 30) -> DataFrame:
    """(source, total, dated, with_excerpt, typed, all_dated): what rows of each source lack."""
    return articles.groupBy(key).agg(F.count("*").alias("total"), F.count("published_at").alias("dated"), F.count_if(F.char_length(rx.trim(c("excerpt"))) >= least).alias("with_excerpt"), F.count("content_type").alias("typed"), (F.count("published_at") == F.count("*")).alias("all_dated"))
