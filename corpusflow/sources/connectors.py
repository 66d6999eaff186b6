"""Connectors: payload tables to articles, composed to the rows that a run takes in.

Each takes payloads of its sources and returns (source_id, title, url, excerpt, published_at,
category, meta, document_type, content_type, content_type_evidence, pos).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, rx, text
from . import citations, feeds, html, payloads

c = F.col
COLUMNS = {
    "source_id": "string", "title": "string", "url": "string", "excerpt": "string", "published_at": "timestamp", "category": "string", "meta": "string",
    "document_type": "string", "content_type": "string", "content_type_evidence": "string", "pos": "int",
}


def as_articles(rows: DataFrame) -> DataFrame:
    """rows with exactly the columns of an article; absent ones are null."""
    return rows.select(*[(c(k) if k in rows.columns else F.lit(None)).cast(t).alias(k) for k, t in COLUMNS.items()])


def _first(rows: DataFrame, keys: list[str], order: str, most: int = 1) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(c("__n") <= most).drop("__n")


def current_issue(pages: DataFrame) -> DataFrame:
    """A journal's current issue: title and DOI of each article, no more."""
    rows = html.page_rows(pages, "current_issue")
    excerpt = F.concat_ws(" · ", F.nullif("section", F.lit("")), F.concat(F.lit("DOI: "), c("doi")))
    return as_articles(rows.withColumn("excerpt", excerpt).withColumn("category", c("s_category")).withColumn("content_type", F.lit("metadata_only")))


def notices(pages: DataFrame, most: int = 8) -> DataFrame:
    """Notices with a route and a date, the first of each URL, ``most`` a page."""
    rows = html.page_rows(pages, "notices").withColumn("r", html.notice_route(c("title"))).where("r is not null and published_at is not null")
    rows = _first(_first(rows, ["page", "url"], "pos"), ["page"], "pos", most)
    return as_articles(rows.select("*", "r.*").withColumn("content_type_evidence", F.lit("declared")))


def contents(pages: DataFrame, most: int = 8) -> DataFrame:
    """A table of contents' rows of professional sections, ``most`` a page; DOI and authors as meta."""
    rows = html.page_rows(pages, "contents").where("title <> ''").withColumn("r", html.section_route(c("section"), c("title"))).where("r is not null")
    rows = _first(rows, ["page"], "pos", most).withColumn("excerpt", F.nullif("excerpt", F.lit("")))
    meta = F.nullif(F.concat_ws(" · ", F.nullif("doi", F.lit("")), F.nullif("authors", F.lit(""))), F.lit(""))
    return as_articles(rows.select("*", "r.*").withColumn("meta", meta).withColumn("content_type_evidence", F.lit("declared")))


def trending(pages: DataFrame, most: int = 25) -> DataFrame:
    """Ranked repositories, without a date, so that a stable sort keeps their order."""
    rows = html.page_rows(pages, "trending").where(c("pos") < most)
    return as_articles(rows.withColumn("meta", c("authors")).withColumn("published_at", F.lit(None)).withColumn("category", F.lit("tech")))


def sectioned_feed(feeds_: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One feed that several sources share, each with its class of items; kinds: source -> guideline or surgery, else research."""
    rows = feeds.items(feeds_)
    kind = feeds.exclusive(c("section"), c("title"), rules.FEED_GUIDELINE, rules.FEED_SURGERY)
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rows = rows.withColumn("__k", kind).where(c("__k") == F.coalesce(F.element_at(table, c("source_id")), F.lit("research")))
    rows = rows.withColumn("title", rx.trim(c("title"))).withColumn("url", rx.trim(c("link"))).where("title <> '' and url <> ''")
    excerpt = F.substring(text.strip_tags(F.coalesce("description", "content", F.lit("")), " "), 1, 1000)
    own = F.nullif(F.lower(rx.trim(c("section"))), F.lit(""))
    return as_articles(
        rows.withColumn("excerpt", excerpt).withColumn("published_at", dates.parsed(c("date"))).withColumn("document_type", F.when(c("__k") == "guideline", "guideline").otherwise("video"))
        .withColumn("content_type", F.coalesce(own, F.when(c("__k") == "surgery", "video article").otherwise("guideline")))
    )


def is_challenge(page: Column) -> Column:
    """A page that asks whether the reader is a person, in place of a feed."""
    head = F.lower(F.substring(page, 1, 500))
    return rx.contains_any(head, rules.CHALLENGE) | (head.startswith("<!doctype html") & head.contains("cloudflare"))


def discussion_feed(feeds_: DataFrame, most: int = 25) -> DataFrame:
    """(source_id, payload, fallback): the first feed, or the second where it is missing or a challenge; titles off topic go before the limit."""
    used = F.when(c("payload").isNull() | is_challenge(c("payload")) | ~c("payload").rlike("(?is)<(rss|feed)\\b"), c("fallback")).otherwise(c("payload"))
    rows = feeds.items(feeds_.select("source_id", used.alias("payload")))
    rows = rows.where("title <> '' and link <> ''").where(~rx.matches(c("title"), rules.OFF_TOPIC))
    rows = _first(rows, ["source_id"], "pos", most)
    excerpt = F.substring(text.strip_tags(F.coalesce("description", "content", F.lit(""))), 1, 300)
    return as_articles(rows.withColumn("title", rx.trim(c("title"))).withColumn("url", rx.trim(c("link"))).withColumn("excerpt", excerpt).withColumn("published_at", dates.parsed(c("date"))).withColumn("category", F.lit("tech")))


def _meta(*parts: str) -> Column:
    return F.concat_ws(" · ", *[F.nullif(c(p), F.lit("")) for p in parts])


def professional_papers(papers: DataFrame, works: DataFrame, issn: str, source_id: str) -> DataFrame:
    """Papers whose publication type is allowed as articles; DOI and date filled from works of equal title."""
    from ..operators import policy

    kinds = {k: "|".join(v) for k, v in rules.PUBLICATION_ROUTES.items()}
    types = F.transform("publication_types", lambda t: F.lower(rx.trim(t)))
    rows = papers.withColumn("__r", F.split(policy.allowed_publication_type(types, kinds, rules.PUBLICATION_EXCLUDED), r"\|")).where("__r is not null")
    rows = citations.supplemented(rows, works, issn)
    kind = F.get(c("__r"), F.lit(0))
    return as_articles(
        rows.withColumn("source_id", F.lit(source_id)).withColumn("excerpt", c("abstract")).withColumn("category", F.get(c("__r"), F.lit(1))).withColumn("content_type", kind)
        .withColumn("document_type", F.when(kind == "video_article", "video").otherwise("news")).withColumn("content_type_evidence", F.lit("declared")).withColumn("meta", _meta("journal", "pmid", "doi"))
    )


def _of_institution(rows: DataFrame, works: DataFrame, source_id: str, kind: str, by_title_key: bool) -> DataFrame:
    rows = citations.supplemented(rows, works, rules.INSTITUTION_ISSN, by_title_key)
    return as_articles(
        rows.withColumn("source_id", F.lit(source_id)).withColumn("url", F.coalesce(F.concat(F.lit("https://doi.org/"), c("doi")), c("url"))).withColumn("excerpt", c("abstract")).withColumn("category", F.lit("politics"))
        .withColumn("document_type", F.lit(kind)).withColumn("content_type", F.lit(kind)).withColumn("content_type_evidence", F.lit("metadata")).withColumn("meta", _meta("journal", "pmid", "doi"))
    )


def institutional_guidance(papers: DataFrame, works: DataFrame, source_id: str = "figo-guidance") -> DataFrame:
    return _of_institution(papers.where(citations.institutional()), works, source_id, "guideline", True)


def society_papers(papers: DataFrame, works: DataFrame, source_id: str = "figo-society-pubmed") -> DataFrame:
    return _of_institution(papers.where(citations.society()), works, source_id, "policy", False)


def guidelines(papers: DataFrame, source_id: str, category: str, now: dt.datetime, hours: int = 168) -> DataFrame:
    return as_articles(citations.guideline_rows(papers, source_id, category, now, hours))


def voted(payload: DataFrame, source_id: str, keywords: tuple[str, ...] = (), limit: int = 30) -> DataFrame:
    return as_articles(payloads.voted_papers(payload, source_id, keywords, limit))


def discussed(payloads_: DataFrame, source_id: str, limit: int = 25) -> DataFrame:
    return as_articles(payloads.discussed_topics(payloads_, source_id, rules.OFF_TOPIC, limit))


def attention(payload: DataFrame, source_id: str, limit: int = 20) -> DataFrame:
    return as_articles(payloads.attention_entries(payload, source_id, limit))


def rss(feeds_: DataFrame) -> DataFrame:
    """Feeds without a connector of their own, four of them with a smaller limit."""
    return as_articles(feeds.articles(feeds_, rules.FEED_LIMITS))
