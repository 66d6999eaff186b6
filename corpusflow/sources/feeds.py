"""RSS and Atom payloads to rows: XML is parsed by Spark's own reader functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rx, text

c = F.col
_ITEM = "title string, link string, guid string, description string, `content:encoded` string, pubDate string, updated string, `dc:date` string, `dc:creator` string, `dc:identifier` string, author string, `prism:doi` string, `prism:section` string"
RSS = f"channel struct<item array<struct<{', '.join(f'{k}:{v}' for k, v in (x.rsplit(' ', 1) for x in _ITEM.split(', ')))}>>>"
ATOM = "entry array<struct<title:string,id:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,published:string,updated:string,author:array<struct<name:string>>>>"


def items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(the payload's other columns, pos, title, link, guid, description, content, date, creator, doi, section): all items of all feeds.

    A payload that is no XML, or neither form, has no items.
    """
    rest = [x for x in payloads.columns if x != column]
    rss = F.from_xml(c(column), RSS, {"ignoreNamespace": "false", "mode": "PERMISSIVE"})
    atom = F.from_xml(c(column), ATOM, {"ignoreNamespace": "false", "mode": "PERMISSIVE"})
    out = "array<struct<title:string,link:string,guid:string,description:string,content:string,date:string,creator:string,doi:string,section:string>>"
    g = lambda i, *ns: F.coalesce(*[i[n] for n in ns])
    own = F.transform(rss["channel"]["item"], lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["guid"].alias("guid"), i["description"].alias("description"), i["content:encoded"].alias("content"), g(i, "pubDate", "dc:date", "updated").alias("date"), g(i, "dc:creator", "author").alias("creator"), g(i, "prism:doi", "dc:identifier").alias("doi"), i["prism:section"].alias("section")))
    href = lambda e: F.get(F.transform(F.array_sort(F.transform(e["link"], lambda x: F.struct((F.coalesce(x["_rel"], F.lit("alternate")) != "alternate").alias("k"), x["_href"].alias("h")))), lambda x: x["h"]), F.lit(0))
    theirs = F.transform(atom["entry"], lambda e: F.struct(e["title"].alias("title"), href(e).alias("link"), e["id"].alias("guid"), e["summary"].alias("description"), e["content"].alias("content"), g(e, "published", "updated").alias("date"), F.array_join(F.transform(e["author"], lambda a: a["name"]), "; ").alias("creator"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("section")))
    every = F.coalesce(own.cast(out), theirs.cast(out))
    return payloads.select(*rest, F.posexplode(every).alias("pos", "i")).select(*rest, "pos", "i.*")


def articles(payloads: DataFrame, limits: dict[str, int] | None = None, limit: int = 30) -> DataFrame:
    """Articles of feeds (source_id, category, payload): the first ``limit`` items (or the source's own limit) with title and link or guid."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else None
    most = F.coalesce(F.element_at(table, c("source_id")), F.lit(limit)) if limits else F.lit(limit)
    rows = items(payloads).where(c("pos") < most)
    title, url = rx.trim(c("title")), F.coalesce(F.nullif(rx.trim(c("link")), F.lit("")), rx.trim(c("guid")))
    excerpt = F.substring(text.strip_tags(F.coalesce(c("description"), c("content"))), 1, 300)
    out = rows.select("source_id", "category", "pos", title.alias("title"), url.alias("url"), F.nullif(excerpt, F.lit("")).alias("excerpt"), dates.parsed(c("date")).alias("published_at"), c("section").alias("content_type"))
    return out.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def diagnostics(payloads: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_id, items, http_403, zero_items, parse_failures); payloads may carry a status."""
    n = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    status = c("status") if "status" in payloads.columns else F.lit(200)
    broken = ~F.coalesce(c("payload"), F.lit("")).rlike("(?is)<(rss|feed|rdf:RDF)\\b.*>")
    out = payloads.withColumn("__s", status).join(n, "source_id", "left")
    items_ = F.coalesce("n", F.lit(0))
    return out.select("source_id", items_.alias("items"), (c("__s") == 403).cast("int").alias("http_403"), (items_ == 0).cast("int").alias("zero_items"), ((c("__s") == 200) & broken).cast("int").alias("parse_failures"))


def fallback(primary: Column, secondary: Column) -> Column:
    """The first payload, or the second where the first is missing or a challenge page."""
    return F.when(primary.rlike("(?is)<(rss|feed)\\b"), primary).otherwise(secondary)


def exclusive(section: Column, title: Column, guideline: str, surgery: str) -> Column:
    """guideline, surgery or research by the section, else the title; guideline first."""
    t = F.coalesce(F.nullif(rx.trim(section), F.lit("")), rx.trim(title), F.lit(""))
    return rx.first_match(t, (("guideline", guideline), ("surgery", surgery)), "research")


def journal_papers(payloads: DataFrame, start: dt.datetime, end: dt.datetime, routed: Column | None = None) -> DataFrame:
    """Papers of journal feeds (source_id, journal, payload), with reject_reason null where they count.

    Stages: missingIdentity, routedToGuidelineOrSurgery (``routed``), missingDate, outOfWindow, missingAbstract.
    """
    rows = items(payloads)
    at = dates.parsed(c("date"))
    plain = rx.trim(rx.replace(text.decode_entities(F.regexp_replace(F.coalesce("content", "description", F.lit("")), "<[^>]+>", " "), True), r"\s+", " "))
    title, url = rx.trim(c("title")), F.coalesce(rx.trim(c("link")), rx.trim(c("guid")))
    doi = text.normalize_doi(F.coalesce(*[rx.extract(c(n), r"(10\.\d{4,9}/[^\s<>\"]+)") for n in ("doi", "guid", "link", "content", "description", "title")]))
    authors = F.filter(F.transform(F.split(F.coalesce("creator", F.lit("")), r"\s*;\s*|\s+and\s+|\s*,\s+(?=[A-Z][a-z]+ [A-Z])"), rx.trim), lambda a: a != "")
    rows = rows.select("source_id", "journal", "pos", title.alias("title"), url.alias("url"), "section", at.alias("activity_at"), plain.alias("abstract"), doi.alias("doi"), authors.alias("authors"))
    away = F.lit(False) if routed is None else routed
    reason = (
        F.when((F.coalesce("title", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == ""), "missingIdentity").when(away, "routedToGuidelineOrSurgery").when(c("activity_at").isNull(), "missingDate")
        .when((c("activity_at") < F.lit(start)) | (c("activity_at") > F.lit(end)), "outOfWindow").when(F.char_length("abstract") < 20, "missingAbstract")
    )
    name = F.coalesce(F.concat(F.lit("doi:"), c("doi")), F.concat(F.lit("rss:"), c("source_id"), F.lit(":"), text.normalize_title(c("title"))))
    out = rows.withColumn("reject_reason", reason).withColumn("id", name).withColumn("published_at", c("activity_at"))
    return out.withColumn("publication_types", F.array().cast("array<string>")).withColumn("source_kinds", F.array(F.lit("journal-rss"))).withColumn("pmid", F.lit(None).cast("string"))


def rejected(papers: DataFrame) -> DataFrame:
    """(source_id, rejected): a map from reason to count."""
    n = papers.where("reject_reason is not null").groupBy("source_id", "reject_reason").agg(F.count("*").alias("n"))
    return n.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("reject_reason", "n"))).alias("rejected"))
