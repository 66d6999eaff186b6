"""Citation XML (one article for each row) to papers, and the query that asks for them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, rx, text
from ..operators.topics import Topic

c = F.col
_DATE = "struct<Year:string,Month:string,Day:string>"
_TEXT = "struct<_VALUE:string,_Label:string>"
SCHEMA = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,"
    f"Abstract:struct<AbstractText:array<{_TEXT}>>,"
    "AuthorList:struct<Author:array<struct<CollectiveName:string,ForeName:string,LastName:string>>>,"
    "PublicationTypeList:struct<PublicationType:array<string>>,"
    f"ArticleDate:{_DATE},Journal:struct<Title:string,JournalIssue:struct<PubDate:{_DATE}>>,"
    "ELocationID:array<struct<_VALUE:string,_EIdType:string>>>>,"
    "PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>,"
    "ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def _date(d: Column) -> Column:
    return dates.from_block(d["Year"], d["Month"], d["Day"])


SET = f"PubmedArticle array<struct<{SCHEMA.replace('MedlineCitation struct', 'MedlineCitation:struct', 1).replace(',PubmedData struct', ',PubmedData:struct', 1)}>>"
_INLINE = r"(?i)</?(?:i|b|em|strong|sup|sub|u)>"  # marks that would split a text


def papers(articles: DataFrame, now: dt.datetime, column: str = "xml") -> DataFrame:
    """Papers of rows that hold an article element each; see papers_of() for what becomes of an article."""
    rows = articles.withColumn("__p", F.from_xml(F.regexp_replace(c(column), _INLINE, ""), SCHEMA, {"attributePrefix": "_", "valueTag": "_VALUE"}))
    return _papers(rows.select("*", c("__p.MedlineCitation").alias("m"), c("__p.PubmedData").alias("d")).drop("__p", column), [x for x in articles.columns if x != column], now)


def papers_of(payloads: DataFrame, now: dt.datetime, column: str = "payload") -> DataFrame:
    """Papers, with number and title, of payloads that hold a set of articles each, with pos; labelled abstract parts on lines
    of their own; DOI from the ids, else from the article.

    A set is parsed at once, since making a parser costs more than parsing an article; a payload
    that is no XML has no papers.
    """
    rest = [x for x in payloads.columns if x != column]
    parsed = F.from_xml(F.regexp_replace(c(column), _INLINE, ""), SET, {"attributePrefix": "_", "valueTag": "_VALUE"})["PubmedArticle"]
    rows = payloads.select(*rest, F.posexplode(parsed).alias("pos", "p")).select(*rest, "pos", c("p.MedlineCitation").alias("m"), c("p.PubmedData").alias("d"))
    return _papers(rows, [*rest, "pos"], now)


def _papers(rows: DataFrame, keep: list[str], now: dt.datetime) -> DataFrame:
    a = c("m.Article")
    parts = F.transform(a["Abstract"]["AbstractText"], lambda x: F.when(F.coalesce(x["_Label"], F.lit("")) != "", F.concat(x["_Label"], F.lit(": "), rx.trim(x["_VALUE"]))).otherwise(rx.trim(x["_VALUE"])))
    names = F.transform(a["AuthorList"]["Author"], lambda x: F.coalesce(x["CollectiveName"], F.concat_ws(" ", x["ForeName"], x["LastName"])))
    pick = lambda items, key, value: F.get(F.filter(items, lambda x: x[key] == value), F.lit(0))
    published = F.coalesce(_date(a["ArticleDate"]), _date(a["Journal"]["JournalIssue"]["PubDate"]))
    doi = F.coalesce(pick(c("d.ArticleIdList.ArticleId"), "_IdType", "doi")["_VALUE"], pick(a["ELocationID"], "_EIdType", "doi")["_VALUE"])
    pmid = rx.trim(c("m.PMID"))
    out = rows.select(
        *keep, F.concat(F.lit("pmid:"), pmid).alias("id"), pmid.alias("pmid"), text.normalize_doi(doi).alias("doi"), rx.trim(a["ArticleTitle"]).alias("title"),
        F.coalesce(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), F.lit("")).alias("abstract"), F.coalesce(a["Journal"]["Title"], F.lit("PubMed")).alias("journal"),
        F.filter(names, lambda x: x != "").alias("authors"), F.filter(F.transform(a["PublicationTypeList"]["PublicationType"], rx.trim), lambda x: x != "").alias("publication_types"),
        published.alias("published_at"), F.coalesce(_date(pick(c("d.History.PubMedPubDate"), "_PubStatus", "pubmed")), published, F.lit(now)).alias("activity_at"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"), F.array(F.lit("pubmed")).alias("source_kinds"),
    )
    return out.where((F.coalesce("pmid", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def query(topics: Sequence[Topic], domain: Sequence[str], start: dt.date, end: dt.date) -> str:
    """The search that the topics stand for: distinct keywords of enabled ones, the domain, the days."""
    # each keyword once, in the order given
    field = lambda ws: " OR ".join(f"{w}[Title/Abstract]" for w in dict.fromkeys(w.strip() for w in ws if w.strip()))
    words, anchor = field(w for t in topics if t.enabled for w in t.include), field(domain)
    if not words or not anchor:
        raise ValueError("topics need keywords, and so does the domain")
    return bounded_query(f"(({words})) AND ({anchor})", start, end)


def bounded_query(query_: str, start: dt.date, end: dt.date) -> str:
    """A search of one's own, of the days only."""
    return f"{query_} AND {start:%Y/%m/%d}:{end:%Y/%m/%d}[EDAT]"


def guideline_rows(papers_: DataFrame, source_id: str, category: str, now: dt.datetime, hours: int = 168) -> DataFrame:
    """Papers of the last hours as articles; the excerpt joins abstract, journal, types and DOI, 1500 characters at most."""
    joined = F.concat_ws(" · ", *[F.nullif(x, F.lit("")) for x in (c("abstract"), c("journal"), F.array_join("publication_types", ", "), F.concat(F.lit("DOI: "), c("doi")))])
    recent = papers_.where(c("activity_at").between(F.lit(now - dt.timedelta(hours=hours)), F.lit(now)))
    return recent.select(F.lit(source_id).alias("source_id"), "title", "url", F.substring(joined, 1, 1500).alias("excerpt"), c("activity_at").alias("published_at"), F.lit(category).alias("category"))


_EMPTY = "array<string>"


def _any_type(pattern: str) -> Column:
    return F.exists(F.coalesce("publication_types", F.array().cast(_EMPTY)), lambda t: t.rlike(rx.java(pattern)))


def _any_author(pattern: str) -> Column:
    return F.exists(F.coalesce("authors", F.array().cast(_EMPTY)), lambda a: a.rlike(rx.java(pattern)))


def institutional() -> Column:
    """Formal papers of the institution's journal: not excluded, a formal title, and the institution among authors or near its organ in the abstract."""
    same = text.normalize_content_title(text.nfkc(c("journal"))) == text.normalize_content_title(F.lit(rules.INSTITUTION_JOURNAL))
    out = rx.matches(c("title"), rules.INSTITUTION_EXCLUDED) | _any_type(rules.INSTITUTION_EXCLUDED)
    evidence = _any_author(rules.INSTITUTION_AUTHOR) | rx.matches(c("abstract"), rules.INSTITUTION_ABSTRACT)
    return F.coalesce(same, F.lit(False)) & ~out & rx.matches(c("title"), rules.INSTITUTION_TITLE) & evidence


def society() -> Column:
    """The complement: neither formal nor excluded, with the society's terms and an affiliation."""
    any_of = lambda p: rx.matches(c("title"), p) | _any_type(p)
    belongs = _any_author(rules.SOCIETY_AFFILIATION) | rx.matches(c("abstract"), rules.SOCIETY_ABSTRACT)
    same = F.coalesce(F.lower(text.nfkc(c("journal"))) == rules.INSTITUTION_JOURNAL.lower(), F.lit(False))
    return same & ~any_of(rules.SOCIETY_FORMAL) & ~any_of(rules.SOCIETY_EXCLUDED) & rx.matches(F.concat_ws(" ", "title", "abstract"), rules.SOCIETY_TERMS) & belongs


def supplemented(papers_: DataFrame, works: DataFrame, issn: str, by_title_key: bool = True) -> DataFrame:
    """papers with DOI and date filled from works (pos, titles, issns, doi, published_at) of equal title in the journal.

    Only papers that lack one are joined; of several works the first counts.
    by_title_key compares normalised titles and ISSNs as they are, else trimmed lower-case titles and ISSNs without marks.
    """
    key = text.normalize_title if by_title_key else (lambda x: F.lower(rx.trim(x)))
    plain = lambda x: F.upper(F.regexp_replace(x, "(?i)[^0-9X]", ""))
    same = F.array_contains("issns", issn) if by_title_key else F.exists("issns", lambda x: plain(x) == plain(F.lit(issn)))
    own = works.where(F.coalesce(same, F.lit(False))).select("pos", F.explode("titles").alias("t"), c("doi").alias("w_doi"), c("published_at").alias("w_at"))
    first = own.groupBy(key(c("t")).alias("__t")).agg(F.min_by(F.struct("w_doi", "w_at"), "pos").alias("w"))
    lacking = c("doi").isNull() | c("published_at").isNull()
    joined = papers_.withColumn("__k", F.when(lacking, key(c("title")))).join(first, c("__k") == c("__t"), "left")
    return joined.withColumn("doi", F.coalesce("doi", text.normalize_doi(c("w.w_doi")))).withColumn("published_at", F.coalesce("published_at", c("w.w_at"))).drop("__k", "__t", "w")


def batches(ids: DataFrame, most: int = 200, size: int = 100) -> DataFrame:
    """(id, batch) of the first ids."""
    from ..operators.rank import batches as cut

    return cut(ids.orderBy("pos").limit(most), [c("pos")], size)


def search(ids: DataFrame, fetched: DataFrame, now: dt.datetime, most: int = 200, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """Papers of the first ids of a search, and one row of counters.

    ids: (pos, id); fetched: (batch, payload), the answers to batches of ``size`` ids; a batch
    without an answer is left out.  Papers without an abstract are counted and left out.
    """
    asked = batches(ids, most, size)
    rows = papers_of(fetched.join(asked.select("batch").distinct(), "batch", "left_semi"), now)
    known = rows.join(asked.select(c("id").alias("__id"), c("pos").alias("search_pos")), c("pmid") == c("__id")).drop("__id")
    has = F.coalesce("abstract", F.lit("")) != ""
    counted = asked.agg(F.count("*").alias("requested"), F.countDistinct("batch").alias("batches"))
    found = known.agg(F.count("*").alias("fetched"), F.count_if(~has).alias("missing_abstract"))
    return known.where(has), counted.crossJoin(F.broadcast(found))  # one row each
