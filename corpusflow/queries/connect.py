"""Connectors composed to articles: pages, feeds and papers are made from the driver's tables and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text
from ..sources import citations, connectors, feeds, payloads, registry
from .common import NOW, NOW_SQL, quoted, sql_any, sql_fixed, sql_match

c = F.col
t = registry.table
_day = lambda name="published_at": F.date_format(name, "yyyy-MM-dd").alias("published")


def _pages(rows: DataFrame, key: str, item: Column, size: int, head: str = "", tail: str = "") -> DataFrame:
    """A page for each ``size`` rows: (source_id, html, s_url, s_category)."""
    made = rows.select(c(key).alias("k"), item.alias("x"), F.floor(c(key) / size).alias("n"))
    pages = made.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "").alias("xs"))
    return pages.select(F.concat(F.lit("p"), c("n")).alias("source_id"), F.concat(F.lit(f"<html><body>{head}"), c("xs"), F.lit(f"{tail}</body></html>")).alias("html"), F.lit("https://j.example.org/list").alias("s_url"), F.lit("tech").alias("s_category"))


def current_issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of an issue; some link to another host, some repeat the link before."""
    k = c("s_suppkey")
    href = F.when(k % 7 == 0, "https://else.example.org/x").otherwise(F.concat(F.lit("/art/"), k - F.when(k % 10 == 9, 1).otherwise(0)))
    item = F.concat(F.lit('<li><div><p><a href="'), href, F.lit('">'), c("s_name"), F.lit(' study</a></p></div><span><a href="https://doi.org/10.5/'), k, F.lit('%2Fx">doi</a></span></li>'))
    pages = _pages(t(spark, sf, "supplier"), "s_suppkey", item, 20, "<p>2023年, 第39卷 第5期 刊出日期：2023-05-15</p><ul>", "</ul>")
    return connectors.current_issue(pages).select("source_id", "title", "url", "excerpt", _day(), "category", "content_type")


NOTICES = ("子宫内膜异位症诊治指南", "宫颈癌专家共识解读", "手术并发症防治要点", "学术会议通知", "妇科指南解读", "核心推荐意见", "招生培训指南", "诊疗规范更新")


def notice_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Notices of several kinds, some without a date, some linked twice; eight a page."""
    k = c("c_custkey")
    title = F.get(F.array(*map(F.lit, NOTICES)), (k % len(NOTICES)).cast("int"))
    date = F.when(k % 5 < 2, F.concat(F.lit("<p>"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")), "yyyy年M月d日"), F.lit("</p>"))).when(k % 5 < 4, F.concat(F.lit('<time datetime="2024-3-'), k % 28 + 1, F.lit('"></time>'))).otherwise("")
    item = F.concat(F.lit('<li><a href="/info/'), k - F.when(k % 9 == 8, 8).otherwise(0), F.lit('">'), title, F.lit("</a>"), date, F.lit("</li>"))
    return connectors.notices(_pages(t(spark, sf, "customer"), "c_custkey", item, 30, "<ul>", "</ul>")).select("source_id", "title", "url", _day(), "category", "content_type", "document_type")


SECTIONS = ("述评", "专家共识", "论著", "指南解读", "指南", "病例报告", "共识解读")


def contents_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A journal's table of contents, some articles with a date of their own."""
    k = c("c_custkey")
    section = F.get(F.array(*map(F.lit, SECTIONS)), (k % len(SECTIONS)).cast("int"))
    own = F.when(k % 3 == 0, '<time datetime="2024-04-02"></time>').when(k % 3 == 1, '<span class="date">soon</span>').otherwise("")
    item = F.concat(F.lit('<article><span class="section">'), section, F.lit('</span><h3><a href="/CN/'), k, F.lit('">'), c("c_name"), F.when(k % 11 == 0, " 回顾性").otherwise(""), F.lit('</a></h3><p class="authors">A; B</p><p class="doi">DOI: 10.1234/x'), k, F.lit("</p>"), F.when(k % 2 == 0, '<p class="abstract">Some text.</p>').otherwise(""), own, F.lit("</article>"))
    pages = _pages(t(spark, sf, "customer"), "c_custkey", item, 25, '<div class="issue-date">出版 2024-05-01</div>')
    return connectors.contents(pages).select("source_id", "title", "url", "excerpt", "meta", _day(), "category", "content_type", "document_type")


def trending_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey")
    item = F.concat(F.lit('<article class="Box-row"><h2><a href="/own/r'), k, F.lit('">name</a></h2><p>'), text.escape_html(c("p_name")), F.lit('</p><div class="f6">'), F.when(k % 3 > 0, F.concat(F.lit('<span itemprop="programmingLanguage">'), c("p_brand"), F.lit("</span>"))).otherwise(""), F.lit('<a href="/own/r/stargazers"> 1,'), k, F.lit(' </a><a href="/own/r/forks">'), c("p_size"), F.lit("</a><span>9 stars today</span></div></article>"))
    return connectors.trending(_pages(t(spark, sf, "part"), "p_partkey", item, 40)).select("source_id", "pos", "title", "url", "excerpt", "meta", F.col("published_at").isNull().alias("undated"))


def _feed(spark: SparkSession, sf: str) -> Column:
    e = text.escape_html
    k = c("c_custkey")
    section = F.when(k % 5 == 0, "Guideline").when(k % 5 == 1, " Video Article ").when(k % 5 == 2, "Original Article").otherwise("")
    title = F.concat(F.when(k % 7 == 0, "Robotic repair ").when(k % 7 == 1, "Position statement ").when(k % 7 == 2, "找对象 ").otherwise("Notes "), c("c_name"))
    return F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), F.when(k % 13 > 0, F.concat(F.lit("https://e.org/"), k)).otherwise(""), F.lit("</link><pubDate>"), F.date_format(F.timestamp_seconds(k * 3600 + 1700000000), "'Mon, 'd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate><prism:section>"), section, F.lit("</prism:section><description>"), e(F.concat(F.lit("<p>About "), c("c_mktsegment"), F.lit("</p>"))), F.lit("</description></item>"))


_RSS = '<rss version="2.0" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/"><channel><title>t</title>'


def _feeds(spark: SparkSession, sf: str, size: int) -> DataFrame:
    rows = t(spark, sf, "customer").select(F.floor(c("c_custkey") / size).alias("n"), F.struct(c("c_custkey").alias("k"), _feed(spark, sf).alias("x")).alias("s"))
    one = rows.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias("xs"))
    return one.select("n", F.concat(F.lit(_RSS), c("xs"), F.lit("</channel></rss>")).alias("payload"))


def sectioned_feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds read by three sources each, which share their items out."""
    kinds = {"guidelines": "guideline", "surgery": "surgery"}
    rows = _feeds(spark, sf, 50).select(F.explode(F.array(*map(F.lit, ("guidelines", "surgery", "papers")))).alias("source_id"), F.lit("tech").alias("category"), "payload")
    return connectors.sectioned_feed(rows, kinds).select("source_id", "title", "url", "excerpt", F.unix_timestamp("published_at").alias("published"), "document_type", "content_type")


def discussion_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of which some are challenge pages or missing, and a second for each; off-topic titles don't use up the limit."""
    first = _feeds(spark, sf, 60)
    second = first.select((c("n") - 1).alias("n"), c("payload").alias("fallback"))
    page = F.when(c("n") % 3 == 0, "<!DOCTYPE html><title>Just a moment...</title>").when(c("n") % 3 == 1, c("payload"))
    rows = first.join(second, "n").select(F.concat(F.lit("d"), c("n")).alias("source_id"), page.alias("payload"), "fallback")
    return connectors.discussion_feed(rows).select("source_id", "title", "url", "excerpt", F.unix_timestamp("published_at").alias("published"))


TYPES = ("Editorial", "Narrative Review", "Video Article", "Journal Article", "Randomized Controlled Trial", "technical note", "Clinical Review")


def _papers(spark: SparkSession, sf: str, journal: Column, title: Column, abstract: Column, authors: Column) -> DataFrame:
    """Parts as papers: some lack DOI or date."""
    k = c("p_partkey")
    kinds = F.array(*map(F.lit, TYPES))
    types = F.array(F.get(kinds, (k % 7).cast("int")), F.get(kinds, (c("p_size") % 5).cast("int")))
    return t(spark, sf, "part").select(
        k.alias("seq"), F.concat(F.lit("pmid:"), k).alias("id"), k.cast("string").alias("pmid"), F.when(k % 3 > 0, F.concat(F.lit("10.7/"), k)).alias("doi"), title.alias("title"), abstract.alias("abstract"), journal.alias("journal"),
        authors.alias("authors"), types.alias("publication_types"), F.when(k % 4 > 0, F.timestamp_seconds(F.lit(1690000000) + k * 86400)).alias("published_at"), (F.lit(NOW).cast("timestamp") - F.make_interval(hours=(k % 400).cast("int"))).alias("activity_at"),
        F.concat(F.lit("https://pubmed.example.org/"), k).alias("url"), F.array(F.lit("pubmed")).alias("source_kinds"),
    )


def _works(spark: SparkSession, sf: str, title: Column, issn: str) -> DataFrame:
    """Works of parts, of some two, some of another journal."""
    k = c("p_partkey")
    rows = t(spark, sf, "part").select(k, title.alias("title"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).where((c("copy") == 0) | (k % 5 == 0))
    return rows.select((k * 2 + c("copy")).alias("pos"), F.array(F.lit("Other"), F.upper("title")).alias("titles"), F.array(F.when(k % 6 > 0, issn).otherwise("0000-0000"), F.lit("1111-1111")).alias("issns"), F.concat(F.lit("https://doi.org/10.8/W"), k, F.lit("-"), c("copy")).alias("doi"), F.timestamp_seconds(F.lit(1600000000) + k * 86400).alias("published_at"))


_UNIQUE = lambda: F.concat(c("p_name"), F.lit(" "), c("p_partkey"))


def professional_paper_rows(spark: SparkSession, sf: str) -> DataFrame:
    papers = _papers(spark, sf, c("p_brand"), _UNIQUE(), c("p_type"), F.array(F.lit("A")))
    out = connectors.professional_papers(papers, _works(spark, sf, _UNIQUE(), "1553-4669"), "1553-4669", "jmig-articles-in-press")
    return out.select("title", "url", "excerpt", _day(), "category", "document_type", "content_type", "meta")


FORMAL = ("FIGO committee guideline on", "FIGO consensus statement about", "A cohort study of FIGO guidance", "FIGO best practice advice for", "FIGO call to action on", "Safety policy perspective on")
AUTHORS = ("FIGO Committee on Safety", "J Doe", "International Federation of Gynecology and Obstetrics", "FIGO")
ABSTRACTS = ("Written by FIGO with its working group in mind.", "No evidence.", "Quality of care.", "FIGO and, far away, others.")


def _institution_papers(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey")
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    journal = F.when(k % 8 == 0, "Another Journal").when(k % 8 == 1, "Int J  Gynaecol. Obstet").otherwise(rules.INSTITUTION_JOURNAL)
    papers = _papers(spark, sf, journal, F.concat(of(FORMAL), F.lit(" "), _UNIQUE()), F.get(F.array(*map(F.lit, ABSTRACTS)), (F.floor(k / 3) % len(ABSTRACTS)).cast("int")), F.array(F.lit("X"), F.get(F.array(*map(F.lit, AUTHORS)), (F.floor(k / 5) % len(AUTHORS)).cast("int"))))
    return papers.withColumn("publication_types", F.array(F.when(c("seq") % 17 == 0, "Letter").otherwise("Journal Article")))


def _institution_works(spark: SparkSession, sf: str) -> DataFrame:
    of = F.get(F.array(*map(F.lit, FORMAL)), (c("p_partkey") % len(FORMAL)).cast("int"))
    return _works(spark, sf, F.concat(of, F.lit(" "), _UNIQUE()), rules.INSTITUTION_ISSN)


def institution_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = connectors.institutional_guidance(_institution_papers(spark, sf), _institution_works(spark, sf))
    return out.select("source_id", "title", "url", "excerpt", _day(), "content_type", "meta")


def society_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = connectors.society_papers(_institution_papers(spark, sf), _institution_works(spark, sf).withColumn("issns", F.transform("issns", lambda x: F.replace(x, F.lit("-"), F.lit(" ")))))
    return out.select("source_id", "title", "url", "excerpt", _day(), "content_type", "meta")


def guideline_article_rows(spark: SparkSession, sf: str) -> DataFrame:
    papers = _papers(spark, sf, c("p_brand"), _UNIQUE(), F.when(c("p_partkey") % 6 > 0, F.repeat(F.concat(c("p_type"), F.lit(" ")), c("p_size"))).otherwise(""), F.array(F.lit("A")))
    return connectors.guidelines(papers, "asrm", "tech", NOW, 168).select("source_id", "title", "url", "excerpt", F.unix_timestamp("published_at").alias("published"), "category")


def voted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One payload of 200 parts as papers with votes; keywords in title, summary or keyword list."""
    k = c("p_partkey")
    paper = F.struct(F.struct(F.concat(F.lit("h"), k).alias("id"), c("p_name").alias("title"), F.concat(F.lit("On "), c("p_type")).alias("summary"), F.array(c("p_brand")).alias("ai_keywords"), F.when(k % 9 > 0, c("p_size") * 10).alias("upvotes"), F.lit("2024-01-05T00:00:00Z").alias("publishedAt")).alias("paper"))
    one = t(spark, sf, "part").where(k <= 200).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), paper.alias("p")))), lambda s: s["p"])).alias("payload"))
    return connectors.voted(one, "hf", ("STEEL", "brand#1", "red")).select("title", "url", "excerpt", "meta", _day())


def discussed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A payload for each nation: its customers as topics, some off topic, some without replies, some URLs in several."""
    k = c("c_custkey")
    topic = F.struct(F.concat(F.when(k % 10 == 0, "相亲 ").otherwise("Ask "), c("c_name")).alias("title"), F.concat(F.lit("https://v.org/"), k % 700).alias("url"), F.when(k % 4 > 0, k * 7 % 601).alias("replies"), (k + 1700000000).alias("created"), F.struct(F.when(c("c_nationkey") % 2 == 0, c("c_mktsegment")).alias("title"), F.lit("node").alias("name")).alias("node"))
    lists = t(spark, sf, "customer").groupBy(c("c_nationkey").alias("ord")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), topic.alias("p")))), lambda s: s["p"])).alias("payload"))
    return connectors.discussed(lists, "v2").select("title", "url", "excerpt", F.unix_timestamp("published_at").alias("published"))


def attention_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One payload of customers as entries in several languages."""
    k = c("c_custkey")
    langs = F.when(k % 3 == 0, F.array(F.lit("ja"))).when(k % 3 == 1, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array().cast("array<string>"))
    entry = F.struct(k.cast("string").alias("tweetId"), c("c_name").alias("title"), F.concat(F.lit(" a \n b "), c("c_mktsegment")).alias("previewText"), F.when(k % 2 == 0, "zxx").otherwise("de").alias("lang"), langs.alias("langsDetected"), (k * 1000).alias("viewCount"), k.alias("likeCount"), (k % 5).alias("retweetCount"), F.lit("2024-01-06T00:00:00Z").alias("tweetCreatedAt"), F.struct(F.lit("h").alias("handle"), (k * 30000).alias("followers")).alias("author"))
    one = t(spark, sf, "customer").where(k <= 90).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("p")))), lambda s: s["p"]).alias("entries"))).alias("payload"))
    return connectors.attention(one, "avc").select("title", "url", "excerpt", "meta", _day())


def market_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of figures by nation, some missing parts, some without data."""
    n = c("n_nationkey")
    data = F.struct((n * 100).cast("int").alias("active_cryptocurrencies"), F.when(n % 3 > 0, F.struct((n * 1e9).alias("usd"))).alias("total_market_cap"), F.struct((n * 1e8).alias("usd")).alias("total_volume"), F.struct((n * 2.0).alias("btc"), F.when(n % 2 == 0, n * 1.0).alias("eth")).alias("market_cap_percentage"))
    rows = t(spark, sf, "nation").select(F.when(n % 5 == 0, "{}").when(n % 5 == 1, "no json").otherwise(F.to_json(F.struct(data.alias("data")))).alias("payload"))
    return payloads.global_stats(rows).select("market_cap", "volume", "change_24h", "btc_share", "eth_share", "active")


def mood_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = c("n_nationkey")
    names = F.array(*map(F.lit, (*rules.FEAR_GREED_LABELS, "Odd")))
    item = F.struct(F.when(n % 7 > 0, (n * 4).cast("string")).otherwise("").alias("value"), F.when(n % 4 > 0, F.get(names, n % 6)).alias("value_classification"), (n + 1700000000).cast("string").alias("timestamp"))
    from ..operators import policy

    rows = t(spark, sf, "nation").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload"))
    return payloads.fear_greed(rows).select("value", "class", "class_local", F.unix_timestamp("ts").alias("at"), policy.fear_greed_tone(c("value")).alias("tone"))


def _xml(k: Column, abstract: Column) -> Column:
    return F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>Title "), k, F.lit("</ArticleTitle>"), abstract, F.lit("</Article></MedlineCitation></PubmedArticle>"))


def _search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A search over parts: 250 ids, of which batches of 100 are asked for; the answer to the second is missing at part 150 and on."""
    k = c("p_partkey")
    rows = t(spark, sf, "part").where(k <= 250)
    ids = rows.select(k.alias("pos"), k.cast("string").alias("id"))
    abstract = F.when(k % 6 > 0, F.concat(F.lit("<Abstract><AbstractText>About "), c("p_type"), F.lit("</AbstractText></Abstract>"))).otherwise("")
    answers = rows.where(k <= 180).select(F.floor((k - 1) / 100).alias("batch"), F.struct(k.alias("k"), _xml(k, abstract).alias("x")).alias("s")).groupBy("batch").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), ""), F.lit("</PubmedArticleSet>")).alias("payload"))
    return citations.search(ids, answers, dt.datetime(2024, 1, 31))


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf)[0].select("search_pos", "pmid", "title", "abstract")


def search_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf)[1].select("requested", "batches", "fetched", "missing_abstract")


def search_query(spark: SparkSession, sf: str) -> DataFrame:
    """The query of topics whose keywords are a region's nations, some of them given twice."""
    from ..operators.topics import Topic

    nations = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    topics = [Topic(f"r{i}", [r.n_name for r in nations if r.n_regionkey in (i, 0)], enabled=i != 3) for i in range(5)]
    days = dt.date(2024, 1, 2), dt.date(2024, 1, 31)
    return spark.createDataFrame([("topics", citations.query(topics, [r.n_name for r in nations[:2]], *days)), ("own", citations.bounded_query(f"{nations[0].n_name}[Title]", *days))], "kind string, query string")


def journal_fields(spark: SparkSession, sf: str) -> DataFrame:
    """DOIs from any field, authors split at marks and words, plain texts, of feed items with a week's window; rejects counted by source."""
    k = c("c_custkey")
    e = text.escape_html
    doi = F.concat(F.lit("10.1000/J."), k)
    item = F.concat(F.lit("<item><title>"), c("c_name"), F.lit("</title><link>https://j.org/"), F.when(k % 3 == 0, doi).otherwise(k.cast("string")), F.lit("</link><dc:creator>"), F.when(k % 2 == 0, "Ann Lee; Bo Li").otherwise("Ann Lee and Bo Li and Cy Mo"), F.lit("</dc:creator><description>"), e(F.when(k % 10 == 5, "<p>x</p>").otherwise(F.concat(F.lit("<p>Text&nbsp;of the "), F.when(k % 3 == 1, doi).otherwise("paper on soils"), F.lit("</p>")))), F.lit("</description>"), F.when(k % 10 > 0, F.concat(F.lit("<pubDate>"), F.date_format(F.timestamp_seconds(k * 3600 + 1700000000), "'Mon, 'd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>"))).otherwise(""), F.lit("</item>"))
    rows = t(spark, sf, "customer").select(F.floor(k / 40).alias("n"), F.struct(k.alias("k"), item.alias("x")).alias("s")).groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias("xs"))
    made = rows.select(F.concat(F.lit("f"), c("n")).alias("source_id"), F.lit("J").alias("journal"), F.concat(F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), c("xs"), F.lit("</channel></rss>")).alias("payload"))
    return feeds.journal_papers(made, dt.datetime(2023, 11, 15), dt.datetime(2023, 12, 30))


def journal_field_rows(spark: SparkSession, sf: str) -> DataFrame:
    return journal_fields(spark, sf).select("title", "doi", F.array_join("authors", "|").alias("authors"), "abstract", "id", "reject_reason")


def journal_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.rejected(journal_fields(spark, sf)).select("source_id", F.explode("rejected").alias("reason", "n"))


QUERIES = {
    f.__name__: f
    for f in (
        current_issue_rows, notice_rows, contents_rows, trending_rows, sectioned_feed_rows, discussion_rows, professional_paper_rows, institution_rows, society_rows, guideline_article_rows, voted_rows,
        discussed_rows, attention_rows, market_stats, mood_rows, search_rows, search_counters, search_query, journal_field_rows, journal_rejects,
    )
}

_item = "customer"
_section = "case c_custkey % 5 when 0 then 'Guideline' when 1 then 'Video Article' when 2 then 'Original Article' else '' end"
_title = "case c_custkey % 7 when 0 then 'Robotic repair ' when 1 then 'Position statement ' when 2 then '找对象 ' else 'Notes ' end || c_name"
_type = lambda e: f"([{', '.join(map(quoted, TYPES))}])[({e}) + 1]"
_pick = lambda xs, e: f"([{', '.join(map(quoted, xs))}])[({e}) + 1]"
_compact = lambda x: f"case when {x} >= 1000000 then {sql_fixed(f'({x} / 1000000.0::double)', 1)} || 'M' when {x} >= 1000 then {sql_fixed(f'({x} / 1000.0::double)', 1)} || 'K' else ({x})::varchar end"
_filled = """
  pub as (select *, case when p_partkey % 3 > 0 then '10.7/' || p_partkey end as d0, case when p_partkey % 4 > 0 then strftime(make_timestamp((1690000000 + p_partkey * 86400)::bigint * 1000000), '%Y-%m-%d') end as t0 from base),
  filled as (select *, coalesce(d0, case when p_partkey % 6 > 0 then '10.8/w' || p_partkey || '-0' end) as doi, coalesce(t0, case when p_partkey % 6 > 0 then strftime(make_timestamp((1600000000 + p_partkey * 86400)::bigint * 1000000), '%Y-%m-%d') end) as published from pub)"""
_institution = f"""
  base as (select *, {_pick(FORMAL, 'p_partkey % 6')} || ' ' || p_name || ' ' || p_partkey as title, {_pick(ABSTRACTS, '(p_partkey // 3) % 4')} as abstract, {_pick(AUTHORS, '(p_partkey // 5) % 4')} as author,
    case p_partkey % 8 when 0 then 'Another Journal' when 1 then 'Int J  Gynaecol. Obstet' else {quoted(rules.INSTITUTION_JOURNAL)} end as journal, case when p_partkey % 17 = 0 then 'Letter' else 'Journal Article' end as kind from part),{_filled}"""
_as_article = "title, coalesce('https://doi.org/' || doi, 'https://pubmed.example.org/' || p_partkey) as url, abstract as excerpt, published, {0} as content_type, concat_ws(' · ', journal, p_partkey::varchar, doi) as meta"

SQL = {
    "current_issue_rows": """
      select 'p' || (s_suppkey // 20) as source_id, s_name || ' study' as title, 'https://j.example.org/art/' || s_suppkey as url, '2023年, 第39卷 第5期 · DOI: 10.5/' || s_suppkey || '/x' as excerpt, '2023-05-15' as published, 'tech' as category, 'metadata_only' as content_type
      from supplier where s_suppkey % 7 <> 0 and s_suppkey % 10 <> 9
      union all select 'p' || (s_suppkey // 20), s_name || ' study', 'https://j.example.org/art/' || (s_suppkey - 1), '2023年, 第39卷 第5期 · DOI: 10.5/' || s_suppkey || '/x', '2023-05-15', 'tech', 'metadata_only'
      from supplier where s_suppkey % 7 <> 0 and s_suppkey % 10 = 9 and (s_suppkey - 1) % 7 = 0""",
    "notice_rows": f"""
      with r as (select c_custkey as k, {_pick(NOTICES, 'c_custkey % 8')} as title, c_custkey % 8 as kind, c_custkey - case when c_custkey % 9 = 8 then 8 else 0 end as link, c_custkey // 30 as page,
        case when c_custkey % 5 < 2 then date '2024-01-01' + (c_custkey % 50)::int when c_custkey % 5 < 4 then make_date(2024, 3, (c_custkey % 28 + 1)::int) end as day from customer),
      f as (select *, row_number() over (partition by page, link order by k) as nth from r where kind not in (3, 6) and day is not null),
      g as (select *, row_number() over (partition by page order by k) as place from f where nth = 1)
      select 'p' || page as source_id, title, 'https://j.example.org/info/' || link as url, strftime(day, '%Y-%m-%d') as published, case kind when 2 then 'finance' when 5 then 'politics' else 'tech' end as category,
        case kind when 0 then 'guideline' when 1 then 'consensus' when 2 then 'complication_prevention' when 4 then 'guideline_interpretation' when 5 then 'clinical_practice_recommendation' else 'guideline' end as content_type,
        case kind when 1 then 'consensus' when 2 then 'education' when 5 then 'news' else 'guideline' end as document_type from g where place <= 8""",
    "contents_rows": f"""
      with r as (select *, c_custkey % 7 as kind, row_number() over (partition by c_custkey // 25 order by c_custkey) as place from customer where c_custkey % 7 not in (2, 5) and c_custkey % 11 <> 0)
      select 'p' || (c_custkey // 25) as source_id, c_name as title, 'https://j.example.org/CN/' || c_custkey as url, case when c_custkey % 2 = 0 then 'Some text.' end as excerpt, '10.1234/x' || c_custkey || ' · A; B' as meta, case when c_custkey % 3 = 0 then '2024-04-02' else '2024-05-01' end as published,
        case kind when 0 then 'politics' else 'tech' end as category, case kind when 0 then 'expert_commentary' when 3 then 'guideline_interpretation' when 4 then 'guideline' else 'consensus' end as content_type, case kind when 0 then 'news' when 1 then 'consensus' when 6 then 'consensus' else 'guideline' end as document_type
      from r where place <= 8""",
    "trending_rows": """
      select 'p' || (p_partkey // 40) as source_id, pos::int as pos, 'own/r' || p_partkey as title, 'https://j.example.org/own/r' || p_partkey as url, p_name as excerpt, concat_ws(' · ', case when p_partkey % 3 > 0 then p_brand end, '★ 1,' || p_partkey, '🍴 ' || p_size, '📈 9 stars today') as meta, true as undated
      from (select *, row_number() over (partition by p_partkey // 40 order by p_partkey) - 1 as pos from part) where pos < 25""",
    "sectioned_feed_rows": f"""
      with r as (select *, {_section} as section, {_title} as title, lower(case when {_section} <> '' then {_section} else {_title} end) as said from customer),
      k as (select *, case when {sql_match('said', rules.FEED_GUIDELINE)} then 'guideline' when {sql_match('said', rules.FEED_SURGERY)} then 'surgery' else 'research' end as kind from r)
      select case kind when 'guideline' then 'guidelines' when 'surgery' then 'surgery' else 'papers' end as source_id, title, 'https://e.org/' || c_custkey as url, 'About ' || c_mktsegment as excerpt, (c_custkey * 3600 + 1700000000)::bigint as published,
        case kind when 'guideline' then 'guideline' else 'video' end as document_type, case when section <> '' then lower(section) when kind = 'surgery' then 'video article' else 'guideline' end as content_type from k where c_custkey % 13 > 0""",
    "discussion_rows": f"""
      with feed as (select distinct c_custkey // 60 as n from customer), src as (select n, case when n % 3 = 1 then n else n + 1 end as used from feed where n + 1 in (select n from feed)),
      r as (select s.n, c.*, {_title} as title, row_number() over (partition by s.n order by c_custkey) as place from src s join customer c on c_custkey // 60 = used where c_custkey % 13 > 0 and c_custkey % 7 <> 2)
      select 'd' || n as source_id, title, 'https://e.org/' || c_custkey as url, 'About ' || c_mktsegment as excerpt, (c_custkey * 3600 + 1700000000)::bigint as published from r where place <= 25""",
    "professional_paper_rows": f"""
      with base as (select *, p_name || ' ' || p_partkey as title, lower({_type('p_partkey % 7')}) as k1, lower({_type('p_size % 5')}) as k2 from part),{_filled},
      r as (select *, case when k1 in ('editorial') then 'expert_commentary' when k1 in ('narrative review', 'clinical review') then 'professional_review' when k1 = 'video article' then 'video_article' when k1 = 'technical note' then 'technical_note' end as r1,
        case when k2 in ('editorial') then 'expert_commentary' when k2 in ('narrative review', 'clinical review') then 'professional_review' when k2 = 'video article' then 'video_article' end as r2 from filled where not ({sql_match('k1', rules.PUBLICATION_EXCLUDED)} or {sql_match('k2', rules.PUBLICATION_EXCLUDED)}))
      select title, 'https://pubmed.example.org/' || p_partkey as url, p_type as excerpt, published, case when coalesce(r1, r2) in ('video_article', 'technical_note') then 'finance' else 'politics' end as category, case when coalesce(r1, r2) = 'video_article' then 'video' else 'news' end as document_type, coalesce(r1, r2) as content_type,
        concat_ws(' · ', p_brand, p_partkey::varchar, doi) as meta from r where coalesce(r1, r2) is not null""",
    "institution_rows": f"""
      with {_institution} select 'figo-guidance' as source_id, {_as_article.format("'guideline'")} from filled
      where p_partkey % 8 <> 0 and not {sql_any('title', (rules.INSTITUTION_EXCLUDED,))} and kind <> 'Letter' and {sql_match('title', rules.INSTITUTION_TITLE)} and ({sql_match('author', rules.INSTITUTION_AUTHOR)} or {sql_match('abstract', rules.INSTITUTION_ABSTRACT)})""",
    "society_rows": f"""
      with {_institution} select 'figo-society-pubmed' as source_id, {_as_article.format("'policy'")} from filled
      where p_partkey % 8 > 1 and not {sql_any('title', (rules.SOCIETY_FORMAL, rules.SOCIETY_EXCLUDED))} and kind <> 'Letter' and {sql_match("title || ' ' || abstract", rules.SOCIETY_TERMS)} and ({sql_match('author', rules.SOCIETY_AFFILIATION)} or {sql_match('abstract', rules.SOCIETY_ABSTRACT)})""",
    "guideline_article_rows": f"""
      select 'asrm' as source_id, p_name || ' ' || p_partkey as title, 'https://pubmed.example.org/' || p_partkey as url,
        substr(concat_ws(' · ', case when p_partkey % 6 > 0 then repeat(p_type || ' ', p_size) end, p_brand, {_type('p_partkey % 7')} || ', ' || {_type('p_size % 5')}, case when p_partkey % 3 > 0 then 'DOI: 10.7/' || p_partkey end), 1, 1500) as excerpt,
        epoch({NOW_SQL})::bigint - (p_partkey % 400) * 3600 as published, 'tech' as category from part where p_partkey % 400 <= 168""",
    "voted_rows": """
      select p_name as title, 'https://huggingface.co/papers/h' || p_partkey as url, 'On ' || p_type as excerpt, case when p_partkey % 9 > 0 then '👍 ' || (p_size * 10) end as meta, '2024-01-05' as published from part
      where p_partkey <= 200 and (contains(lower(p_name || ' On ' || p_type || ' ' || p_brand), 'steel') or contains(lower(p_brand), 'brand#1') or contains(lower(p_name || ' On ' || p_type), 'red')) order by case when p_partkey % 9 > 0 then p_size * 10 else 0 end desc, p_partkey limit 30""",
    "discussed_rows": """
      with r as (select *, c_custkey % 700 as u, c_custkey * 7 % 601 as replies, case when c_nationkey % 2 = 0 then c_mktsegment else 'node' end as node from customer where c_custkey % 10 <> 0 and c_custkey % 4 > 0 and c_custkey * 7 % 601 > 0),
      f as (select * from r qualify row_number() over (partition by u order by c_nationkey, c_custkey) = 1)
      select 'Ask ' || c_name as title, 'https://v.org/' || u as url, replies || ' 回复 · ' || node || ' 节点' as excerpt, c_custkey + 1700000000 as published from f order by replies desc, c_nationkey, c_custkey limit 25""",
    "attention_rows": f"""
      select c_name as title, 'https://x.com/h/status/' || c_custkey as url, 'a b ' || c_mktsegment as excerpt,
        '@h · ' || {_compact('c_custkey * 30000')} || ' 粉丝 · ' || {_compact('c_custkey * 1000')} || ' 阅 · ' || {_compact('c_custkey')} || ' 赞' || case when c_custkey % 5 > 0 then ' · ' || {_compact('c_custkey % 5')} || ' 转' else '' end as meta, '2024-01-06' as published
      from customer where c_custkey <= 90 and (c_custkey % 3 = 1 or (c_custkey % 3 = 2 and c_custkey % 2 = 0)) order by c_custkey limit 20""",
    "market_stats": """
      select case when n_nationkey % 3 > 0 then n_nationkey * 1e9 else 0 end::double as market_cap, (n_nationkey * 1e8)::double as volume, 0::double as change_24h, (n_nationkey * 2)::double as btc_share, case when n_nationkey % 2 = 0 then n_nationkey else 0 end::double as eth_share, (n_nationkey * 100)::int as active
      from nation where n_nationkey % 5 > 1""",
    "mood_rows": f"""
      with r as (select *, coalesce(case when n_nationkey % 4 > 0 then {_pick((*rules.FEAR_GREED_LABELS, 'Odd'), 'n_nationkey % 6')} end, 'Neutral') as mood, (n_nationkey * 4)::double as v from nation where n_nationkey % 7 > 0)
      select v as value, mood as class, case mood {' '.join(f'when {quoted(k)} then {quoted(v)}' for k, v in rules.FEAR_GREED_LABELS.items())} else mood end as class_local, n_nationkey + 1700000000::bigint as at,
        case when v <= 24 then 'fear-extreme' when v <= 44 then 'fear' when v <= 55 then 'neutral' when v <= 74 then 'greed' else 'greed-extreme' end as tone from r""",
    "search_rows": "select p_partkey as search_pos, p_partkey::varchar as pmid, 'Title ' || p_partkey as title, 'About ' || p_type as abstract from part where p_partkey <= 180 and p_partkey % 6 > 0",
    "search_counters": "select least(200, (select count(*) from part))::bigint as requested, ceil(least(200, (select count(*) from part)) / 100.0)::bigint as batches, count(*)::bigint as fetched, count(*) filter (where p_partkey % 6 = 0)::bigint as missing_abstract from part where p_partkey between 1 and 180",
    "search_query": """
      with first as (select n_name, min(r * 100 + n_nationkey) as o from nation, unnest([0, 1, 2, 4]) as u(r) where n_regionkey in (0, r) group by 1)
      select 'own' as kind, n_name || '[Title] AND 2024/01/02:2024/01/31[EDAT]' as query from nation where n_nationkey = 0 union all
      select 'topics', '((' || (select string_agg(n_name || '[Title/Abstract]', ' OR ' order by o) from first) || ')) AND (' || (select string_agg(n_name || '[Title/Abstract]', ' OR ' order by n_nationkey) from nation where n_nationkey < 2) || ') AND 2024/01/02:2024/01/31[EDAT]'""",
    "journal_field_rows": """
      with r as (select *, make_timestamp((c_custkey * 3600 + 1700000000)::bigint * 1000000) as moment, case when c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_custkey % 10 <> 5) then '10.1000/j.' || c_custkey end as doi, case when c_custkey % 3 = 1 then '10.1000/J.' || c_custkey else 'paper on soils' end as last from customer)
      select c_name as title, doi, case when c_custkey % 2 = 0 then 'Ann Lee|Bo Li' else 'Ann Lee|Bo Li|Cy Mo' end as authors, case when c_custkey % 10 = 5 then 'x' else 'Text of the ' || last end as abstract,
        coalesce('doi:' || doi, 'rss:f' || (c_custkey // 40) || ':' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'))) as id, case when c_custkey % 10 = 0 then 'missingDate' when moment < timestamp '2023-11-15' or moment > timestamp '2023-12-30' then 'outOfWindow' when c_custkey % 10 = 5 then 'missingAbstract' end as reject_reason from r""",
    "journal_rejects": """
      with r as (select *, make_timestamp((c_custkey * 3600 + 1700000000)::bigint * 1000000) as moment from customer),
      q as (select c_custkey // 40 as n, case when c_custkey % 10 = 0 then 'missingDate' when moment < timestamp '2023-11-15' or moment > timestamp '2023-12-30' then 'outOfWindow' when c_custkey % 10 = 5 then 'missingAbstract' end as reason from r)
      select 'f' || n as source_id, reason, count(*)::bigint as n from q where reason is not null group by q.n, reason""",
}
