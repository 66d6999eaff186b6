"""Scalar functions over documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, rx, text, urls
from ..operators import dedupe, policy
from ..sources import html, registry
from .common import sql_first, sql_fixed

c = F.col
t = registry.table

#: A rule list for the driver's documents.
DOCUMENT_RULES = (
    ("symbols", r"\S(?:\*\*\*|\$\$\$|###|%%%|&&&)"),
    ("shouting", r"\S!! \S+!!"),
    ("table", r" \| \S+ \| "),
    ("contact", r"\b[\w.]+@[\w.]+\.\w+\b|\+\d{6,}"),
    ("licence", r"\b(?:license|licence|copyright|warranty)\b"),
    ("english", r"\b(?:the|and|of|to)\b"),
    ("french", r"\b(?:le|la|les|des)\b"),
    ("german", r"\b(?:der|die|und|das)\b"),
    ("spanish", r"\b(?:el|los|que|un)\b"),
)


def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    line = F.get(F.split("text", "\n", 2), F.lit(0))
    return t(spark, sf, "documents").select("doc_id", text.normalize_title(line).alias("title_key"), text.normalize_content_title(line).alias("content_key"))


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", urls.canonical(c("url")).alias("canonical"), urls.host(c("url")).alias("host"), urls.is_http(c("url")).alias("valid"))


def url_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    pages = t(spark, sf, "pages").select("page_id", "url").withColumn("key", F.regexp_replace(urls.canonical(c("url")), r"\?.*$", ""))
    return dedupe.first_by(pages, "key", [c("page_id")]).select("page_id", "key")


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    pages = t(spark, sf, "pages")
    m = html.detail_metadata(pages.select("page_id", "html"))
    head = pages.select("page_id", text.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("page_title"))
    return m.join(head, "page_id").select("page_id", "page_title", F.char_length("excerpt").alias("excerpt_chars"), "date_modified_found")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages whose navigation counts as content (the driver's pages have no others)."""
    pages = t(spark, sf, "pages").select(c("page_id").cast("string").alias("source_id"), F.regexp_replace("html", "<(/?)nav>", "<$1div>").alias("html"), c("url").alias("s_url"), F.array().cast("array<string>").alias("s_allowed_hosts"), F.array().cast("array<string>").alias("s_keywords"), F.array().cast("array<string>").alias("s_exclude_keywords"), F.lit("tech").alias("s_category"))
    return html.link_list(pages).select("source_id", "title", "url")


def doc_classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    return d.select("doc_id", rx.first_match(c("text"), DOCUMENT_RULES, "unknown", c("low")).alias("kind"))


def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    none = F.array().cast("array<string>")
    return d.select("doc_id", text.fingerprint(c("source"), c("lang"), F.concat(F.lit("j"), c("doc_id")), F.when(c("doc_id") % 2 == 0, c("n_chars").cast("string")), none, F.array(c("source"), c("lang"))).alias("fingerprint"))


def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    x = c("o_totalprice")
    return o.select("o_orderkey", text.compact_number(F.floor(x)).alias("compact"), text.round_half_up(x - 200000, 1).alias("rounded"), text.round2(x / 7).alias("rounded2"), policy.banded(x, [(100000.0, "low"), (300000.0, "middle")], "high").alias("band"), text.escape_html(F.concat(F.lit("<b a=\"'&'\">"), c("o_orderpriority"))).alias("escaped"))


def dates_from_text(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    d = c("o_orderdate")
    said = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("on "), F.date_format(d, "yyyy-M-d"))).when(c("o_orderkey") % 4 == 1, F.date_format(d, "d MMMM yyyy")).when(c("o_orderkey") % 4 == 2, F.concat(F.date_format(d, "MMM d, yyyy"), F.lit(" (print)"))).otherwise(F.date_format(d, "yyyy年M月d日"))
    return o.select("o_orderkey", F.date_format(dates.from_text(said), "yyyy-MM-dd").alias("day"))


def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    said = F.when(c("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), c("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("answer "), c("props"), F.lit(" done")))
    return e.select("event_id", F.get_json_object(text.extract_json(said), "$.k").cast("long").alias("k"))


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    url = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), c("o_orderkey") + 1000000, F.lit("/"))).otherwise(F.concat(F.lit("https://doi.org/10.1000/AB."), c("o_custkey"), F.lit(").")))
    meta = F.concat(F.lit("see PMID: "), c("o_custkey") + 7000000)
    doi = F.when(c("o_orderkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" DOI: 10.1000/XY."), c("o_custkey"), F.lit(").;")))
    return o.select("o_orderkey", urls.doi_in(url, meta).alias("doi"), urls.pmid_in(url, meta).alias("pmid"), text.normalize_doi(doi).alias("normalized"))


QUERIES = {f.__name__: f for f in (title_normalize, url_canonical, url_dedupe_first, page_metadata, page_links, doc_classify_rules, fingerprint, number_formats, dates_from_text, json_extract, identifiers)}

_CANON = r"""
  regexp_replace(
    lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) ||
    coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_.*|rss)$'))), '&'), ''), ''),
    '/$', '')
"""

SQL = {
    "title_normalize": r"""
      select doc_id, trim(regexp_replace(lower(l), '[^\p{L}\p{N}&]+', ' ', 'g')) as title_key, trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g')) as content_key
      from (select doc_id, split_part(text, chr(10), 1) as l from documents)""",
    "url_canonical": f"select page_id, {_CANON} as canonical, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) as host, regexp_matches(url, '^(?i)https?://[^/?#]+') as valid from pages",
    "url_dedupe_first": f"""
      select page_id, key from (select page_id, key, row_number() over (partition by key order by page_id) as n from (select page_id, regexp_replace({_CANON}, '\\?.*$', '') as key from pages)) where n = 1""",
    "page_metadata": None,
    "page_links": r"""
      with l as (select page_id, generate_subscripts(hs, 1) as pos, unnest(hs) as href, unnest(ts) as title, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root
        from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as ts from pages)),
      r as (select cast(page_id as varchar) as source_id, trim(title) as title, root || href as url, pos from l where length(trim(title)) >= 8)
      select source_id, title, url from r qualify row_number() over (partition by source_id, url order by pos) = 1""",
    "doc_classify_rules": f"select doc_id, {sql_first('text', DOCUMENT_RULES, "'unknown'")} as kind from documents",
    "fingerprint": """
      select doc_id, sha256('{"title":"' || source || '","abstract":"' || lang || '","journal":"j' || doc_id || '"' || case when doc_id % 2 = 0 then ',"publishedAt":"' || n_chars || '"' else '' end
        || ',"publicationTypes":[],"authors":["' || least(source, lang) || '","' || greatest(source, lang) || '"]}') as fingerprint from documents""",
    "number_formats": """
      select o_orderkey, case when x >= 1000000 then @millions || 'M' when x >= 1000 then @thousands || 'K' else printf('%.0f', x) end as compact,
        floor((o_totalprice - 200000) * 10 + 0.5) / 10 as rounded, floor((o_totalprice / 7 + 2.220446049250313e-16) * 100 + 0.5) / 100 as rounded2,
        case when o_totalprice <= 100000 then 'low' when o_totalprice <= 300000 then 'middle' else 'high' end as band,
        '&lt;b a=&quot;&#39;&amp;&#39;&quot;&gt;' || o_orderpriority as escaped
      from (select *, floor(o_totalprice) as x from orders)""".replace("@millions", sql_fixed("(x / 1000000.0::double)", 1)).replace("@thousands", sql_fixed("(x / 1000.0::double)", 1)),
    "dates_from_text": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where year(o_orderdate) >= 2000 union all select o_orderkey, null as day from orders where year(o_orderdate) < 2000",
    "json_extract": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "identifiers": """
      select o_orderkey, case when o_orderkey % 3 = 0 then null else '10.1000/ab.' || o_custkey end as doi,
        case when o_orderkey % 3 = 0 then cast(o_orderkey + 1000000 as varchar) else cast(o_custkey + 7000000 as varchar) end as pmid,
        case when o_orderkey % 5 = 0 then null else '10.1000/xy.' || o_custkey end as normalized from orders""",
}
SQL = {k: v for k, v in SQL.items() if v}
