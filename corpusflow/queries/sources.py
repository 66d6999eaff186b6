"""Connectors: payloads are made from the driver's tables and read back, so that the tables are the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import feeds, payloads, registry

c = F.col
t = registry.table


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """One RSS payload for each 20 customers."""
    e = text.escape_html
    k = t(spark, sf, "customer")
    item = F.concat(F.lit("<item><title> "), e(F.concat(c("c_name"), F.lit(" & "), c("c_mktsegment"))), F.lit("</title><link>"), F.when(c("c_custkey") % 5 > 0, F.concat(F.lit("https://e.org/"), c("c_custkey"))).otherwise(""), F.lit("</link><guid>"), c("c_custkey"), F.lit("</guid><pubDate>"), F.date_format(F.timestamp_seconds(c("c_custkey") * 3600 + 1700000000), "'Mon, 'd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate><description>"), e(F.concat(F.lit("<p>Balance of "), c("c_name"), F.lit(" is <b>"), c("c_nationkey"), F.lit("</b></p>"))), F.lit("</description></item>"))
    rows = k.groupBy(F.floor(c("c_custkey") / 20).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("x")))), lambda s: s["x"]), "").alias("xs"))
    return rows.select(F.concat(F.lit("f"), c("n")).alias("source_id"), F.lit("tech").alias("category"), F.concat(F.lit("J"), c("n")).alias("journal"), F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), c("xs"), F.lit("</channel></rss>")).alias("payload"))


def rss_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = feeds.articles(_feed(spark, sf), {"f0": 8}, 15)
    return out.select("source_id", c("pos").cast("long").alias("pos"), "title", "url", "excerpt", F.unix_timestamp("published_at").alias("published"))


def rss_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    f = _feed(spark, sf).withColumn("payload", F.when(c("source_id").isin("f3", "f2"), "<html>challenge</html>").otherwise(c("payload"))).withColumn("status", F.when(c("source_id") == "f2", 403).otherwise(200))
    return feeds.diagnostics(f, feeds.articles(f)).select("source_id", c("items").cast("long").alias("items"), "http_403", "zero_items", "parse_failures")


def journal_papers(spark: SparkSession, sf: str) -> DataFrame:
    start, end = dt.datetime(2023, 11, 15, tzinfo=dt.timezone.utc), dt.datetime(2023, 12, 30, tzinfo=dt.timezone.utc)
    out = feeds.journal_papers(_feed(spark, sf), start, end, c("title").contains("MACHINERY"))
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def candle_scan(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").withColumn("i", F.struct(c("o_orderkey"), c("o_totalprice").alias("p"), F.when(c("o_orderkey") % 10 > 0, c("o_totalprice") + 1).alias("q")))
    g = o.groupBy(F.concat(F.lit("S"), c("o_custkey") % 50).alias("symbol")).agg(F.array_sort(F.collect_list("i")).alias("xs"))
    col = lambda n: F.transform("xs", lambda s: s[n])
    chart = F.struct(F.struct(F.array(F.struct(F.struct(c("symbol")).alias("meta"), F.transform("xs", lambda s: s["o_orderkey"] * 86400).alias("timestamp"), F.struct(F.array(F.struct(col("p").alias("open"), col("q").alias("high"), col("p").alias("low"), col("p").alias("close"), F.transform("xs", lambda s: F.lit(None).cast("bigint")).alias("volume"))).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    made = g.select("symbol", F.to_json(chart, {"ignoreNullFields": "false"}).alias("payload"))
    return payloads.candles(made).select("symbol", F.unix_timestamp("ts").alias("at"), "high", "close", "volume")


def ranked_items(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "part")
    order = d.select((c("p_partkey") * 7 % 1999).alias("pos"), c("p_partkey").alias("id"))
    items = d.where("p_partkey % 9 <> 0").select(F.to_json(F.struct(c("p_partkey").alias("id"), c("p_name").alias("title"), F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("https://p.org/"), c("p_partkey"))).alias("url"), c("p_size").alias("score"))).alias("payload"))
    return payloads.ranked_items(order, items, "hn", 40).select("pos", "title", "url", "excerpt")


def registry_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select(c("s_name").alias("id"), F.when(c("s_nationkey") % 3 == 0, "tech").when(c("s_nationkey") % 3 == 1, "finance").otherwise("politics").alias("category"), (c("s_acctbal") > 0).alias("enabled"), F.when(c("s_suppkey") % 4 == 0, F.array(F.lit("zh"))).alias("locales"))
    out = registry.summary(registry.for_locale(s, "en"))
    return out.select("category", "total", "enabled", F.get("ids", F.lit(0)).alias("first_id"))


def registry_invalid(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier")
    s = s.select(
        F.when(c("s_suppkey") % 17 == 0, " ").otherwise(F.concat(F.lit("s"), c("s_suppkey") % 90)).alias("id"), c("s_name").alias("name"), F.when(c("s_suppkey") % 11 == 0, "nowhere").otherwise("https://a.org/").alias("url"),
        F.lit("rss").alias("type"), F.when(c("s_suppkey") % 13 == 0, "sports").otherwise("tech").alias("category"), F.lit("academic_journal").alias("class"),
    )
    return registry.invalid(s).groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rss_scan, rss_diagnostics, journal_papers, candle_scan, ranked_items, registry_summary, registry_invalid)}

_F = "(select *, 'f' || (c_custkey // 20) as source_id, c_custkey % 20 as pos from customer)"
SQL = {
    "rss_scan": f"""
      select source_id, pos::bigint as pos, c_name || ' & ' || c_mktsegment as title, case when c_custkey % 5 > 0 then 'https://e.org/' || c_custkey else cast(c_custkey as varchar) end as url, 'Balance of ' || c_name || ' is ' || c_nationkey as excerpt, (c_custkey * 3600 + 1700000000)::bigint as published
      from {_F} where pos < case source_id when 'f0' then 8 else 15 end""",
    "rss_diagnostics": f"select source_id, case when source_id in ('f2', 'f3') then 0 else count(*) end::bigint as items, case when source_id = 'f2' then 1 else 0 end::int as http_403, case when source_id in ('f2', 'f3') then 1 else 0 end::int as zero_items, case when source_id = 'f3' then 1 else 0 end::int as parse_failures from {_F} group by 1",
    "journal_papers": f"""
      select case when c_custkey % 5 = 0 then 'missingIdentity' when contains(c_mktsegment, 'MACHINERY') then 'routedToGuidelineOrSurgery' when moment < timestamp '2023-11-15' or moment > timestamp '2023-12-30' then 'outOfWindow' else 'accepted' end as reason, count(*)::bigint as n
      from (select *, make_timestamp((c_custkey * 3600 + 1700000000)::bigint * 1000000) as moment from {_F}) group by 1""",
    "candle_scan": "select 'S' || (o_custkey % 50) as symbol, o_orderkey * 86400 as at, o_totalprice + 1 as high, o_totalprice as close, 0::bigint as volume from orders where o_orderkey % 10 > 0",
    "ranked_items": """
      select (p_partkey * 7 % 1999)::bigint as pos, p_name as title, case when p_partkey % 2 = 0 then 'https://p.org/' || p_partkey else 'https://news.ycombinator.com/item?id=' || p_partkey end as url, p_size || ' points · 0 comments' as excerpt from part where p_partkey % 9 <> 0 and p_partkey * 7 % 1999 < 40""",
    "registry_summary": """
      select case s_nationkey % 3 when 0 then 'tech' when 1 then 'finance' else 'politics' end as category, count(*)::bigint as total, count(*) filter (where s_acctbal > 0)::bigint as enabled, min(s_name) as first_id from supplier where s_suppkey % 4 <> 0 group by 1""",
    "registry_invalid": """
      with s as (select *, case when s_suppkey % 17 = 0 then ' ' else 's' || (s_suppkey % 90) end as id from supplier), n as (select id, count(*) as k from s group by 1),
      p as (select case when trim(id) = '' then 'blank id' when k > 1 then 'repeated id' when s_suppkey % 11 = 0 then 'bad url' when s_suppkey % 13 = 0 then 'unknown category' end as problem from s join n using (id))
      select problem, count(*)::bigint as n from p where problem is not null group by 1""",
}
