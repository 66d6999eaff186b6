"""JSON payload tables to rows: one payload for each row; parsing is PERMISSIVE with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rx, text

c = F.col


def ranked_items(order: DataFrame, items: DataFrame, source_id: str, limit: int = 30, link: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Items of a ranked id list: order (pos, id), items (payload); missing ones and those without title are dropped."""
    schema = "id bigint, title string, url string, text string, score int, descendants int, time bigint"
    got = items.select(F.from_json("payload", schema).alias("i")).select("i.*").where("title <> ''")
    facts = F.concat_ws(" · ", F.concat(F.coalesce("score", F.lit(0)), F.lit(" points")), F.concat(F.coalesce("descendants", F.lit(0)), F.lit(" comments")))
    rows = order.where(c("pos") < limit).join(got, "id")
    return rows.select(
        F.lit(source_id).alias("source_id"), "pos", "title", F.coalesce("url", F.concat(F.lit(link), c("id"))).alias("url"),
        F.when(F.coalesce("text", F.lit("")) != "", F.substring(text.strip_tags(c("text")), 1, 300)).otherwise(facts).alias("excerpt"), F.timestamp_seconds("time").alias("published_at"), F.lit("tech").alias("category"),
    )


def voted_papers(payload: DataFrame, source_id: str, keywords: Sequence[str] = (), limit: int = 30, link: str = "https://huggingface.co/papers/") -> DataFrame:
    """Papers of a daily list that hold any keyword, by votes, ties in list order."""
    schema = "array<struct<paper:struct<id:string,title:string,summary:string,ai_keywords:array<string>,upvotes:int,publishedAt:string>>>"
    rows = payload.select(F.posexplode(F.from_json("payload", schema)).alias("pos", "e")).select("pos", "e.paper.*")
    every = F.concat_ws(" ", "title", "summary", F.array_join("ai_keywords", " "))
    rows = rows.where(rx.contains_any(every, keywords)) if keywords else rows
    best = rows.orderBy(F.coalesce("upvotes", F.lit(0)).desc(), "pos").limit(limit)
    return best.select(F.lit(source_id).alias("source_id"), "title", F.concat(F.lit(link), c("id")).alias("url"), F.substring(F.coalesce("summary", F.lit("")), 1, 300).alias("excerpt"), dates.parsed(c("publishedAt")).alias("published_at"), F.concat(F.lit("👍 "), c("upvotes")).alias("meta"), F.lit("tech").alias("category"), "upvotes", "pos")


def discussed_topics(payloads: DataFrame, source_id: str, off_topic: str, limit: int = 25) -> DataFrame:
    """Topics of several node lists (ord, payload): first of each URL, with replies, by replies."""
    schema = "array<struct<title:string,url:string,replies:int,created:bigint,node:struct<title:string,name:string>>>"
    rows = payloads.select("ord", F.posexplode(F.from_json("payload", schema)).alias("pos", "t")).select("ord", "pos", "t.*")
    rows = rows.where("url <> '' and title <> ''").where(~rx.matches(c("title"), off_topic) & (F.coalesce("replies", F.lit(0)) > 0))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("ord", "pos"))).where("__n = 1")
    best = first.orderBy(F.desc("replies"), "ord", "pos").limit(limit)
    excerpt = F.concat(c("replies"), F.lit(" 回复 · "), F.coalesce("node.title", "node.name", F.lit("?")), F.lit(" 节点"))
    return best.select(F.lit(source_id).alias("source_id"), "title", "url", excerpt.alias("excerpt"), F.timestamp_seconds("created").alias("published_at"), F.lit("tech").alias("category"), "replies")


def attention_entries(payload: DataFrame, source_id: str, limit: int = 20) -> DataFrame:
    """Entries in English (detected languages, else en or zxx) in rank order, with a line of counts."""
    schema = "struct<entries:array<struct<tweetId:string,title:string,previewText:string,lang:string,langsDetected:array<string>,viewCount:bigint,likeCount:bigint,retweetCount:bigint,tweetCreatedAt:string,author:struct<handle:string,followers:bigint>>>>"
    rows = payload.select(F.posexplode(F.from_json("payload", schema)["entries"]).alias("pos", "e")).select("pos", "e.*")
    english = F.when(F.size("langsDetected") > 0, F.array_contains("langsDetected", "en")).otherwise(c("lang").isin("en", "zxx"))
    some = rows.where(F.coalesce(english, F.lit(False))).orderBy("pos").limit(limit)
    part = lambda n, unit: F.concat(text.compact_number(n), F.lit(f" {unit}"))
    meta = F.concat_ws(" · ", F.concat(F.lit("@"), c("author.handle")), part(c("author.followers"), "粉丝"), part(c("viewCount"), "阅"), part(c("likeCount"), "赞"), F.when(c("retweetCount") > 0, part(c("retweetCount"), "转")))
    url = F.concat(F.lit("https://x.com/"), c("author.handle"), F.lit("/status/"), c("tweetId"))
    return some.select(F.lit(source_id).alias("source_id"), "pos", "title", url.alias("url"), F.substring(rx.trim(rx.replace(c("previewText"), r"\s+", " ")), 1, 300).alias("excerpt"), dates.parsed(c("tweetCreatedAt")).alias("published_at"), meta.alias("meta"), F.lit("tech").alias("category"))


def candles(payloads: DataFrame) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from chart payloads; rows with a null price are dropped, volume defaults to 0."""
    q = F.get(c("chart.indicators.quote"), F.lit(0))
    bars = F.arrays_zip(c("chart.timestamp").alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"))
    rows = charts(payloads).select("symbol", F.explode(bars).alias("r"))
    out = rows.select("symbol", F.timestamp_seconds("r.ts").alias("ts"), "r.open", "r.high", "r.low", "r.close", F.coalesce("r.volume", F.lit(0)).alias("volume"))
    return out.dropna(subset=["open", "high", "low", "close"])


def charts(payloads: DataFrame) -> DataFrame:
    """(symbol, chart): each payload parsed once.

    The explode keeps one row together with its payload's parse, so that no expression
    over the payload can move above a later explode and be computed for each candle.
    """
    schema = "struct<chart:struct<result:array<struct<meta:struct<symbol:string,currency:string,exchangeName:string,regularMarketPrice:double,fiftyTwoWeekHigh:double,fiftyTwoWeekLow:double>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>>"
    parsed = F.get(F.from_json("payload", schema)["chart"]["result"], F.lit(0))
    return payloads.select("symbol", F.explode(F.array(parsed)).alias("chart")).select(F.coalesce("chart.meta.symbol", "symbol").alias("symbol"), "chart")


def quotes(payloads: DataFrame) -> DataFrame:
    """(symbol, currency, exchange, price, high_52w, low_52w) with defaults '' and 0; the price falls back to the last close."""
    base = charts(payloads).select("symbol", c("chart.meta").alias("m"))
    close = candles(payloads).groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    return base.join(close, "symbol", "left").select("symbol", F.coalesce("m.currency", F.lit("")).alias("currency"), F.coalesce("m.exchangeName", F.lit("")).alias("exchange"), F.coalesce("m.regularMarketPrice", "last_close", F.lit(0.0)).alias("price"), F.coalesce("m.fiftyTwoWeekHigh", F.lit(0.0)).alias("high_52w"), F.coalesce("m.fiftyTwoWeekLow", F.lit(0.0)).alias("low_52w"))


def global_stats(payload: DataFrame) -> DataFrame:
    """One row of market figures, 0 for what is missing; none if the payload has no data."""
    schema = "struct<data:struct<active_cryptocurrencies:int,total_market_cap:struct<usd:double>,total_volume:struct<usd:double>,market_cap_percentage:struct<btc:double,eth:double>,market_cap_change_percentage_24h_usd:double>>"
    d = payload.select(F.from_json("payload", schema)["data"].alias("d")).where("d is not null")
    z = lambda x, n, zero=0.0: F.coalesce(x, F.lit(zero)).alias(n)
    return d.select(z("d.total_market_cap.usd", "market_cap"), z("d.total_volume.usd", "volume"), z("d.market_cap_change_percentage_24h_usd", "change_24h"), z("d.market_cap_percentage.btc", "btc_share"), z("d.market_cap_percentage.eth", "eth_share"), z("d.active_cryptocurrencies", "active", 0))


#: Class names and their translations.
MOODS = {"Extreme Fear": "极度恐慌", "Fear": "恐慌", "Neutral": "中性", "Greed": "贪婪", "Extreme Greed": "极度贪婪"}


def fear_greed(payload: DataFrame) -> DataFrame:
    schema = "struct<data:array<struct<value:string,value_classification:string,timestamp:string>>>"
    i = payload.select(F.get(F.from_json("payload", schema)["data"], F.lit(0)).alias("i")).where("i.value <> ''")
    table = F.create_map(*[F.lit(x) for kv in MOODS.items() for x in kv])
    mood = F.coalesce("i.value_classification", F.lit("Neutral"))
    return i.select(c("i.value").cast("double").alias("value"), mood.alias("class"), F.coalesce(F.element_at(table, mood), mood).alias("class_local"), F.timestamp_seconds(c("i.timestamp").cast("bigint")).alias("ts"))
