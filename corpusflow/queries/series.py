"""Indicators over weekly order totals by priority, and usage reports over events as calls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators import usage
from ..sources import registry
from .common import NOW_SQL

c = F.col
t = registry.table
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts, close): exact sums of order totals by priority and week."""
    o = t(spark, sf, "orders").groupBy(c("o_orderpriority").alias("symbol"), F.date_trunc("week", c("o_orderdate")).alias("ts"))
    return o.agg(F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("close"))


_r = lambda x, n: F.round(x, n)
_at = lambda: F.date_format("ts", "yyyy-MM-dd").alias("week")


def sma(spark: SparkSession, sf: str) -> DataFrame:
    rows = weekly(spark, sf)
    return rows.select("symbol", _at(), _r(ts.sma("close", 20), 5).alias("sma20"), _r(ts.sma("close", 50), 5).alias("sma50"), _r(ts.change("close", 1), 4).alias("pct_1"), _r(ts.change("close", 5), 4).alias("pct_5"))


def ema_rsi_macd(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(ts.recursive(weekly(spark, sf), emas=(12, 26)))


def ema_long(spark: SparkSession, sf: str) -> DataFrame:
    """The same by segments of 40 weeks, the averages of which compose."""
    return _indicators(ts.recursive_long(weekly(spark, sf), emas=(12, 26), rows=40))


def _indicators(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", _at(), *[_r(n, 2).alias(n) for n in ("ema_12", "ema_26", "macd", "macd_signal", "macd_histogram")], _r("rsi_14", 4).alias("rsi_14"))


def cross_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = weekly(spark, sf)
    rows = rows.withColumn("fast", ts.sma("close", 5)).withColumn("slow", ts.sma("close", 20))
    return ts.recent_cross(rows, "fast", "slow", 40, "cross").select("symbol", "cross", c("cross_days").alias("days"))


def analyze(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.slim(ts.analyze(weekly(spark, sf)))
    return out.select("symbol", "trend", "rsi_state", F.array_join("signals", ",").alias("signals"), "pct_1d", "pct_5d", "pct_high", "pct_low", "sma20", "sma50", "sma200")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    error = F.when(c("event_id") % 4 == 0, "HTTP 429 Too Many Requests").when(c("event_id") % 4 == 1, "Request timed out").when(c("event_id") % 4 == 2, "401 Unauthorized").otherwise("socket closed")
    return e.select(c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"), c("event_type").alias("backend"), (c("user_id") % 10 != 0).alias("success"), F.floor(c("value") * 100).alias("input_chars"), F.floor(c("value") * 10).alias("output_chars"), F.when(c("user_id") % 10 == 0, error).alias("error"))


def usage_by_backend(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.by_backend(calls(spark, sf), NOW, {"click": 120, "view": 240}, 72)
    return out.withColumn("ratio", F.round("ratio", 9))


def usage_last_failures(spark: SparkSession, sf: str) -> DataFrame:
    return usage.last_failures(calls(spark, sf)).select("backend", "seq", "error")


def usage_last_calls(spark: SparkSession, sf: str) -> DataFrame:
    return usage.last_calls(calls(spark, sf)).select("seq", "backend", "success")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of events by type as a stream that ends with its input, read from its sink."""
    import uuid

    from ..storage import shared_dir
    from ..streaming import state

    base = f"{shared_dir(spark)}/corpusflow-{uuid.uuid4().hex}"
    schema = t(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", c("ts").cast("timestamp"))
    counts = state.windowed_counts(rows, "ts", "1 day", "2 days", "event_type").select(F.col("window.start").alias("start"), "event_type", "n")

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_unique(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each (user, type, day) as a stream with a 48-hour watermark."""
    import uuid

    from ..storage import shared_dir
    from ..streaming import state

    base = f"{shared_dir(spark)}/corpusflow-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(t(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = rows.withColumn("ts", c("ts").cast("timestamp")).withColumn("key", F.concat_ws("-", "user_id", "event_type", F.date_format("ts", "yyyyMMdd")))
    query = state.unique_stream(rows, "key", "ts").select("key").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES = {f.__name__: f for f in (sma, ema_rsi_macd, ema_long, cross_signals, analyze, usage_by_backend, usage_last_failures, usage_last_calls, stream_windows, stream_unique)}

_W = """w as (select o_orderpriority as symbol, date_trunc('week', o_orderdate) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as close from orders group by 1, 2),
  s as (select *, row_number() over (partition by symbol order by ts) as rn, row_number() over (partition by symbol order by ts desc) - 1 as back from w)"""
_ma = lambda n, x="close": f"case when rn >= {n} then avg({x}) over (partition by symbol order by ts rows between {n - 1} preceding and current row) end"
_pct = lambda n: f"coalesce(({{0}} - lag(close, {n}) over o) / lag(close, {n}) over o * 100, 0)".format("close")
_ERROR = "case event_id % 4 when 0 then 'HTTP 429 Too Many Requests' when 1 then 'Request timed out' when 2 then '401 Unauthorized' else 'socket closed' end"
_REC = f"""
  d as (select *, close - lag(close) over (partition by symbol order by ts) as ch from s),
  seed as (select symbol, avg(close) filter (where rn <= 12) as e12, avg(close) filter (where rn <= 26) as e26, sum(greatest(ch, 0)) filter (where rn between 2 and 15) / 14 as g, sum(greatest(-ch, 0)) filter (where rn between 2 and 15) / 14 as l from d group by 1),
  e as (
    select symbol, 12::bigint as rn, e12 as a, null::double as b, null::double as g, null::double as l from seed union all
    select d.symbol, d.rn, (d.close - e.a) * (2.0::double / 13) + e.a, case when d.rn = 26 then seed.e26 when d.rn > 26 then (d.close - e.b) * (2.0::double / 27) + e.b end,
      case when d.rn = 15 then seed.g when d.rn > 15 then (e.g * 13 + greatest(d.ch, 0)) / 14 end, case when d.rn = 15 then seed.l when d.rn > 15 then (e.l * 13 + greatest(-d.ch, 0)) / 14 end
    from e join d on d.symbol = e.symbol and d.rn = e.rn + 1 join seed on seed.symbol = d.symbol
  ), m as (select symbol, rn, a - b as line from e where b is not null),
  ms as (select symbol, avg(line) as v from m where rn between 26 and 34 group by 1),
  sg as (select symbol, 34::bigint as rn, v from ms union all select m.symbol, m.rn, (m.line - sg.v) * (2.0::double / 10) + sg.v from sg join m on m.symbol = sg.symbol and m.rn = sg.rn + 1),
  every as (select s.*, e.a, e.b, e.a - e.b as line, sg.v as sig, 100 - 100 / (1 + e.g / case when e.l = 0 then 1e-10 else e.l end) as rsi from s left join e using (symbol, rn) left join sg using (symbol, rn))"""

SQL = {
    "sma": f"with {_W} select symbol, strftime(ts, '%Y-%m-%d') as week, round({_ma(20)}, 5) as sma20, round({_ma(50)}, 5) as sma50, round({_pct(1)}, 4) as pct_1, round({_pct(5)}, 4) as pct_5 from s window o as (partition by symbol order by ts)",
    "ema_rsi_macd": f"with recursive {_W}, {_REC} select symbol, strftime(ts, '%Y-%m-%d') as week, round(a, 2) as ema_12, round(b, 2) as ema_26, round(line, 2) as macd, round(sig, 2) as macd_signal, round(line - sig, 2) as macd_histogram, round(rsi, 4) as rsi_14 from every",
    "cross_signals": f"""
      with {_W}, x as (select symbol, ts, back, {_ma(5)} - {_ma(20)} as d from s), y as (select *, lag(d) over (partition by symbol order by ts) as p from x where d is not null),
      h as (select symbol, back, case when p <= 0 and d > 0 then 'up' when p >= 0 and d < 0 then 'down' end as way from y where back < 40)
      select symbol, arg_min(way, back) as "cross", min(back)::bigint as days from h where way is not null group by 1""",
    "analyze": f"""
      with recursive {_W}, {_REC},
      f as (select *, {_ma(20)} as s20, {_ma(50)} as s50, {_ma(200)} as s200, lag(close) over o as p1, lag(close, 5) over o as p5, max(close) over (o rows between 251 preceding and current row) as hi, min(close) over (o rows between 251 preceding and current row) as lo from every window o as (partition by symbol order by ts)),
      c1 as (select symbol, back, s50 - s200 as d, lag(s50 - s200) over (partition by symbol order by ts) as p from f where s200 is not null), c2 as (select symbol, back, line - sig as d, lag(line - sig) over (partition by symbol order by ts) as p from f where sig is not null),
      x1 as (select symbol, arg_min(case when d > 0 then 'golden-cross' else 'death-cross' end, back) as x from c1 where back < 10 and ((p <= 0 and d > 0) or (p >= 0 and d < 0)) group by 1),
      x2 as (select symbol, arg_min(case when d > 0 then 'macd-bull-cross' else 'macd-bear-cross' end, back) as x from c2 where back < 5 and ((p <= 0 and d > 0) or (p >= 0 and d < 0)) group by 1),
      z as (select f.*, x1.x as g1, x2.x as g2, (close - hi) / hi * 100 as ph, (close - lo) / lo * 100 as pl, case when close > s50 and s50 > s200 then 'bullish' when close < s50 and s50 < s200 then 'bearish' else 'neutral' end as trend, case when rsi > 70 then 'overbought' when rsi < 30 then 'oversold' else 'normal' end as st from f left join x1 using (symbol) left join x2 using (symbol) where back = 0)
      select symbol, trend, st as rsi_state, concat_ws(',', g1, g2, case when st <> 'normal' then 'rsi-' || st end, case when ph >= -3 then 'near-52w-high' when pl <= 3 then 'near-52w-low' end, case trend when 'bullish' then 'above-sma50-sma200' when 'bearish' then 'below-sma50-sma200' end) as signals,
        floor((close - p1) / p1 * 10000 + 0.5) / 100 as pct_1d, floor((close - p5) / p5 * 10000 + 0.5) / 100 as pct_5d, floor(ph * 100 + 0.5) / 100 as pct_high, floor(pl * 100 + 0.5) / 100 as pct_low,
        floor(s20 * 100 + 0.5) / 100 as sma20, floor(s50 * 100 + 0.5) / 100 as sma50, floor(s200 * 100 + 0.5) / 100 as sma200 from z""",
    "usage_by_backend": f"""
      with k as (select *, ts >= {NOW_SQL} - to_hours(case event_type when 'click' then 120 when 'view' then 240 else 72 end) as recent, user_id % 10 = 0 as bad, floor(value * 100)::bigint as i, floor(value * 10)::bigint as o from events),
      g as (select event_type as backend, count(*)::bigint as calls, count(*) filter (where recent)::bigint as recent_calls, coalesce(sum(i) filter (where recent), 0)::bigint as recent_input_chars, coalesce(sum(o) filter (where recent), 0)::bigint as recent_output_chars,
        count(*) filter (where bad)::bigint as failures, count(*) filter (where bad and event_id % 4 = 0)::bigint as failed_quota, count(*) filter (where bad and event_id % 4 = 1)::bigint as failed_timeout, count(*) filter (where bad and event_id % 4 = 2)::bigint as failed_auth, count(*) filter (where bad and event_id % 4 = 3)::bigint as failed_other from k group by 1)
      select *, round(recent_input_chars / 3.0::double / 1000000, 9) as ratio, case when recent_input_chars / 3000000.0 > 0.7 then 'high' when recent_input_chars / 3000000.0 > 0.4 then 'middle' else 'low' end as band from g""",
    "usage_last_failures": f"select event_type as backend, event_id as seq, {_ERROR} as error from events where user_id % 10 = 0 qualify row_number() over (partition by event_type order by event_id desc) <= 3",
    "usage_last_calls": "select event_id as seq, event_type as backend, user_id % 10 <> 0 as success from events order by event_id desc limit 10",
    "stream_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*)::bigint as n from events group by 1, 2",
    "stream_unique": "select distinct user_id || '-' || event_type || '-' || strftime(ts, '%Y%m%d') as key from events",
}
SQL["ema_long"] = SQL["ema_rsi_macd"]
