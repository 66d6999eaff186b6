"""Indicators over time series: (symbol, ts, close), one row for each day.

Moving averages are window frames.  Exponential averages and Wilder smoothing are
recursive, so that each value needs the one before: recursive() folds a symbol's whole series
in one task, linear in its length (8 bytes a value); recursive_long() cuts series into segments
whose effects compose, so that one symbol is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..storage import stored

c = F.col
BY, AT, VALUE = "symbol", "ts", "close"


def _w() -> Window:
    return Window.partitionBy(BY).orderBy(AT)


def sma(value: str, period: int) -> Column:
    """Mean of the last ``period`` values; null before there are so many."""
    frame = F.avg(value).over(_w().rowsBetween(1 - period, 0))
    return F.when(F.row_number().over(_w()) >= period, frame) if period > 0 else F.lit(None).cast("double")


def change(value: str, back: int) -> Column:
    """Percent against ``back`` rows before; 0 if there is none or it is 0."""
    before = F.lag(value, back).over(_w())
    return F.coalesce(F.when((before != 0) & ~F.isnan(before), (c(value) - before) / before * 100), F.lit(0.0))


def ema_values(x: np.ndarray, period: int) -> np.ndarray:
    """Aligned with x; nan before the seed, the mean of the first ``period`` values."""
    out = np.full(len(x), np.nan)
    if period <= 0 or len(x) < period:
        return out
    e = float(sum(x[:period].tolist())) / period
    out[period - 1] = e
    k = 2 / (period + 1)
    for i, v in enumerate(x[period:].tolist(), period):
        e = (v - e) * k + e
        out[i] = e
    return out


def rsi_values(x: np.ndarray, period: int = 14) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if period <= 0 or len(x) <= period:
        return out
    d = np.diff(x).tolist()
    gain = sum(v for v in d[:period] if v > 0) / period
    loss = sum(-v for v in d[:period] if v < 0) / period
    value = lambda g, s: 100 - 100 / (1 + g / (s if s != 0 else 1e-10))
    out[period] = value(gain, loss)
    for i, v in enumerate(d[period:], period + 1):
        gain = (gain * (period - 1) + max(v, 0)) / period
        loss = (loss * (period - 1) + max(-v, 0)) / period
        out[i] = value(gain, loss)
    return out


def macd_values(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema_values(x, fast) - ema_values(x, slow)
    some = ~np.isnan(line)
    out = np.full(len(x), np.nan)
    out[some] = ema_values(line[some], signal)
    return line, out, line - out


def recursive(series: DataFrame, emas: Sequence[int] = (), rsi: int | None = 14, macd: tuple[int, int, int] | None = (12, 26, 9)) -> DataFrame:
    """series with ema_<n>, rsi_<n> and macd, macd_signal, macd_histogram, as asked for; null where undefined."""
    extra = [f"ema_{n}" for n in emas] + ([f"rsi_{rsi}"] if rsi else []) + (["macd", "macd_signal", "macd_histogram"] if macd else [])
    base = series.select(BY, AT, VALUE)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(AT, ignore_index=True)
        x = rows[VALUE].to_numpy(float)
        for n in emas:
            rows[f"ema_{n}"] = ema_values(x, n)
        if rsi:
            rows[f"rsi_{rsi}"] = rsi_values(x, rsi)
        if macd:
            rows["macd"], rows["macd_signal"], rows["macd_histogram"] = macd_values(x, *macd)
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + "".join(f", {x} double" for x in extra)
    out = base.groupBy(BY).applyInPandas(fold, schema)
    return out.select(*base.columns, *[F.when(~F.isnan(x), c(x)).alias(x) for x in extra])


#: Rows of a segment of a long series: one task's work.
SEGMENT_ROWS = 100_000


def numbered(series: DataFrame) -> DataFrame:
    """(symbol, ts, close, n): rows of each series numbered from 1 by one range sort, so that no series is one task's.

    A row's number is its place in its sorted part, less that of the series' first row there, plus the series' rows in the parts before.
    """
    part = series.select(BY, AT, VALUE).repartitionByRange(BY, AT).sortWithinPartitions(BY, AT)
    at = stored(part.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    runs = at.groupBy(BY, "__part").agg(F.count("*").alias("__m"), F.min("__at").alias("__first"))
    before = F.sum("__m").over(Window.partitionBy(BY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__m")
    return at.join(runs, [BY, "__part"]).withColumn("n", c("__before") + c("__at") - c("__first") + 1).select(BY, AT, VALUE, "n")


class Averages:
    """The recursive indicators as one affine recursion over a state of averages: what a segment does to the state
    is a matrix, and matrices of segments compose.

    States: an average for each EMA period, gain and loss, and fast, slow and signal of the MACD.  Until an average's
    seed is full it gathers the seed's parts; afterwards it moves to the value by its share.
    """

    def __init__(self, emas: Sequence[int], rsi: int | None, macd: tuple[int, int, int] | None):
        self.emas, self.rsi, self.macd = tuple(emas), rsi, macd
        self.names = [f"ema_{n}" for n in emas] + ([f"rsi_{rsi}"] if rsi else []) + (["macd", "macd_signal", "macd_histogram"] if macd else [])
        self.size = len(self.emas) + (2 if rsi else 0) + (3 if macd else 0)

    @staticmethod
    def _moved(x: np.ndarray, n: np.ndarray, period: int, share: float, e: float, first: int = 1) -> np.ndarray:
        """The average after each row; the seed is the mean of rows first .. first + period - 1."""
        out = np.empty(len(x))
        for i, (v, k) in enumerate(zip(x.tolist(), n.tolist())):
            if k >= first + period:
                e = (v - e) * share + e
            elif k >= first:
                e = e + v / period
            out[i] = e
        return out

    def states(self, x: np.ndarray, n: np.ndarray, before: float, state: np.ndarray) -> np.ndarray:
        """The states after each row, (states, rows), from the state before and the value before the first row."""
        out, at = np.empty((self.size, len(x))), 0
        for p in self.emas:
            out[at] = self._moved(x, n, p, 2 / (p + 1), state[at])
            at += 1
        if self.rsi:
            d = np.diff(x, prepend=before)
            for part in (np.maximum(d, 0), np.maximum(-d, 0)):
                out[at] = self._moved(part, n, self.rsi, 1 / self.rsi, state[at], 2)
                at += 1
        if self.macd:
            fast, slow, signal = self.macd
            out[at] = self._moved(x, n, fast, 2 / (fast + 1), state[at])
            out[at + 1] = self._moved(x, n, slow, 2 / (slow + 1), state[at + 1])
            out[at + 2] = self._moved(out[at] - out[at + 1], n, signal, 2 / (signal + 1), state[at + 2], max(fast, slow))
        return out

    def step(self, x: np.ndarray, n: np.ndarray, before: float) -> np.ndarray:
        """What a segment does to the state: the matrix (size, size + 1) of the linear part and the constant."""
        end = self.states(x, n, before, np.zeros(self.size))[:, -1]
        still, out = np.zeros(len(x)), np.empty((self.size, self.size + 1))
        for k in range(self.size):  # without input the states decay as they depend on each other
            out[:, k] = self.states(still, n, 0.0, np.eye(self.size)[k])[:, -1]
        out[:, -1] = end
        return out

    def values(self, x: np.ndarray, n: np.ndarray, before: float, state: np.ndarray) -> dict[str, np.ndarray]:
        """The indicators of each row; nan before their seeds are full."""
        s, at, out = self.states(x, n, before, state), 0, {}
        for p in self.emas:
            out[f"ema_{p}"] = np.where(n >= p, s[at], np.nan)
            at += 1
        if self.rsi:
            gain, loss = s[at], s[at + 1]
            out[f"rsi_{self.rsi}"] = np.where(n > self.rsi, 100 - 100 / (1 + gain / np.where(loss != 0, loss, 1e-10)), np.nan)
            at += 2
        if self.macd:
            late = max(self.macd[:2])
            line = np.where(n >= late, s[at] - s[at + 1], np.nan)
            out["macd"], out["macd_signal"] = line, np.where(n >= late + self.macd[2] - 1, s[at + 2], np.nan)
            out["macd_histogram"] = out["macd"] - out["macd_signal"]
        return out


def recursive_long(series: DataFrame, emas: Sequence[int] = (), rsi: int | None = 14, macd: tuple[int, int, int] | None = (12, 26, 9), rows: int = SEGMENT_ROWS) -> DataFrame:
    """The same as recursive(), up to rounding, for series that are too long for one task.

    Rows are numbered by a range sort and cut into segments.  Each segment gives, as one row, the affine map
    that it is to the averages; the maps of a series compose in order, which is all that is done by series,
    and each segment is computed again from the averages that it begins with.
    """
    one = Averages(emas, rsi, macd)
    cut = stored(numbered(series).withColumn("segment", F.floor((c("n") - 1) / rows)))
    ends = cut.groupBy(BY, "segment").agg(F.max_by(VALUE, "n").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy(BY).orderBy("segment"))).drop("last")
    cut = cut.join(ends, [BY, "segment"])

    def opened(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        df.sort_values("n", ignore_index=True, inplace=True)
        x = df[VALUE].to_numpy(float)
        before = df["before"].iloc[0]
        return x, df["n"].to_numpy(), x[0] if pd.isna(before) else float(before)

    def summed(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({BY: [df[BY].iloc[0]], "segment": [df["segment"].iloc[0]], "step": [one.step(*opened(df)).ravel().tolist()]})

    def carried(df: pd.DataFrame) -> pd.DataFrame:
        df, state, states = df.sort_values("segment", ignore_index=True), np.zeros(one.size), []
        for step in df["step"]:
            states.append(state.tolist())
            m = np.array(step).reshape(one.size, one.size + 1)
            state = m[:, :-1] @ state + m[:, -1]
        return pd.DataFrame({BY: df[BY], "segment": df["segment"], "state": states})

    def filled(df: pd.DataFrame) -> pd.DataFrame:
        values = one.values(*opened(df), np.array(df["state"].iloc[0]))
        return df[[BY, AT, VALUE]].assign(**values)

    kind = lambda name: f"`{name}` {cut.schema[name].dataType.simpleString()}"
    steps = cut.groupBy(BY, "segment").applyInPandas(summed, f"{kind(BY)}, segment long, step array<double>")
    states = stored(steps).groupBy(BY).applyInPandas(carried, f"{kind(BY)}, segment long, state array<double>")
    out = cut.join(stored(states), [BY, "segment"]).groupBy(BY, "segment").applyInPandas(filled, ", ".join(map(kind, (BY, AT, VALUE))) + "".join(f", {x} double" for x in one.names))
    return out.select(BY, AT, VALUE, *[F.when(~F.isnan(x), c(x)).alias(x) for x in one.names])


def recent_cross(rows: DataFrame, fast: str, slow: str, lookback: int, name: str) -> DataFrame:
    """(symbol, <name>, <name>_days): the newest crossing within ``lookback`` rows of the end, up or down.

    From not above to above is up, from not below to below down; rows where either is null don't count.
    """
    both = rows.where(c(fast).isNotNull() & c(slow).isNotNull()).select(BY, AT, (c(fast) - c(slow)).alias("d"))
    both = both.withColumn("p", F.lag("d").over(_w())).withColumn("days", F.row_number().over(Window.partitionBy(BY).orderBy(F.desc(AT))) - 1)
    way = F.when((c("p") <= 0) & (c("d") > 0), "up").when((c("p") >= 0) & (c("d") < 0), "down")
    hits = both.where(c("days") < lookback).withColumn("way", way).where("way is not null")
    return hits.groupBy(BY).agg(F.min_by("way", "days").alias(name), F.min("days").cast("long").alias(f"{name}_days"))


def latest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(BY).orderBy(F.desc(AT)))).where("__n = 1").drop("__n")


def trend(price: Column, s50: Column, s200: Column) -> Column:
    known = (F.coalesce(s50, F.lit(0.0)) != 0) & (F.coalesce(s200, F.lit(0.0)) != 0)
    return F.when(known & (price > s50) & (s50 > s200), "bullish").when(known & (price < s50) & (s50 < s200), "bearish").otherwise("neutral")


def analyze(series: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """One row for each symbol: price, changes, averages, momentum, trend and up to five signals in order.

    quotes: (symbol, price, high_52w, low_52w); without it the last close is the price and
    the extremes are those of the last 252 rows.  A missing (null or 0) extreme gives a
    change of 0, which counts as near the high.
    """
    year = _w().rowsBetween(-251, 0)
    rows = series.select(BY, AT, VALUE)
    for n in (20, 50, 200):
        rows = rows.withColumn(f"sma{n}", sma(VALUE, n))
    rows = rows.withColumn("prev1", F.lag(VALUE, 1).over(_w())).withColumn("prev5", F.lag(VALUE, 5).over(_w()))
    rows = rows.withColumn("__hi", F.max(VALUE).over(year)).withColumn("__lo", F.min(VALUE).over(year))
    more = recursive(series)
    golden = recent_cross(rows, "sma50", "sma200", 10, "sma_cross")
    macd = recent_cross(more, "macd", "macd_signal", 5, "macd_cross")
    last = latest(rows).join(latest(more).drop(AT, VALUE), BY).join(golden, BY, "left").join(macd, BY, "left")
    if quotes is not None:
        last = last.join(quotes, BY, "left")
    else:
        last = last.withColumn("price", c(VALUE)).withColumn("high_52w", c("__hi")).withColumn("low_52w", c("__lo"))
    pct = lambda base: F.coalesce(F.when(c(base) != 0, (c("price") - c(base)) / c(base) * 100), F.lit(0.0))
    out = last.withColumn("pct_1d", pct("prev1")).withColumn("pct_5d", pct("prev5")).withColumn("pct_high", pct("high_52w")).withColumn("pct_low", pct("low_52w"))
    out = out.withColumn("trend", trend(c("price"), c("sma50"), c("sma200"))).withColumn("rsi_state", F.when(c("rsi_14") > 70, "overbought").when(c("rsi_14") < 30, "oversold").otherwise("normal"))
    signals = F.array(
        F.when(c("sma_cross") == "up", "golden-cross").when(c("sma_cross") == "down", "death-cross"),
        F.when(c("macd_cross") == "up", "macd-bull-cross").when(c("macd_cross") == "down", "macd-bear-cross"),
        F.when(c("rsi_state") != "normal", F.concat(F.lit("rsi-"), c("rsi_state"))),
        F.when(c("pct_high") >= -3, "near-52w-high").when(c("pct_low") <= 3, "near-52w-low"),
        F.when(c("trend") == "bullish", "above-sma50-sma200").when(c("trend") == "bearish", "below-sma50-sma200"),
    )
    return out.withColumn("signals", F.filter(signals, lambda s: s.isNotNull())).drop("__hi", "__lo")


def slim(analysis: DataFrame) -> DataFrame:
    """The commentary's payload: rounded to 2 digits, RSI to 1, MACD to 4, halves up."""
    from ..functions.text import round_half_up as r

    two = [r(c(n), 2).alias(n) for n in ("price", "pct_1d", "pct_5d", "pct_high", "pct_low", "sma20", "sma50", "sma200")]
    return analysis.select(BY, *two, r(c("rsi_14"), 1).alias("rsi_14"), *[r(c(n), 4).alias(n) for n in ("macd", "macd_signal", "macd_histogram")], "trend", "rsi_state", "signals")


def watchlist(spark, rows=rules.WATCHLIST) -> DataFrame:
    """The dimension (ord, symbol, name, name_en, group, group_ord, group_name, group_name_en)."""
    groups = {g: (i, zh, en) for i, (g, zh, en) in enumerate(rules.ASSET_GROUPS)}
    return spark.createDataFrame([(i, s, n, e, g, *groups[g]) for i, (s, n, e, g) in enumerate(rows)], "ord int, symbol string, name string, name_en string, group string, group_ord int, group_name string, group_name_en string")


def display_name(locale: str) -> Column:
    return F.coalesce(c("name_en"), c("name")) if locale == "en" else c("name")


def analyze_watchlist(series: DataFrame, dimension: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """analyze() for the symbols of the dimension that have a series, with ord, name and group; sorted by ord.

    A symbol without rows has no result; symbols that aren't watched are left out before any window.
    """
    watched = F.broadcast(dimension)  # some dozens of rows
    out = analyze(series.join(watched.select(BY), BY, "left_semi"), quotes)
    return out.join(watched, BY).orderBy("ord")


def group_counts(rows: DataFrame, spark) -> DataFrame:
    """(group, n) of every asset group in order, also of those without rows."""
    groups = spark.createDataFrame([(i, g) for i, (g, _, _) in enumerate(rules.ASSET_GROUPS)], "group_ord int, group string")
    n = rows.groupBy("group").agg(F.count("*").alias("n"))
    return groups.join(n, "group", "left").select("group_ord", "group", F.coalesce("n", F.lit(0)).alias("n")).orderBy("group_ord")


def signal_tones(signals: Column) -> Column:
    """Array of (signal, tone); an unknown signal is neutral."""
    tones = F.create_map(*[F.lit(x) for kv in rules.SIGNAL_TONES.items() for x in kv])
    return F.transform(signals, lambda s: F.struct(s.alias("signal"), F.coalesce(F.element_at(tones, s), F.lit("neutral")).alias("tone")))
