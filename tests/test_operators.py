"""Operators against plain loops over random rows."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import dedupe, digest, history, rank, timeseries
from corpusflow.sources import feeds, html
from corpusflow.sources.registry import RunLimits
from corpusflow.streaming import state

c = F.col


@pytest.mark.parametrize("seed", range(2))
def test_greedy_two_keys(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abcdefghij") if r.random() > 0.05 else "", r.choice("uvwxyz") + r.choice("123")) for i in range(60)]
    df = spark.createDataFrame(rows, "o long, a string, b string")
    got = sorted(x.o for x in dedupe.greedy_two_keys(df, "o", "a", "b").collect())
    assert got == dedupe.greedy_fold(pd.DataFrame(rows, columns=["o", "a", "b"]))


@pytest.mark.parametrize("folded", [1, 3, 7])
def test_greedy_two_keys_in_parts_of_components(spark, monkeypatch, folded):
    """Only the first rows of a component are folded at once: the order holds across folds."""
    monkeypatch.setattr(dedupe, "FOLDED_ROWS", folded)
    monkeypatch.setattr(dedupe, "PARALLEL_ROUNDS", 1)
    r = random.Random(folded)
    rows = [(i, f"a{r.randrange(12)}", f"b{r.randrange(12)}") for i in range(40)]
    got = sorted(x.o for x in dedupe.greedy_two_keys(spark.createDataFrame(rows, "o long, a string, b string"), "o", "a", "b").collect())
    assert got == dedupe.greedy_fold(pd.DataFrame(rows, columns=["o", "a", "b"]))


def test_a_chain_of_many_links_takes_few_rounds(spark, monkeypatch):
    """Row i shares a key with i - 1 and the other with i + 1: each depends on the one before."""
    n, counted = 300_000, []
    rows = spark.range(n).select(c("id").alias("o"), F.concat(F.lit("a"), F.floor(c("id") / 2)).alias("a"), F.concat(F.lit("b"), F.floor((c("id") + 1) / 2)).alias("b"))
    real = dedupe._folded
    monkeypatch.setattr(dedupe, "_folded", lambda open_: counted.append(1) or real(open_))
    got = dedupe.greedy_two_keys(rows, "o", "a", "b")
    assert got.agg(F.count("*"), F.sum("o")).first()[:] == (n // 2, sum(range(0, n, 2))) and len(counted) <= 5


def test_a_key_of_a_third_of_all_rows(spark):
    """Joins on keys have an exchange below each side, so that adaptive execution can split a hot key."""
    n = 3000
    rows = spark.range(n).select(c("id").alias("o"), F.when(c("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), c("id"))).alias("a"), F.concat(F.lit("b"), c("id") % 1000).alias("b"))
    got = {x.o for x in dedupe.greedy_two_keys(rows, "o", "a", "b").collect()}
    assert got == set(dedupe.greedy_fold(rows.toPandas()))
    keys = rows.select("o", c("a").alias("k")).unionByName(rows.select("o", c("b").alias("k")))
    found = {x.o: x.component for x in dedupe.components(keys, "o", "k").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o in range(n):
        for k in ("hot" if o % 3 == 0 else f"a{o}", f"b{o % 1000}"):
            x, y = root(o), root(k)
            parent[x] = y
    least = {}
    for o in range(n):
        least.setdefault(root(o), o)
    assert found == {o: least[root(o)] for o in range(n)}


def test_greedy_two_keys_of_a_long_chain(spark):
    """Each row conflicts with the next: the rounds end, and what is left is folded."""
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(70)] + [(100 + i, "hot", f"c{i}") for i in range(20)]
    got = sorted(x.o for x in dedupe.greedy_two_keys(spark.createDataFrame(rows, "o long, a string, b string"), "o", "a", "b").collect())
    assert got == dedupe.greedy_fold(pd.DataFrame(rows, columns=["o", "a", "b"])) and len(got) == 36


def test_components(spark):
    r = random.Random(3)
    rows = [(i, f"k{r.randrange(60)}") for i in range(80) for _ in range(r.randrange(3))]
    parent = {i: i for i in range(80)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key: dict = {}
    for i, k in rows:
        a, b = find(i), find(by_key.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*rows, *[(i, None) for i in range(80)]], "n long, k string")
    assert {x.n: x.component for x in dedupe.components(df, "n", "k").collect()} == {i: find(i) for i in range(80)}


@pytest.mark.parametrize("seed", range(2))
def test_interleaving(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"s{r.randrange(5)}", r.randrange(20)) for i in range(40)]
    by: dict = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    queues = [sorted(q, key=lambda x: -x[2]) for q in by.values()]
    want = []
    while any(queues) and len(want) < 17:
        for q in queues:
            if q and len(want) < 17:
                want.append(q.pop(0)[0])
    df = spark.createDataFrame(rows, "seq long, s string, d int")
    got = rank.interleaved(df, "s", [F.desc("d"), F.asc("seq")], 17).orderBy("place").collect()
    assert [x.seq for x in got] == want


def test_capped_equals_the_greedy_walk(spark):
    r = random.Random(5)
    rows = [(i, f"t{r.randrange(4)}", r.randrange(10)) for i in range(50)]
    counts, want = {}, []
    for i, t, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
        if counts.get(t, 0) < 3 and len(want) < 8:
            counts[t] = counts.get(t, 0) + 1
            want.append(i)
    df = spark.createDataFrame(rows, "i long, t string, s int")
    assert [x.i for x in rank.capped(df, "t", [F.desc("s"), F.asc("i")], 3, 8).collect()] == want


def test_golden_record(spark):
    rows = [(1, "rss:1", None, "10.1/a", "T", "", ["rss"], ["b", "A"]), (2, "pmid:9", "9", None, "T", "J", ["pubmed"], ["a"]), (3, "x", None, None, "U", "K", ["rss"], [])]
    df = spark.createDataFrame(rows, "seq long, id string, pmid string, doi string, title string, journal string, source_kinds array<string>, authors array<string>")
    out = {r.component: r for r in dedupe.merge_groups(dedupe.paper_components(df), F.array_contains("source_kinds", "pubmed")).collect()}
    assert out[1].id == "pmid:9" and out[1].doi == "10.1/a" and out[1].journal == "J" and out[1].authors == ["a", "A", "b"] and out[1].members == 2
    assert out[3].id == "x"


def test_indicators_against_definitions():
    x = pd.Series([float(v) for v in (5, 6, 7, 6, 5, 4, 5, 6, 8, 9)])
    e = timeseries.ema_values(x.to_numpy(), 3)
    assert pd.isna(e[1]) and e[2] == 6.0 and e[3] == 6.0 and e[4] == 5.5
    assert len([v for v in timeseries.rsi_values(x.to_numpy(), 3) if v == v]) == 7
    assert all(v != v for v in timeseries.rsi_values(x.to_numpy()[:3], 3))


def test_link_list(spark):
    page = '<nav><a href="/n">navigation link</a></nav><ul><li><a href="/a#x">A long enough title</a> 3 March 2024 about oocytes</li><li><a href="https://else.org/b">Another long title</a></li><li><a href="/c">short</a></li></ul>'
    df = spark.createDataFrame([("s", page, "https://e.org/", None, [], ["jobs"], "tech")], "source_id string, html string, s_url string, s_allowed_hosts array<string>, s_keywords array<string>, s_exclude_keywords array<string>, s_category string")
    rows = html.link_list(df).collect()
    assert [(r.title, r.url, str(r.published_at)[:10]) for r in rows] == [("A long enough title", "https://e.org/a#x", "2024-03-03")]


def test_page_metadata():
    page = '<html><head><script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-02","description":" d  e "}]}</script><meta name="description" content="m"></head><body><header>no</header><main>text</main></body></html>'
    m = html.page_metadata(page)
    assert m["json_date"] == "2024-01-02" and m["excerpts"] == ["d e", "m", "text"] and m["modified"] is False
    assert html.page_metadata(None)["excerpts"] == [] and html.page_metadata("<p")["types"] == []


def test_atom(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="s"/><link href="https://e.org/1"/><summary>S</summary><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("a", "tech", feed), ("b", "tech", "no xml"), ("c", "tech", None)], "source_id string, category string, payload string")
    rows = feeds.articles(df).collect()
    assert [(r.source_id, r.title, r.url, r.excerpt) for r in rows] == [("a", "T", "https://e.org/1", "S")]


def test_page_rows(spark):
    page = '<div class="issueDate">2024-05-01</div><article><span class="section">述评</span><h3><a href="/CN/1">Title one</a></h3><p class="authors">A; B</p><p class="doi">10.1234/x</p></article>'
    df = spark.createDataFrame([("s", "tech", page, "https://e.org/")], "source_id string, s_category string, html string, s_url string")
    r = html.page_rows(df, "contents").first()
    assert (r.title, r.section, r.doi, str(r.published_at)[:10]) == ("Title one", "述评", "10.1234/x", "2024-05-01")


def test_run_limits():
    assert RunLimits.parse({"maxPapers": 7}, {"RESEARCH_MIN_SCORE": "55"}).min_score == 55
    for bad in ({"max_papers": 0}, {"enabled": 1}, {"what": 1}, {"cacheDays": "x"}):
        with pytest.raises(ValueError, match="runtime"):
            RunLimits.parse(bad)


def test_window_start():
    now = dt.datetime(2024, 1, 10)
    assert state.window_start(None, now) == dt.datetime(2024, 1, 3) and state.window_start(now, now) == dt.datetime(2024, 1, 8)


def test_failed_sources_fall_back(spark):
    cached = spark.createDataFrame([(1, "a", "1", None, "t", ["pubmed"], dt.datetime(2024, 1, 9))], "seq long, id string, pmid string, doi string, title string, source_kinds array<string>, activity_at timestamp")

    def fails():
        raise OSError("no network")

    shown = spark.createDataFrame([], "key string")
    def breaks():  # only when it is read whole
        return cached.withColumn("id", F.when(c("seq") == 1, F.raise_error(F.lit("broken page"))).otherwise(c("id")))

    assert state.discovered({"a": fails}) == (None, [("a", False, 0, "no network")])
    rows, status = state.discovered({"a": fails, "b": lambda: cached, "c": breaks})
    assert [(n, ok, k) for n, ok, k, _ in status] == [("a", False, 0), ("b", True, 1), ("c", False, 0)] and rows.count() == 1
    both = state.merged(rows, cached, dt.datetime(2024, 1, 10), 90)
    assert both.first().members == 2 and history.unshown_papers(both, shown).count() == 1


def test_digest_sections(spark):
    answer = '{"tech_briefs":[{"url":"u","summary":"s","importance":3}],"politics_briefs":null'
    rows = spark.createDataFrame([(answer,)], "a string").select(F.explode(digest.sections(c("a"))).alias("i")).select("i.*").collect()
    assert [(r.category, r.b.url) for r in rows] == [("tech", "u")]


@pytest.mark.parametrize("rows", [1, 7, 40, 1000])
def test_segments_of_a_series_equal_the_fold(spark, rows):
    r = random.Random(rows)
    data = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100 + r.random() * 50) for s, n in (("a", 130), ("b", 25), ("c", 3), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp, close double").repartition(3)
    whole, cut = (sorted(tuple(x) for x in f.collect()) for f in (timeseries.recursive(df, (5, 12)), timeseries.recursive_long(df, (5, 12), rows=rows)))
    assert len(whole) == len(cut) == 159
    for a, b in zip(whole, cut):
        assert a[:3] == b[:3] and all((x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a[3:], b[3:])), (a, b)


def test_one_long_series_is_many_tasks_work(spark):
    n = 120_000
    df = spark.range(n).select(F.lit("a").alias("symbol"), F.timestamp_seconds("id").alias("ts"), (100 + F.sin(c("id") / 50) * 20 + F.rand(3)).alias("close"))
    df = timeseries.stored(df)
    got = timeseries.recursive_long(df, (26,), rows=10_000).orderBy("ts").toPandas()
    x = df.orderBy("ts").toPandas()["close"].to_numpy()
    for name, want in (("ema_26", timeseries.ema_values(x, 26)), ("rsi_14", timeseries.rsi_values(x)), ("macd_signal", timeseries.macd_values(x)[1])):
        a, b = got[name].to_numpy(float), want
        assert ((a != a) == (b != b)).all() and abs(a - b)[b == b].max() < 1e-9


def test_kept_history_is_joined_in_place(spark, sf):
    """The history isn't shuffled, however the sides are joined, and the rows are those of the whole join."""
    import uuid

    from corpusflow.queries import common

    a, name = common.articles(spark, sf), f"kept_{uuid.uuid4().hex}"
    for date, part in (("2024-01-01", 0), ("2024-01-05", 1), ("2024-01-03", 2)):
        history.keep(history.keyed(a.where(c("seq") % 5 == part)), name, date)
    past = history.keyed(a.where("seq % 5 < 3")).withColumn("date", F.get(F.array(*map(F.lit, ("2024-01-01", "2024-01-05", "2024-01-03"))), (c("seq") % 5).cast("int")))
    new = a.where("seq % 5 >= 2")
    want = sorted(tuple(x) for x in history.against(new, past, "2024-01-05").select("seq", "matched_by", "matched_date").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = history.against_kept(new, name, "2024-01-05").select("seq", "matched_by", "matched_date")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(x) for x in out.collect()) == want and any(x[1] for x in want) and not all(x[1] for x in want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange by the join's keys: that of the articles' keys
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(kind") == 1
