"""One scan for many patterns, against plain re; and stages that skip what earlier ones reject."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import rx, scan
from corpusflow.operators import policy, routing, topics
from corpusflow.queries import common

c = F.col


def texts(seed: int, n: int) -> list[str | None]:
    """Texts of needles, words that rules hold, and what stands between."""
    r = random.Random(seed)
    words = sorted({w for p in policy._PATTERNS for w in rx.needles(p)} | {w for p in policy._PATTERNS for w in re.findall(r"[a-zA-Z一-鿿]{3,}", p)} | set(rules.INCLUDE_KEYWORDS))
    return [None, ""] + ["".join(r.choice([w, w.upper(), w.title(), w[:-1], w + "s"]) + r.choice([" ", "  ", "-", "", "\n", ", "]) for w in r.choices(words, k=r.randrange(1, 12))) for _ in range(n)]


def test_every_pattern_agrees_with_re(spark):
    given = texts(0, 400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").withColumn("low", F.lower("t"))
    df = df.withColumn(policy.HITS.column, policy.HITS.scanner.bits(c("low")))
    patterns = list(dict.fromkeys(policy._PATTERNS))
    got = {x.i: x for x in df.select("i", *[rx.matches(c("t"), p, low=policy.HITS).alias(f"p{k}") for k, p in enumerate(patterns)], *[policy.HITS.any(n).alias(n) for n in ("include", "exclude")]).collect()}
    seen = 0
    for i, t in enumerate(given):
        for k, p in enumerate(patterns):
            want = t is not None and bool(re.search(p, t, re.I | re.A))
            assert got[i][f"p{k}"] == want, (p, t)
            seen += want
        for name, words in (("include", rules.INCLUDE_KEYWORDS), ("exclude", rules.EXCLUDE_KEYWORDS)):
            assert got[i][name] == (t is not None and any(w in t.lower() for w in words))
    assert seen > 300


def test_more_patterns_than_a_word_has_bits(spark):
    names = [f"word{i:03d}x" for i in range(3 * scan.BITS + 5)]
    s = scan.Scanner(names, {"last": ["zzz", ""], "none": []})
    assert s.words == 4 and len(s.bit) == len(names) + 1
    hits = scan.Hits(s, "h")
    df = spark.createDataFrame([("word000x word%03dx" % (len(names) - 1),), ("zzz",), (None,)], "t string").withColumn("h", s.bits(c("t")))
    got = df.select(*[F.coalesce(hits.may(n), F.lit(False)) for n in names], hits.any("last"), hits.any("none")).collect()
    assert [[k for k, x in enumerate(row) if x] for row in got] == [[0, len(names) - 1], [len(names)], []]


def test_a_pattern_without_substrings_may_always_match(spark):
    s = scan.Scanner([r"\d+", "abc"])
    hits = scan.Hits(s, "h")
    assert hits.may(r"\d+") is None
    df = spark.createDataFrame([("x1",), ("ABC",), ("",)], "t string").withColumn("h", s.bits(F.lower("t")))
    assert [tuple(x) for x in df.select(rx.matches(c("t"), r"\d+", low=hits), rx.matches(c("t"), "abc", low=hits)).collect()] == [(True, False), (False, True), (False, False)]
    with pytest.raises(KeyError):
        hits.may("unknown")


def test_no_patterns(spark):
    s = scan.Scanner()
    assert spark.createDataFrame([("x",)], "t string").select(s.bits(c("t")).alias("h")).first().h.w0 == 0


def test_one_scan_for_a_row(spark, sf):
    """The plan of the staged filter has one Arrow function over the item's text, whatever the number of rules."""
    rows = routing.classified(routing.with_source(common.articles(spark, sf), common.sources(spark)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rows_that_early_stages_reject_have_no_types(spark, sf):
    base = policy.with_texts(routing.with_source(common.articles(spark, sf), common.sources(spark))).withColumn("excluded", policy.hard_excluded())
    out = routing._with_types(base, c("published_at").isNotNull())
    assert out.where("published_at is null and (d_type is not null or k_type is not null or official is not null)").count() == 0 and out.where("d_type is not null").count() > 0


def test_topics_against_plain_substrings(spark):
    now = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
    r = random.Random(4)
    words = ["Fetal", "growth", "IVF", "embryo-transfer", "&amp;", "mouse", "ﬁbroid", "trial"]
    rows = [(f"p{i}", " ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=8)), [r.choice(["Cohort", "Trial"])], now) for i in range(200)]
    wanted = [topics.Topic("a", ("fetal growth", "fibroid", ""), ("mouse",), ("trial",)), topics.Topic("b", ("embryo transfer",)), topics.Topic("c", ("ivf",), enabled=False), topics.Topic("d", ())]
    got = {(x.id, x.topic_id): x.topic_match for x in topics.scored(spark.createDataFrame(rows, "id string, title string, abstract string, publication_types array<string>, activity_at timestamp"), wanted, now).collect()}
    from corpusflow.functions.text import normal_phrase as norm

    want = {}
    for i, title, abstract, types, _ in rows:
        t, a, n = norm(title), norm(abstract), [norm(x) for x in types]
        for topic in wanted[:2]:
            has = lambda x, ws: any(norm(w) and norm(w) in x for w in ws)
            score = 0 if has(" ".join([t, a, *n]), topic.exclude) else 50 if has(t, topic.include) else (50 if any(norm(w) in n for w in topic.publication_types) else 40) if has(a, topic.include) else 0
            if score:
                want[i, topic.id] = score
    assert got == want and len(want) > 50


def test_blank_and_trim(spark):
    every = [" ", "\t", " x　", "﻿", "", "a b", "\n\x0bq ", None, "​"]
    got = spark.createDataFrame([(x,) for x in every], "t string").select(rx.trim(c("t")).alias("t"), rx.blank(c("t")).alias("b")).collect()
    spaces = " \t\n\x0b\f\r  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
    assert [(x.t, x.b) for x in got] == [(t.strip(spaces) if t is not None else None, not (t or "").strip(spaces)) for t in every]
