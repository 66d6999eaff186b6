"""Model calls: several at once, within their time; runs that end when every chunk fails; the digest as a whole."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import models
from corpusflow.plans import daily
from corpusflow.queries import common

c = F.col


def test_slow_calls_overlap(spark):
    def slow(prompt: str) -> str:
        time.sleep(0.5)
        return prompt.upper()

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "i long, prompt string").coalesce(1)
    models.answered(prompts.limit(1), slow).collect()
    begun = time.monotonic()
    rows = models.answered(prompts, slow, calls=6).collect()
    assert time.monotonic() - begun < 4 and [(r.answer, r.error) for r in sorted(rows)] == [(f"P{i}", None) for i in range(12)]


def test_a_call_that_hangs_is_given_up(spark):
    def hangs(prompt: str) -> str:
        time.sleep(60 if prompt == "p1" else 0)
        return prompt

    begun = time.monotonic()
    rows = models.answered(spark.createDataFrame([("p0",), ("p1",), ("p2",)], "prompt string").coalesce(1), hangs, attempts=2, seconds=0.5).collect()
    assert time.monotonic() - begun < 20
    assert {r.prompt: (r.answer, r.error) for r in rows} == {"p0": ("p0", None), "p1": (None, "timed out after 0.5 s"), "p2": ("p2", None)}


def candidates(spark, n):
    return spark.createDataFrame([(i, i, f"https://x.org/{i}", f"t{i}", "src", "tech", "x" * 40, None, None, None, None) for i in range(n)], "seq long, place long, url string, title string, source string, category string, excerpt string, published_at timestamp, content_type string, document_type string, meta string")


def test_reviews_fail_by_chunk_and_all_failing_is_an_error(spark):
    def some(prompt: str) -> str:
        rows = json.loads(prompt)
        if rows[0]["title"] == "t0":
            raise RuntimeError("no answer")
        return json.dumps({"reviews": [{"url": r["url"], "status": "accepted", "summary": "s"} for r in rows]})

    def none(prompt: str) -> str:
        return "nothing that parses"

    out = {r.chunk: r.answer for r in models.review(candidates(spark, 70), some).collect()}
    assert set(out) == {0, 1, 2} and out[0] is None and len(json.loads(out[1])["reviews"]) == 30 and len(json.loads(out[2])["reviews"]) == 10
    with pytest.raises(models.AllFailed, match="for 40 candidates"):
        models.review(candidates(spark, 40), none)
    assert models.review(candidates(spark, 0), none).count() == 0


def test_a_run_ends_if_all_chunks_fail(spark, sf):
    a, past = common.articles(spark, sf), None
    past = daily.history.keyed(a.where("false")).withColumn("date", F.lit("2024-01-30"))
    bad = spark.createDataFrame([(0, "no json"), (1, None)], "chunk long, answer string")
    with pytest.raises(models.AllFailed):
        daily.run(a, common.sources(spark), past, bad, common.NOW, "2024-01-31")


def test_a_run_with_a_model(spark, sf):
    def model(prompt: str) -> str:
        return "Sure: ```json\n" + json.dumps({"reviews": [{"url": r["url"], "status": "accepted", "summary": "fine"} for r in json.loads(prompt)]}) + "\n```"

    a = common.articles(spark, sf)
    past = daily.history.keyed(a.where("seq % 5 = 0")).withColumn("date", F.lit("2024-01-30"))
    r = daily.run(a, common.sources(spark), past, model, common.NOW, "2024-01-31")
    s = daily.statistics(r).first().asDict()
    assert 0 < s["semantic_accepted"] <= s["semantic_reviewed"] <= 60 and 0 < s["final_displayed"] <= 15
    assert s["fetched_total"] == a.count() == r.judged.count() and s["deterministic_accepted"] == r.judged.where("reason is null").count() and s["final_displayed"] == r.selected.count()


ARTICLES = "seq long, url string, title string, source string, category string, excerpt string, published_at timestamp, summary string, review_status string, low_priority boolean"


def day(spark, n):
    kinds = ("tech", "finance", "politics")
    return spark.createDataFrame([(i, f"https://x.org/{i}", f"t{i}", f"s{i % 4}", kinds[i % 3], "e" * 300, dt.datetime(2024, 1, 5), f"sum {i}", "accepted", i == 3) for i in range(n)], ARTICLES)


def test_the_digest_as_a_whole(spark, tmp_path):
    """The first answer doesn't parse; the second repeats a URL, invents one and misses others, which come back."""
    flag = str(tmp_path / "asked")

    def model(prompt: str) -> str:
        import os

        rows = json.loads(prompt)
        assert all(len(r["excerpt"]) == 200 and r["published_at"].startswith("2024-01-05") for r in rows) and [r["n"] for r in rows] == list(range(1, len(rows) + 1))
        if not os.path.exists(flag):
            open(flag, "w").close()
            return "one moment"
        of = lambda k: [{"url": r["url"], "summary": "", "importance": 12} for r in rows if r["category"] == k][:2]
        return json.dumps({"hero_headline": "h", "daily_overview": "o", "editor_note": "n", "keywords": ["k"], "tech_briefs": of("tech") * 2 + [{"url": "https://no.org", "summary": "x", "importance": 3}], "finance_briefs": of("finance"), "politics_briefs": []})

    briefs, texts = models.daily_digest(day(spark, 12), model)
    rows = briefs.collect()
    assert texts.first()[:] == ("h", "o", "n", ["k"]) and len(rows) == 12 and len({r.url for r in rows}) == 12
    assert sum(not r.restored for r in rows) == 4 and {r.importance for r in rows if not r.restored} == {10, 5} and all(r.summary.startswith("sum") for r in rows)


def test_no_articles_no_call(spark):
    def never(prompt: str) -> str:
        raise AssertionError

    briefs, texts = models.daily_digest(day(spark, 0), never, "en")
    assert briefs.count() == 0 and texts.first().hero_headline.startswith("No important update")


def test_a_digest_that_fails_twice_is_an_error(spark):
    def broken(prompt: str) -> str:
        raise RuntimeError("quota")

    with pytest.raises(RuntimeError, match="quota"):
        models.daily_digest(day(spark, 3), broken)
