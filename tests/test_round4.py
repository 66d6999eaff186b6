"""Cases of the reviewer's findings of round 3."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions import rx, scan, text, udf
from corpusflow.operators import dedupe, digest, history, topics
from corpusflow.plans import research
from corpusflow.sources import html

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def test_fallback_breaks_ties_by_the_names_of_records(spark):
    """Two cached papers of one score: pmid:10 comes before pmid:9, whatever ids the cache's rows have."""
    rows = [(9, "p00000009", "9", None, "Growth of things 9"), (10, "p00000010", "10", None, "Growth of things 10")]
    cached = spark.createDataFrame(rows, "seq long, id string, pmid string, doi string, title string").selectExpr(
        "*", "'An abstract about the growth of things' as abstract", "'j' as journal", "array('Clinical Trial') as publication_types", "timestamp '2024-01-30 00:00:00' as activity_at"
    )

    def down(*_):
        raise OSError("no answer")

    shown = spark.createDataFrame([], "key string")
    limits = topics.Limits(min_score=0.0, max_per_topic=1, max_papers=1)
    r = research.run({"down": down}, cached, None, shown, (topics.Topic("t", ("growth",)),), NOW, lambda rows: rows, selection=limits)
    assert r.cached_fallback and [(x.id, x.pmid) for x in r.papers.collect()] == [("pmid:10", "10")]


def test_arrow_functions_get_small_batches(spark):
    """A batch of long texts is bounded by its bytes, not by 10,000 rows alone."""
    for f in (lambda: text.nfkc(F.col("id").cast("string")), lambda: scan.Scanner(lists={"x": ["y"]}).bits(F.col("id").cast("string"))):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        f()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"

    @udf.arrow("long")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("ab"), 10_000).alias("x"))  # 40 MB
    assert texts.select(rows(F.col("x")).alias("n")).agg(F.max("n")).first()[0] <= 400


def test_only_broken_answers_are_repaired(spark, monkeypatch):
    """Answers that parse strictly don't pass through Python."""

    @udf.arrow("string")
    def failing(s: pd.Series) -> pd.Series:
        assert s.isna().all()
        return s

    monkeypatch.setattr(text, "repair_json", failing)
    df = spark.createDataFrame([('{"a": 1}',), (None,)], "x string")
    assert [x[0] and x[0].a for x in df.select(digest.parsed(F.col("x"), "struct<a:int>")).collect()] == [1, None]


def test_stream_input_is_dealt_into_files_without_a_sort(spark, tmp_path, monkeypatch):
    """Files of a stream's input follow the table's rows, so that no task holds a quarter of it."""
    from corpusflow.queries import papers

    monkeypatch.setattr(papers, "FILE_ROWS", 100)
    rows = spark.range(4000).withColumnRenamed("id", "seq")
    each = papers._dealt(rows, str(tmp_path / "in"))
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert each == 10 and len(sizes) == 40 and sum(sizes) == 4000 and max(sizes) < 200
    assert papers._dealt(rows.limit(0), str(tmp_path / "none")) == 1


def test_a_page_is_walked_twice_at_most(monkeypatch):
    """What a page says is found in one walk of its nodes, and one more where some were taken out."""
    walks, walk = [], html.Node.walk
    monkeypatch.setattr(html.Node, "walk", lambda self: walks.append(self.tag) or walk(self))
    page = '<nav class="lead">no</nav><meta name="date" content="2024-01-02"><time datetime="2024-01-03"></time><main>a  b<p class="lead">c</p></main><i class="category">K</i>'
    got = html.page_metadata(page)
    assert len(walks) == 2 and (got["meta_dates"], got["time"], got["body"], got["excerpts"], got["types"]) == (["2024-01-02"], "2024-01-03", "a bc", ["c", "a bc"], ["K"])


def test_reviews_are_joined_to_the_last_candidate_of_a_url(spark, sf, monkeypatch):
    """Rules run only for the candidates that count: one for each URL."""
    from corpusflow.operators import routing
    from corpusflow.queries import articles

    seen, classified, made = [], routing.classified, articles.articles
    monkeypatch.setattr(articles, "articles", lambda *a: made(*a).withColumn("url", F.concat(F.lit("https://acog.example.org/"), F.col("seq") % 7)))
    monkeypatch.setattr(routing, "classified", lambda df: seen.append(df) or classified(df))
    articles.review_join(spark, sf)
    n = seen[0].agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls")).first()
    assert n.n == n.urls == 7


def _python_nodes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ")


def _texts(spark):
    rows = [(1, "a", "Growth of the K&amp;R", "On the growth&#1;of Ｔhings", ["Clinical Trial", None]), (2, "b", None, "ΟΔΟΣ\u0001rat", []), (3, "c", "ΟΔΟΣ", "İ and ﬁ, of the", None), (4, "d", "of", "the", ["a\u0001b"])]
    return spark.createDataFrame(rows, "seq long, id string, title string, abstract string, publication_types array<string>").withColumn("activity_at", F.lit(NOW))


def test_topics_are_scored_by_two_workers_a_task(spark):
    """Texts of a paper pass through Python for compatibility forms at once, and both scans are one worker's: four workers a task before."""
    wanted = (topics.Topic("t", ("of the", "fi"), exclude=("growth of things",), publication_types=("clinical trial",)), topics.Topic("u", ("οδος", "rat")))
    out = topics.scored(_texts(spark), wanted, NOW)
    assert _python_nodes(out) == 2
    # an excluded phrase counts in the whole text, also over the edge of two parts
    assert sorted((r.id, r.topic_id, r.topic_match) for r in out.collect()) == [("b", "u", 40.0), ("c", "t", 40.0), ("c", "u", 50.0)]


def test_parts_of_a_marked_text_have_the_normal_forms_of_titles(spark):
    parts = F.array(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    whole = text.marked(parts)
    for r in _texts(spark).select(text.normal_parts(whole, F.lower(whole)).alias("p"), F.array(*[F.coalesce(text.normalize_title(F.col(x)), F.lit("")) for x in ("title", "abstract")]).alias("each")).collect():
        assert r.p == r.each
    # a numeric entity of the mark doesn't part a title
    assert spark.sql("select array('a&#1;b', 'c') as x").select(text.normalize_titles(F.col("x")).alias("y")).first().y == ["a b", "c"]


def test_keys_of_papers_are_made_once(spark):
    """Titles pass through Python for the keys once, not again for what is left of the plan."""
    assert _python_nodes(dedupe.paper_components(_texts(spark).selectExpr("*", "'7' as pmid", "cast(null as string) as doi"))) == 0


def test_papers_are_not_shuffled_for_few_shown_ones(spark):
    """What was shown of the papers has a known size when the papers' texts meet it."""
    p = _texts(spark).selectExpr("*", "cast(seq as string) as pmid", "cast(null as string) as doi")
    out = history.unshown_papers(p, spark.sql("select 'pmid:2' as key"))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() and sorted(r.id for r in out.collect()) == ["a", "c", "d"]


def test_words_are_looked_for_in_a_text_that_is_made_once(spark):
    """A text that is an expression isn't computed for each of many words."""
    pattern = "|".join(f"{x}word" for x in "abcdefghi")
    rows = spark.range(3).selectExpr("element_at(array('an hword', 'none', null), cast(id as int) + 1) as x")
    low = F.lower(F.concat("x", F.lit("!")))
    assert [r.y for r in rows.select(rx.matches(F.col("x"), pattern, low=low).alias("y")).collect()] == [True, False, False]
    assert "exists(array(lower(concat(" in rows.select(rx.may_match(low, pattern).alias("y"))._jdf.queryExecution().analyzed().toString()
