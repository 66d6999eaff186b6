"""Edges to models: what prompts hold, and what becomes of answers.  A model is a callable that the caller injects."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx
from ..storage import stored
from . import digest, rank

c = F.col
SUMMARIES = "struct<summaries:array<struct<url:string,summary:string>>>"
PAPERS = "struct<papers:array<struct<id:string," + ",".join(f"{k}:string" for k in rules.SUMMARY_FIELDS) + ">>>"
COMMENTARY = "struct<market_overview:string,watchlist:array<struct<symbol:string,display_name:string,stance:string,rationale:string>>,risk_caveat:string>"


#: Calls that a task has under way at once.
CALLS = 4


def _within(model: Callable[[str], str], prompt: str, seconds: float | None) -> str:
    """model(prompt), or an error once the time is over; the call itself, which nothing can stop, is left alone."""
    if seconds is None:
        return model(prompt)
    said: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            said.put((model(prompt), None))
        except Exception as e:
            said.put((None, e))

    threading.Thread(target=call, daemon=True).start()
    try:
        answer, error = said.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"timed out after {seconds:g} s") from None
    if error is not None:
        raise error
    return answer


def answered(prompts: DataFrame, model: Callable[[str], str], attempts: int = 1, hint: str = "", calls: int = CALLS, seconds: float | None = None) -> DataFrame:
    """prompts with answer and error: model(prompt) for each row, tried again with the hint at its end; a prompt's failure is its own.

    The model runs in the tasks, ``calls`` prompts of a batch at once, each attempt ``seconds`` long at most; it must be picklable.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(attempts):
            try:
                return _within(model, prompt + (hint if n else ""), seconds), None
            except Exception as e:
                error = str(e)[:200]
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls) as pool:
            for rows in batches:
                said = list(pool.map(one, rows["prompt"]))
                yield rows.assign(answer=[a for a, _ in said], error=[e for _, e in said])

    rows = prompts.drop("answer", "error")
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string, error string")


class AllFailed(RuntimeError):
    """No chunk of a run's reviews could be used."""


def checked_reviews(answers: DataFrame, candidates: int) -> DataFrame:
    """answers (chunk, answer) as they are, unless there are candidates and no answer parses: that ends the run."""
    good = answers.where(digest.parsed(c("answer"), digest.REVIEWS)["reviews"].isNotNull()).limit(1).count()
    if candidates and not good:
        raise AllFailed(f"all review chunks failed for {candidates} candidates")
    return answers


def review(capped: DataFrame, model: Callable[[str], str], size: int = 30, seconds: float | None = 90) -> DataFrame:
    """(chunk, answer) of the reviews of capped candidates (with place), in chunks of ``size``, each a task's call.

    A chunk that fails has no answer, and its candidates aren't reviewed; if all fail, an error.
    """
    prompts = digest.review_payload(rank.batches(capped, [c("place")], size))  # some prompts
    said = stored(answered(prompts.repartition(c("batch")), model, seconds=seconds))
    return checked_reviews(said.select(c("batch").alias("chunk"), "answer"), capped.count())


def enrichment_payload(items: DataFrame, kind: str) -> DataFrame:
    """(prompt, requested): all items (seq, url, title, excerpt, source, author) as one JSON array with the fields of an enricher."""
    title, more, excerpt, length = rules.ENRICHERS[kind]
    item = F.struct(c("url"), c("title").alias(title), *[F.coalesce(c(x), F.lit("")).alias(x) for x in more], F.substring(F.coalesce("excerpt", F.lit("")), 1, length).alias(excerpt))
    return items.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda s: s["i"])).alias("prompt"), F.count("*").alias("requested"))


def summaries_of(answers: DataFrame) -> DataFrame:
    """(url, summary, pos) of answers: of several for a URL the last; blank ones don't count; an answer that doesn't parse has none."""
    rows = answers.select(F.posexplode(digest.parsed(c("answer"), SUMMARIES)["summaries"]).alias("pos", "s")).select("pos", "s.*")
    rows = rows.where("coalesce(url, '') <> '' and coalesce(summary, '') <> ''")
    return rows.groupBy("url").agg(F.max_by(rx.trim(c("summary")), "pos").alias("summary"), F.max("pos").alias("pos"))


def undercounted(prompts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(requested, returned, undercount): under half of three items or more came back.  One row for each of both, so the join is of single rows."""
    n = summaries.agg(F.count("*").alias("returned"))
    return prompts.select("requested").crossJoin(F.broadcast(n)).withColumn("undercount", (c("requested") >= 3) & (c("returned") < c("requested") / 2))


def paper_payload(papers: DataFrame) -> DataFrame:
    """(id, prompt): ten fields of each paper as JSON, under the names of the wire; absent ones are left out."""
    item = F.struct("id", "pmid", "doi", "title", "abstract", "journal", "authors", "publication_types", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("published_at"), F.date_format("activity_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("activity_at"))
    return papers.select("id", F.to_json(item).alias("prompt"))


def paper_summary(item: Column, locale: str = "zh") -> Column:
    """struct of the eight fields, trimmed; blank ones say that the abstract doesn't report them."""
    return F.struct(*[F.coalesce(F.nullif(rx.trim(item[k]), F.lit("")), F.lit(rules.NOT_REPORTED[locale])).alias(k) for k in rules.SUMMARY_FIELDS])


def summarized(papers: DataFrame, answers: DataFrame, locale: str = "zh") -> DataFrame:
    """papers with summary and summary_status: the first answer of an id counts; without one the status is failed.

    answers: (chunk, answer); an answer that doesn't parse has no papers.
    """
    items = answers.select("chunk", F.posexplode(digest.parsed(c("answer"), PAPERS)["papers"]).alias("pos", "p")).where("p.id is not null")
    first = items.groupBy(c("p.id").alias("__id")).agg(F.min_by("p", F.struct("chunk", "pos")).alias("__p"))
    out = papers.drop("summary", "summary_status").join(first, c("id") == c("__id"), "left")
    out = out.withColumn("summary", F.when(c("__p").isNotNull(), paper_summary(c("__p"), locale)))
    return out.withColumn("summary_status", F.when(c("__p").isNotNull(), "success").otherwise("failed")).drop("__id", "__p")


def commentary_valid(parsed: Column) -> Column:
    """An overview and picks of the least lengths, every pick with symbol, stance and rationale."""
    least = rules.COMMENTARY
    bad = F.exists(parsed["watchlist"], lambda p: p["symbol"].isNull() | p["stance"].isNull() | (F.coalesce(F.char_length(p["rationale"]), F.lit(0)) < least["rationale"]))
    fine = (F.char_length(parsed["market_overview"]) >= least["overview"]) & (F.size(parsed["watchlist"]) >= least["picks"]) & ~bad
    return F.coalesce(fine, F.lit(False))


def commentary(answers: DataFrame) -> DataFrame:
    """One row (market_overview, watchlist, risk_caveat, attempt): the first valid of the answers (attempt, answer) within
    three attempts, else the empty one with the fixed caveat (attempt null)."""
    rows = answers.where(c("attempt") <= rules.COMMENTARY["attempts"]).withColumn("p", digest.parsed(c("answer"), COMMENTARY)).where(commentary_valid(c("p")))
    best = rows.agg(F.min_by("p", "attempt").alias("p"), F.min("attempt").alias("attempt"))
    none = F.array().cast("array<struct<symbol:string,display_name:string,stance:string,rationale:string>>")
    return best.select(F.coalesce("p.market_overview", F.lit("")).alias("market_overview"), F.coalesce("p.watchlist", none).alias("watchlist"), F.coalesce("p.risk_caveat", F.lit(rules.COMMENTARY_CAVEAT)).alias("risk_caveat"), "attempt")


def commentary_payload(slim: DataFrame, watchlist: DataFrame, locale: str = "zh") -> DataFrame:
    """(prompt): analysed symbols (timeseries.slim()) with their name and group, as one JSON array in watchlist order."""
    name = F.coalesce(c("name_en") if locale == "en" else F.lit(None).cast("string"), c("name"))
    rows = slim.join(F.broadcast(watchlist.select("symbol", "ord", name.alias("display_name"), "group")), "symbol")  # a dimension of some dozens of rows
    item = F.struct("symbol", "display_name", "group", *[x for x in slim.columns if x != "symbol"])
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))), lambda s: s["i"])).alias("prompt"))


def empty_report(spark, locale: str = "zh") -> DataFrame:
    """The report of a day without articles: one row of constants."""
    text = rules.EMPTY_REPORT[locale]
    none = F.array().cast(digest.BRIEF)
    return spark.range(1).select(F.lit(text).alias("hero_headline"), F.lit(text).alias("daily_overview"), none.alias("tech_briefs"), none.alias("finance_briefs"), none.alias("politics_briefs"), F.lit(text).alias("editor_note"), F.array().cast("array<string>").alias("keywords"))


def digest_candidates(articles: DataFrame, limits: dict[str, int] = rules.CATEGORY_LIMITS) -> DataFrame:
    """Articles that go to a digest's prompt: of each category so many, a source in turn; number counts all of them."""
    out = None
    for i, (category, most) in enumerate(limits.items()):
        rows = rank.interleaved(articles.where(c("category") == category), "source", [c("seq")], most).withColumn("__c", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("number", F.row_number().over(Window.orderBy("__c", "place"))).drop("__c", "place")  # some dozens of rows


TEXTS = ("hero_headline", "daily_overview", "editor_note", "keywords")


def daily_digest(articles: DataFrame, model: Callable[[str], str], locale: str = "zh", seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(briefs, texts) of a day: candidates, prompt, answer with one retry, and the join of the answer with the candidates.

    articles: (seq, url, title, source, category, excerpt, published_at, summary, review_status, low_priority).  Without
    articles the empty report, and no call.  The second call has the same prompt, after a failure or an answer
    that doesn't parse; if it fails too, an error.
    """
    spark = articles.sparkSession
    few = stored(digest_candidates(articles))  # some dozens of rows
    if not few.limit(1).count():
        return spark.createDataFrame([], "category string, place long, title string, url string, source string, summary string, importance int, restored boolean"), empty_report(spark, locale).select(*TEXTS)
    item = digest.digest_payload(few, [c("number")])
    prompt = item.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("number", F.struct(c("number").alias("n"), *[x for x in item.columns if x != "number"]).alias("i")))), lambda x: x["i"])).alias("prompt"))
    for last in (False, True):
        said = stored(answered(prompt, model, seconds=seconds).withColumn("parsed", digest.parsed(c("answer"), digest.DIGEST)))
        got = said.select("error", c("parsed").isNotNull().alias("good")).first()
        if got.good:
            break
        if last:
            raise RuntimeError(f"no digest: {got.error or 'the answer does not parse'}")
    items = said.select(F.explode(digest.sections(c("answer"))).alias("s")).select("s.section", "s.category", "s.pos", "s.b.url", "s.b.summary", "s.b.importance")
    return digest.sanitized(items, few), said.select(*[c(f"parsed.{x}") for x in TEXTS])
