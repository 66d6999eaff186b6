"""Sinks: atomic state, dated JSON, append logs, Markdown, HTML, site index, expiring caches."""

from __future__ import annotations

import datetime as dt
import html

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text
from . import commits

c = F.col


_fs = commits.hadoop


def replace_atomically(df: DataFrame, path: str) -> None:
    """Makes df the state under ``path``: readers (read_current()) see the old rows or the new ones, also if the writer dies.

    Of two writers the later one's rows stay, and neither deletes what the other is writing; the state before is
    kept for readers that have begun, older ones are deleted.
    """
    commits.commit(df.sparkSession, path, lambda s: commits.Change(replace={"state": df}))
    commits.expire(df.sparkSession, path, 2)


def read_current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table that replace_atomically() wrote last; None if it never did."""
    now = commits.latest(spark, path)
    return commits.read(spark, path, now, "state", schema) if now.number else None


def write_dated(df: DataFrame, path: str, date: str) -> None:
    """JSON under date=<date>; a run replaces its own date only."""
    df.withColumn("date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fresh_cache(cache: DataFrame, now: dt.datetime) -> DataFrame:
    return cache.where(c("expires_at") > F.lit(now))


def with_ttl(rows: DataFrame, now: dt.datetime, days: int = 14) -> DataFrame:
    return rows.withColumn("expires_at", F.lit(now + dt.timedelta(days=days)))


def markdown(briefs: DataFrame, titles: dict[str, str], empty: str = "") -> DataFrame:
    """(markdown): sections in the order of titles, their briefs by place; a section without briefs says ``empty``."""
    line = F.concat(F.lit("### ["), c("title"), F.lit("]("), c("url"), F.lit(")\n"), c("source"), F.lit(" · "), F.coalesce(c("importance"), F.lit(0)).cast("string"), F.lit("/10\n\n"), c("summary"), F.lit("\n"))
    spark = briefs.sparkSession
    heads = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(titles.items())], "o int, category string, head string")
    bodies = briefs.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    block = F.concat(F.lit("## "), c("head"), F.lit("\n\n"), F.coalesce("body", F.lit(empty + "\n")))
    return heads.join(bodies, "category", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", block.alias("b")))), lambda s: s["b"]), "\n").alias("markdown"))


def papers_markdown(papers: DataFrame, head: str, signal: str, failed: str = "") -> DataFrame:
    """(markdown): a section of papers by place: title with link, original title, meta line, score, topic, the summary's fields."""
    title = F.coalesce(F.nullif(c("summary.title_zh"), F.lit("")), c("title"))
    points = [F.concat(F.lit(f"- **{k}:** "), c(f"summary.{k}")) for k in rules.SUMMARY_FIELDS[1:]]
    body = F.when(c("summary").isNotNull(), F.concat_ws("\n", *points)).otherwise(F.lit(failed))
    lines = F.concat_ws("\n", F.concat(F.lit("### ["), title, F.lit("]("), c("url"), F.lit(")")), c("title"), c("meta"), F.format_string("%.2f", c("total")), c("topic_id"), F.lit(""), body, F.lit(""))
    every = papers.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", lines.alias("l")))), lambda s: s["l"]), "\n").alias("b"))
    return every.select(F.concat(F.lit(f"## {head}\n\n{signal}\n\n"), c("b")).alias("markdown"))


def html_items(briefs: DataFrame) -> DataFrame:
    """(category, place, html): one escaped list item for each brief."""
    e = text.escape_html
    return briefs.select("category", "place", F.concat(F.lit('<li class="brief"><a href="'), e(c("url")), F.lit('">'), e(c("title")), F.lit("</a> <span>"), e(c("source")), F.lit("</span><p>"), e(c("summary")), F.lit("</p></li>")).alias("html"))


MOST_ON_PAGE = 200


def html_page(briefs: DataFrame, titles: dict[str, str], title: str) -> str:
    """A page of a report, gathered on the driver; more than 200 briefs are an error, as a report has some dozens."""
    rows = html_items(briefs).limit(MOST_ON_PAGE + 1).collect()
    if len(rows) > MOST_ON_PAGE:
        raise ValueError(f"a report has at most {MOST_ON_PAGE} briefs")
    e = html.escape
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for k, head in titles.items():
        own = [r.html for r in sorted(rows, key=lambda r: r.place) if r.category == k]
        if own:
            parts.append(f"<section><h2>{e(head)}</h2><ul>" + "".join(own) + "</ul></section>")
    return "".join(parts) + "</body></html>"


def site_index(spark: SparkSession, root: str) -> DataFrame:
    """(date, path, size), newest first: reports <date>/<date>.html under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root).select("path", c("length").alias("size"))
    date = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/([^/]*)\.html$", 1)
    named = date == F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/([^/]*)\.html$", 2)
    return files.select(date.alias("date"), "path", "size").where((c("date") != "") & named).orderBy(F.desc("date"))


def build_site(spark: SparkSession, root: str, wanted: str) -> list[tuple[str, int]]:
    """Removes reports whose title isn't ``wanted``, writes index.html (the newest report) and archive.html; (date, size), newest first.

    Reports are read where they lie: a page's text moves through an executor, only names and sizes come to the driver.
    """
    title = F.regexp_extract(F.decode("content", "UTF-8"), "(?is)<title>(.*?)</title>", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root)
    bad = files.where(~title.startswith(wanted)).select("path").where(c("path").rlike(r"/\d{4}-\d{2}-\d{2}/[^/]*\.html$")).collect()
    fs, _, Path = _fs(spark, root)
    for r in bad:
        fs.delete(Path(r.path).getParent(), True)
    found = [(r.date, r.path, r.size) for r in site_index(spark, root).collect()]
    if not found:
        raise ValueError(f"no report under {root}")
    util, conf = spark._jvm.org.apache.hadoop.fs.FileUtil, spark._jsc.hadoopConfiguration()
    fs.delete(Path(f"{root}/index.html"), False)
    util.copy(fs, Path(found[0][1]), fs, Path(f"{root}/index.html"), False, conf)
    rows = "".join(f'<li><a href="./{d}/{d}.html">{d}</a> <span class="size">{n / 1024:.0f} KB</span></li>' for d, _, n in found)
    out = fs.create(Path(f"{root}/archive.html"), True)
    out.write(bytearray(f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(wanted)}</title></head><body><ul>{rows}</ul></body></html>".encode()))
    out.close()
    return [(d, n) for d, _, n in found]


OUTPUTS = ("report", "articles", "displayed")


def write_run(report: DataFrame, articles: DataFrame, displayed: DataFrame, path: str, date: str) -> commits.Snapshot:
    """The three outputs of a run, by date: its report, all articles it chose from, and what it displayed.

    One commit for the three, in place of its date's: no reader sees those of different runs.
    """
    outputs = {f"{name}/date={date}": df for name, df in zip(OUTPUTS, (report, articles, displayed))}
    return commits.commit(report.sparkSession, path, lambda s: commits.Change(replace=outputs), "json")


def read_run(spark: SparkSession, path: str, date: str, schemas: dict[str, str], snapshot: commits.Snapshot | None = None) -> dict[str, DataFrame]:
    """Outputs of the run of a date, all of one commit; an error if there is none."""
    s = snapshot or commits.latest(spark, path)
    if not all(s.tables.get(f"{name}/date={date}") for name in schemas):
        raise FileNotFoundError(f"{path}: no run of {date}")
    return {name: commits.read(spark, path, s, f"{name}/date={date}", schema, "json") for name, schema in schemas.items()}


def read_runs(spark: SparkSession, path: str, name: str, schema: str, before: str | None = None) -> DataFrame:
    """One output of the runs of all dates, with their date; before: of earlier dates only, whose files alone are read."""
    s = commits.latest(spark, path)
    dates = {k.rpartition("date=")[2]: v for k, v in s.tables.items() if k.startswith(f"{name}/date=")}
    folders = [f"{path}/{f}" for d, own in dates.items() if before is None or d < before for f in own]
    if not folders:
        return spark.createDataFrame([], f"{schema}, date string")
    return spark.read.schema(f"{schema}, date string").option("basePath", f"{path}/{name}").json(folders)


def tree_of(items: DataFrame, caps: dict[str, int], keep_order: list[str] | None = None) -> DataFrame:
    """(category, groups): category → subgroup → source → items, nested.

    items: (category, subgroup, source_id, ord, seq, published_at, title, url).  Newest
    first within a source (given order for ``keep_order``), capped by category, sources
    in registry order.
    """
    kept = c("source_id").isin(*(keep_order or [""]))
    when = F.when(kept, F.lit(None)).otherwise(F.coalesce(c("published_at").cast("timestamp").cast("double"), F.lit(0.0)))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), c("category")), F.lit(5)) if caps else F.lit(5)
    ranked = items.withColumn("n", F.row_number().over(Window.partitionBy("category", "subgroup", "source_id").orderBy(when.desc_nulls_last(), "seq"))).where(c("n") <= limit)
    by_source = ranked.groupBy("category", "subgroup", "source_id", "ord").agg(F.array_sort(F.collect_list(F.struct("n", "title", "url"))).alias("items"))
    by_group = by_source.groupBy("category", "subgroup").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "items"))).alias("sources"))
    return by_group.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("subgroup", "sources"))).alias("groups"))


def merged_top(items: DataFrame, k: int = 12, without_lang: str | None = None, done: Column | None = None) -> DataFrame:
    """The k newest of enabled sources, then without one language and without those already done."""
    best = items.where(F.coalesce("enabled", F.lit(True))).orderBy(F.coalesce(c("published_at").cast("timestamp").cast("double"), F.lit(0.0)).desc(), "seq").limit(k)
    best = best.where(~F.coalesce(c("lang") == without_lang, F.lit(False))) if without_lang else best
    return best.where(~done) if done is not None else best
