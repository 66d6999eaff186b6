"""State, sinks, model edges and composed runs over the driver's tables."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, text
from ..operators import digest, history, models, policy, rank, routing, timeseries, topics
from ..plans import daily, research
from ..sinks import files
from ..sources import connectors, html, registry
from ..storage import shared_dir, stored
from ..streaming import state
from . import articles as A
from . import connect, series
from .common import ARTICLES_SQL, NOW, NOW_SQL, SOURCES_SQL, articles, quoted, sources, sql_any, sql_contains, sql_fixed, sql_in, sql_match
from .papers import TOPICS, _PAPERS, papers

c = F.col
t = registry.table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusflow-{uuid.uuid4().hex}"


def _write(spark: SparkSession, path: str, content: str) -> None:
    fs, p, _ = files._fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


# sources that fail for themselves


def _dispatched(spark: SparkSession, sf: str) -> tuple[DataFrame | None, DataFrame]:
    """Feeds f0 to f4; f1 breaks while it is read, together with f0 and f2; f5 is disabled, one is never read."""
    payloads = connect._feeds(spark, sf, 25).select(F.concat(F.lit("f"), c("n")).alias("source_id"), F.lit("tech").alias("category"), "payload")

    def strict(rows: DataFrame) -> DataFrame:
        out = connectors.rss(rows)
        return out.withColumn("title", F.when(c("source_id") == "f1", F.raise_error(F.lit("broken")).cast("string")).otherwise(c("title")))

    names = [{"id": f"f{i}", "type": "rss" if i > 2 else "strict", "enabled": i < 5} for i in range(6)] + [{"id": "figo-news", "type": "rss"}, {"id": "f9", "type": "unknown"}]
    return registry.dispatched(payloads, names, {}, {"rss": connectors.rss, "strict": strict})


def dispatch_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _dispatched(spark, sf)[0].select("source_id", "title", "url", "category")


def dispatch_status(spark: SparkSession, sf: str) -> DataFrame:
    return _dispatched(spark, sf)[1].select("source_id", "ok", "fetched")


def run_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings parsed from both spellings and the environment, and the field that an error names."""
    given = [({}, {}), ({"maxPapers": 7, "min_score": 55.5}, {}), ({"cacheDays": 30}, {"RESEARCH_CACHE_DAYS": "60", "RESEARCH_ENABLED": "false"}), ({"max_papers": 21}, {}), ({"enabled": 1}, {}), ({"what": 2}, {})]
    rows = []
    for i, (settings, env) in enumerate(given):
        try:
            r = registry.RunLimits.parse(settings, env)
            rows.append((i, str(r.max_papers), f"{r.min_score:.1f}", str(r.cache_days), str(r.enabled).lower(), None))
        except ValueError as e:
            rows.append((i, None, None, None, None, str(e).split(":")[0]))
    return spark.createDataFrame(rows, "i int, max_papers string, min_score string, cache_days string, enabled string, error string")


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration for each brand of parts: its parts are the topics; some lack what they must have."""
    p, k = t(spark, sf, "part"), c("p_partkey")
    topic = F.struct(
        F.when(k % 41 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), k)).alias("id"), F.when(k % 97 == 0, F.lit(" ")).otherwise(c("p_name")).alias("name"), c("p_type").alias("description"),
        F.when(k % 89 == 0, F.array().cast("array<string>")).otherwise(F.array(c("p_brand"))).alias("include_keywords"), F.array().cast("array<string>").alias("exclude_keywords"), F.array(F.lit("Clinical Trial")).alias("publication_types"), F.when(k % 83 > 0, k % 2 == 0).alias("enabled"),
    )
    source = F.array(F.struct(F.lit("s").alias("id"), F.lit("S").alias("name"), F.when(F.min(k) % 5 == 0, "web").otherwise("pubmed").alias("kind"), F.lit("https://x.org").alias("url"), F.lit(True).alias("enabled")))
    whole = F.struct(F.lit(1).alias("schema_version"), F.array(F.lit("d")).alias("domain_keywords"), source.alias("sources"), F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), topic.alias("t")))), lambda x: x["t"]).alias("topics"))
    rows = p.groupBy(F.concat("p_brand", F.lit("/"), F.floor(k / 50)).alias("config")).agg(F.to_json(whole).alias("payload"))
    return registry.configs(rows)


def research_configs(spark: SparkSession, sf: str) -> DataFrame:
    return _configs(spark, sf).select("config", "problem")


def research_topics(spark: SparkSession, sf: str) -> DataFrame:
    return registry.topics_of(_configs(spark, sf)).select("config", "ord", "id", "name", F.array_join("include_keywords", ",").alias("include"), "enabled")


# state and sinks


def state_scan(spark: SparkSession, sf: str) -> DataFrame:
    """States that are missing, there, to be cleared, and in a broken format: the last is moved aside and stays."""
    base, schema = _folder(spark), "n_nationkey int, n_name string"
    t(spark, sf, "nation").select("n_nationkey", "n_name").write.parquet(f"{base}/good")
    _write(spark, f"{base}/bad/part-0.parquet", "no table")
    cases = [("missing", registry.read_state(spark, f"{base}/none", schema)), ("good", registry.read_state(spark, f"{base}/good", schema)), ("cleared", registry.read_state(spark, f"{base}/good", schema, clear=True)), ("broken", registry.read_state(spark, f"{base}/bad", schema))]
    aside = len([s for s in files._fs(spark, base)[0].listStatus(files._fs(spark, base)[1]) if s.getPath().getName().startswith("bad.broken-")])
    out = None
    for name, df in cases:
        one = df.agg(F.lit(name).alias("case"), F.count("*").alias("n"), F.max("n_name").alias("last"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(spark.createDataFrame([("aside", aside, None)], "case string, n bigint, last string"))


def state_switch(spark: SparkSession, sf: str) -> DataFrame:
    """A state written three times: readers see the last version, and two versions are kept."""
    base = f"{_folder(spark)}/state"
    for i in range(3):
        files.replace_atomically(t(spark, sf, "nation").where(c("n_regionkey") <= i), base)
    fs, p, _ = files._fs(spark, f"{base}/state")
    kept = len(fs.listStatus(p))
    return files.read_current(spark, base).select("n_nationkey", "n_name", F.lit(kept).alias("versions"))


def history_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Dated JSON, one date written twice, one file malformed."""
    base = _folder(spark)
    k = t(spark, sf, "customer").select("c_custkey", "c_name")
    for day, part in (("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-01", 2)):
        files.write_dated(k.where(c("c_custkey") % 3 == part), base, day)
    _write(spark, f"{base}/date=2024-01-03/x.json", '{"c_custkey": 1, "c_na')
    return registry.read_history(spark, base, "c_custkey bigint, c_name string").groupBy("date").agg(F.count("*").alias("n"), F.max("c_name").alias("last"))


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """Calls appended in two goes, old records under an old name, and a malformed line."""
    base = f"{_folder(spark)}/calls"
    e = t(spark, sf, "events").select(c("event_id").alias("durationMs"), F.when(c("event_id") % 3 > 0, c("event_type")).alias("backend"), (c("user_id") % 2 == 0).alias("success"), F.when(c("event_id") % 4 > 0, c("user_id")).alias("inputChars"), F.when(c("event_id") % 4 == 0, c("user_id") * 2).alias("promptChars"), F.lit("m").alias("model"))
    files.append_log(e.where("durationMs % 2 = 0"), base)
    files.append_log(e.where("durationMs % 2 = 1"), base)
    _write(spark, f"{base}/broken.json", '{"durationMs": "x", \nnot json\n')
    rows = registry.read_calls(spark, [base]).where("duration_ms is not null")
    return rows.groupBy("backend").agg(F.count("*").alias("calls"), F.sum("input_chars").alias("input_chars"), F.count_if(c("success")).alias("good"))


def run_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The three outputs of a run, of which the articles are read again for another rendering."""
    base = _folder(spark)
    a = articles(spark, sf).withColumn("summary", F.lit("s"))
    files.write_run(a.limit(1).select("title"), a.select("seq", "source_id", "title", "url", "excerpt", "published_at", "category", "content_type", "summary"), a.where("seq % 5 = 0").select("url"), base, "2024-01-31")
    run = files.read_run(spark, base, "2024-01-31", {"articles": registry.ARTICLES, "displayed": "url string"})
    back, shown = run["articles"], run["displayed"].distinct()
    return back.join(shown, "url", "left_semi").select("seq", "title", "excerpt", F.unix_timestamp("published_at").alias("published"), "content_type", "document_type", "summary")


def _briefs(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation")
    category = F.when(c("n_regionkey") < 2, "tech").when(c("n_regionkey") < 4, "politics").otherwise("other")
    return n.select(category.alias("category"), c("n_nationkey").alias("place"), F.concat(F.lit("<"), c("n_name"), F.lit(">")).alias("title"), F.concat(F.lit("https://n.org/"), c("n_nationkey")).alias("url"), F.lit("S & T").alias("source"), F.concat(F.lit("About "), c("n_name")).alias("summary"), (c("n_nationkey") % 10).alias("importance"))


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    return files.markdown(_briefs(spark, sf), {"politics": "Dynamics", "finance": "Surgery", "tech": "Guidelines"}, "Nothing new.")


def html_report(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(files.html_page(_briefs(spark, sf), {"politics": "Dynamics & more", "finance": "Surgery", "tech": "Guidelines"}, "A <report>"),)], "html string")


def site_list(spark: SparkSession, sf: str) -> DataFrame:
    """A site of a report for each nation's day; those of another title are removed, the newest is the index."""
    base = _folder(spark)
    for r in t(spark, sf, "nation").collect():  # 25 rows
        day = f"2024-01-{r.n_nationkey + 1:02}"
        _write(spark, f"{base}/{day}/{day}.html", f"<html><title>{'Brief' if r.n_regionkey < 3 else 'Old'} {r.n_name}</title></html>")
    _write(spark, f"{base}/2024-01-01/other.html", "<title>Brief</title>")
    rows = files.build_site(spark, base, "Brief")
    index = spark.read.text(f"{base}/index.html", wholetext=True).first().value
    return spark.createDataFrame([(d, n, d in index or i == 0) for i, (d, n) in enumerate(rows)], "date string, size bigint, first boolean")


def cache_expiry(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select("event_id", "ts")
    kept = files.with_ttl(rows, NOW, 14).withColumn("expires_at", c("expires_at") - F.make_interval(days=(c("event_id") % 30).cast("int")))
    return files.fresh_cache(kept, NOW).select("event_id")


# pages in detail


def _details(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that say their date, excerpt and type in different places."""
    k = c("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.concat(F.lit("About order "), k, F.lit(" of "), c("o_orderpriority"), F.lit(" with more words"))
    structured = F.when(k % 5 == 0, F.concat(F.lit('<script type="application/ld+json">[{"@graph":[{"datePublished":"'), day, F.lit('T00:00:00Z","description":"'), said, F.lit('","articleSection":"Update | Mar. 3, 2024"}]}]</script>'))).when(k % 5 == 4, '<script type="application/ld+json">{broken</script>').otherwise("")
    meta = F.when(k % 5 == 1, F.concat(F.lit('<meta name="citation_publication_date" content="'), day, F.lit('"><meta property="og:description" content="'), said, F.lit('"><meta name="prism.section" content="Guideline">'))).otherwise("")
    timed = F.when(k % 5 == 2, F.concat(F.lit('<time datetime="'), day, F.lit('"></time><div class="lead">short</div>'))).otherwise("")
    body = F.when(k % 5 == 3, F.concat(F.lit("<main>Published: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" "), said, F.lit('</main><span class="category">News</span>'))).otherwise("")
    return registry.spread(spark, sf, "orders").select(k, (k % 2 == 0).alias("strict"), F.concat(F.lit("<html><head>"), structured, meta, F.lit("</head><body><nav>Published: May 1, 2001</nav>"), timed, body, F.lit("</body></html>")).alias("html"))


def detail_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = html.detail_metadata(_details(spark, sf), structured_only=c("strict"))
    return out.select("o_orderkey", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "excerpt", "content_type", "content_type_evidence", "date_modified_found")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return stored(routing.classified(routing.with_source(articles(spark, sf), sources(spark))))


_TARGETS = ("acog", "bjog", "china-obgyn")


def detail_needs(spark: SparkSession, sf: str) -> DataFrame:
    return state.needs_details(_asked(spark, sf), _TARGETS).select("seq")


def _looked_up(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cache that knows every page, of two in three too long; pages without an answer, and some that say nothing."""
    a = _asked(spark, sf)
    said = lambda at, words, kind, silent=F.lit(False): [F.when(~silent, F.lit(at)).cast("timestamp").alias("published_at"), F.when(~silent, words).alias("excerpt"), F.when(~silent, kind).alias("content_type"), F.lit("metadata").alias("content_type_evidence")]
    cached = a.select(F.concat("url", F.lit("&gclid=2")).alias("url"), *said(dt.datetime(2024, 1, 2), "From the cache", "clinical update"), F.when(c("seq") % 3 == 0, F.lit(dt.datetime(2024, 2, 9))).otherwise(F.lit(dt.datetime(2024, 1, 9))).cast("timestamp").alias("expires_at"))
    extract = lambda misses: misses.where("seq % 4 > 0").select("url", *said(dt.datetime(2024, 1, 3), "From its page", "abstract", c("seq") % 4 == 1))
    return state.with_details(a, _TARGETS, cached, extract, NOW)


def detail_articles(spark: SparkSession, sf: str) -> DataFrame:
    """All articles after the look-up: those of the chosen URLs are filled, no others."""
    return _looked_up(spark, sf)[0].select("seq", F.unix_timestamp("published_at").alias("published"), "excerpt", "content_type", "content_type_evidence")


def detail_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept afterwards: what hadn't expired, and pages that said something."""
    known = _looked_up(spark, sf)[1]
    return known.groupBy("excerpt").agg(F.countDistinct("url").alias("urls"), F.unix_timestamp(F.max("expires_at")).alias("expires"))


def detail_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _looked_up(spark, sf)[2]


def detail_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Articles filled from details by canonical URL, of several for a URL one row as a whole."""
    a = articles(spark, sf)
    d = a.where("seq % 4 = 0").select(F.concat("url", F.lit("&gclid=1")).alias("url"), F.lit(dt.datetime(2024, 1, 3)).alias("published_at"), F.concat(F.lit("x"), c("seq") % 5003).alias("excerpt"), F.lit("news").alias("content_type"), F.lit("metadata").alias("content_type_evidence"))
    return state.enriched(a, d).select("seq", F.unix_timestamp("published_at").alias("published"), "excerpt", "content_type", "content_type_evidence")


# labels and choices


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation")
    stance = F.get(F.array(*map(F.lit, ("看多", "偏下行", "中性", "Bullish", "bearish", ""))), c("n_nationkey") % 6)
    title = F.get(F.array(*map(F.lit, ("World Cup opens", "Trade talks", "F1 race", "F10 plan", "足球赛事", "A squadron"))), c("n_nationkey") % 6)
    return n.select("n_nationkey", policy.stance_tone(stance).alias("stance"), policy.importance_tone(c("n_nationkey") % 10).alias("importance"), policy.is_sports(title).alias("sports"), dates.day_key(F.timestamp_seconds(c("n_nationkey") * 5000 + 1700000000)).alias("day"), text.big_money(c("n_nationkey") * 7.77e10).alias("money"), text.signed_percent(c("n_nationkey") - 12.345).alias("percent"), text.price(c("n_nationkey") * 123.4).alias("price"))


def watchlist_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The watchlist with its names and groups, and how many weeks of orders each symbol has."""
    w = timeseries.watchlist(spark).join(_watched_series(spark, sf).groupBy("symbol").agg(F.count("*").alias("weeks")), "symbol", "left")
    return w.select("ord", "symbol", timeseries.display_name("zh").alias("zh"), timeseries.display_name("en").alias("en"), "group", "group_ord", "group_name_en", F.coalesce("weeks", F.lit(0)).alias("weeks"))


def _watched_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series by order priority under symbols of the watchlist; one of them has none."""
    names = {"1-URGENT": "SPY", "2-HIGH": "BTC-USD", "3-MEDIUM": "GC=F", "4-NOT SPECIFIED": "unwatched", "5-LOW": "AAPL"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return series.weekly(spark, sf).withColumn("symbol", F.element_at(table, c("symbol")))


def _watched(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.analyze_watchlist(_watched_series(spark, sf), timeseries.watchlist(spark))


def watchlist_trends(spark: SparkSession, sf: str) -> DataFrame:
    out = _watched(spark, sf).withColumn("tones", F.array_join(F.transform(timeseries.signal_tones(c("signals")), lambda s: s["tone"]), ","))
    return out.select("ord", "symbol", "group", "trend", F.size("signals").alias("signals"), (F.size(F.split("tones", ",")) == F.greatest(F.size("signals"), F.lit(1))).alias("toned"))


def asset_groups(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.group_counts(_watched(spark, sf), spark)


def domain_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of papers in a domain only, by keywords in title, abstract or types."""
    out = topics.scored(papers(spark, sf), TOPICS, NOW, domain=("Case  report", "von der"))
    return topics.matched_topics(out).select("id", F.array_join("matched_topic_ids", ",").alias("matched"))


def source_choice(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select("s_suppkey", F.when(c("s_nationkey") % 2 == 0, "politics").otherwise("tech").alias("category"), F.when(c("s_suppkey") % 3 == 0, "china-obgyn").when(c("s_suppkey") % 3 == 1, "guidelines").alias("subcategory"))
    out = None
    for name in (None, "guidelines", "china_obgyn", "no such"):
        one = s.where(registry.matches_category(name)).agg(F.lit(str(name)).alias("asked"), F.count("*").alias("n"), F.min("s_suppkey").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


# prompts and answers


def digest_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered candidates of a digest: of each category so many, a source in turn."""
    a = articles(spark, sf).withColumn("category", F.when(c("seq") % 3 == 0, "tech").when(c("seq") % 3 == 1, "finance").otherwise("politics")).withColumn("source", c("source_id"))
    rows = models.digest_candidates(a)
    out = digest.digest_payload(rows, [c("number")], 12)
    return out.select("number", "title", "url", "source", "category", "excerpt", "published_at")


_REVIEW = "array<struct<url:string,title:string,excerpt:string,source:string,category:string,published_at:string,content_type:string,document_type:string,meta:string>>"


def review_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of 30 candidates each, read back."""
    a = articles(spark, sf).withColumn("source", c("source_id"))
    capped = rank.review_cap(a, rules.REVIEW_LIMITS, rules.REVIEW_LIMIT, rules.SHARED_QUOTA_SOURCES, rules.REVIEW_GROUP_LIMIT, rules.REVIEW_TOTAL)
    prompts = digest.review_payload(rank.batches(capped, [c("place")], 30))
    return prompts.select("batch", F.explode(F.from_json("prompt", _REVIEW)).alias("p")).select("batch", "p.url", "p.title", "p.excerpt", "p.source", "p.content_type", "p.document_type", "p.meta")


def paper_prompt(spark: SparkSession, sf: str) -> DataFrame:
    p = connect._papers(spark, sf, c("p_brand"), connect._UNIQUE(), c("p_type"), F.array(c("p_brand"), F.lit("B")))
    out = models.paper_payload(p).select("id", F.from_json("prompt", "struct<id:string,pmid:string,doi:string,title:string,abstract:string,journal:string,authors:array<string>,publication_types:array<string>,published_at:string,activity_at:string>").alias("p"))
    return out.select("id", "p.pmid", "p.doi", "p.title", "p.journal", F.array_join("p.authors", "|").alias("authors"), F.array_join("p.publication_types", "|").alias("types"), "p.published_at")


def paper_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of parts from two answers, the second broken off; repeated ids, blank fields, missing papers."""
    k = c("p_partkey")
    p = t(spark, sf, "part").where(k <= 60).select(F.concat(F.lit("pmid:"), k).alias("id"), F.lit("T").alias("title"))
    item = F.struct(c("id"), F.concat(F.lit(" Z"), k).alias("title_zh"), F.when(k % 2 == 0, F.lit("  ")).otherwise("why").alias("research_question"), F.lit("how").alias("methods"))
    rows = t(spark, sf, "part").where(k <= 50).select(k, F.concat(F.lit("pmid:"), k - F.when(k % 10 == 9, 1).otherwise(0)).alias("id")).withColumn("x", F.to_json(item)).withColumn("chunk", F.floor(k / 25))
    answers = rows.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "x"))), lambda s: s["x"]), ",").alias("xs")).select("chunk", F.concat(F.lit('Here: {"papers":['), c("xs"), F.when(c("chunk") % 2 == 0, "]} done").otherwise("]")).alias("answer"))
    out = models.summarized(p, answers)
    return out.select("id", "summary_status", c("summary.title_zh").alias("title_zh"), c("summary.research_question").alias("research_question"), c("summary.limitations").alias("limitations"))


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Each enricher's prompt answered by a callable that leaves items out, repeats one and wraps its JSON in words."""
    items = t(spark, sf, "nation").select(c("n_nationkey").alias("seq"), F.concat(F.lit("https://n.org/"), c("n_nationkey")).alias("url"), c("n_name").alias("title"), F.repeat(c("n_name"), 60).alias("excerpt"), F.when(c("n_nationkey") % 2 == 0, "S").alias("source"), F.lit("me").alias("author"))

    def model(prompt: str) -> str:
        got = json.loads(prompt)
        found = [{"url": x["url"], "summary": " ".join([" ", *sorted(k for k in x if k != "url"), str(max(len(v) for v in x.values()))])} for i, x in enumerate(got) if i % 3 or "author" not in x]
        found = found if "repo" not in got[0] else found[:5] + [{"url": found[0]["url"], "summary": "again"}, {"url": "", "summary": "none"}]
        return "Sure: ```json\n" + json.dumps({"summaries": found}) + "\n```"

    out = None
    for kind in rules.ENRICHERS:
        answers = stored(models.answered(models.enrichment_payload(items, kind), model))
        found = models.summaries_of(answers)
        n = models.undercounted(answers, found).select(c("returned").alias("n"), "undercount")
        one = digest.backfilled(items.withColumn("summary", F.lit(None).cast("string")), found, "url", "summary").crossJoin(F.broadcast(n)).select(F.lit(kind).alias("kind"), "seq", "summary", "n", "undercount")  # one row
        out = one if out is None else out.unionByName(one)
    return out


def model_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """A callable that fails at first for some prompts and always for others."""
    prompts = t(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("p"), c("n_nationkey") % 3).alias("prompt"))

    def model(prompt: str) -> str:
        if prompt == "p1" or prompt.startswith("p2"):
            raise RuntimeError(f"no answer to {prompt[:2]}")
        return prompt.upper()

    return models.answered(prompts, model, attempts=2, hint=" again").select("n_nationkey", "answer", "error")


def market_commentary(spark: SparkSession, sf: str) -> DataFrame:
    """By nation up to four answers, the early ones too short or malformed; the first valid one within three attempts, else the fallback."""
    n = t(spark, sf, "nation").collect()  # 25 rows
    pick = lambda s: {"symbol": "SPY", "stance": "x", "rationale": s}
    good = lambda i: json.dumps({"market_overview": "m" * 100, "watchlist": [pick("r" * 20), pick("r" * 20)], **({"risk_caveat": f"c{i}"} if i % 2 else {})})
    bad = [json.dumps({"market_overview": "short", "watchlist": []}), json.dumps({"market_overview": "m" * 100, "watchlist": ["SPY", "QQQ"]}), json.dumps({"market_overview": "m" * 100, "watchlist": [pick("r" * 20), pick("few")]}), "none"]
    out = None
    for r in n[:6]:
        at = r.n_nationkey % 5
        rows = [(a, good(r.n_nationkey) if a > at else bad[(a + at) % 4]) for a in range(1, 5)]
        one = models.commentary(spark.createDataFrame(rows, "attempt int, answer string")).select(F.lit(r.n_nationkey).alias("n"), F.char_length("market_overview").alias("overview"), F.size("watchlist").alias("picks"), F.when(c("risk_caveat") == rules.COMMENTARY_CAVEAT, "fixed").otherwise(c("risk_caveat")).alias("caveat"), F.coalesce("attempt", F.lit(0)).alias("attempt"))
        out = one if out is None else out.unionByName(one)
    return out


def market_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = models.commentary_payload(timeseries.slim(_watched(spark, sf)), timeseries.watchlist(spark), "en")
    return prompt.select(F.posexplode(F.from_json("prompt", "array<struct<symbol:string,display_name:string,group:string,trend:string,price:double>>")).alias("pos", "p")).select("pos", "p.*")


def empty_report(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a day without articles: no model is asked."""

    def never(prompt: str) -> str:
        raise RuntimeError("asked")

    a = articles(spark, sf).where(c("published_at") > F.lit(NOW) + F.expr("interval 1000 days"))
    briefs, r = models.daily_digest(a.withColumn("source", c("source_id")), never, "en")
    return r.crossJoin(briefs.agg(F.count("*").alias("n"))).select("hero_headline", "daily_overview", "editor_note", (c("n").cast("int") + F.size("keywords")).alias("items"))  # one row each


def _of_sections(prompt: str) -> str:
    """A model that briefs every candidate, important as its number is."""
    import json

    rows = json.loads(prompt)
    of = lambda k: [{"url": r["url"], "summary": f"s{r['n']}", "importance": r["n"]} for r in rows if r["category"] == k]
    return json.dumps({"hero_headline": "h", "daily_overview": "o", "editor_note": "n", "keywords": [], **{f"{k}_briefs": of(k) for k in ("tech", "finance", "politics")}})


def digest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The digest as a whole: candidates, prompt, a model's answer, and its join with the candidates."""
    a = articles(spark, sf).withColumn("category", F.when(c("seq") % 3 == 0, "tech").when(c("seq") % 3 == 1, "finance").otherwise("politics")).withColumn("source", c("source_id"))
    a = a.withColumns({"url": F.concat("url", F.lit("&n="), c("seq")), "summary": F.lit(None).cast("string"), "review_status": F.lit("uncertain"), "low_priority": F.lit(False)})
    return models.daily_digest(a, _of_sections)[0].select("category", "place", "url", "source", "summary", "importance", "restored")


def _accepts(prompt: str) -> str:
    """A model that accepts what has a title."""
    import json

    return json.dumps({"reviews": [{"url": r["url"], "status": "accepted" if r["title"].strip() else "rejected", "summary": r["source"]} for r in json.loads(prompt)]})


def review_run(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of capped candidates by a model, in chunks of 30, several calls at once."""
    a = articles(spark, sf).withColumn("source", c("source_id"))
    capped = rank.review_cap(a, rules.REVIEW_LIMITS, rules.REVIEW_LIMIT, rules.SHARED_QUOTA_SOURCES, rules.REVIEW_GROUP_LIMIT, rules.REVIEW_TOTAL)
    return digest.reviews_of(models.review(capped, _accepts)).select("url", "status", "summary")


def raw_report(spark: SparkSession, sf: str) -> DataFrame:
    """Briefs of displayed URLs for two sets of them; with none left the texts are blanked."""
    b = _briefs(spark, sf)
    texts = spark.createDataFrame([("h", "o", "n")], "hero_headline string, daily_overview string, editor_note string")
    out = None
    for name, shown in (("some", b.where("place % 4 = 0").select("url")), ("none", b.select(F.concat("url", F.lit("x")).alias("url")))):
        kept, said = digest.for_raw(b, texts, shown, "empty")
        one = kept.agg(F.count("*").alias("briefs"), F.max("title").alias("last")).crossJoin(F.broadcast(said)).withColumn("case", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def top_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return digest.highlights(_briefs(spark, sf).where("category <> 'other'")).select("title", "importance")


def column_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = routing.with_source(articles(spark, sf), sources(spark)).withColumn("category", F.when(c("seq") % 4 == 0, "tech").when(c("seq") % 4 == 1, "finance").otherwise("politics"))
    return digest.column_counts(a)


def displayed(spark: SparkSession, sf: str) -> DataFrame:
    """Records of displayed articles, checked against the candidates."""
    a = articles(spark, sf).withColumn("meta", F.when(c("seq") % 2 == 0, F.concat(F.lit("PMID: "), c("seq") + 1000000)).when(c("seq") % 3 == 0, F.concat(F.lit("see 10.1000/x."), c("seq"))))
    visible = a.where("seq < 60 and seq % 31 <> 0 and seq % 7 = 0").select("url")
    kept = history.assert_displayed(visible, a)
    rows = history.displayed_records(a.where("seq < 60").join(kept, "url", "left_semi"))
    return rows.select("url", "title", "category", "source_id", "doi", "pmid")


def paper_meta(spark: SparkSession, sf: str) -> DataFrame:
    p = connect._papers(spark, sf, F.when(c("p_size") % 3 > 0, F.concat(F.lit("J & "), c("p_brand"))), connect._UNIQUE(), c("p_type"), F.array(F.lit("A")))
    return p.select("pmid", digest.research_meta().alias("meta"))


def summary_reuse(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select(c("p_partkey").alias("id"), F.sha2("p_name", 256).alias("input_hash"))
    cached = t(spark, sf, "part").where("p_partkey % 2 = 0").select(c("p_partkey").alias("id"), F.sha2(F.when(c("p_partkey") % 3 > 0, c("p_name")).otherwise("old"), 256).alias("summary_input_hash"), F.when(c("p_partkey") % 5 > 0, F.concat(F.lit("s"), c("p_partkey"))).alias("summary"))
    return state.reuse_summaries(p, cached).select("id", "summary")


def paper_section(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with a last success, without one, and without papers."""
    p = t(spark, sf, "part").where("p_partkey <= 5").select((c("p_partkey") % 4 * 10 + c("p_partkey")).alias("place"), c("p_name").alias("title"), F.timestamp_seconds(c("p_partkey") * 86400 + 1700000000).alias("activity_at"))
    last = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)
    out = None
    for name, rows, at in (("success", p, last), ("newest", p, None), ("none", p.where("false"), None)):
        one = state.section(rows, at, NOW, at is None).withColumn("case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("case", F.unix_timestamp("data_as_of").alias("as_of"), "is_cached_fallback", "papers", "daily_signal")


def read_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    out = None
    for name, last in (("first", None), ("later", dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc))):
        start = state.window_start(last, NOW, 48, 7)
        one = e.where((c("ts") >= F.lit(start)) & (c("ts") <= F.lit(NOW))).agg(F.lit(name).alias("case"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# composed runs


def _research_sources(spark: SparkSession, sf: str) -> dict:
    p = papers(spark, sf).withColumn("pmid", c("seq").cast("string")).withColumn("doi", F.lit(None).cast("string")).withColumn("title", F.concat("title", F.lit(" n"), c("seq"))).withColumn("source_kinds", F.array(F.lit("pubmed"))).withColumn("summary", F.lit(None).cast(f"struct<{','.join(f'{k}:string' for k in rules.SUMMARY_FIELDS)}>")).withColumn("summary_input_hash", F.lit(None).cast("string"))

    def broken(*_) -> DataFrame:
        raise OSError("no answer")

    return {"odd": lambda *_: p.where("seq % 2 = 1"), "down": broken, "cache": p.where("seq % 2 = 0"), "all": p}


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where("doc_id % 10 = 3").select(F.concat(F.lit("pmid:"), c("doc_id")).alias("key"))


_SELECTION = topics.Limits(min_score=60.0, max_per_topic=40, max_papers=100)


def _research(spark: SparkSession, sf: str, fail: bool = False) -> research.Research:
    s = _research_sources(spark, sf)
    fetch = {"down": s["down"]} if fail else {"odd": s["odd"], "down": s["down"]}

    def summarize(rows: DataFrame) -> DataFrame:
        some = rows.where("cast(pmid as bigint) % 3 > 0").select(F.to_json(F.struct("id", F.concat(F.lit("Z"), c("pmid")).alias("title_zh"))).alias("x"))
        return some.agg(F.lit(0).alias("chunk"), F.concat(F.lit('{"papers":['), F.array_join(F.collect_list("x"), ","), F.lit("]}")).alias("answer"))

    limits = registry.RunLimits(cache_days=365)
    return research.run(fetch, s["cache"], None, _shown(spark, sf), TOPICS, NOW, summarize, limits, _SELECTION)


def research_papers(spark: SparkSession, sf: str) -> DataFrame:
    """One source read, one down: merged with the cache, what was shown left out, the best selected, two of three summarised."""
    r = _research(spark, sf)
    assert [x[:2] for x in r.status] == [("odd", True), ("down", False)] and not r.cached_fallback
    return r.papers.select("pmid", "topic_id", "total", "summary_status", c("summary.title_zh").alias("title_zh"))


def research_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What goes back into the cache: all papers, of which the selected ones carry their summary."""
    return _research(spark, sf).cache.agg(F.count("*").alias("papers"), F.count("summary").alias("summaries"), F.count("summary_input_hash").alias("hashes"))


def research_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """All sources down: selected from the cache and flagged; a run that fails as a whole gives none."""
    r = _research(spark, sf, fail=True)
    none = research.safely(lambda: 1 / 0, warn=lambda _: None)
    return r.papers.select("pmid", "topic_id", "total", F.lit(r.cached_fallback).alias("cached"), F.lit(none is None).alias("isolated"))


def research_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    s = _research_sources(spark, sf)
    return research.dry_run({"odd": s["odd"], "all": lambda: s["all"], "down": s["down"]}, TOPICS, NOW, _SELECTION)


def _daily(spark: SparkSession, sf: str) -> daily.Run:
    """The daily run; every candidate is accepted by the model, in chunks of 30, but each seventh."""
    a = articles(spark, sf)
    past = history.keyed(a.where("seq % 5 = 0")).withColumn("date", F.lit("2024-01-30"))
    status = F.when(c("seq") % 7 == 0, "rejected").otherwise("accepted")
    one = F.to_json(F.struct("url", status.alias("status"), F.concat(F.lit("s"), c("seq")).alias("summary")))
    answers = a.groupBy(F.floor(c("seq") / 30).alias("chunk")).agg(F.concat(F.lit('{"reviews":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("j")))), lambda s: s["j"]), ","), F.lit("]}")).alias("answer"))
    return daily.run(a, sources(spark), past, answers, NOW, "2024-01-31")


def daily_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return daily.statistics(_daily(spark, sf))


def daily_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return daily.funnel(_daily(spark, sf)).select("source_id", "fetched", "eligible", "fresh", "capped", "reviewed", "selected")


def daily_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).selected.select("seq", "order", "supplemental", "summary", "meta")


QUERIES = {
    f.__name__: f
    for f in (
        dispatch_rows, dispatch_status, run_settings, research_configs, research_topics, state_scan, state_switch, history_scan, call_log, run_outputs, markdown_report, html_report, site_list, cache_expiry, detail_rows, detail_needs, detail_statistics,
        detail_fill, detail_articles, detail_cache, label_rows, watchlist_rows, watchlist_trends, asset_groups, domain_papers, source_choice, digest_prompt, review_prompt, paper_prompt, paper_summaries, enrichment, model_attempts, market_commentary,
        market_prompt, empty_report, digest_run, review_run, raw_report, top_highlights, column_counts, displayed, paper_meta, summary_reuse, paper_section, read_windows, research_papers, research_cache, research_fallback, research_dry_run,
        daily_statistics, daily_funnel, daily_selection,
    )
}

_feed = "(select *, c_custkey // 25 as n, row_number() over (partition by c_custkey // 25 order by c_custkey) - 1 as pos from customer)"
_said = "case c_custkey % 7 when 0 then 'Robotic repair ' when 1 then 'Position statement ' when 2 then '找对象 ' else 'Notes ' end || c_name"
_brief = "(select *, case when n_regionkey < 2 then 'tech' when n_regionkey < 4 then 'politics' else 'other' end as category from nation)"
_md = lambda k: f"(select coalesce(string_agg('### [<' || n_name || '>](https://n.org/' || n_nationkey || ')' || chr(10) || 'S & T · ' || (n_nationkey % 10) || '/10' || chr(10) || chr(10) || 'About ' || n_name || chr(10), chr(10) order by n_nationkey), 'Nothing new.' || chr(10)) from {_brief} where category = '{k}')"
_li = lambda k: f"""(select string_agg('<li class="brief"><a href="https://n.org/' || n_nationkey || '">&lt;' || n_name || '&gt;</a> <span>S &amp; T</span><p>About ' || n_name || '</p></li>', '' order by n_nationkey) from {_brief} where category = '{k}')"""
_about = "'About order ' || o_orderkey || ' of ' || o_orderpriority || ' with more words'"
_watch = "values " + ", ".join(f"({i}, {quoted(s)}, {quoted(n)}, {quoted(e)}, {quoted(g)})" for i, (s, n, e, g) in enumerate(rules.WATCHLIST))
_groups = "values " + ", ".join(f"({i}, {quoted(g)}, {quoted(e)})" for i, (g, _, e) in enumerate(rules.ASSET_GROUPS))
_names = "case symbol when '1-URGENT' then 'SPY' when '2-HIGH' then 'BTC-USD' when '3-MEDIUM' then 'GC=F' when '5-LOW' then 'AAPL' end"
_analysis = series.SQL["analyze"]
_lacks = f"(published_at is null or not subst or coalesce(content_type, '') = '' or d_type = 'unknown')"
_excluded_said = "concat_ws(chr(10), title, content_type, document_type)"
_asked_sql = f"with {A.BASE}, need as (select * from cl where {sql_in('source_id', _TARGETS)} and {_lacks} and not excluded and url like 'http%' and not {sql_any(_excluded_said, rules.DETAIL_EXCLUDED)})"
_config_sql = """
      with x as (select *, p_brand || '/' || (p_partkey // 50) as config, case when p_partkey % 41 = 0 then 'same' else 't' || p_partkey end as id from part), n as (select *, row_number() over (partition by config order by p_partkey) - 1 as nth, min(p_partkey) over (partition by config) as least_key from x),
      b as (select *, case when p_partkey % 97 = 0 then 'topics[' || nth || '].name' when p_partkey % 89 = 0 then 'topics[' || nth || '].include_keywords' when p_partkey % 83 = 0 then 'topics[' || nth || '].enabled' end as problem,
        case when row_number() over (partition by config, id order by nth) > 1 then 'topics[' || nth || '].id' end as twice from n),
      y as (select *, min(case when problem is not null then nth end) over (partition by config) as first_bad, min(case when twice is not null then nth end) over (partition by config) as first_twice from b)"""
_looked_sql = f"""{_asked_sql}, needed as (select *, {A._CANON} as key from need), firsts as (select * from needed qualify row_number() over (partition by key order by seq) = 1 order by seq limit 16), chosen as (select * from firsts qualify row_number() over (partition by source_id order by seq) <= 8),
      cached as (select {A._CANON} as key, bool_or(seq % 3 = 0) as good from {ARTICLES_SQL} a group by 1), r as (select chosen.*, coalesce(good, false) as hit, seq % 4 > 1 as answered from chosen left join cached using (key))"""
_group = f"case when {sql_in('source_id', rules.SHARED_QUOTA_SOURCES)} then 'shared' else source_id end"
_limit = f"case source_id {' '.join(f'when {quoted(k)} then {v}' for k, v in rules.FILL_LIMITS.items())} else {rules.DIGEST_TOTAL} end"
_column = "case when {0} <> 'politics' then {0} when s_subcategory = 'china-obgyn' or s_lang = 'zh' then 'china-obgyn' else 'international-obgyn' end"


def _filled(rows: str) -> str:
    """CTEs that choose from ranked rows (seq, part, place, g, lim, col, u): chosen (seq, nth, supplemental)."""
    step = lambda new: f"""lambda acc, x: case when len(acc.q) < {rules.DIGEST_TOTAL} and not list_contains(acc.q, x.q[1]) and not list_contains(acc.u, x.u[1]) and len(list_filter(acc.g, lambda y: y = x.g[1])) < x.lim{' and not list_contains(acc.c, x.c[1])' if new else ''}
      then {{'q': list_concat(acc.q, x.q), 'g': list_concat(acc.g, x.g), 'c': list_concat(acc.c, x.c), 'u': list_concat(acc.u, x.u), 'lim': acc.lim}} else acc end"""  # noqa: E731
    return f"""ranked as ({rows}),
    near as (select * from (select *, row_number() over (partition by g order by place) as i from ranked where part = 'priority') where i <= lim order by place limit {rules.DIGEST_TOTAL}),
    start as (select {{'q': coalesce(list(seq order by place), []::bigint[]), 'g': coalesce(list(g order by place), []::varchar[]), 'c': coalesce(list(col order by place), []::varchar[]), 'u': []::varchar[], 'lim': 0::bigint}} as s from near),
    rest as (select coalesce(list({{'q': [seq], 'g': [g], 'c': [col], 'u': [u], 'lim': lim::bigint}} order by place), []) as xs from ranked where part = 'supplemental'),
    one as (select list_reduce(xs, {step(True)}, s) as s, xs from start, rest), two as (select list_reduce(xs, {step(False)}, s) as s from one),
    done as (select case when len(start.s.q) < 10 then two.s.q else start.s.q end as q, len(start.s.q) as n from two, start),
    chosen as (select unnest(q) as seq, generate_subscripts(q, 1)::bigint as ord, generate_subscripts(q, 1) > n as supplemental from done)"""


_place = "row_number() over (partition by {part} order by {value} desc, coalesce(epoch(published_at), 0) desc, seq)"
_part = f"case when hours <= {A._near} then 'priority' else 'supplemental' end"
_eligible = f"""{A.KEPT}, ok as (select judged.*, {_part} as part from judged join kept using (seq)),
  keyed as (select *, {A._CANON} as ku, nullif({A._TKEY}, '') as kt from ok), past as (select {A._CANON} as ku, nullif({A._TKEY}, '') as kt from art where seq % 5 = 0),
  matched as (select *, case when ku in (select ku from past) then 'url' when kt in (select kt from past where kt is not null) then 'title' end as hit from keyed),
  fresh as (select * from matched where hit is null),
  turns as (select *, row_number() over (partition by source_id order by seq) as turn, min(seq) over (partition by source_id) as first_seq, {sql_in('source_id', rules.SHARED_QUOTA_SOURCES)} as sh from fresh),
  own as (select * from turns where turn <= case source_id {' '.join(f'when {quoted(k)} then {v}' for k, v in rules.REVIEW_LIMITS.items())} else {rules.REVIEW_LIMIT} end),
  shared as (select *, row_number() over (partition by sh order by turn, first_seq) as nth from own),
  capped as (select * from shared where not sh or nth <= {rules.REVIEW_GROUP_LIMIT} order by turn, first_seq limit {rules.REVIEW_TOTAL}),
  rejected as (select url from art where seq % 7 = 0), said as (select url, min(seq) as said_by from art where seq % 7 <> 0 group by 1),
  reviewed as (select capped.*, said_by, not subst and official and d_type not in ('news', 'video', 'education') and not {sql_match('title', rules.VIDEO_TITLE)} as fb from capped join said using (url) where url not in (select url from rejected) and known and not excluded),
  accepted as (select * from reviewed where subst or fb)"""
_accepted_rank = f"""select seq, part, {_place.format(part='part', value='(' + A._value + ')')} as place, {_group} as g, {_limit} as lim, {_column.format('r_category')} as col, {A._CANON} as u from accepted"""

SQL = {
    "dispatch_rows": f"select 'f' || n as source_id, {_said} as title, 'https://e.org/' || c_custkey as url, 'tech' as category from {_feed} where n in (0, 2, 3, 4) and pos < 30 and c_custkey % 13 > 0",
    "dispatch_status": f"select * from (values ('f1', false, 0::bigint)) as v(source_id, ok, fetched) union all select 'f' || i, true, (select count(*) from {_feed} where n = i and pos < 30 and c_custkey % 13 > 0) from unnest([0, 2, 3, 4]) as u(i)",
    "run_settings": """select * from (values (0, '5', '40.0', '90', 'true', null), (1, '7', '55.5', '90', 'true', null), (2, '5', '40.0', '60', 'false', null), (3, null, null, null, null, 'runtime.max_papers'), (4, null, null, null, null, 'runtime.enabled'), (5, null, null, null, null, 'runtime.what'))
      as v(i, max_papers, min_score, cache_days, enabled, error)""",
    "state_scan": "select 'good' as \"case\", count(*)::bigint as n, max(n_name) as last from nation union all select * from (values ('missing', 0, null), ('cleared', 0, null), ('broken', 0, null), ('aside', 1, null))",
    "state_switch": "select n_nationkey, n_name, 2 as versions from nation where n_regionkey <= 2",
    "history_scan": "select case c_custkey % 3 when 1 then '2024-01-02' else '2024-01-01' end as date, count(*)::bigint as n, max(c_name) as last from customer where c_custkey % 3 > 0 group by 1",
    "call_log": "select case when event_id % 3 > 0 then event_type else 'claude-cli' end as backend, count(*)::bigint as calls, sum(case when event_id % 4 > 0 then user_id else user_id * 2 end)::bigint as input_chars, count(*) filter (where user_id % 2 = 0)::bigint as good from events group by 1",
    "run_outputs": f"select seq, title, excerpt, epoch(published_at)::bigint as published, content_type, null::varchar as document_type, 's' as summary from {ARTICLES_SQL} a where url in (select url from {ARTICLES_SQL} b where seq % 5 = 0)",
    "markdown_report": f"select '## Dynamics' || chr(10) || chr(10) || {_md('politics')} || chr(10) || '## Surgery' || chr(10) || chr(10) || {_md('finance')} || chr(10) || '## Guidelines' || chr(10) || chr(10) || {_md('tech')} as markdown",
    "html_report": f"""select '<!doctype html><html><head><meta charset=''utf-8''><title>A &lt;report&gt;</title></head><body><h1>A &lt;report&gt;</h1><section><h2>Dynamics &amp; more</h2><ul>' || {_li('politics')} || '</ul></section><section><h2>Guidelines</h2><ul>' || {_li('tech')} || '</ul></section></body></html>' as html""",
    "site_list": "select printf('2024-01-%02d', n_nationkey + 1) as date, (length('<html><title>Brief ' || n_name || '</title></html>'))::bigint as size, n_nationkey = (select max(n_nationkey) from nation where n_regionkey < 3) as first from nation where n_regionkey < 3",
    "cache_expiry": "select event_id from events where event_id % 30 < 14",
    "detail_rows": f"""
      select o_orderkey, case when o_orderkey % 5 in (0, 3) or (o_orderkey % 5 in (1, 2) and o_orderkey % 2 = 1) then strftime(o_orderdate, '%Y-%m-%d') end as published,
        case when o_orderkey % 5 in (0, 1) and length({_about}) >= 30 then {_about} when o_orderkey % 5 = 3 then 'Published: ' || strftime(o_orderdate, '%B %-d, %Y') || ' ' || {_about} end as excerpt,
        case o_orderkey % 5 when 0 then 'Update' when 1 then 'Guideline' when 3 then 'News' end as content_type, case when o_orderkey % 5 in (0, 1, 3) then 'metadata' end as content_type_evidence, false as date_modified_found from orders where year(o_orderdate) >= 2000
      union all select o_orderkey, case when o_orderkey % 5 = 0 or (o_orderkey % 5 in (1, 2) and o_orderkey % 2 = 1) then strftime(o_orderdate, '%Y-%m-%d') end, case when o_orderkey % 5 in (0, 1) and length({_about}) >= 30 then {_about} when o_orderkey % 5 = 3 then 'Published: ' || strftime(o_orderdate, '%B %-d, %Y') || ' ' || {_about} end,
        case o_orderkey % 5 when 0 then 'Update' when 1 then 'Guideline' when 3 then 'News' end, case when o_orderkey % 5 in (0, 1, 3) then 'metadata' end, false from orders where year(o_orderdate) < 2000""",
    "detail_needs": f"{_asked_sql} select seq from need",
    "detail_statistics": f"""{_looked_sql}
      select coalesce(source_id, 'all') as source_id, count(*) filter (where not hit)::bigint as requested, count(*) filter (where hit)::bigint as cache_hits, count(*) filter (where not hit and answered)::bigint as succeeded, count(*) filter (where not hit and not answered)::bigint as failed,
        count(*) filter (where not hit and answered and published_at is null)::bigint as date_enriched, count(*) filter (where not hit and answered and not subst)::bigint as excerpt_enriched, count(*) filter (where not hit and answered and coalesce(content_type, '') = '')::bigint as type_enriched
      from r group by grouping sets ((source_id), ())""",
    "detail_articles": f"""{_looked_sql}, d as (select key, case when hit then timestamp '2024-01-02' else timestamp '2024-01-03' end as moment, case when hit then 'From the cache' else 'From its page' end as x, case when hit then 'clinical update' else 'abstract' end as kind from r where hit or answered)
      select seq, epoch(coalesce(published_at, moment))::bigint as published, case when subst then excerpt else coalesce(x, excerpt) end as excerpt, coalesce(nullif(content_type, ''), kind) as content_type, coalesce(content_type_evidence, case when x is not null then 'metadata' end) as content_type_evidence
      from (select *, {A._CANON} as key from cl) left join d using (key)""",
    "detail_cache": f"""{_looked_sql}
      select 'From the cache' as excerpt, count(distinct url)::bigint as urls, epoch(timestamp '2024-02-09')::bigint as expires from {ARTICLES_SQL} a where seq % 3 = 0
      union all select 'From its page', count(*)::bigint, epoch({NOW_SQL} + interval 14 day)::bigint from r where not hit and answered having count(*) > 0""",
    "detail_fill": f"""
      with a as (select *, {A._CANON} as key, lower(coalesce(trim(content_type), '')) as kt from {ARTICLES_SQL} o), d as (select key, min('x' || (seq % 5003)) as x from a where seq % 4 = 0 group by 1),
      j as (select *, kt <> 'metadata_only' and (trim(coalesce(excerpt, '')) <> '' or kt in ('abstract', 'excerpt', 'full_text', 'structured_description')) as subst from a left join d using (key))
      select seq, epoch(coalesce(published_at, case when x is not null then timestamp '2024-01-03' end))::bigint as published, case when subst then excerpt else coalesce(x, excerpt) end as excerpt, coalesce(nullif(content_type, ''), case when x is not null then 'news' end) as content_type,
        coalesce(content_type_evidence, case when x is not null then 'metadata' end) as content_type_evidence from j""",
    "label_rows": """
      select n_nationkey, case n_nationkey % 6 when 0 then 'bull' when 1 then 'bear' when 3 then 'bull' when 4 then 'bear' else 'neutral' end as stance, case when n_nationkey % 10 >= 8 then 'high' when n_nationkey % 10 >= 6 then 'mid' else 'low' end as importance, n_nationkey % 6 in (0, 2, 4) as sports,
        strftime(make_timestamp((n_nationkey * 5000 + 1700000000 + 28800)::bigint * 1000000), '%Y-%m-%d') as day, case when n_nationkey * 7.77e10 >= 1e12 then '$' || @money2 || ' T' when n_nationkey * 7.77e10 >= 1e9 then '$' || @money1 || ' B' else '$' || @money0 end as money,
        case when n_nationkey < 8 then printf('%.2f', n_nationkey * 123.4::double) else case when n_nationkey > 8 then (n_nationkey * 123.4)::bigint // 1000 || ',' else '' end || printf(case when n_nationkey > 8 then '%06.2f' else '%.2f' end, (n_nationkey * 123.4 - (n_nationkey * 123.4)::bigint // 1000 * 1000)::double) end as price,
        case when n_nationkey >= 12.345 then '+' else '' end || @percent || '%' as percent from nation""".replace("@money2", sql_fixed("(n_nationkey * 7.77e10::double / 1e12)", 2)).replace("@money1", sql_fixed("(n_nationkey * 7.77e10::double / 1e9)", 1)).replace("@money0", sql_fixed("(n_nationkey * 7.77e10::double)", 0)).replace("@percent", sql_fixed("(n_nationkey - 12.345::double)", 2)),
    "watchlist_rows": f"select w.ord, w.symbol, w.zh, coalesce(w.en, w.zh) as en, w.\"group\", g.i as group_ord, g.en as group_name_en, (select count(distinct date_trunc('week', o_orderdate)) from orders where {_names.replace('symbol', 'o_orderpriority')} = w.symbol)::bigint as weeks from ({_watch}) as w(ord, symbol, zh, en, \"group\") join ({_groups}) as g(i, name, en) on w.\"group\" = g.name",
    "watchlist_trends": f"""
      select w.ord, w.symbol, w."group", a.trend, case when a.signals = '' then 0 else len(string_split(a.signals, ',')) end::int as signals, true as toned from ({_analysis}) a join ({_watch}) as w(ord, symbol, zh, en, "group") on w.symbol = {_names.replace('symbol', 'a.symbol')}""",
    "asset_groups": f"select g.i as group_ord, g.name as \"group\", count(w.symbol)::bigint as n from ({_groups}) as g(i, name, en) left join (select * from ({_watch}) as v(ord, symbol, zh, en, \"group\") where symbol in ('SPY', 'BTC-USD', 'GC=F', 'AAPL') and symbol in (select {_names.replace('symbol', 'o_orderpriority')} from orders)) w on w.\"group\" = g.name group by 1, 2",
    "domain_papers": f"with {_PAPERS.replace('from paper', 'from paper', 1)}, d as (select * from e where contains(e, 'case report') or contains(e, 'von der')) select id, string_agg(topic_id, ',' order by topic_ord) as matched from d group by id",
    "source_choice": """
      with s as (select *, case when s_nationkey % 2 = 0 then 'politics' else 'tech' end as category, case s_suppkey % 3 when 0 then 'china-obgyn' when 1 then 'guidelines' end as sub from supplier)
      select 'None' as asked, count(*)::bigint as n, min(s_suppkey) as first from s union all select 'guidelines', count(*), min(s_suppkey) from s where category = 'tech' and sub = 'guidelines' union all select 'china_obgyn', count(*), min(s_suppkey) from s where category = 'politics' and sub = 'china-obgyn' union all select 'no such', 0, null""",
    "digest_prompt": f"""
      with a as (select *, seq % 3 as k from {ARTICLES_SQL} o), r as (select *, row_number() over (partition by k, source_id order by seq) as turn, min(seq) over (partition by k, source_id) as f from a),
      p as (select *, row_number() over (partition by k order by turn, f) as place from r), q as (select * from p where place <= case k when 0 then 25 when 1 then 20 else 15 end)
      select row_number() over (order by k, place)::int as number, title, url, source_id as source, case k when 0 then 'tech' when 1 then 'finance' else 'politics' end as category, substr(coalesce(excerpt, ''), 1, 12) as excerpt, coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z'), '') as published_at from q""",
    "digest_run": f"""
      with a as (select *, seq % 3 as k from {ARTICLES_SQL} o), r as (select *, row_number() over (partition by k, source_id order by seq) as turn, min(seq) over (partition by k, source_id) as f from a),
      p as (select *, row_number() over (partition by k order by turn, f) as place from r), q as (select *, row_number() over (order by k, place) as n from p where place <= case k when 0 then 25 when 1 then 20 else 15 end)
      select case k when 0 then 'tech' when 1 then 'finance' else 'politics' end as category, place::bigint as place, url || '&n=' || seq as url, source_id as source, 's' || n as summary, least(10, n)::int as importance, false as restored from q where place <= case k when 2 then 10 else 4 end""",
    "review_run": f"""
      with c as ({A.SQL['review_cap']}) select url, case when trim(title) <> '' then 'accepted' else 'rejected' end as status, o.source_id as summary from c join {ARTICLES_SQL} o using (seq)""",
    "research_configs": f"""{_config_sql} select config, coalesce(case when least_key % 5 = 0 then 'sources[0].kind' end, min(problem) filter (where nth = first_bad), min(twice) filter (where nth = first_twice)) as problem from y group by config, least_key""",
    "research_topics": f"""{_config_sql} select config, nth::int as ord, id, p_name as name, p_brand as include, p_partkey % 2 = 0 as enabled from y where least_key % 5 <> 0 and first_bad is null and first_twice is null""",
    "review_prompt": f"""
      with c as ({A.SQL['review_cap']}) select ((place - 1) // 30)::bigint as batch, url, title, substr(coalesce(excerpt, ''), 1, 500) as excerpt, o.source_id as source, coalesce(content_type, '') as content_type, coalesce(document_type, '') as document_type, '' as meta from c join {ARTICLES_SQL} o using (seq)""",
    "paper_prompt": f"""
      select 'pmid:' || p_partkey as id, p_partkey::varchar as pmid, case when p_partkey % 3 > 0 then '10.7/' || p_partkey end as doi, p_name || ' ' || p_partkey as title, p_brand as journal, p_brand || '|B' as authors, {connect._type('p_partkey % 7')} || '|' || {connect._type('p_size % 5')} as types,
        case when p_partkey % 4 > 0 then strftime(make_timestamp((1690000000 + p_partkey * 86400)::bigint * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') end as published_at from part""",
    "paper_summaries": """
      with given as (select p_partkey - case when p_partkey % 10 = 9 then 1 else 0 end as k, min(p_partkey) as source from part where p_partkey <= 50 group by 1)
      select 'pmid:' || p_partkey as id, case when source is null then 'failed' else 'success' end as summary_status, 'Z' || source as title_zh, case when source % 2 = 0 then '摘要未报告' when source is not null then 'why' end as research_question, case when source is not null then '摘要未报告' end as limitations
      from part left join given on k = p_partkey where p_partkey <= 60""",
    "enrichment": """
      with kinds as (select * from (values ('trending', 'description repo', 200), ('finance', 'excerpt source title', 280), ('viral', 'author previewText title', 280), ('papers', 'excerpt title', 300)) as v(kind, fields, most)),
      r as (select *, case kind when 'viral' then n_nationkey % 3 > 0 when 'trending' then n_nationkey < 5 else true end as back, greatest(least(length(n_name) * 60, most), length('https://n.org/' || n_nationkey)) as longest from kinds, nation)
      select kind, n_nationkey as seq, case when kind = 'trending' and n_nationkey = 0 then 'again' when back then fields || ' ' || longest end as summary, count(*) filter (where back) over (partition by kind)::bigint as n, count(*) filter (where back) over (partition by kind) < 12.5 as undercount from r""",
    "model_attempts": "select n_nationkey, case n_nationkey % 3 when 0 then 'P0' when 1 then 'P1 AGAIN' end as answer, case when n_nationkey % 3 = 2 then 'no answer to p2' end as error from nation",
    "market_commentary": """
      with r as (select n_nationkey as n, n_nationkey % 5 + 1 as good from nation order by n_nationkey limit 6)
      select n, case when good <= 3 then 100 else 0 end::int as overview, case when good <= 3 then 2 else 0 end::int as picks, case when good <= 3 and n % 2 = 1 then 'c' || n else 'fixed' end as caveat, case when good <= 3 then good else 0 end::int as attempt from r""",
    "market_prompt": f"""
      with w as (select * from ({_watch}) as v(ord, symbol, zh, en, "group")), last as (select o_orderpriority as symbol, arg_max(close, ts) as price from (select o_orderpriority, date_trunc('week', o_orderdate) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as close from orders group by 1, 2) group by 1)
      select (row_number() over (order by w.ord) - 1)::int as pos, w.symbol, coalesce(w.en, w.zh) as display_name, w."group", a.trend, floor(l.price * 100 + 0.5) / 100 as price from ({_analysis}) a join w on w.symbol = {_names.replace('symbol', 'a.symbol')} join last l on l.symbol = a.symbol""",
    "empty_report": f"select {quoted(rules.EMPTY_REPORT['en'])} as hero_headline, {quoted(rules.EMPTY_REPORT['en'])} as daily_overview, {quoted(rules.EMPTY_REPORT['en'])} as editor_note, 0 as items",
    "raw_report": "select 'some' as \"case\", count(*)::bigint as briefs, max('<' || n_name || '>') as last, 'h' as hero_headline, 'o' as daily_overview, 'n' as editor_note from nation where n_nationkey % 4 = 0 union all select 'none', 0, null, 'empty', 'empty', 'n'",
    "top_highlights": f"select '<' || n_name || '>' as title, (n_nationkey % 10)::int as importance from {_brief} where category <> 'other' order by n_nationkey % 10 desc, case category when 'tech' then 0 when 'finance' then 1 else 2 end, n_nationkey limit 5",
    "column_counts": f"""
      with j as (select * from {ARTICLES_SQL} a left join {SOURCES_SQL} s on a.source_id = s.s_id), k as (select *, coalesce(s_subcategory = 'china-obgyn', false) or coalesce(s_lang = 'zh', false) as zh from j)
      select count(*) filter (where seq % 4 = 0)::bigint as guidelines, count(*) filter (where seq % 4 = 1)::bigint as surgery, count(*) filter (where seq % 4 > 1 and not zh)::bigint as international, count(*) filter (where seq % 4 > 1 and zh)::bigint as china from k""",
    "displayed": f"""
      with a as (select * from {ARTICLES_SQL} o where seq < 60), v as (select url from a where seq % 31 <> 0 and seq % 7 = 0)
      select url, title, 'tech' as category, source_id, case when seq % 2 = 1 and seq % 3 = 0 then '10.1000/x.' || seq end as doi, case when seq % 2 = 0 then (seq + 1000000)::varchar end as pmid from a where url in (select url from v)""",
    "paper_meta": "select p_partkey::varchar as pmid, concat_ws(' · ', case when p_size % 3 > 0 then 'J &amp; ' || p_brand end, case when p_partkey % 4 > 0 then strftime(make_timestamp((1690000000 + p_partkey * 86400)::bigint * 1000000), '%Y-%m-%d') end, 'PMID ' || p_partkey, case when p_partkey % 3 > 0 then 'DOI 10.7/' || p_partkey end) as meta from part",
    "summary_reuse": "select p_partkey as id, case when p_partkey % 2 = 0 and p_partkey % 3 > 0 and p_partkey % 5 > 0 then 's' || p_partkey end as summary from part",
    "paper_section": f"""
      with p as (select *, p_partkey % 4 * 10 + p_partkey as place from part where p_partkey <= 5), s as (select count(*)::bigint as n, max(p_partkey * 86400 + 1700000000)::bigint as newest from p), d as (select string_agg(p_name, '; ' order by place) as signal from (select * from p order by place limit 3))
      select 'success' as "case", epoch(timestamp '2024-01-30')::bigint as as_of, false as is_cached_fallback, n as papers, signal as daily_signal from s, d union all select 'newest', newest, true, n, signal from s, d union all select 'none', epoch({NOW_SQL})::bigint, true, 0, ''""",
    "read_windows": f"select 'first' as \"case\", count(*)::bigint as n from events where ts >= {NOW_SQL} - interval 7 days and ts <= {NOW_SQL} union all select 'later', count(*) from events where ts >= timestamp '2024-01-18' and ts <= {NOW_SQL}",
}
_nth_title = "split_part(text, chr(10), 1) || ' n' || doc_id as title"
_research_papers = _PAPERS.replace("split_part(text, chr(10), 1) as title", _nth_title)
_r2 = lambda x: f"floor(({x} + 2.220446049250313e-16) * 100 + 0.5) / 100"


def _selected(where: str) -> str:
    return f"""
      {_research_papers}, scored as (
        select *, {_r2('ev * 25')} as evidence, {_r2('act * 15')} as actionability, {_r2('rec * 10')} as recency from e
        where {where} and length(trim(abstract)) >= 20 and age >= 0 and age <= 7 and ev > 0.1 and not {sql_match("title || ' ' || k1 || ' ' || k2", rules.NON_RESEARCH)}
      ), total as (select *, {_r2('topic_match + evidence + actionability + recency')} as total from scored),
      best as (select *, row_number() over (partition by id order by total desc, ev desc, topic_ord) as n from total),
      top as (select *, row_number() over (partition by topic_id order by total desc, ev desc, moment desc, 'pmid:' || doc_id) as g from best where n = 1 and total >= 60),
      chosen as (select * from top where g <= 40 order by total desc, ev desc, moment desc, 'pmid:' || doc_id limit 100)"""


SQL |= {
    "research_papers": f"with {_selected('doc_id % 10 <> 3')} select doc_id::varchar as pmid, topic_id, total, case when doc_id % 3 > 0 then 'success' else 'failed' end as summary_status, case when doc_id % 3 > 0 then 'Z' || doc_id end as title_zh from chosen",
    "research_cache": f"with {_selected('doc_id % 10 <> 3')} select (select count(*) from documents)::bigint as papers, count(*) filter (where doc_id % 3 > 0)::bigint as summaries, count(*) filter (where doc_id % 3 > 0)::bigint as hashes from chosen",
    "research_fallback": f"with {_selected('doc_id % 10 <> 3 and doc_id % 2 = 0')} select doc_id::varchar as pmid, topic_id, total, true as cached, true as isolated from chosen",
    "research_dry_run": f"with {_selected('true')} select 2 as successful_sources, 1 as failed_sources, (select count(*) + count(*) filter (where doc_id % 2 = 1) from documents)::bigint as fetched, (select count(*) from documents)::bigint as deduped, count(*)::bigint as selected from chosen",
    "daily_statistics": f"""
      with {_eligible}, {_filled(_accepted_rank)}
      select (select count(*) from judged)::bigint as fetched_total, (select count(*) from ok)::bigint as deterministic_accepted, (select count(*) from matched where hit = 'url')::bigint as history_rejected_by_url, (select count(*) from matched where hit = 'title')::bigint as history_rejected_by_title,
        0::bigint as history_rejected_by_doi, 0::bigint as history_rejected_by_pmid, (select count(*) from capped)::bigint as semantic_reviewed, (select count(*) from accepted)::bigint as semantic_accepted, (select count(*) from chosen where not supplemental)::bigint as priority_selected,
        (select count(*) from chosen where supplemental)::bigint as supplemental_selected, (select count(*) from chosen)::bigint as final_displayed, ((select count(*) from capped) - (select count(*) from accepted))::bigint as semantic_rejected""",
    "daily_funnel": f"""
      with {_eligible}, {_filled(_accepted_rank)}, n as (select source_id, count(*) as fetched from judged group by 1)
      select source_id, fetched::bigint as fetched, (select count(*) from ok x where x.source_id = n.source_id)::bigint as eligible, (select count(*) from fresh x where x.source_id = n.source_id)::bigint as fresh, (select count(*) from capped x where x.source_id = n.source_id)::bigint as capped,
        (select count(*) from accepted x where x.source_id = n.source_id)::bigint as reviewed, (select count(*) from accepted x join chosen using (seq) where x.source_id = n.source_id)::bigint as selected from n""",
    "daily_selection": f"""
      with {_eligible}, {_filled(_accepted_rank)}
      select seq, ord as "order", supplemental, case when fb then {quoted(digest.TITLE_ONLY)} else 's' || said_by end as summary, case when supplemental or {sql_in('k_type', rules.RECENT_SELECTION_CONTENT)} then '近期精选' end as meta from chosen join accepted using (seq)""",
    "priority_fill": f"""
      with {A.KEPT}, ok as (select judged.*, {_part} as part from judged join kept using (seq)),
      {_filled("select seq, part, " + _place.format(part='part', value='(' + A._value + ')') + f" as place, {_group} as g, {_limit} as lim, {_column.format('r_category')} as col, {A._CANON} as u from ok")}
      select seq, ord as "order", supplemental from chosen""",
}
_ = sql_contains
