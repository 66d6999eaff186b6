"""Topics, identities and state over documents as papers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text
from ..operators import dedupe, history, topics
from ..sources import citations, registry
from ..storage import shared_dir
from ..streaming import ledger, state
from .common import NOW, NOW_SQL, quoted, sql_first, sql_match

c = F.col
KINDS = ("Systematic Review", "Clinical Trial", "Cohort Study", "Case Report", "Editorial", "Prospective cohort", "Letter")
TOPICS = (
    topics.Topic("forms", ("tion the", "eaux de"), publication_types=("Clinical trial",)),
    topics.Topic("common", ("of the", "de la", "in der"), exclude=("license",)),
    topics.Topic("rare", ("schen und", "ado por", "the thing"), publication_types=("cohort study",)),
    topics.Topic("off", ("the",), enabled=False),
)
LIMITS = topics.Limits(min_score=60.0, max_per_topic=40, max_papers=100)


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """documents as papers: id, title (first line), abstract (text), types by id, activity by id."""
    d = registry.spread(spark, sf, "documents")
    kinds = F.array(*map(F.lit, KINDS))
    return d.select(
        c("doc_id").alias("seq"), F.format_string("p%08d", c("doc_id")).alias("id"), F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"), c("text").alias("abstract"), c("source").alias("journal"),
        F.array(F.get(kinds, (c("doc_id") % len(KINDS)).cast("int")), F.get(kinds, (c("doc_id") % 5).cast("int"))).alias("publication_types"),
        F.timestamp_seconds(F.lit(int(NOW.timestamp())) - (c("doc_id") % 240) * 3600).alias("activity_at"),
    )


def topic_score_select(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.select(papers(spark, sf), TOPICS, NOW, LIMITS)
    return out.select("id", "topic_id", "total", "evidence_rank", "evidence", "actionability", "recency", F.array_join("matched_topic_ids", ",").alias("matched"))


def topic_matches(spark: SparkSession, sf: str) -> DataFrame:
    s = topics.scored(papers(spark, sf), TOPICS, NOW)
    return topics.matched_topics(s).select("id", F.array_join("matched_topic_ids", ",").alias("matched"))


def evidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, KINDS))
    p = registry.table(spark, sf, "part")
    types = F.array(F.get(kinds, (c("p_size") % 7).cast("int")), c("p_type"), F.get(kinds, (c("p_partkey") % 7).cast("int")))
    return p.select("p_partkey", topics.evidence_weight(types).alias("weight"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    d = registry.spread(spark, sf, "documents")
    return d.select(
        c("doc_id").alias("seq"), F.format_string("p%08d", c("doc_id")).alias("id"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("n"), F.floor(c("doc_id") / 6))).alias("pmid"),
        F.when(c("doc_id") % 4 < 2, F.concat(F.lit("10.1/"), c("doc_id") % 997)).alias("doi"), F.get(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), "\n", 2), F.lit(0)).alias("title"), F.when(c("doc_id") % 2 == 0, c("source")).alias("journal"),
        F.array(F.when(c("doc_id") % 5 == 0, "pubmed").otherwise("rss")).alias("source_kinds"), F.timestamp_seconds(c("n_chars")).alias("activity_at"),
    )


def dedupe_components(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.paper_components(_keyed(spark, sf)).select("seq", "component")


def golden_records(spark: SparkSession, sf: str) -> DataFrame:
    groups = dedupe.paper_components(_keyed(spark, sf))
    out = dedupe.merge_groups(groups, F.array_contains("source_kinds", "pubmed"))
    return out.select("component", "id", "pmid", "doi", "journal", F.unix_timestamp("activity_at").alias("activity"), F.array_join("source_kinds", ",").alias("kinds"), "members")


def state_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two batches as papers: fetched ones before cached ones, kept for ten days."""
    e = registry.table(spark, sf, "events")
    base = e.select(c("event_id").alias("seq"), F.concat(F.lit("e"), c("event_id")).alias("id"), F.concat(c("user_id"), F.lit("-"), c("event_type"), F.lit("-"), F.floor(c("value"))).alias("pmid"), F.lit(None).cast("string").alias("doi"), F.lit("").alias("title"), c("event_type").alias("journal"), F.array(F.lit("pubmed")).alias("source_kinds"), c("ts").cast("timestamp").alias("activity_at"))
    fetched, cached = base.where("seq % 2 = 1"), base.where("seq % 2 = 0")
    out = state.merged(fetched, cached, NOW, 10)
    return out.select("pmid", "members", F.unix_timestamp("activity_at").alias("activity"))


#: Rows of a file that a stream reads, about.
FILE_ROWS = 1_000_000


def _dealt(rows: DataFrame, path: str) -> int:
    """Writes rows as files of some FILE_ROWS each, a quarter of which a micro-batch reads: how many that are.

    A task writes one file as its rows come, without a sort, so its memory doesn't grow with the table.
    """
    each = -(-rows.count() // (4 * FILE_ROWS)) or 1
    rows.repartition(4 * each, "seq").write.parquet(path)
    return each


def papers_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as papers in files that four micro-batches read as a stream: each is one commit of the records and their index."""
    base = f"{shared_dir(spark)}/corpusflow-{uuid.uuid4().hex}"
    e = registry.table(spark, sf, "events")
    rows = e.select(
        c("event_id").alias("seq"), F.concat(F.lit("e"), c("event_id")).alias("id"), F.concat(c("user_id"), F.lit("-"), c("event_type"), F.lit("-"), F.floor(c("value"))).alias("pmid"), F.lit(None).cast("string").alias("doi"),
        F.lit("").alias("title"), c("event_type").alias("journal"), F.array(F.lit("pubmed")).alias("source_kinds"), c("ts").cast("timestamp").alias("activity_at"),
    )
    each = _dealt(rows, f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")
    ledger.merge_stream(stream, f"{base}/state", "papers", lambda s, batch: ledger.absorb(spark, f"{base}/state", s, batch, NOW, 10), f"{base}/checkpoint").awaitTermination()
    out = ledger.records(spark, f"{base}/state")
    return out.select("pmid", "journal", F.unix_timestamp("activity_at").alias("activity"), F.array_join("source_kinds", ",").alias("kinds"))


def history_papers(spark: SparkSession, sf: str) -> DataFrame:
    k = _keyed(spark, sf)
    shown = history.shown_keys(k.where("seq % 10 = 0").select(F.lit("2024-01-30").alias("date"), "pmid", "doi", "title"), "2024-01-31")
    return history.unshown_papers(k.where("seq % 10 <> 0"), shown).select("id")


def citation_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Citation XML made from parts, fifty articles a payload, read back."""
    p = registry.table(spark, sf, "part").select((c("p_partkey") / 50).cast("long").alias("n"), F.format_string(
        "<PubmedArticle><MedlineCitation><PMID>%d</PMID><Article><Journal><Title>%s</Title><JournalIssue><PubDate><Year>2023</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><ArticleTitle>Effects of <i>%s</i> on yield</ArticleTitle>"
        "<Abstract><AbstractText Label=\"AIM\">To see %s.</AbstractText><AbstractText>Then done.</AbstractText></Abstract><AuthorList><Author><LastName>%s</LastName><ForeName>A</ForeName></Author><Author><CollectiveName>Group %d</CollectiveName></Author></AuthorList>"
        "<PublicationTypeList><PublicationType>Clinical Trial</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus=\"pubmed\"><Year>2024</Year><Month>1</Month><Day>%d</Day></PubMedPubDate></History>"
        "<ArticleIdList><ArticleId IdType=\"pubmed\">%d</ArticleId><ArticleId IdType=\"doi\">https://doi.org/10.5/P%d.</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
        c("p_partkey"), c("p_brand"), c("p_name"), c("p_name"), c("p_type"), c("p_size"), c("p_partkey") % 28 + 1, c("p_partkey"), c("p_partkey")).alias("xml"))
    sets = p.groupBy("n").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.array_sort(F.collect_list("xml")), ""), F.lit("</PubmedArticleSet>")).alias("payload"))
    out = citations.papers_of(sets, dt.datetime(2024, 1, 31))
    return out.select("pmid", "title", "abstract", "journal", F.array_join("authors", "; ").alias("authors"), "doi", F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.date_format("activity_at", "yyyy-MM-dd").alias("active"))


QUERIES = {f.__name__: f for f in (topic_score_select, topic_matches, evidence_rank, dedupe_components, golden_records, state_merge, papers_stream, history_papers, citation_scan)}


def _kind(expr: str) -> str:
    return f"([{', '.join(map(quoted, KINDS))}])[({expr}) + 1]"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}&]+', ' ', 'g'))"


def _has(x: str, words) -> str:
    return "(" + " or ".join([f"contains({x}, {quoted(w)})" for w in words] or ["false"]) + ")"


def _topic(t: topics.Topic) -> str:
    expected = " or ".join([f"lower(k1) = {quoted(x.lower())} or lower(k2) = {quoted(x.lower())}" for x in t.publication_types] or ["false"])
    return f"case when {_has('e', t.exclude)} then 0 when {_has('t', t.include)} then 50 when {_has('a', t.include)} then case when {expected} then 50 else 40 end else 0 end"


def _weight(k: str) -> str:
    return "(" + sql_first(k, rules.EVIDENCE, "null") + ")"


_r2 = lambda x: f"floor(({x} + 2.220446049250313e-16) * 100 + 0.5) / 100"
_PAPERS = f"""
  paper as (
    select doc_id, printf('p%08d', doc_id) as id, split_part(text, chr(10), 1) as title, text as abstract, {_kind('doc_id % 7')} as k1, {_kind('doc_id % 5')} as k2, {NOW_SQL} - to_hours(doc_id % 240) as moment from documents
  ), n as (
    select *, {_norm('title')} as t, {_norm('abstract')} as a, {_norm("title || ' ' || abstract || ' ' || k1 || ' ' || k2")} as e, coalesce(greatest({_weight('k1')}, {_weight('k2')}), 0.4)::double as ev,
      ({sql_first("lower(title || ' ' || abstract || ' ' || k1 || ' ' || k2)", rules.ACTIONABILITY, '0.4')})::double as act, date_diff('second', moment, {NOW_SQL}) / 86400.0 as age from paper
  ), s as (
    select *, case when age <= 2 then 1.0 when age <= 4 then 0.75 when age <= 7 then 0.5 else 0 end as rec from n
  ), e as (
    select s.*, o as topic_ord, tid as topic_id, m::double as topic_match from s, unnest([{', '.join(f"{{'o': {i}, 'tid': {quoted(t.id)}, 'm': {_topic(t)}}}" for i, t in enumerate(TOPICS) if t.enabled)}]) as u(x), lateral (select x.o as o, x.tid as tid, x.m as m) where m > 0
  )"""
_KEYED = r"""
  keyed as (
    select doc_id as seq, printf('p%08d', doc_id) as id, case when doc_id % 3 = 0 then 'n' || (doc_id // 6) end as pmid, case when doc_id % 4 < 2 then '10.1/' || (doc_id % 997) end as doi,
      trim(regexp_replace(lower(split_part(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), chr(10), 1)), '[^\p{L}\p{N}&]+', ' ', 'g')) as title, case when doc_id % 2 = 0 then source end as journal, doc_id % 5 = 0 as pub, n_chars from documents
  ), ks as (
    select seq, 'p' || pmid as k from keyed where pmid is not null union select seq, 'd' || doi from keyed where doi is not null union select seq, 't' || title from keyed where title <> ''
  )"""
_COMP = r"""
  hub as (select k, min(seq) as h from ks group by k), link as (select distinct ks.seq as a, h as b from ks join hub using (k) where ks.seq <> h), bl as (select a, b from link union select b, a from link),
  reach as (select seq as a, seq as b from keyed union select r.a, bl.b from reach r join bl on r.b = bl.a),
  comp as (select a as seq, min(b) as component from reach group by a)"""

SQL = {
    "topic_score_select": f"""
      with {_PAPERS}, scored as (
        select *, {_r2('ev * 25')} as evidence, {_r2('act * 15')} as actionability, {_r2('rec * 10')} as recency from e
        where length(trim(abstract)) >= 20 and age >= 0 and age <= 7 and ev > 0.1 and not {sql_match("title || ' ' || k1 || ' ' || k2", rules.NON_RESEARCH)}
      ), total as (
        select *, {_r2('topic_match + evidence + actionability + recency')} as total from scored
      ), best as (
        select *, row_number() over w as n, string_agg(topic_id, ',' order by total desc, ev desc, topic_ord) over (partition by id) as matched from total window w as (partition by id order by total desc, ev desc, topic_ord)
      ), top as (
        select *, row_number() over (partition by topic_id order by total desc, ev desc, moment desc, id) as g from best where n = 1 and total >= {LIMITS.min_score}
      )
      select id, topic_id, total, ev as evidence_rank, evidence, actionability, recency, matched from top where g <= {LIMITS.max_per_topic} order by total desc, ev desc, moment desc, id limit {LIMITS.max_papers}""",
    "topic_matches": f"with {_PAPERS} select id, string_agg(topic_id, ',' order by topic_ord) as matched from e group by id",
    "evidence_rank": f"select p_partkey, coalesce(greatest({_weight(_kind('p_size % 7'))}, {_weight('p_type')}, {_weight(_kind('p_partkey % 7'))}), 0.4)::double as weight from part",
    "dedupe_components": f"with recursive {_KEYED}, {_COMP} select seq, component from comp",
    "golden_records": f"""
      with recursive {_KEYED}, {_COMP}, g as (select * from keyed join comp using (seq))
      select component, coalesce('pmid:' || any_pmid, 'doi:' || any_doi, pid) as id, any_pmid as pmid, any_doi as doi, any_journal as journal, activity, kinds, members from (
        select component, coalesce(max(pmid) filter (where pref), min_by(pmid, seq) filter (where pmid is not null)) as any_pmid,
          coalesce(max(doi) filter (where pref), min_by(doi, seq) filter (where doi is not null)) as any_doi, coalesce(max(journal) filter (where pref), min_by(journal, seq) filter (where journal is not null)) as any_journal,
          max(id) filter (where pref) as pid, max(n_chars)::bigint as activity, string_agg(distinct case when pub then 'pubmed' else 'rss' end, ',' order by case when pub then 'pubmed' else 'rss' end) as kinds, count(*)::bigint as members
        from (select *, row_number() over (partition by component order by not pub, seq) = 1 as pref from g) group by component)""",
    "papers_stream": f"""
      select user_id || '-' || event_type || '-' || floor(value)::bigint as pmid, min(event_type) as journal, max(epoch(date_trunc('second', ts)))::bigint as activity, 'pubmed' as kinds
      from events group by 1 having max(ts) >= {NOW_SQL} - interval 10 day""",
    "state_merge": f"""
      select pmid, members, activity from (select user_id || '-' || event_type || '-' || cast(floor(value) as bigint) as pmid, count(*)::bigint as members, max(epoch(date_trunc('second', ts)))::bigint as activity, max(ts) as last from events group by 1)
      where last >= {NOW_SQL} - interval 10 days""",
    "history_papers": f"""
      with {_KEYED}, old as (select distinct k from ks where seq % 10 = 0)
      select id from keyed where seq % 10 <> 0 and seq not in (select seq from ks join old using (k))""",
    "citation_scan": """
      select cast(p_partkey as varchar) as pmid, 'Effects of ' || p_name || ' on yield' as title, 'AIM: To see ' || p_name || '.' || chr(10) || 'Then done.' as abstract, p_brand as journal, 'A ' || p_type || '; Group ' || p_size as authors,
        '10.5/p' || p_partkey as doi, '2023-03-01' as published, strftime(date '2024-01-01' + cast(p_partkey % 28 as integer), '%Y-%m-%d') as active from part""",
}
