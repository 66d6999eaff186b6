"""Classification, filtering, selection, history and digests over articles made from orders, and over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx
from ..operators import dedupe, digest, history, rank, routing
from ..sources import registry
from ..storage import stored
from .common import ARTICLES_SQL, NOW, NOW_SQL, SOURCES_SQL, articles, quoted, sources, sql_any, sql_contains, sql_first, sql_in, sql_match

c = F.col
t = registry.table


def classify_articles(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.classified(routing.with_source(articles(spark, sf), sources(spark)))
    return out.select("seq", "excluded", "d_type", "k_type", "k_evidence", "official", "subst")


def route_articles(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.classified(routing.with_source(articles(spark, sf), sources(spark))).where("s_known").withColumn("r", routing.route())
    return out.select("seq", "r.category", "r.reject")


def filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    judged = routing.staged(articles(spark, sf), sources(spark), NOW)
    return judged.select("seq", F.when(c("reason") != "duplicate", c("reason")).alias("reason_before_duplicates"), F.when(c("reason").isNull() | (c("reason") == "duplicate"), c("category")).alias("category"))


def filter_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    judged = routing.staged(articles(spark, sf), sources(spark), NOW)
    return judged.where("reason is null").select("seq", "category", "partition")


def filter_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return routing.statistics(routing.staged(articles(spark, sf), sources(spark), NOW))


def rejects_by_source(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.by_source(routing.staged(articles(spark, sf), sources(spark), NOW).where("reason <> 'duplicate'"))
    return out.select("source_id", F.explode("rejects").alias("reason", "n"))


def dedupe_greedy(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("u"), c("doc_id") % 611, F.lit("-"), c("lang")).alias("u"), c("text").alias("h"))
    return dedupe.greedy_two_keys(d, "doc_id", "u", "h")


def history_anti(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    past = history.keyed(a.where("seq % 3 = 0")).withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("seq") % 40).cast("int")), "yyyy-MM-dd"))
    out = history.against(a.where("seq % 3 <> 0"), past, "2024-01-31")
    return out.select("seq", "matched_by", "matched_date")


def history_kept(spark: SparkSession, sf: str) -> DataFrame:
    """All articles against a history that three runs appended, the last of which is today's and doesn't count."""
    a, name = articles(spark, sf), f"corpusflow_{uuid.uuid4().hex}"
    day = F.get(F.array(*map(F.lit, KEPT_DATES)), (c("seq") % 3).cast("int"))
    for date in KEPT_DATES:
        history.keep(history.keyed(a.where(day == date)), name, date)
    return history.against_kept(a, name, KEPT_DATES[2]).select("seq", "matched_by", "matched_date")


KEPT_DATES = ("2024-01-29", "2024-02-02", "2024-01-31")


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "source", "n_chars", c("doc_id").alias("seq"))
    return rank.interleaved(d, "source", [F.desc("n_chars"), F.asc("seq")], 60).select("doc_id", "source", "place")


def review_cap(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return rank.review_cap(a, rules.REVIEW_LIMITS, rules.REVIEW_LIMIT, rules.SHARED_QUOTA_SOURCES, rules.REVIEW_GROUP_LIMIT, rules.REVIEW_TOTAL).select("seq", "source_id", "place")


def priority_fill(spark: SparkSession, sf: str) -> DataFrame:
    judged = routing.staged(articles(spark, sf), sources(spark), NOW)
    return rank.select_supplemental(routing.selection_input(judged, sources(spark)))


def value_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.classified(routing.with_source(articles(spark, sf), sources(spark)))
    out = out.withColumn("meta", F.when(c("seq") % 2 == 0, "近期精选 · x").when(c("seq") % 3 == 0, " y "))
    return out.select("seq", routing.value_score().alias("score"), routing.labelled_recent(c("meta")).alias("label"), routing.display_column().alias("column"))


def window_partition(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    part = routing.window_part(c("event_type"), c("ts").cast("timestamp"), NOW, {"view": (24, 240), "click": (48, 480), "purchase": (240, 700)})
    return e.groupBy("event_type", part.alias("part")).agg(F.count("*").alias("n"))


def grouped_topn(spark: SparkSession, sf: str) -> DataFrame:
    customers = t(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    out = rank.grouped_top(customers, t(spark, sf, "nation"), "n_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 5, ["c_custkey"])
    return out.select("n_name", F.array_join(F.transform("items", lambda s: s["c_custkey"].cast("string")), ",").alias("top"))


def _digest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    b = t(spark, sf, "benchmark")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {0: "tech", 1: "finance", 2: "politics"}.items() for x in kv]), (c("item_id") % 3).cast("int"))
    return b.select(c("item_id").alias("seq"), F.concat(F.lit("https://x.org/"), c("item_id")).alias("url"), c("text").alias("title"), F.lit("S").alias("source"), kind.alias("category"), F.when(c("item_id") % 5 != 4, c("text")).alias("summary"), F.when(c("item_id") % 4 != 3, "accepted").otherwise("uncertain").alias("review_status"), (c("item_id") % 4 == 3).alias("low_priority"))


def digest_join(spark: SparkSession, sf: str) -> DataFrame:
    """A digest answer made from benchmark items, with repeats, wrong categories and bad importances."""
    b = t(spark, sf, "benchmark")
    names = F.create_map(*[F.lit(x) for kv in {0: "tech", 1: "finance", 2: "politics"}.items() for x in kv])
    given = F.element_at(names, ((c("item_id") + F.when(c("item_id") % 10 == 8, 1).otherwise(0)) % 3).cast("int"))
    items = b.select(F.when(given == "tech", 0).when(given == "finance", 1).otherwise(2).alias("section"), given.alias("category"), c("item_id").alias("pos"), F.concat(F.lit(" https://x.org/"), c("item_id")).alias("url"), F.when(c("item_id") % 6 == 0, "given").alias("summary"), F.when(c("item_id") % 8 != 0, (c("item_id") * 0.7).cast("double")).alias("importance"))
    return digest.sanitized(items, _digest_candidates(spark, sf)).select("category", "place", "url", "summary", "importance", "restored")


def review_join(spark: SparkSession, sf: str) -> DataFrame:
    """Review answers of 30-row chunks, one of them broken, against their candidates."""
    a = articles(spark, sf)
    cand = stored(routing.classified(routing.with_source(digest.last_of_url(a), sources(spark))))
    status = F.when(c("seq") % 5 == 0, "rejected").when(c("seq") % 5 == 1, "uncertain").otherwise("accepted")
    one = F.struct(F.to_json(F.struct(c("url"), status.alias("status"), F.concat(F.lit("s"), c("seq")).alias("summary"))).alias("j"))
    chunks = a.withColumn("chunk", F.floor(c("seq") / 30)).groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("o")))), lambda s: s["o"]["j"]), ",").alias("js"))
    body = F.concat(F.lit('```json\n{"reviews":['), c("js"), F.when(c("chunk") % 2 == 0, ",]}").otherwise("]}"), F.lit("\n```"))
    out = digest.reviewed(cand, digest.reviews_of(chunks.withColumn("answer", body)))
    return out.select("seq", "summary", "review_status", "low_priority")


def llm_rejected(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return digest.llm_rejected(a.where("seq % 2 = 0"), a.where("seq % 7 = 0")).select("seq")


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    v = t(spark, sf, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.concat(s["role"], F.lit(": "), s["text"]))
    return v.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("transcript"), F.count("*").alias("turns"))


def funnel_by_source(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans import daily

    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return daily.by_stage({"fetched": d, "labelled": d.where("quality is not null"), "good": d.where("quality = 1"), "clean": d.where("quality = 1 and toxic = 0")}, "source")


def details_by_source(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import state

    return state.detail_statistics(t(spark, sf, "documents").select(c("source").alias("source_id"), (c("n_chars") < 100).alias("hit"), F.when(c("lang") == "en", True).alias("answered"), (c("n_chars") % 2 == 0).alias("dated"), (c("n_chars") % 3 == 0).alias("excerpted"), F.lit(False).alias("typed")))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return digest.completeness(articles(spark, sf))


def history_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that history knows by DOI, by number, by both or not at all; the latest date of the first kind counts."""
    k = c("o_orderkey")
    meta = F.when(k % 4 == 0, F.concat(F.lit("PMID: "), c("o_custkey") % 500 + 1000000)).when(k % 4 == 1, F.concat(F.lit("see 10.1000/AB."), c("o_custkey") % 300, F.lit("."))).when(k % 4 == 2, F.concat(F.lit("10.1000/ab."), c("o_custkey") % 300, F.lit(" PMID 1000"), F.lpad((c("o_custkey") % 500).cast("string"), 3, "0")))
    a = t(spark, sf, "orders").select(k.alias("seq"), F.concat(F.lit("https://h.org/"), k).alias("url"), F.concat(F.lit("Title "), k).alias("title"), F.lit(None).cast("string").alias("excerpt"), meta.alias("meta"))
    past = history.keyed(a.where("seq % 3 = 0")).withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("seq") % 40).cast("int")), "yyyy-MM-dd"))
    return history.against(a.where("seq % 3 <> 0"), past, "2024-01-31").select("seq", "matched_by", "matched_date")


def merged_top(spark: SparkSession, sf: str) -> DataFrame:
    from ..sinks.files import merged_top as best

    d = t(spark, sf, "documents").select("doc_id", c("doc_id").alias("seq"), "lang", F.timestamp_seconds(c("n_chars")).alias("published_at"), (c("doc_id") % 3 > 0).alias("enabled"))
    return best(d, 40, "en", c("doc_id") % 7 == 0).select("doc_id")


def detail_candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select(c("doc_id").alias("seq"), F.concat(F.lit("k"), c("doc_id") % 37).alias("key"), F.concat(F.lit("s"), c("doc_id") % 2).alias("source_id"))
    return dedupe.detail_candidates(d, "key", 16, 8).select("seq", "source_id")


def report_tree(spark: SparkSession, sf: str) -> DataFrame:
    from ..sinks.files import tree_of

    n, k = t(spark, sf, "nation"), t(spark, sf, "customer")
    items = k.join(F.broadcast(n), c("c_nationkey") == c("n_nationkey")).select(F.concat(F.lit("r"), c("n_regionkey")).alias("category"), "c_mktsegment", F.col("n_name").alias("source_id"), c("n_nationkey").alias("ord"), c("c_custkey").alias("seq"), F.timestamp_seconds(F.floor(c("c_acctbal") + 10000)).alias("published_at"), c("c_name").alias("title"), c("c_name").alias("url")).withColumnRenamed("c_mktsegment", "subgroup")
    tree = tree_of(items, {"r0": 4, "r1": 2}, ["NATION_3"])
    flat = tree.select("category", F.explode("groups").alias("g")).select("category", "g.subgroup", F.explode("g.sources").alias("s"))
    return flat.select("category", "subgroup", "s.source_id", F.array_join(F.transform("s.items", lambda i: i["title"]), ",").alias("titles"))


QUERIES = {
    f.__name__: f
    for f in (
        classify_articles, route_articles, filter_reasons, filter_duplicates, filter_statistics, rejects_by_source, dedupe_greedy, history_anti, history_kept, round_robin, review_cap, priority_fill, value_scores,
        window_partition, history_keys, grouped_topn, digest_join, review_join, llm_rejected, conversation_turns, funnel_by_source, details_by_source, completeness, merged_top, detail_candidates, report_tree,
    )
}

_M = "concat_ws(chr(10), title, excerpt, meta, content_type)"
_T = "concat_ws(chr(10), title, meta, content_type)"
_kinds = tuple(dict.fromkeys(k for k, _ in rules.CONTENT_TYPES))
_decl = r"regexp_replace(lower(trim(content_type)), '[\s-]+', '_', 'g')"
_PATH = "substr(url, instr(url, '://') + 3)"
BASE = f"""
  art as (select * from {ARTICLES_SQL} o), src as (select * from {SOURCES_SQL} q),
  j as (select a.*, s.*, s_id is not null as known, {_M} as m, {_T} as tt from art a left join src s on a.source_id = s.s_id),
  k as (
    select *, {sql_any('m', rules.HARD_EXCLUDED)} as excluded,
      case when {sql_any('m', rules.HARD_EXCLUDED)} then {sql_first('m', rules.HARD_EXCLUDED_KIND, "'unknown'")} when {sql_in('document_type', rules.DOCUMENT_TYPES)} then document_type else {sql_first('trim(title)', rules.TITLE_TYPES, "'unknown'")} end as d_type,
      case when {sql_in(_decl, _kinds)} then {_decl} end as k1, {sql_first('trim(content_type)', rules.CONTENT_TYPES)} as k2, {sql_first('m', rules.CONTENT_TYPES)} as k3 from j
  ), cl as (
    select *, coalesce(k1, k2, k3) as k_type, case when k1 is not null then 'declared' when k2 is not null then 'metadata' when k3 is not null then 'title_excerpt' end as k_evidence,
      lower(coalesce(trim(content_type), '')) <> 'metadata_only' and (trim(coalesce(excerpt, '')) <> '' or lower(coalesce(trim(content_type), '')) in ('abstract', 'excerpt', 'full_text', 'structured_description')) as subst,
      not excluded and coalesce(s_class = 'official_authority', false) and {sql_in('d_type', rules.FORMAL_TYPES)} and trim(title) <> '' and published_at is not null and url like 'http%' and coalesce(split_part({_PATH}, '/', 1) in (s_host, regexp_extract(s_url, '://([^/]+)', 1)), false) as official from k
  )"""
_G, _N = (lambda x: f"('{x}|')"), (lambda x: f"('|{x}')")
_opinion = "coalesce(k_type in ('professional_review', 'expert_commentary'), false)"
_academic = "coalesce(s_class = 'academic_journal', false)"
ROUTED = f"""{BASE}, r as (
    select *, case
      when {sql_in('source_id', rules.PODCAST_SOURCES)} and ({sql_match('m', rules.PODCAST_PROMOTION)} or not {sql_match('m', rules.PODCAST_PROFESSIONAL)}) then {_N('unsupported_content_type')}
      when {sql_in('source_id', rules.MIXED_FEED_SOURCES)} and {sql_any('m', (rules.RESEARCH_NEWS, rules.RESEARCH_WORD))} and not {sql_any('m', (rules.DYNAMICS, rules.FORMAL_GUIDANCE))} then {_N('ordinary_research_article')}
      when {sql_in('document_type', rules.GUIDANCE_TYPES)} or (d_type = 'policy' and official) then {_G('tech')}
      when coalesce(document_type = 'research_article', false) or {sql_match('tt', rules.ORDINARY_RESEARCH)} then {_N('ordinary_research_article')}
      when {sql_in('k_type', rules.SURGERY_CONTENT)} or {sql_match('content_type', rules.TECHNIQUE_LABEL)} or {sql_match('title', rules.TECHNIQUE_TITLE)} then {_G('finance')}
      when {sql_in('k_type', rules.GUIDANCE_CONTENT)} then {_G('tech')}
      when {sql_in('k_type', rules.DYNAMICS_CONTENT)} and {_academic} and {_opinion} and not (subst and k_evidence in ('declared', 'metadata')) then {_N('unsupported_content_type')}
      when {sql_in('k_type', rules.DYNAMICS_CONTENT)} then {_G('politics')}
      when {sql_in('d_type', rules.GUIDANCE_TYPES)} or {sql_match('tt', rules.FORMAL_GUIDANCE)} then {_G('tech')}
      when {sql_match('m', rules.SURGICAL_METHOD)} or (d_type = 'video' and {sql_match('m', rules.SURGICAL_TOPIC)}) then {_G('finance')}
      when {sql_in('d_type', ('news', 'safety_alert', 'policy'))} or {sql_match('m', rules.DYNAMICS)} then {_G('politics')}
      when {_academic} then {_N('ordinary_research_article')}
      when d_type in ('video', 'education') and not {sql_match('m', rules.SURGICAL_TOPIC)} then {_N('unsupported_content_type')}
      else coalesce(s_category, '') || '|' end as route from cl
  ), rt as (select *, nullif(split_part(route, '|', 1), '') as r_category, nullif(split_part(route, '|', 2), '') as r_reject from r)"""
_any_of = lambda xs: f"len(list_filter(coalesce({xs}, []), lambda w: contains(lower(m), lower(w)))) > 0"
_near = "case r_category when 'tech' then 720 when 'finance' then 336 else 168 end"
_far = "case r_category when 'tech' then 4320 when 'finance' then 2160 else 720 end"
JUDGED = f"""{ROUTED}, quota as (
    select seq from (select seq, row_number() over (partition by source_id order by seq) as turn, min(seq) over (partition by source_id) as f from rt where {sql_in('source_id', rules.SHARED_QUOTA_SOURCES)}) order by turn, f limit {rules.SHARED_QUOTA}
  ), judged as (
    select *, date_diff('second', published_at, {NOW_SQL}) / 3600.0 as hours, case
      when {sql_in('source_id', rules.SHARED_QUOTA_SOURCES)} and seq not in (select seq from quota) then 'unsupported_content_type'
      when trim(title) = '' or url not like 'http%' then 'invalid_item'
      when excluded or {sql_contains('m', rules.EXCLUDE_KEYWORDS)} then 'promotional'
      when not known or published_at is null then 'invalid_item'
      when {_any_of('s_exclude')} then 'source_excluded'
      when {sql_in('source_id', rules.DUAL_KEYWORD_SOURCES)} and not ({sql_contains('m', rules.INCLUDE_KEYWORDS)} and {_any_of('s_keywords')}) then 'not_obgyn'
      when r_reject is not null then r_reject
      when hours < 0 or hours > {_far} then 'outside_time_window'
      when not subst and not official then 'missing_excerpt'
      when coalesce(s_class = 'general_authority', false) and not ({sql_contains('m', rules.INCLUDE_KEYWORDS)} and {_any_of('s_keywords')}) then 'not_obgyn' end as reason from rt
  )"""
_CANON = "regexp_replace(split_part(url, '?', 1), '/$', '') || '?' || split_part(url, 'feed&', 2)"
_TKEY = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"
GREEDY = """list_reduce(list({'o': o, 'a': a, 'b': b} order by o), lambda s, x: case when list_contains(s.sa, x.a) or list_contains(s.sb, x.b) then s
   else {'o': list_append(s.o, x.o), 'sa': list_append(s.sa, x.a), 'sb': list_append(s.sb, x.b)} end, {'o': []::bigint[], 'sa': []::varchar[], 'sb': []::varchar[]})"""
KEPT = f"{JUDGED}, open as (select seq as o, {_CANON} as a, {_TKEY} as b from judged where reason is null), folded as (select {GREEDY} as s from open where a <> '' and b <> ''), kept as (select unnest(s.o) as seq from folded)"
_value = f"case s_class when 'official_authority' then 40 when 'academic_journal' then 30 when 'professional_vertical' then 20 else 10 end + case when {sql_in('d_type', rules.GUIDANCE_TYPES)} then 60 when {sql_in('k_type', rules.GUIDANCE_CONTENT)} then 50 when {sql_in('k_type', ('safety_alert', 'practice_change'))} then 45 when {sql_in('k_type', rules.SURGERY_CONTENT)} then 40 when {sql_in('k_type', rules.DYNAMICS_CONTENT)} then 30 else 0 end"
_counter = {}
for _reason, _name in rules.COUNTERS.items():
    _counter.setdefault(_name, []).append(_reason)

SQL = {
    "classify_articles": f"with {BASE} select seq, excluded, d_type, k_type, k_evidence, official, subst from cl",
    "route_articles": f"with {ROUTED} select seq, r_category as category, r_reject as reject from rt where known",
    "filter_reasons": f"with {JUDGED} select seq, reason as reason_before_duplicates, case when reason is null then r_category end as category from judged",
    "filter_duplicates": f"with {KEPT} select seq, r_category as category, case when hours <= {_near} then 'priority' else 'supplemental' end as partition from judged join kept using (seq)",
    "filter_statistics": f"with {KEPT}, f as (select seq, case when reason is null and seq not in (select seq from kept) then 'duplicate' else reason end as reason from judged) select count(*)::bigint as total, count(*) filter (where reason is null)::bigint as accepted, count(*) filter (where reason is not null)::bigint as rejected, "
    + ", ".join(f"count(*) filter (where {sql_in('reason', rs)})::bigint as {n}" for n, rs in _counter.items()) + " from f",
    "rejects_by_source": f"with {JUDGED} select source_id, reason, count(*)::bigint as n from judged where reason is not null group by 1, 2",
    "dedupe_greedy": f"with open as (select doc_id as o, 'u' || (doc_id % 611) || '-' || lang as a, text as b from documents), folded as (select {GREEDY} as s from open where b <> '') select unnest(s.o) as doc_id from folded",
    "history_anti": f"""
      with a as (select *, {_CANON} as ku, nullif({_TKEY}, '') as kt, strftime(date '2024-01-01' + cast(seq % 40 as integer), '%Y-%m-%d') as d from {ARTICLES_SQL} o),
      u as (select ku, max(d) as du from a where seq % 3 = 0 and d <> '2024-01-31' group by 1), t as (select kt, max(d) as dt from a where seq % 3 = 0 and d <> '2024-01-31' and kt is not null group by 1)
      select seq, case when du is not null then 'url' when dt is not null then 'title' end as matched_by, coalesce(du, dt) as matched_date from a left join u using (ku) left join t using (kt) where seq % 3 <> 0""",
    "history_kept": f"""
      with a as (select *, {_CANON} as ku, nullif({_TKEY}, '') as kt, case seq % 3 when 0 then '2024-01-29' when 1 then '2024-02-02' else '2024-01-31' end as d from {ARTICLES_SQL} o),
      u as (select ku, max(d) as du from a where d <> '2024-01-31' group by 1), t as (select kt, max(d) as dt from a where d <> '2024-01-31' and kt is not null group by 1)
      select seq, case when du is not null then 'url' when dt is not null then 'title' end as matched_by, coalesce(du, dt) as matched_date from a left join u using (ku) left join t using (kt)""",
    "round_robin": """
      select doc_id, source, row_number() over (order by turn, f)::int as place from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as turn, min(doc_id) over (partition by source) as f from documents) order by turn, f limit 60""",
    "review_cap": f"""
      with r as (select seq, source_id, row_number() over (partition by source_id order by seq) as turn, min(seq) over (partition by source_id) as f, {sql_in('source_id', rules.SHARED_QUOTA_SOURCES)} as sh from {ARTICLES_SQL} o),
      l as (select * from r where turn <= case source_id {' '.join(f"when {quoted(k)} then {v}" for k, v in rules.REVIEW_LIMITS.items())} else {rules.REVIEW_LIMIT} end),
      g as (select *, row_number() over (partition by sh order by turn, f) as n from l)
      select seq, source_id, row_number() over (order by turn, f)::int as place from g where not sh or n <= {rules.REVIEW_GROUP_LIMIT} order by turn, f limit {rules.REVIEW_TOTAL}""",
    "value_scores": f"""with {BASE} select seq, ({_value})::int as score, case when seq % 2 = 0 then '近期精选 · x' when seq % 3 = 0 then '近期精选 · y' else '近期精选' end as label,
      case when category <> 'politics' then category when s_subcategory = 'china-obgyn' or s_lang = 'zh' then 'china-obgyn' else 'international-obgyn' end as column from cl""",
    "window_partition": f"""
      select event_type, case when h < 0 then 'future' when lo is null then 'none' when h <= lo then 'priority' when h <= hi then 'supplemental' else 'outside' end as part, count(*)::bigint as n from (
        select event_type, epoch({NOW_SQL} - ts) / 3600.0 as h, case event_type when 'view' then 24 when 'click' then 48 when 'purchase' then 240 end as lo, case event_type when 'view' then 240 when 'click' then 480 when 'purchase' then 700 end as hi from events) group by 1, 2""",
    "grouped_topn": """
      select n_name, top from nation left join (select c_nationkey, string_agg(cast(c_custkey as varchar), ',' order by c_acctbal desc, c_custkey) as top from
        (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) where r <= 5 group by 1) on n_nationkey = c_nationkey""",
    "digest_join": """
      with cand as (select item_id as seq, 'https://x.org/' || item_id as url, (['tech', 'finance', 'politics'])[item_id % 3 + 1] as category, case when item_id % 5 <> 4 then text end as summary, item_id % 4 = 3 as low from benchmark),
      item as (select item_id, (['tech', 'finance', 'politics'])[(item_id + case when item_id % 10 = 8 then 1 else 0 end) % 3 + 1] as category, case when item_id % 6 = 0 then 'given' end as s, case when item_id % 8 <> 0 then item_id * 0.7 end as imp from benchmark),
      found as (select c.seq, c.url, c.category, coalesce(i.s, c.summary) as summary, greatest(1, least(10, floor(coalesce(imp, 5) + 0.5))) as v, low, i.item_id from item i join cand c on i.item_id = c.seq and i.category = c.category where coalesce(i.s, c.summary) is not null),
      kept as (select *, row_number() over (partition by category order by item_id) as place from found qualify place <= case category when 'politics' then 10 else 4 end),
      back as (select *, row_number() over (order by case category when 'tech' then 0 when 'finance' then 1 else 2 end, seq) as i from cand where not low and summary is not null and seq not in (select seq from kept) qualify i <= greatest(1, 15 - (select count(*) from kept))),
      every as (select category, place, url, summary, (case when low then least(5, v) else v end)::int as importance, false as restored from kept union all select category, 1000 + i, url, trim(summary), 5, true from back)
      select category, row_number() over (partition by category order by place)::bigint as place, url, summary, importance, restored from every""",
    "review_join": f"""
      with {BASE}, one as (select *, case when seq % 5 = 0 then 'rejected' when seq % 5 = 1 then 'uncertain' else 'accepted' end as status from cl),
      rejected as (select distinct url from one where status = 'rejected'),
      pair as (select a.*, r.seq as rseq, r.status as rstatus from (select * from one qualify row_number() over (partition by url order by seq desc) = 1) a join one r on a.url = r.url where a.known and r.status <> 'rejected' and a.url not in (select url from rejected)),
      f as (select *, not subst and official and d_type not in ('news', 'video', 'education') and not {sql_match('title', rules.VIDEO_TITLE)} as fb from pair),
      good as (select *, row_number() over (partition by url order by rseq) as n from f where not excluded and (rstatus = 'accepted' or (s_class = 'official_authority' and official)) and (subst or fb))
      select seq, case when fb then {quoted(digest.TITLE_ONLY)} else 's' || rseq end as summary, case when fb then 'uncertain' else rstatus end as review_status, fb or rstatus = 'uncertain' as low_priority from good where n = 1""",
    "llm_rejected": f"with a as (select seq, {_CANON} as k from {ARTICLES_SQL} o) select seq from a where seq % 2 = 0 and k not in (select k from a where seq % 7 = 0)",
    "conversation_turns": """
      select conv_id, string_agg(role || ': ' || text, chr(10) order by n) as transcript, count(*)::bigint as turns from (select *, row_number() over (partition by conv_id order by turn, role, text) as n from conversations) group by 1""",
    "funnel_by_source": """
      select source, count(*)::bigint as fetched, count(quality)::bigint as labelled, count(*) filter (where quality = 1)::bigint as good, count(*) filter (where quality = 1 and toxic = 0)::bigint as clean from documents left join labels using (doc_id) group by 1""",
    "details_by_source": "select case when grouping(source) = 1 then 'all' else source end as source_id, count(*) filter (where n_chars >= 100)::bigint as requested, count(*) filter (where n_chars < 100)::bigint as cache_hits, count(*) filter (where n_chars >= 100 and coalesce(lang = 'en', false))::bigint as succeeded, count(*) filter (where n_chars >= 100 and not coalesce(lang = 'en', false))::bigint as failed, count(*) filter (where n_chars >= 100 and lang = 'en' and n_chars % 2 = 0)::bigint as date_enriched, count(*) filter (where n_chars >= 100 and lang = 'en' and n_chars % 3 = 0)::bigint as excerpt_enriched, 0::bigint as type_enriched from documents group by grouping sets ((source), ())",
    "history_keys": """
      with a as (select o_orderkey as seq, case when o_orderkey % 4 in (0, 2) then (o_custkey % 500 + 1000000)::varchar end as pmid, case when o_orderkey % 4 in (1, 2) then '10.1000/ab.' || (o_custkey % 300) end as doi, strftime(date '2024-01-01' + cast(o_orderkey % 40 as integer), '%Y-%m-%d') as d from orders),
      x as (select doi, max(d) as dd from a where seq % 3 = 0 and d <> '2024-01-31' and doi is not null group by 1), y as (select pmid, max(d) as dp from a where seq % 3 = 0 and d <> '2024-01-31' and pmid is not null group by 1)
      select seq, case when dd is not null then 'doi' when dp is not null then 'pmid' end as matched_by, coalesce(dd, dp) as matched_date from a left join x using (doi) left join y using (pmid) where seq % 3 <> 0""",
    "completeness": f"select source_id, count(*)::bigint as total, count(published_at)::bigint as dated, count(*) filter (where length(trim(excerpt)) >= 30)::bigint as with_excerpt, count(content_type)::bigint as typed, count(published_at) = count(*) as all_dated from {ARTICLES_SQL} o group by 1",
    "merged_top": "select doc_id from (select * from documents where doc_id % 3 > 0 order by n_chars desc, doc_id limit 40) where lang <> 'en' and doc_id % 7 <> 0",
    "detail_candidates": "select seq, source_id from (select *, row_number() over (partition by source_id order by seq) as r from (select doc_id as seq, 's' || (doc_id % 2) as source_id from documents qualify row_number() over (partition by doc_id % 37 order by doc_id) = 1 order by doc_id limit 16)) where r <= 8",
    "report_tree": """
      select category, subgroup, source_id, string_agg(title, ',' order by n) as titles from (
        select 'r' || n_regionkey as category, c_mktsegment as subgroup, n_name as source_id, c_name as title,
          row_number() over (partition by n_regionkey, c_mktsegment, n_name order by case when n_name = 'NATION_3' then null else floor(c_acctbal + 10000) end desc nulls last, c_custkey) as n from customer join nation on c_nationkey = n_nationkey)
      where n <= case category when 'r0' then 4 when 'r1' then 2 else 5 end group by 1, 2, 3""",
}
