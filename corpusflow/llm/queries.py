"""The queries of this subpackage: thin callables (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, divergence, fingerprints, line_dedup, minhash_dedup, periodic_runs, quality_classifier, quality_rules, source_mixing, substring_dedup, suffix_dedup, url_filter
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file's place, on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(column: str):
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), runs=True)
    return out.select("doc_id", "n_lines", "n_removed", _sha("text").alias("kept_sha256"), "n_runs", "longest_run")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), texts=False)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


def _mixed_layouts(records: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON of several layouts, dealt out by a hash of the id.

    A user and an assistant turn become two fields (plain, nested, or under other names), with a
    system turn before them three; others a list under one of three names, some with fields that
    no mapping names.
    """
    turns, kind = F.col("record.messages"), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    roles = F.array_join(F.transform(turns, lambda t: t["role"]), ",")
    said = lambda i: F.get(turns, F.lit(i))["content"]
    listed = lambda role, text: F.transform(turns, lambda t: F.struct(t["role"].alias(role), t["content"].alias(text)))
    pair = lambda a, b: F.struct(said(0).alias(a), said(1).alias(b))
    two, three = (roles == "user,assistant") & (F.size(turns) == 2), (roles == "system,user,assistant") & (F.size(turns) == 3)
    named = F.transform(turns, lambda t: F.struct(t["content"], F.lit("x").alias("name"), t["role"]))
    out = (
        F.when(two & (kind == 0), F.to_json(pair("prompt", "response"))).when(two & (kind == 1), F.to_json(pair("question", "answer")))
        .when(two & (kind == 2), F.to_json(F.struct(F.col("conv_id").alias("id"), pair("prompt", "response").alias("data"))))
        .when(three & (kind < 2), F.to_json(F.struct(said(1).alias("prompt"), said(2).alias("response"), said(0).alias("system"), kind.alias("score"))))
        .when(kind == 0, F.to_json(F.struct(F.col("conv_id").alias("id"), named.alias("messages")))).when(kind == 1, F.to_json(F.struct(listed("speaker", "text").alias("dialog"))))
        .otherwise(F.to_json(F.col("record")))
    )
    return records.select("conv_id", out.alias("record"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L as conv_id, t as turn, r as role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    out = chat_format.format_records(_mixed_layouts(chat_format.rows_to_records(rows.unionByName(extra))))
    back = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_mixing.mix(docs, source_mixing.tempered(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Words of host names whose pages make up the query's list.
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills|track|spam|adult)([.-]|$)"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of all pages on hosts named after what is unwanted, in canonical form, so that other spellings of them are found too."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select("url"), URL_RULES)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), tails=True, texts=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_fingerprints, op4_substring_dedup, op5_chat_format, op6_quality_rules, op7_suffix_array_dedup, op8_source_mixing, op9_quality_classifier, op10_minhash_dedup, op11_source_divergence, op12_url_filter, op13_periodic_runs, pipeline)}

#: A line is a run of characters other than \n; it counts if it holds more than spaces, tabs and the like.
OP1_SQL = r"""
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), line as (
  select doc_id, i, ls[i] as l, row_number() over (partition by doc_id order by i) as seq
  from cut, unnest(range(1, len(ls) + 1)) as u(i)
  where regexp_matches(ls[i], '[^\x20\x09-\x0D]')
), pair as (
  select doc_id, seq, l, lead(l) over (partition by doc_id order by seq) as next_l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as words from line
), later as (
  select doc_id, seq, 2 as n from (
    select doc_id, seq, row_number() over (partition by l, next_l order by doc_id, seq) as nth from pair where next_l is not null
  ) where nth > 1
  union all
  select doc_id, seq, 1 as n from (
    select doc_id, seq, row_number() over (partition by l order by doc_id, seq) as nth from pair where words >= 50
  ) where nth > 1
), gone as (
  select distinct doc_id, seq + k as seq from later, unnest([0, 1]) as v(k) where k < n
), counts as (
  select line.doc_id, count(*) as n_lines, count(gone.seq) as n_removed,
         list(line.i) filter (where gone.seq is not null) as gone_at
  from line left join gone on line.doc_id = gone.doc_id and line.seq = gone.seq group by line.doc_id
), equal as (
  select a.doc_id, a.seq, b.doc_id as d2, a.seq - b.seq as shift from line a join line b on a.l = b.l and (a.doc_id <> b.doc_id or a.seq <> b.seq)
), run as (
  select *, seq - row_number() over (partition by doc_id, d2, shift order by seq) as part from equal
), reach as (
  select doc_id, seq, max(last) as last from (select doc_id, seq, max(seq) over (partition by doc_id, d2, shift, part) as last from run) group by doc_id, seq
), longest as (
  select doc_id, count(distinct last) as n_runs, max(last - seq + 1) as longest_run from reach group by doc_id
)
select d.doc_id, coalesce(c.n_lines, 0)::bigint as n_lines, coalesce(c.n_removed, 0)::bigint as n_removed,
       sha256(case when coalesce(c.n_removed, 0) = 0 then array_to_string(d.ls, chr(10))
                   when c.n_removed = c.n_lines then ''
                   else array_to_string(list_transform(list_filter(range(1, len(d.ls) + 1), lambda i: not list_contains(c.gone_at, i)), lambda i: d.ls[i]), chr(10)) end) as kept_sha256,
       coalesce(g.n_runs, 0)::bigint as n_runs, coalesce(g.longest_run, 0)::bigint as longest_run
from cut d left join counts c on d.doc_id = c.doc_id left join longest g on d.doc_id = g.doc_id
"""

OP5_SQL = r"""
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
  select *, regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g') as e from every
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(8 + length(role) + 8 + length(e) + 7)::bigint as formatted_chars
from escaped group by conv_id
"""

_WORD = r"[^\x20\x09-\x0D]+"
OP6_SQL = rf"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents
), word as (
  select rid, generate_subscripts(ws, 1) as i, unnest(ws) as w from (select rid, regexp_extract_all(text, '{_WORD}') as ws from docs)
), per_word as (
  select rid, count(*) as n_words, sum(length(w)) as word_chars from word group by rid
), tri as (
  select rid, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from word window o as (partition by rid order by i)
), often as (
  select rid, i from (select rid, i, count(*) over (partition by rid, w, w2, w3) as n from tri where w3 is not null) where n > 1
), repeats as (
  select rid, count(*) as n_repeat_words from (select distinct rid, i + k as i from often, unnest([0, 1, 2]) as v(k)) group by rid
), line as (
  select d.rid, d.doc_id, d.host, u.l from (select *, string_split(text, chr(10)) as ls from docs) d, unnest(ls) as u(l)
  where regexp_matches(u.l, '{_WORD}')
), dup as (
  select rid, count(*) - count(distinct l) as n_dup_lines from line group by rid
), norm as (
  select rid, doc_id, host, regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g'), '[0-9]', '0', 'g') as n,
         len(regexp_extract_all(l, '{_WORD}')) as w from line
), size as (
  select host, count(distinct doc_id) as docs from docs group by 1
), common as (
  select host, n from (select host, n, count(distinct doc_id) as c from norm where n <> '' group by host, n) join size using (host) where c > greatest(3.0, docs * 0.05)
), gone as (
  select rid, sum(w) as n_common_words from norm join common using (host, n) where doc_id is not null group by rid
), base as (
  select d.doc_id, coalesce(p.n_words, 0)::bigint as n_words, coalesce(p.word_chars, 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(u.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(g.n_common_words, 0)::bigint as n_common_words
  from docs d left join per_word p using (rid) left join dup u using (rid) left join repeats r using (rid) left join gone g using (rid)
), judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words,
       not base_failed and n_words - n_common_words >= n_words * 0.3 as kept from judged
"""

OP11_SQL = r"""
with docs as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents
), word as (
  select rid, lang, source, unnest(ts) as term from docs
), kept as (
  select lang, term, count(*) as t from word group by lang, term having count(distinct rid) >= 3
), n as (
  select lang, source, term, count(*) as n from word join kept using (lang, term) group by lang, source, term
), size as (
  select lang, count(*) as v, sum(t) as total from kept group by lang
), grp as (
  select g.lang, g.source, coalesce(sum(n.n), 0) as total from (select distinct lang, source from docs) g left join n using (lang, source) group by g.lang, g.source
), dense as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n.n, 0) + 1) // (g.total + s.v) as p,
         1 + 1000000000::hugeint * (k.t + 1) // (s.total + s.v) as q
  from grp g join kept k using (lang) join size s using (lang) left join n using (lang, source, term)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), part as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from dense where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from part
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""

OP12_SQL = r"""
with cut as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) as path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) as query from pages
), named as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '\.$', ''), '^(www|m)\.', '') as name,
         regexp_replace(regexp_replace(regexp_replace(path, '/index\.html$', ''), '\.html$', ''), '/+$', '') as way,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') as asked from cut
), canon as (
  select *, case when name <> '' then name || way || case when asked <> '' then '?' || asked else '' end end as canonical,
         case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
              when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
              when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
              when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
              when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from named
), listed as (
  select distinct canonical from canon where regexp_matches(host, '(^|[.-])(casino|bets|pills|track|spam|adult)([.-]|$)')
)
select page_id, host, path, rule, canonical, rule is null and l.canonical is not null as listed,
       case when rule is not null then case when rule in ('com/', 'www.example.com/en/') then 'allow' else 'block' end when l.canonical is not null then 'block' else 'allow' end as verdict
from canon left join listed l using (canonical)
"""

SQL = {"op1_line_dedup": OP1_SQL, "op5_chat_format": OP5_SQL, "op6_quality_rules": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_url_filter": OP12_SQL}
