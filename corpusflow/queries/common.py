"""Shared pieces of queries: the run's time, articles made from the driver's tables, SQL of rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import spread

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
NOW_SQL = "timestamp '2024-01-31 00:00:00'"


def quoted(x: object) -> str:
    return "null" if x is None else "'" + str(x).replace("'", "''") + "'"


def sql_match(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {quoted('(?i)' + pattern)}), false)"


def sql_any(text: str, patterns: Sequence[str]) -> str:
    return "(" + " or ".join(sql_match(text, p) for p in patterns) + ")"


def sql_first(text: str, rules: Sequence[tuple[object, str]], otherwise: str = "null") -> str:
    label = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return "case " + " ".join(f"when {sql_match(text, p)} then {label(k)}" for k, p in rules) + f" else {otherwise} end"


def sql_contains(text: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), {quoted(w.lower())})" for w in words) + ")"


def sql_in(x: str, names: Sequence[str]) -> str:
    return f"coalesce({x} in ({', '.join(map(quoted, names))}), false)"


def sql_fixed(x: str, digits: int) -> str:
    """A double with fixed digits, from its exact value; exact halves go away from zero."""
    half, scale = 2 ** (digits + 1), 10**digits
    return f"printf('%.{digits}f', case when {x} * {half} = floor({x} * {half}) and abs({x}) * {2 * scale} % 2 = 1 then ({x} * {scale} + 0.5 * sign({x})) / {scale} else {x} end)"


def cycle(key: str, values: Sequence[object]) -> str:
    """A value for each remainder of a key: SQL for both engines."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end"


#: Articles are made from orders: whole sentences that rules look for, dealt out by remainders.
TITLES = (
    "Clinical guideline on preeclampsia", "Consensus statement on fetal growth", "Committee opinion on cesarean birth", "Patient safety alert for oxytocin", "Position statement on fertility care",
    "Randomized controlled trial of cerclage", "Surgical technique for hysteroscopy", "Video article on laparoscopic repair", "Webinar registration now open", "Career opportunities in our clinic",
    "Society news and update", "Quality improvement in obstetrics", "Policy document on maternal care", "Narrative review of endometriosis", "Invited editorial on placenta accreta",
    "Study finds changes in the placenta of mice", "Training course in robotic surgery", "Technical note on pelvic floor mesh", "妇科肿瘤诊疗指南解读", "高危剖宫产专家共识", "宫腔镜手术技术要点", "学会动态与临床更新", "招聘产科医生", "   ",
)
EXCERPTS = (None, "A summary of obstetric practice.", "New evidence about pregnancy and the uterine wall.", "Laparoscopy outcomes in gynecology.", "Budget report of the region.", "   ", "Register for the congress; sponsor packages.", "IVF success and embryo quality.")
CONTENT = (None, None, "abstract", "Surgical Technique", "metadata_only", "professional-review", "Clinical update", "guideline summary", "original article", None, "full_text")
DOCUMENTS = (None, None, None, None, None, None, "guideline", None, "research_article", None, "policy", None, "nonsense")
SOURCES = (
    ("acog", "official_authority", "https://acog.example.org/news", "tech", ("obstetric", "guideline"), ("budget",), "acog.example.org", None, "en"),
    ("nice", "general_authority", "https://nice.example.org/", "tech", ("pregnancy", "obstetric"), (), "nice.example.org", None, "en"),
    ("bjog", "academic_journal", "https://bjog.example.net/", "finance", (), (), "bjog.example.net", None, "en"),
    ("figo-podcast", "professional_vertical", "https://figo.example.com/", "politics", (), (), "figo.example.com", None, "en"),
    ("figo-society-pubmed", "professional_vertical", "https://pubmed.example.com/", "politics", (), (), "pubmed.example.com", None, "en"),
    ("medpage-today-headlines", "professional_vertical", "https://medpage.example.com/", "politics", ("pregnancy", "obstetric"), (), "medpage.example.com", None, "en"),
    ("medical-xpress-obgyn", "professional_vertical", "https://xpress.example.com/", "politics", (), ("mesh",), "xpress.example.com", None, "en"),
    ("china-obgyn", "professional_vertical", "https://china.example.cn/", "politics", (), (), "china.example.cn", "china-obgyn", "zh"),
)
SOURCE_IDS = (*[s[0] for s in SOURCES], "unknown-source")
SOURCE_SCHEMA = "id string, class string, url string, category string, keywords array<string>, exclude_keywords array<string>, allowed_hosts array<string>, subcategory string, lang string, name string"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s[:4], list(s[4]), list(s[5]), [s[6]], *s[7:], s[0].upper()) for s in SOURCES], SOURCE_SCHEMA)


def _article_columns(now: str, minus_hours: str) -> str:
    hosts = [s[6] for s in SOURCES] + ["elsewhere.example.org"]
    return f"""
      o_orderkey as seq, {cycle('o_custkey', SOURCE_IDS)} as source_id,
      concat({cycle('o_orderkey', TITLES)}, case when o_orderkey % 24 = 23 then '' else concat(' ', cast(o_custkey % 97 as varchar(10))) end) as title,
      concat(case when o_orderkey % 31 = 0 then 'ftp://' else 'https://' end, {cycle('o_custkey', hosts)}, '/a/', cast(o_orderkey % 5003 as varchar(10)), '?utm_source=feed&id=', cast(o_custkey % 5 as varchar(10))) as url,
      {cycle('o_custkey', EXCERPTS)} as excerpt, cast(null as varchar(10)) as meta, {cycle('o_orderkey', CONTENT)} as content_type,
      {minus_hours} as published_at, 'tech' as category, {cycle('o_orderkey', DOCUMENTS)} as document_type, cast(null as varchar(10)) as content_type_evidence
    """


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark, sf_dir, "orders").createOrReplaceTempView("corpusflow_orders")
    at = "case when o_orderkey % 41 = 0 then null else timestamp_seconds(1706659200 - (o_orderkey * 7 % 5000 - 48) * 3600) end"
    return spark.sql(f"select {_article_columns('', at)} from corpusflow_orders").withColumn("category", F.lit("tech"))


AT_SQL = f"case when o_orderkey % 41 = 0 then null else {NOW_SQL} - to_hours(o_orderkey * 7 % 5000 - 48) end"
ARTICLES_SQL = f"(select {_article_columns('', AT_SQL)} from orders)"


def _list(xs: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]::varchar[]"


SOURCES_SQL = "(select * from (values " + ", ".join(f"({quoted(s[0])}, {quoted(s[1])}, {quoted(s[2])}, {quoted(s[3])}, {_list(s[4])}, {_list(s[5])}, {quoted(s[6])}, {quoted(s[7])}, {quoted(s[8])})" for s in SOURCES) + ") as v(s_id, s_class, s_url, s_category, s_keywords, s_exclude, s_host, s_subcategory, s_lang))"
