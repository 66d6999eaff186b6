"""Registries, configurations, logs, histories and the driver's tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..storage import stored

c = F.col
SOURCES = "id string, name string, url string, type string, category string, class string, subcategory string, lang string, query string, notes string, use_curl boolean, enabled boolean, locales array<string>, keywords array<string>, exclude_keywords array<string>, allowed_hosts array<string>, lookback_hours int"
#: What the enumerated fields may be.
TYPES, CATEGORIES = ("rss", "scrape", "api"), ("tech", "finance", "politics")
CLASSES = ("official_authority", "academic_journal", "professional_vertical", "general_authority")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for work that costs much a row: a table of less than 64 MB a core, which may lie in one
    row group and so be one task's, is dealt over the cores by its first column; larger ones are many tasks' as they lie."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return df.repartition(cores, df.columns[0]) if size < cores * (64 << 20) else df


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A registry file: a JSON array; ord is its order.  Raises if invalid() finds anything."""
    # a registry is some dozens of entries: one file, one task, its order kept
    rows = spark.read.schema(SOURCES).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())
    wrong = invalid(rows).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.id}: {r.problem}" for r in wrong))
    return rows


def invalid(sources: DataFrame) -> DataFrame:
    """(id, problem) of entries with blank or repeated ids, blank names, bad URLs or unknown kinds."""
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(c("id").alias("__id"))
    from ..functions import rx, urls

    problem = (
        F.when(rx.blank(c("id")), "blank id").when(c("__id").isNotNull(), "repeated id").when(rx.blank(c("name")), "blank name").when(~urls.is_http(c("url")), "bad url")
        .when(~F.coalesce(c("type").isin(*TYPES), F.lit(False)), "unknown type").when(~F.coalesce(c("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(c("class").isNotNull() & ~c("class").isin(*CLASSES), "unknown class")
    )
    return sources.join(twice, c("id") == c("__id"), "left").withColumn("problem", problem).where("problem is not null").select("id", "problem")


def for_locale(sources: DataFrame, locale: str, default: tuple[str, ...] = ("zh", "en")) -> DataFrame:
    return sources.where(F.array_contains(F.coalesce("locales", F.array(*map(F.lit, default))), locale))


def summary(sources: DataFrame) -> DataFrame:
    """(category, total, enabled, ids) sorted by category."""
    on = F.coalesce("enabled", F.lit(True))
    return sources.groupBy("category").agg(F.count("*").alias("total"), F.count_if(on).alias("enabled"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy("category")


@dataclass(frozen=True)
class RunLimits:
    """Defaults and (least, most) of a run's settings."""

    lookback_days: int = 7
    max_papers: int = 5
    cache_days: int = 90
    overlap_hours: int = 48
    min_score: float = 40
    max_per_topic: int = 3
    enabled: bool = True
    clear_cache: bool = False

    BOUNDS = {"lookback_days": (1, 90), "max_papers": (1, 20), "cache_days": (1, 365), "overlap_hours": (0, 168), "min_score": (0, 100), "max_per_topic": (1, 10)}

    @classmethod
    def parse(cls, given: dict, env: dict[str, str] | None = None, prefix: str = "RESEARCH_") -> RunLimits:
        """From a dict in snake or camel case, overridden by the environment; an error names the field."""
        import re

        known = {k: v for k, v in cls.__dataclass_fields__.items()}
        out = {re.sub(r"(?<!^)([A-Z])", r"_\1", k).lower(): v for k, v in given.items()}
        for k in known:
            if env and prefix + k.upper() in env:
                out[k] = json.loads(env[prefix + k.upper()].lower())
        for k, v in out.items():
            if k not in known:
                raise ValueError(f"runtime.{k}: unknown")
            if k in cls.BOUNDS:
                lo, hi = cls.BOUNDS[k]
                if isinstance(v, bool) or not isinstance(v, int | float) or not lo <= v <= hi:
                    raise ValueError(f"runtime.{k}: must be a number from {lo} to {hi}")
            elif not isinstance(v, bool):
                raise ValueError(f"runtime.{k}: must be true or false")
        return cls(**out)


_TOPIC = "struct<id:string,name:string,description:string,include_keywords:array<string>,exclude_keywords:array<string>,publication_types:array<string>,enabled:boolean>"
CONFIG = f"schema_version int, domain_keywords array<string>, sources array<struct<id:string,name:string,kind:string,url:string,enabled:boolean>>, topics array<{_TOPIC}>"
PAPER_KINDS = ("pubmed", "journal-rss")


def _first_problem(items: Column, name: str, tests: list[tuple[str, Callable[[Column], Column]]]) -> Column:
    """The path of the first field of the first item that fails its test, then of the first repeated id."""

    def of(x: Column, i: Column) -> Column:
        out = None
        for field, bad in tests:
            path = F.concat(F.lit(f"{name}["), i, F.lit(f"].{field}"))
            out = F.when(bad(x[field]), path) if out is None else out.when(bad(x[field]), path)
        return out

    twice = lambda x, i: F.when(F.exists(F.slice(items, F.lit(1), i), lambda y: y["id"] == x["id"]), F.concat(F.lit(f"{name}["), i, F.lit("].id")))
    first = lambda f: F.get(F.filter(F.transform(items, f), lambda p: p.isNotNull()), F.lit(0))
    return F.coalesce(first(of), first(twice))


def configs(rows: DataFrame) -> DataFrame:
    """rows (config, payload) with the parsed configuration and ``problem``: the path of the first field that is wrong, null if none is.

    Names, descriptions and URLs must not be blank, flags be there, lists be lists (those of what to include not
    empty) without blank entries, kinds of sources known, and ids of sources and of topics each be there once.
    """
    from ..functions import rx

    out = rows.withColumn("parsed", F.from_json("payload", CONFIG))
    words = lambda least: lambda x: x.isNull() | (F.size(x) < least) | F.exists(x, rx.blank)
    of = lambda name: c(f"parsed.{name}")
    none = lambda name: F.coalesce(F.size(of(name)), F.lit(0)) < 1
    sources = [("kind", lambda x: ~F.coalesce(x.isin(*PAPER_KINDS), F.lit(False))), ("id", rx.blank), ("name", rx.blank), ("url", rx.blank), ("enabled", lambda x: x.isNull())]
    topics = [("id", rx.blank), ("name", rx.blank), ("description", rx.blank), ("include_keywords", words(1)), ("exclude_keywords", words(0)), ("publication_types", words(0)), ("enabled", lambda x: x.isNull())]
    problem = (
        F.when(c("parsed").isNull(), "root").when(~F.coalesce(of("schema_version") == 1, F.lit(False)), "schema_version").when(none("sources"), "sources").when(none("topics"), "topics")
        .otherwise(F.coalesce(_first_problem(of("sources"), "sources", sources), _first_problem(of("topics"), "topics", topics), F.when(words(1)(of("domain_keywords")), "domain_keywords")))
    )
    return out.withColumn("problem", problem)


def topics_of(parsed: DataFrame) -> DataFrame:
    """(config, ord, id, name, ...) of the topics of configurations without a problem."""
    return parsed.where("problem is null").select("config", F.posexplode("parsed.topics").alias("ord", "t")).select("config", "ord", "t.*")


CALLS = "ts timestamp, backend string, model string, durationMs bigint, success boolean, inputChars bigint, outputChars bigint, promptChars bigint, errorCategory string, errorSnippet string"


def read_calls(spark: SparkSession, paths: list[str], old_backend: str = "claude-cli") -> DataFrame:
    """Call logs, JSON lines; malformed lines are dropped, old records get their missing columns."""
    rows = spark.read.schema(CALLS).option("mode", "DROPMALFORMED").json(paths)
    return rows.select(
        F.monotonically_increasing_id().alias("seq"), "ts", F.coalesce("backend", F.lit(old_backend)).alias("backend"), "model", c("durationMs").alias("duration_ms"),
        "success", F.coalesce("inputChars", "promptChars", F.lit(0)).alias("input_chars"), F.coalesce("outputChars", F.lit(0)).alias("output_chars"), c("errorCategory").alias("error_category"), c("errorSnippet").alias("error"),
    )


def read_history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records under <root>/date=YYYY-MM-DD/*.json, with their date; malformed files are skipped."""
    rows = spark.read.schema(f"{schema}, date string, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


#: What Spark says of a file that isn't Parquet, or is a broken one.
_BROKEN = ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FAILED_READ_FILE.PARQUET")


def read_state(spark: SparkSession, path: str, schema: str, clear: bool = False) -> DataFrame:
    """A state table, or an empty one where it is missing, to be cleared, or in a broken format: that is moved aside.

    Any other failure (a lost executor, no permission) is raised: the state isn't touched.
    """
    empty = spark.createDataFrame([], schema)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if clear or not fs.exists(fs_path):
        return empty
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.write.format("noop").mode("overwrite").save()  # all files, not only the first
        return rows
    except Exception as e:
        if not any(x in str(e) for x in _BROKEN):
            raise
        aside = f"{path}.broken-{uuid.uuid4().hex[:8]}"
        if not fs.rename(fs_path, spark._jvm.org.apache.hadoop.fs.Path(aside)):
            raise OSError(f"{path} is broken and can't be moved to {aside}") from e
        return empty


ARTICLES = "seq bigint, source_id string, title string, url string, excerpt string, meta string, content_type string, published_at timestamp, category string, document_type string, summary string"


Connector = Callable[[DataFrame], DataFrame]


def dispatched(payloads: DataFrame, sources: list[dict], by_id: dict[str, Connector], by_type: dict[str, Connector]) -> tuple[DataFrame | None, DataFrame]:
    """Rows of all enabled sources, and (source_id, ok, fetched, error) of each.

    A source is read by the connector of its id, else of its type; sources that are disabled or
    never read have no rows.  Sources of one connector are read together and stored; if that
    fails, each is read for itself, so that a failure is its own source's.
    """
    groups: dict[int, tuple[Connector, list[str]]] = {}
    for s in sources:
        f = by_id.get(s["id"]) or by_type.get(s.get("type", ""))
        if f is not None and s.get("enabled", True) and s["id"] not in rules.NEVER_READ:
            groups.setdefault(id(f), (f, []))[1].append(s["id"])
    out, status = None, []

    def read(f: Connector, ids: list[str]) -> DataFrame:
        return stored(f(payloads.where(c("source_id").isin(*ids))))

    for f, ids in groups.values():
        try:
            parts = [(ids, read(f, ids))]
        except Exception:  # one of them, to be found
            parts = []
            for i in ids:
                try:
                    parts.append(([i], read(f, [i])))
                except Exception as e:
                    status.append((i, False, 0, str(e).split("\n")[0][:200]))
        for own, rows in parts:
            counts = {r.source_id: r["count"] for r in rows.groupBy("source_id").count().collect()}
            status += [(i, True, counts.get(i, 0), None) for i in own]
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, payloads.sparkSession.createDataFrame(status, "source_id string, ok boolean, fetched bigint, error string")


def matches_category(requested: str | None, mapping: dict[str, tuple[str, str]] = rules.REQUESTED) -> Column:
    """Sources that a command line asks for by (category, subcategory); none given, all; an unknown one, none."""
    if not requested:
        return F.lit(True)
    if requested not in mapping:
        return F.lit(False)
    category, subcategory = mapping[requested]
    return (c("category") == category) & F.coalesce(c("subcategory") == subcategory, F.lit(False))
