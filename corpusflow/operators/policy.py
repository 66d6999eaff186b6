"""Classification of articles by ordered rules.

Columns of an article: source_id, title, url, excerpt, meta, content_type,
published_at, category, document_type, content_type_evidence; of its source, joined
with the prefix ``s_``: s_class, s_url, s_allowed_hosts, s_category.  Absent texts are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import rx, scan, urls

c = F.col


#: Columns of with_texts(): all of an item's text, what tells its type, its title, all in lower case, and what a scan of that found.
ITEM, KIND, TITLE, LOW = "__item", "__kind", "__title", "__item_low"

#: Every rule over an item, its kind or its title, which are parts of the item: one scan finds which of them may match.
_PATTERNS = (
    *rules.HARD_EXCLUDED, *(p for table in (rules.HARD_EXCLUDED_KIND, rules.TITLE_TYPES, rules.CONTENT_TYPES) for _, p in table), rules.SURGICAL_TOPIC, rules.SURGICAL_METHOD, rules.PODCAST_PROMOTION, rules.PODCAST_PROFESSIONAL,
    rules.RESEARCH_NEWS, rules.RESEARCH_WORD, rules.DYNAMICS, rules.FORMAL_GUIDANCE, rules.ORDINARY_RESEARCH, rules.GUIDANCE_WORDS, rules.TECHNIQUE_LABEL, rules.TECHNIQUE_TITLE,
)
HITS = scan.Hits(scan.Scanner(_PATTERNS, {"include": rules.INCLUDE_KEYWORDS, "exclude": rules.EXCLUDE_KEYWORDS}), "__hits")


def with_texts(articles: DataFrame) -> DataFrame:
    """Adds the texts that rules read, so that some hundred rules share each, and the bits of the rules that may match."""
    out = articles.withColumn(ITEM, F.concat_ws("\n", c("title"), c("excerpt"), c("meta"), c("content_type")))
    out = out.withColumn(KIND, F.concat_ws("\n", c("title"), c("meta"), c("content_type"))).withColumn(TITLE, rx.trim(c("title")))
    out = out.withColumn(LOW, F.lower(c(ITEM)))
    return out.withColumn(HITS.column, HITS.scanner.bits(c(LOW)))


def item_has(pattern: str) -> Column:
    return rx.matches(c(ITEM), pattern, low=HITS)


def kind_has(pattern: str) -> Column:
    return rx.matches(c(KIND), pattern, low=HITS)


def hard_excluded() -> Column:
    return rx.any_match(c(ITEM), rules.HARD_EXCLUDED, HITS)


def document_type(excluded: Column | None = None) -> Column:
    """Hard-excluded content by its kind; a declared type; the title's first rule; unknown."""
    return (
        F.when(hard_excluded() if excluded is None else excluded, rx.first_match(c(ITEM), rules.HARD_EXCLUDED_KIND, "unknown", HITS))
        .when(c("document_type").isin(*rules.DOCUMENT_TYPES), c("document_type"))
        .otherwise(rx.first_match(c(TITLE), rules.TITLE_TYPES, "unknown", HITS))
    )


def with_content_type(articles: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds k_type and k_evidence: the declared name, else by rules over the declared text, else over all of the item.

    Each step is a column, looked at where those before gave nothing; only of wanted rows.
    """
    wanted = F.lit(True) if wanted is None else wanted
    kinds = tuple(dict.fromkeys(k for k, _ in rules.CONTENT_TYPES))
    out = articles.withColumn("__type", F.when(wanted, rx.trim(c("content_type"))))
    out = out.withColumn("__name", rx.replace(F.lower(c("__type")), r"[\s-]+", "_")).withColumn("__name", F.when(c("__name").isin(*kinds), c("__name")))
    out = out.withColumn("__said", F.when(c("__name").isNull() & c("__type").isNotNull(), rx.first_match(c("__type"), rules.CONTENT_TYPES, low=HITS)))
    out = out.withColumn("__found", F.when(wanted & c("__name").isNull() & c("__said").isNull(), rx.first_match(c(ITEM), rules.CONTENT_TYPES, low=HITS)))
    given = c("content_type_evidence")
    evidence = F.when(c("__name").isNotNull(), F.coalesce(given, F.lit("declared"))).when(c("__said").isNotNull(), F.coalesce(given, F.lit("metadata"))).when(c("__found").isNotNull(), "title_excerpt")
    return out.withColumn("k_type", F.coalesce("__name", "__said", "__found")).withColumn("k_evidence", evidence).drop("__type", "__name", "__said", "__found")


def substantive() -> Column:
    kind = F.lower(rx.trim(F.coalesce(c("content_type"), F.lit(""))))
    return (kind != "metadata_only") & (~rx.blank(c("excerpt")) | kind.isin("abstract", "excerpt", "full_text", "structured_description"))


def official_formal(document: Column, excluded: Column | None = None) -> Column:
    """A dated formal document on a host of the official authority that it comes from."""
    hosts = F.array_union(F.array(urls.host(c("s_url"))), F.transform(F.coalesce(c("s_allowed_hosts"), F.array().cast("array<string>")), F.lower))
    return (
        ~(hard_excluded() if excluded is None else excluded) & F.coalesce(c("s_class") == "official_authority", F.lit(False)) & document.isin(*rules.FORMAL_TYPES) & ~rx.blank(c("title"))
        & c("published_at").isNotNull() & urls.is_http(c("url")) & F.coalesce(F.array_contains(hosts, urls.host(c("url"))), F.lit(False))
    )


def academic_exception(kind: Column, evidence: Column) -> Column:
    """Reviews and commentaries of a journal that say what they are."""
    return (c("s_class") == "academic_journal") & substantive() & kind.isin("professional_review", "expert_commentary") & evidence.isin("declared", "metadata")


def error_kind(blob: Column) -> Column:
    """timeout, quota, auth or other; null for a blank text."""
    return F.when(~rx.blank(blob), rx.first_match(blob, rules.ERROR_KINDS, "other"))


def allowed_publication_type(types: Column, allowed: dict[str, str], excluded: str) -> Column:
    """The first of an array's types that the map allows; none if any type matches the exclusion."""
    table = F.create_map(*[F.lit(x) for kv in allowed.items() for x in (kv[0].lower(), kv[1])])
    found = F.filter(F.transform(types, lambda t: F.element_at(table, F.lower(t))), lambda x: x.isNotNull())
    return F.when(~F.exists(types, lambda t: t.rlike(rx.java(excluded))), F.get(found, F.lit(0)))


def banded(x: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first upper bound that x doesn't exceed."""
    out = None
    for top, label in bands:
        hit = x <= top
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def fear_greed_tone(value: Column) -> Column:
    return banded(value, list(rules.FEAR_GREED_TONES), "greed-extreme")


def stance_tone(stance: Column) -> Column:
    return rx.first_match(stance, rules.STANCES, "neutral")


def importance_tone(importance: Column) -> Column:
    return F.when(importance >= 8, "high").when(importance >= 6, "mid").otherwise("low")


def is_sports(title: Column) -> Column:
    return rx.matches(title, rules.SPORTS)
