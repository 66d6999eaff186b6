"""History: what was shown before, as prioritised anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..storage import discard, stored

c = F.col
KEYS = ("url", "title", "doi", "pmid")


def keyed(articles: DataFrame) -> DataFrame:
    """Adds the four keys (k_url, k_title, k_doi, k_pmid); blank ones are null."""
    out = articles.withColumn("k_url", F.nullif(urls.canonical(c("url")), F.lit("")))
    out = out.withColumn("k_title", F.nullif(text.normalize_content_title(c("title")), F.lit("")))
    return out.withColumn("k_doi", urls.doi_in(c("url"), c("excerpt"), c("meta"))).withColumn("k_pmid", urls.pmid_in(c("url"), c("excerpt"), c("meta")))


def _keys() -> object:
    """Array of (place of the key's kind in KEYS, key) of a keyed row."""
    return F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), c(f"k_{k}").alias("key")) for i, k in enumerate(KEYS)]), lambda s: s["key"].isNotNull())


def against(articles: DataFrame, history: DataFrame, current_date: str) -> DataFrame:
    """articles (unique seq) with matched_by (url, title, doi, pmid, in this order; null: new) and matched_date.

    history: (k_url, k_title, k_doi, k_pmid, date) of all dates but the current one,
    also later ones.  A key's latest date counts.  Both sides become rows (kind, key):
    the history is read once and reduced to one row a key, one join finds all matches,
    and only (seq, match) goes back to the articles.
    """
    latest = history.where(c("date") != current_date).select(F.explode(_keys()).alias("k"), "date").groupBy("k").agg(F.max("date").alias("date"))
    asked = keyed(articles).select("seq", F.explode(_keys()).alias("k"))
    found = asked.join(latest, "k").groupBy(c("seq").alias("__seq")).agg(F.min_by(F.struct("k.kind", "date"), "k.kind").alias("__m"))
    by = F.get(F.array(*map(F.lit, KEYS)), c("__m.kind"))
    return articles.join(found, c("seq") == c("__seq"), "left").select(*articles.columns, by.alias("matched_by"), c("__m.date").alias("matched_date"))


def unshown_papers(papers: DataFrame, shown: DataFrame) -> DataFrame:
    """Papers none of whose identity keys was shown; shown: (key).

    What was shown of them is stored, so that its size is known before the papers, with their texts, would be shuffled.
    """
    hits = stored(papers.select("id", F.explode(text.identity_keys(c("pmid"), c("doi"), c("title"))).alias("key")).join(shown.select("key").distinct(), "key", "left_semi").select("id").distinct())
    return papers.join(hits, "id", "left_anti")


def shown_keys(reports: DataFrame, current_date: str) -> DataFrame:
    """Distinct keys of papers in reports before the current date; reports: (date, pmid, doi, title)."""
    return reports.where(c("date") < current_date).select(F.explode(text.identity_keys(c("pmid"), c("doi"), c("title"))).alias("key")).distinct()


def displayed_records(articles: DataFrame) -> DataFrame:
    k = keyed(articles)
    return k.select("url", "title", "category", "source_id", c("k_doi").alias("doi"), c("k_pmid").alias("pmid"))


def assert_displayed(visible: DataFrame, candidates: DataFrame, most: int = 15) -> DataFrame:
    """visible, or an error when read: each URL a candidate's, none twice, at most ``most``."""
    v = visible.withColumn("__u", urls.canonical(c("url")))
    known = candidates.select(urls.canonical(c("url")).alias("__u")).distinct().withColumn("__ok", F.lit(True))
    counts = v.groupBy("__u").agg(F.count("*").alias("n")).join(known, "__u", "left")
    facts = counts.agg(F.count_if(c("__ok").isNull()).alias("unknown"), F.count_if(c("n") > 1).alias("twice"), F.count("*").alias("all"))
    checked = facts.select(
        F.when(c("unknown") > 0, F.raise_error(F.lit("a displayed URL is no candidate's")))
        .when(c("twice") > 0, F.raise_error(F.lit("a displayed URL occurs twice")))
        .when(c("all") > most, F.raise_error(F.lit("too many articles are displayed")))
        .otherwise(F.lit(True)).alias("__fine")
    )
    return v.drop("__u").crossJoin(F.broadcast(checked)).where("__fine").drop("__fine")  # one row


# History that grows for ever: keys kept in buckets, joined where they lie


def _slot(key: Column, slots: int) -> list[Column]:
    """The word of a filter of 64-bit words that a key sets two bits of, and these bits."""
    h = F.xxhash64(key)
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(h, F.lit(slots)), bit(40).bitwiseOR(bit(50))]


#: Buckets of the table, and words of the filter before it: 4 MB at most, whatever the history's length.
BUCKETS, SLOTS = 64, 1 << 16


def keep(displayed: DataFrame, table: str, date: str, buckets: int = BUCKETS) -> None:
    """Appends the keys of a run's articles (keyed()) to a bucketed table, and their bits to the filter beside it.

    Only the run's rows move: they are dealt to the buckets and sorted there; nothing of what is kept is read.
    """
    rows = displayed.select(F.explode(_keys()).alias("k")).select("k.kind", "k.key").distinct().withColumn("date", F.lit(date))
    rows = stored(rows.repartition(buckets, "kind", "key"))
    rows.repartition(buckets, "kind", "key").write.mode("append").bucketBy(buckets, "kind", "key").sortBy("kind", "key").saveAsTable(table)
    slot, bits = _slot(F.struct("kind", "key"), SLOTS)
    rows.select(slot.alias("slot"), bits.alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).coalesce(1).write.mode("append").saveAsTable(f"{table}_filter")
    discard(rows)


def against_kept(articles: DataFrame, table: str, current_date: str) -> DataFrame:
    """The same rows as against(), with the history that keep() appended to a table.

    Keys that the filter (one word of 64 bits for each slot, 65,536 slots, so it may be broadcast) doesn't know go no further; the
    others are dealt to the table's buckets, which are read in place: the history isn't shuffled,
    whatever its length, nor reduced before the join, as only matches are.
    """
    spark = articles.sparkSession
    sieve = spark.table(f"{table}_filter").groupBy("slot").agg(F.bit_or("bits").alias("known"))
    slot, bits = _slot(F.struct("kind", "key"), SLOTS)
    asked = keyed(articles).select("seq", F.explode(_keys()).alias("k")).select("seq", "k.kind", "k.key").withColumn("slot", slot)
    asked = asked.join(F.broadcast(sieve), "slot").where(c("known").bitwiseAND(bits) == bits).select("seq", "kind", "key")
    past = spark.table(table).where(c("date") != current_date)
    found = asked.join(past, ["kind", "key"]).groupBy(c("seq").alias("__seq")).agg(F.max_by(F.struct("kind", "date"), F.struct(-c("kind"), "date")).alias("__m"))
    by = F.get(F.array(*map(F.lit, KEYS)), c("__m.kind"))
    return articles.join(found, c("seq") == c("__seq"), "left").select(*articles.columns, by.alias("matched_by"), c("__m.date").alias("matched_date"))
