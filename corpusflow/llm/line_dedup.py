"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

Every text is a sequence of line IDs (128-bit digests of its lines that hold anything but
white space).  A suffix has a rank, a byte string whose order is that of the suffixes' first
h IDs; at first that is the ID itself.  A round takes the suffixes that aren't told apart
yet and the rank b of the suffix h lines on, numbers the distinct pairs (a, b) in their
order by one range-partitioned sort, and appends the number to the rank: ranks then order
by 2h IDs.  Suffixes that are alone with their rank, or end, stay as they are.  Rounds go
on until all are told apart (those alike to the end of their texts are equal for good), and
documents without open suffixes leave.

Neighbours in the order of ranks share as many whole numbers of their ranks as they share
powers of two of lines; the rest of their longest common prefix is counted on their IDs.
Only left-maximal pairs are looked at (the lines before differ): any other pair is one of
them, moved on by a line.  Each gives a maximal run of lines that starts elsewhere too.

Equal ranks are the intervals of the suffix array: in an interval of at least
``min_lines`` lines, or of one line of at least ``min_words`` words, all suffixes but the
earliest start a later copy, and later copies are deleted.

DataFrame functions only.  A document's ranks stay together in one row; lines move by
pairs of ranks, which are aggregated before they move, and ranks are joined back by
sort-merge joins that adaptive execution may split.  Nothing is gathered by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let, stored, unused

MIN_LINES = 2
MIN_WORDS = 50
_ID, _NUMBER = 16, 8  # bytes of a line ID, and of each number after it


def _lines(text: Column) -> Column:
    """Structs (at, line) of the lines that hold a visible character."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(numbered, lambda s: s["line"].rlike("[^\\x20\\x09-\\x0D]"))


def _text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart: rows of equal ids and texts are one document."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sequences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, lines): each document's line IDs as first ranks, whether a line has min_words words, and none open."""
    space, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"  # counting ends at the last word asked for, without going back
    long = lambda x: (F.length(x) >= 2 * min_words - 1) & x.rlike(f"^{space}*+(?:{word}++{space}++){{{min_words - 1}}}{word}")
    lines = F.transform(_lines(F.col("text").cast("string")), lambda s: F.struct(F.unhex(F.md5(s["line"])).alias("r"), F.lit(False).alias("open"), long(s["line"]).alias("long")))
    return docs.where("doc_id is not null").select("doc_id", _text_key(F.col("text")).alias("t"), lines.alias("lines")).dropDuplicates(["doc_id", "t"])


def _start() -> Column:
    return F.struct("doc_id", "t", "seq")


def _classes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, several): the earliest start of each class of rows, and whether it has another."""
    found = rows.groupBy(*keys).agg(F.min(_start()).alias("lo"), F.max(_start()).alias("hi"))
    return found.select(*keys, "lo", (F.col("lo") != F.col("hi")).alias("several"))


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "t", F.posexplode("lines").alias("seq", "x")).select("doc_id", "t", "seq", "x.r", "x.long")


def _occurring_twice(docs: DataFrame) -> DataFrame:
    return stored(_classes(_exploded(docs), "r").where("several").select(F.col("r").alias("__r")))


def _opened(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs in which the lines that occur twice or more are open."""
    return _regrouped(_exploded(docs).join(again, F.col("r") == F.col("__r"), "left").withColumn("open", F.col("__r").isNotNull()))


def _regrouped(rows: DataFrame) -> DataFrame:
    every = rows.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("seq", "r", "open", "long"))).alias("lines"))
    return every.withColumn("lines", F.transform("lines", lambda x: F.struct(x["r"], x["open"], x["long"])))


def _is_open() -> Column:
    return F.exists("lines", lambda x: x["open"])


def _with_ahead(docs: DataFrame, h: int) -> DataFrame:
    """Suffixes of documents with open ones, with the rank b of the suffix h lines on (none: empty)."""
    ahead = F.transform("lines", lambda x, i: F.struct(x["r"], x["open"], x["long"], F.coalesce(F.get(F.col("lines"), i + h)["r"], F.lit(b"")).alias("b")))
    return docs.where(_is_open()).select("doc_id", "t", F.posexplode(ahead).alias("seq", "x")).select("doc_id", "t", "seq", "x.*")


def _names(rows: DataFrame) -> DataFrame:
    """Numbers of the distinct pairs of open suffixes' ranks, in their order, and whether a pair has several suffixes."""
    pairs = _classes(rows.where("open"), "r", "b").repartitionByRange("r", "b").sortWithinPartitions("r", "b")
    return stored(pairs.select(F.col("r").alias("__r"), F.col("b").alias("__b"), "several", F.monotonically_increasing_id().alias("number")))


def _doubled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The documents of rows, their open suffixes' ranks extended by the pair's number, to twice the lines."""
    number = F.unhex(F.lpad(F.hex("number"), 2 * _NUMBER, "0"))
    named = rows.where("open").join(names, (F.col("r") == F.col("__r")) & (F.col("b") == F.col("__b")))
    named = named.select("doc_id", "t", "seq", F.concat("r", number).alias("r"), (F.col("several") & (F.length("b") > 0)).alias("open"), "long")
    return _regrouped(named.unionByName(rows.where("not open").drop("b")))


def suffix_ranks(docs: DataFrame, most: int | None = None, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """Stored tables (doc_id, t, lines) after each round: ranks by 1, 2, 4, ... lines, until nothing is open or by ``most`` lines.

    A round holds the documents that had an open suffix before it; a document's final ranks are in its last.
    """
    first = stored(sequences(docs, min_words))
    again = _occurring_twice(first)
    states = [stored(_opened(first, again))]
    discard(first, again)
    h = 1
    while (most is None or 2 * h <= most) and states[-1].where(_is_open()).limit(1).count():
        rows = _with_ahead(states[-1], h)
        names = _names(rows)
        states.append(stored(_doubled(rows, names)))
        discard(names)
        h *= 2
    return states


def _repeated(state: DataFrame, step: int = 0) -> DataFrame:
    """(doc_id, t, seq, left, key, long): open suffixes by the class of their first h + step lines, step lines beyond the
    state's h; left: lines of the suffix, since suffixes that are equal to the end share fewer than h."""
    ahead = F.transform("lines", lambda x, i: F.struct(x["open"], x["long"], F.get(F.col("lines"), i + step)["open"].alias("too"), x["r"], F.get(F.col("lines"), i + step)["r"].alias("b"), (F.size("lines") - i).alias("left")))
    rows = state.select("doc_id", "t", F.posexplode(ahead).alias("seq", "x")).where("x.open and x.too")
    return rows.select("doc_id", "t", "seq", "x.left", (F.struct("x.r", "x.b") if step else F.col("x.r")).alias("key"), "x.long")


def later_copies(states: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, t, starts): where later copies begin, as structs (seq, n): of runs of min_lines lines, and of long lines."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    level = min_lines.bit_length() - 1

    def later(rows: DataFrame, n: int) -> DataFrame:
        # stored, so that the join below deals both sides anew and may split a run that very many documents share
        earliest = stored(_classes(rows, "key").where("several").select("key", "lo"))
        return rows.join(earliest, "key").where(_start() > F.col("lo")).select("doc_id", "t", F.struct("seq", F.lit(n).alias("n")).alias("s"))

    found = later(_repeated(states[0]).where("long"), 1)
    if level < len(states):
        found = found.unionByName(later(_repeated(states[level], min_lines - (1 << level)).where(F.col("left") >= min_lines), min_lines))
    return found.groupBy("doc_id", "t").agg(F.collect_list("s").alias("starts"))


def suffix_array(states: list[DataFrame]) -> DataFrame:
    """(p, doc_id, t, seq, n, r, before), stored: the suffixes whose first line occurs twice or more, in parts p that are
    ranges of ranks; n: lines of the document, before: the ID of the line before."""
    every = None
    for k, state in enumerate(states):
        done = state if k == len(states) - 1 else state.where(~_is_open())
        every = done if every is None else every.unionByName(done)
    ahead = F.transform("lines", lambda x, i: F.struct(x["r"], F.substring(F.when(i > 0, F.get(F.col("lines"), i - 1)["r"]), 1, _ID).alias("before")))
    rows = every.select("doc_id", "t", F.size("lines").alias("n"), F.posexplode(ahead).alias("seq", "x")).where(F.length("x.r") > _ID)
    rows = rows.select("doc_id", "t", "seq", "n", "x.r", "x.before").repartitionByRange("r", "doc_id", "t", "seq")
    return stored(rows.withColumn("p", F.spark_partition_id()))


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """(a, b): each suffix b with the one before it in the array, a, as structs."""
    row = F.struct("r", "doc_id", "t", "seq", "n", "before")
    inside = suffixes.select("p", row.alias("b")).withColumn("a", F.lag("b").over(Window.partitionBy("p").orderBy("b"))).where("a is not null")
    # between parts: a row for each part
    ends = suffixes.groupBy("p").agg(F.min(row).alias("b"), F.max(row).alias("last"))
    between = ends.withColumn("a", F.lag("last").over(Window.orderBy("p"))).where("a is not null")
    return inside.select("a", "b").unionByName(between.select("a", "b"))


def maximal_runs(states: list[DataFrame]) -> DataFrame:
    """(doc_id, t, seq, n): runs of n lines from seq on that start elsewhere too, from the common prefixes of neighbours.

    Of a document's runs those that no other contains are its maximal repeated runs.
    """
    pairs = _neighbours(suffix_array(states))
    same = lambda k: (F.length("a.r") >= _ID + _NUMBER * k) & (F.substring("a.r", 1, _ID + _NUMBER * k) == F.substring("b.r", 1, _ID + _NUMBER * k))
    pairs = pairs.where(same(0) & ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False)))
    # a shared number of round k tells of 2**k lines; the number of the last round is each suffix's own but at the end of texts
    h = F.lit(1)
    for k in range(1, len(states)):
        h = F.when(same(k), F.lit(1 << k)).otherwise(h)
    whole = F.col("a.r") == F.col("b.r")
    pairs = pairs.select(F.col("a.doc_id").alias("da"), F.col("a.t").alias("ta"), F.col("a.seq").alias("sa"), F.col("b.doc_id").alias("db"), F.col("b.t").alias("tb"), F.col("b.seq").alias("sb"), h.alias("h"), F.when(whole, F.col("a.n") - F.col("a.seq")).alias("n"))
    pairs = stored(pairs)
    # the rest: fewer than h IDs of each, from their documents
    ids = states[0].select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.transform("lines", lambda x: F.substring(x["r"], 1, _ID)).alias("ids"))
    rest = pairs.where("n is null")
    for x in ("a", "b"):
        rest = rest.join(ids, (F.col("d" + x) == F.col("__d")) & (F.col("t" + x) == F.col("__t"))).withColumn("i" + x, F.slice("ids", F.col("s" + x) + F.col("h") + 1, F.col("h"))).drop("__d", "__t", "ids")
    equal = F.zip_with("ia", "ib", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    rest = rest.withColumn("n", F.col("h") + F.when(first == 0, F.size("ia")).otherwise(first - 1).cast("int")).drop("ia", "ib")
    every = pairs.where("n is not null").unionByName(rest)
    side = lambda x: every.select(F.col("d" + x).alias("doc_id"), F.col("t" + x).alias("t"), F.col("s" + x).alias("seq"), F.col("n").cast("int").alias("n"))
    return side("a").unionByName(side("b"))


def run_counts(runs: DataFrame) -> DataFrame:
    """(doc_id, t, n_runs, longest_run): a document's maximal repeated runs: those whose end is beyond all that start before."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.when(x["end"] > acc["end"], 1).otherwise(0)).cast("long").alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    run = F.struct(F.col("seq"), (-F.col("n")).alias("less"), (F.col("seq") + F.col("n")).alias("end"))  # of one start the longest first
    each = runs.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(run)).alias("xs"), F.max("n").cast("long").alias("longest_run"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return each.select("doc_id", "t", F.aggregate("xs", zero, step)["n"].alias("n_runs"), "longest_run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """docs with ``text`` freed of later copies, plus n_lines and n_removed (non-blank lines, removed ones) and, if runs is
    set, n_runs and longest_run (maximal runs of its lines that start elsewhere too, and the lines of the longest).

    A line goes if it lies in a run of min_lines non-blank lines that also starts earlier (in a
    document of smaller doc_id, or earlier in the same one), or has min_words words itself and
    also occurs earlier.  Blank lines are kept, except that a text which loses all other lines
    becomes empty.

    Defined cases: null text counts as empty; a null doc_id is neither source nor copy, its text
    stays; rows of one doc_id with equal texts are one document given several times and are
    treated alike, with different texts they are documents of their own, ordered by a hash; a
    text of fewer than min_lines lines loses long lines only.  Other columns pass unread; those
    called as an output are replaced.
    """
    states = suffix_ranks(docs, None if runs else 1 << (min_lines.bit_length() - 1), min_words)
    found = later_copies(states, min_lines)
    if runs:
        found = found.join(run_counts(maximal_runs(states)), ["doc_id", "t"], "full")
    made = ["n_lines", "n_removed", *(["n_runs", "longest_run"] if runs else [])]
    keep = [c for c in docs.columns if c not in made]
    its_id, its_key, key, starts, done = unused(docs, "__id", "__t", "__key", "__starts", "__done")
    found = found.withColumnsRenamed({"doc_id": its_id, "t": its_key, "starts": starts})
    text = F.col("text").cast("string")
    given = docs.select(*keep).withColumn(key, _text_key(F.col("text")))
    joined = given.join(found, (F.col("doc_id") == F.col(its_id)) & (F.col(key) == F.col(its_key)), "left")
    gone = F.coalesce(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["seq"], s["seq"] + s["n"] - 1)))), F.array().cast("array<int>"))
    joined = joined.withColumn(done, let(F.struct(_lines(text).alias("own"), gone.alias("gone"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("all")), _without))
    out = {c: F.col(c) for c in keep}
    out |= {"text": F.coalesce(F.col(f"{done}.text"), F.col("text")), "n_lines": F.col(f"{done}.n_lines").cast("long"), "n_removed": F.col(f"{done}.n_removed").cast("long")}
    out |= {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in made[2:]}
    return joined.select(*[v.alias(k) for k, v in out.items()])


def _without(s: Column) -> Column:
    """Text (null: unchanged) and counts of one document, from its lines and the lines that go."""
    at = F.transform(s["gone"], lambda i: F.get(s["own"]["at"], i))
    left = F.array_except(F.sequence(F.lit(0), F.size(s["all"]) - 1), at)
    text = (
        F.when(F.size(s["gone"]) == 0, F.lit(None).cast("string"))
        .when(F.size(s["gone"]) >= F.size(s["own"]), F.lit(""))
        .otherwise(F.array_join(F.transform(left, lambda i: F.get(s["all"], i)), "\n"))
    )
    return F.struct(text.alias("text"), F.size(s["own"]).alias("n_lines"), F.size(s["gone"]).alias("n_removed"))
