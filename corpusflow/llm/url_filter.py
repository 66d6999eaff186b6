"""URL filters: ordered host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A rule names a host and a path; it fits URLs of that host and its subdomains whose path starts
with the rule's, and of the rules that fit the longest decides.  A URL that no rule fits is
blocked if its canonical form is on a list.  The list becomes a blocked Bloom filter: a block is
512 bits in eight words, a URL sets one bit in each word of one block.  The filter is a table of
a row for each block, MOST_BLOCKS at most whatever the list's length, so it may be broadcast;
pages probe it in the scan's tasks.  What may be on the list goes on to an exact join with the
list, which removes false positives: a full filter costs time, never right results.

A canonical URL drops scheme, user, default port, leading ``www.`` or ``m.``, a trailing dot of
the host, fragment, ``index.html``, ``.html`` and slashes at the path's end, and parameters that
only track; the other parameters are sorted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Blocks of 512 bits: 8 MB of filter, some 5 million URLs at 12 bits each.
MOST_BLOCKS = 1 << 17
BITS_A_URL = 12
WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that only track.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _parts(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group), F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    return F.translate(_parts(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _parts(url, 2)


def canonical(url: Column) -> Column:
    """The form that lists and pages are compared in; null where there is no host."""
    name = host(url)
    for pattern in (r"^[^@]*@", r":(80|443)?$", r"\.$", r"^(www|m)\."):
        name = F.regexp_replace(name, pattern, "")
    way = path(url)
    for pattern in (r"/index\.html$", r"\.html$", r"/+$"):
        way = F.regexp_replace(way, pattern, "")
    asked = F.filter(F.split(_parts(url, 3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.when(name != "", F.concat(name, way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(name: Column, way: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    Longest by characters of host and path; of equally long ones the longer host, then block.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block")):
        fits = ((name == r.host) | name.endswith("." + r.host)) & way.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(url: str) -> list[Column]:
    """The bit that a URL sets in each word of its block."""
    h = F.xxhash64(F.lit(7), F.col(url))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(url)), F.lit(blocks))


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the listed URLs: partial bit-ors, then a row for each block that has a bit."""
    return listed.select(_block(url, blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(url)))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def blocks_for(urls: int, most: int = MOST_BLOCKS) -> int:
    """A power of two of blocks with some twelve bits a URL, up to ``most``."""
    need = max(1, -(-urls * BITS_A_URL // 512))
    return min(most, 1 << (need - 1).bit_length())


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) for every row of pages.

    verdict is that of the longest rule that fits; without one, block if the canonical URL is that of
    a row of ``listed`` (column url), else allow.  listed says whether the list decided.

    Defined cases: a null url, or one without ``://``, has empty host and path, no rule, a null
    canonical URL and is allowed; null page_ids and repeated rows are judged like any other; a
    canonical URL is listed once however often it is given, null ones never; an empty list blocks
    nothing; other columns aren't read; no rows, no output.
    """
    names = stored(listed.select(canonical(F.col("url").cast("string")).alias("on_list")).where("on_list is not null").distinct())
    blocks = blocks_for(names.count(), most_blocks)
    sieve = bloom_filter(names, "on_list", blocks)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict", "canonical")
    asked = rows.where("verdict is null and canonical is not null").withColumn("block", _block("canonical", blocks))
    probed = asked.join(F.broadcast(sieve), "block", "left")
    present = F.lit(True)
    for i, b in enumerate(_bits("canonical")):
        present = present & (F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(b) != 0)
    probed = probed.withColumn("perhaps", present).drop("block", *(f"w{i}" for i in range(WORDS)))
    # both sides are shuffled anew, so that a URL of very many pages can be split
    exact = probed.where("perhaps").join(names, F.col("canonical") == F.col("on_list"), "left").withColumn("listed", F.col("on_list").isNotNull())
    cols = ["page_id", "host", "path", "rule", "verdict", "canonical", "listed"]
    no = F.lit(False)
    out = exact.select(cols).unionByName(probed.where("not perhaps").withColumn("listed", no).select(cols))
    out = out.unionByName(rows.where("verdict is not null or canonical is null").withColumn("listed", no).select(cols))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))
