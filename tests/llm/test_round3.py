"""Source divergence, URL filters and periodic runs against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import divergence, periodic_runs, quality_rules, queries, url_filter
from tests.oracle import assert_same, connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_url_filter"])
def test_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connection(sf), queries.SQL[name])


# 11: source divergence


def divergence_brute(rows, min_docs=3, top=200):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    said = [(lang or "", source or "", [t.translate(LOWER) for t in find.findall(text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {x for x, _, _ in said}:
        held = collections.Counter(t for x, _, ts in said if x == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = {s: collections.Counter(t for x, y, ts in said if (x, y) == (lang, s) for t in ts if t in kept) for s in {y for x, y, _ in said if x == lang}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {"pair": [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s], "term": [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def mixed(seed: int, n: int, sources: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["The", "the", "é", "Éa", "中文", "x1y", "don't", "a" * 50, "𝔘", "ﬁ", "ß"] + ["w" + "abcdefgh"[i % 8] * (1 + i // 8) for i in range(60)]
    text = lambda: r.choice([None, "", "12 34 --", " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))])
    return [(r.choice([i, None, 3]), text(), r.choice(["en", "en", "de", None, ""]), r.choice([None, "hot", "hot", *(f"s{k}" for k in range(sources))])) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"block_rows": 7}, {"block_rows": 11, "panel": 2}, {"top": 3, "block_rows": 5}])
def test_divergence(spark, limits):
    rows = mixed(1, 150, 6) + [(1, "only here", "fr", "a"), (2, "or there", "fr", "b"), (3, "alone " * 5, "it", "a")]
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), **limits)
    assert {tuple(x) for x in got.collect()} == divergence_brute(rows, top=limits.get("top", 200)) and got.schema["rank"].dataType.typeName() == "integer"


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert divergence.audit(none).collect() == []
    alone = divergence.audit(spark.createDataFrame([(None, None, None, None), (1, "", None, "x")], DOCS)).collect()
    assert {tuple(x) for x in alone} == {("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)}


def test_divergence_leaves_other_columns_alone(spark):
    rows = mixed(2, 40, 3)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("!") for c in ("term", "n", "docs", "block", "x", "y", "panel", "t", "v", "value", "rank", "part", "item", "lead", "salt")})
    assert {tuple(x) for x in divergence.audit(df).collect()} == divergence_brute(rows)


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([10**12, 1, 4 * 10**15, 7]), np.array([3 * 10**13, 9 * 10**15, 4 * 10**15 + 1, 7])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(count, total)]


def test_terms_of_a_long_text():
    text = "Añb-c" * 400_000
    words, doc = divergence.terms(pa.array(["", text, None, "z"]))
    assert len(words) == 400_002 and set(words.dictionary.to_pylist()) == {"añb", "cañb", "c", "z"} and doc[0] == 1 and doc[-1] == 3


def test_pair_sums_in_chunks(monkeypatch):
    monkeypatch.setattr(divergence, "PAIR_CELLS", 8)
    p = np.random.default_rng(0).integers(1, 10**9, (5, 4))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(p[i], p[j])) for j in (1, 4)] for i in range(5)]
    assert divergence.pair_sums(p, np.arange(5), np.array([1, 4])).tolist() == want


# 12: URL filters

URLS = [
    None, "", "no scheme", "http://", "http:///p", "HTTP://WWW.Example.COM/en/1?x", "https://a.www.example.com/en/", "http://notexample.com/en/1", "http://example.com", "http://example.com/en", "http://x.net/es/1", "http://net/fr/",
    "http://x.net?u=http://y.net/es/", "https://m.bad.org/a.html?b=2&a=1&utm_source=q#f", "http://bad.org:80/a/?a=1&b=2", "http://bad.org/a?a=1", "https://u@bad.org./a//?ref=x&b=2&a=1", "http://BAD.org/A?a=1&b=2", "http://É.com/", "x\ny://z\n.org/\n?q", "http://bad.org",
]


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    query = rest[len(host) + len(path) :]
    return host.translate(LOWER), path, query[1:].split("#")[0] if query.startswith("?") else ""


def canonical(url):
    host, path, query = split(url)
    for pattern in (r"^[^@]*@", r":(80|443)?$", r"\.$", r"^(www|m)\."):
        host = re.sub(pattern, "", host)
    for pattern in (r"/index\.html$", r"\.html$", r"/+$"):
        path = re.sub(pattern, "", path)
    asked = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", x))
    return host + path + ("?" + "&".join(asked) if asked else "") if host else None


def judged(url, listed, rules):
    host, path, _ = split(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
    on = canonical(url) is not None and canonical(url) in listed
    return (host, path, best and best.host + best.path, best.verdict if best else "block" if on else "allow", canonical(url), best is None and on)


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_urls(spark, blocks):
    r = random.Random(0)
    urls = URLS + [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'm.'])}h{r.randrange(40)}.org/{r.randrange(9)}{r.choice(['', '/', '.html'])}" for _ in range(400)]
    listed = [None, "bad", "http://bad.org/a?b=2&a=1", "http://www.example.com/en/1?x", *(f"http://h{i}.org/{i % 9}" for i in range(0, 40, 2))] * 2
    pages = spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    pages = pages.withColumns({c: F.lit("!") for c in ("canonical", "on_list", "block", "w0", "perhaps", "listed", "r", "rule", "verdict", "host", "path")})
    got = url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "url string"), queries.URL_RULES, blocks)
    want = collections.Counter((i if i % 7 else None, *judged(u, {canonical(x) for x in listed}, queries.URL_RULES)) for i, u in enumerate(urls))
    assert collections.Counter(tuple(x) for x in got.collect()) == want and len({x[4] for x in want}) == 2


def test_longest_rule_wins(spark):
    rules = [url_filter.Rule("allow", "b.c", "/"), url_filter.Rule("block", "c", "/xy"), url_filter.Rule("block", "b.c", "/"), url_filter.Rule("allow", "c", "")]
    urls = ["http://a.b.c/xy", "http://b.c/q", "http://c/xyz", "http://c", "http://abc/", "http://xb.c/"]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string"), rules)
    assert [(x.rule, x.verdict) for x in out.orderBy("page_id").collect()] == [("b.c/", "block"), ("b.c/", "block"), ("c/xy", "block"), ("c", "allow"), (None, "allow"), ("c", "allow")]


def test_no_pages_and_no_list(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, none, queries.URL_RULES).collect() == []
    assert url_filter.blocks_for(0) == 1 and url_filter.blocks_for(10**9) == url_filter.MOST_BLOCKS


def test_filter_passes_all_that_is_listed(spark):
    """No false negatives, and few false positives at the planned size."""
    n = 3000
    blocks = url_filter.blocks_for(n)
    sieve = url_filter.bloom_filter(spark.range(n).select(F.format_string("u%d", "id").alias("u")), "u", blocks)
    asked = spark.range(2 * n).select("id", F.format_string("u%d", "id").alias("u")).withColumn("block", url_filter._block("u", blocks)).join(sieve, "block", "left")
    passed = F.lit(True)
    for i, b in enumerate(url_filter._bits("u")):
        passed = passed & (F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(b) != 0)
    ids = {x.id for x in asked.where(passed).collect()}
    assert ids >= set(range(n)) and len(ids) < n * 1.03


def test_a_hot_url_is_shuffled_on_both_sides(spark):
    """A third of the pages have one listed URL: the exact join has an exchange below each side, which adaptive execution can split."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot.org/")).otherwise(F.format_string("http://h%d.org/", "id")).alias("url"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = url_filter.judge(pages, spark.createDataFrame([("http://hot.org",)], "url string"), [])
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"SortMergeJoin.*canonical.*", plan)
        assert len(joins) == 1 and len(re.findall(r"Exchange hashpartitioning\((canonical|on_list)", plan)) == 2
        assert out.where("listed").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# 13: periodic runs


def runs_brute(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def periodic_brute(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = runs_brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(text), text)


def test_runs_against_brute_force():
    r = random.Random(0)
    docs = [[r.randrange(k) for _ in range(n)] for k in (1, 2, 3, 5) for n in (0, 1, 2, 11, 12, 13, 24, 60, 150)]
    docs += [(u := [r.randrange(9) for _ in range(p)]) * (150 // p) + u[: p // 2] + [7] + u * 3 for p in (1, 2, 5, 6, 7, 30)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for least in (12, 2, 1):
        doc, start, end, q = periodic_runs.runs(np.array(sum(docs, []), np.int64), bounds, least)
        for k, d in enumerate(docs):
            mine = doc == k
            assert list(zip((start[mine] - bounds[k]).tolist(), (end - start)[mine].tolist(), q[mine].tolist())) == runs_brute(d, least), (k, least)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_runs_in_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    d = [1, 2, 3] * 10 + [4] * 20 + [1, 2] * 9
    doc, start, end, q = periodic_runs.runs(np.array(d * 2), np.array([0, len(d), 2 * len(d)]))
    assert list(zip(start[doc == 1] - len(d), (end - start)[doc == 1], q[doc == 1])) == runs_brute(d)


def test_collisions_are_found_and_mended(monkeypatch):
    """With hashes that are always equal every stretch is too long; the words decide and another base follows."""
    class Blind(periodic_runs._Hashes):
        def __init__(self, values, seed):
            super().__init__(values, seed)
            self.seed = seed

        def equal(self, a, b, n):
            return np.ones(len(a), bool) if self.seed < 2 else super().equal(a, b, n)

    monkeypatch.setattr(periodic_runs, "_Hashes", Blind)
    d = [1, 2, 3] * 6 + list(range(10)) + [5] * 14
    doc, start, end, q = periodic_runs.runs(np.array(d), np.array([0, len(d)]))
    assert list(zip(start, end - start, q)) == runs_brute(d)


def test_thue_morse_words_have_no_long_runs():
    """Hashes modulo a power of two collide on these for every base."""
    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])
    doc, start, end, q = periodic_runs.runs(bits, np.array([0, len(bits)]))
    assert (end - start == 2 * q).all() and len(q) == len(runs_brute(bits.tolist()))


def test_periodic_runs(spark):
    r = random.Random(3)
    unit = lambda n: " ".join(r.choice(["a", "b", "cé", "中"]) for _ in range(n))
    texts = [None, "", " \t\n", "x", "ab " * 300, unit(30)] + [r.choice([" ", "\n"]).join([unit(r.randrange(1, 9))] * r.randrange(1, 9)) + "\n" + unit(r.randrange(40)) for _ in range(150)] + [" ".join(f"w{k}" for k in range(300))] * 30
    rows = [(i - 3 if i % 17 else None, t, "!", "!") for i, t in enumerate(texts)] + [(5, "dup dup", "", "")] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("start", "length", "period", "n_runs", "n")})
    got = collections.Counter(tuple(x) for x in periodic_runs.periodic_runs(df, tails=True).collect())
    want = collections.Counter((None, *periodic_brute("null", t)[1:]) if i is None else periodic_brute(i, t) for i, t, *_ in rows)
    assert zlib.crc32(b"null") % 10 and got == want and sum(zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in rows) > 9
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def test_periodic_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(x) for x in queries.op13_periodic_runs(spark, sf).collect()}
    short = [d for d in docs if len(d.text or "") < 20_000]
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs) and {periodic_brute(d.doc_id, d.text)[:-1] for d in short} <= got


def test_runs_of_a_very_long_text():
    """A text of over a megabyte: a passage of 60,000 words thrice, without a limit on its period."""
    r = random.Random(1)
    passage = [f"w{r.randrange(50_000)}" for _ in range(60_000)]
    out = periodic_runs._digests(pa.array([1]), pa.array([" ".join(["first", *passage * 3, "last"])]), 12, False, True).to_pylist()[0]
    assert (out["start"], out["length"], out["period"], out["exponent_milli"]) == (1, 180_000, 60_000, 3000) and out["text"] == " ".join(["first", *passage, "last"])


# 6: a line that very many documents of a host hold


def test_a_hot_line_is_shuffled_on_both_sides(spark):
    """Two joins by (host, line) in the plan's parts, each with an exchange below either side; a line of a third of all documents is found."""
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("own words of "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") % 3 == 0, F.lit("\nthe same line")).otherwise(F.lit(""))).alias("text"), F.lit("host").alias("source"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality_rules._over_limit(quality_rules.stored(quality_rules.measured(rows)), 3, 0.05)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"SortMergeJoin", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(host#\d+, h#", plan)) == 2
        got = out.collect()
        assert {x.doc_id for x in got} == set(range(0, 900, 3)) and all(len(x.gone) == 1 for x in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
