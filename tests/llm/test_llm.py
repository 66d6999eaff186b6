"""Each operator against brute force over small fixtures, and its defined cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import bpe, chat_format, fingerprints, kernels, line_dedup, minhash_dedup, quality_classifier, quality_rules, queries, source_mixing, substring_dedup, suffix_dedup
from tests.oracle import assert_same, connection

c = F.col
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, shared passages, repeated lines, empty, null and long ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(60) for _ in range(3)]
    texts: list = []
    for i in range(n):
        kind = i % 10
        if kind < 5 or not texts:
            t = "\n".join(line(r.randrange(1, 40)) for _ in range(r.randrange(1, 7)))
        elif kind == 5:
            t = r.choice([x for x in texts if x])
        elif kind == 6:
            ws = r.choice([x for x in texts if x]).split(" ")
            ws[r.randrange(len(ws))] = "EDIT"
            t = " ".join(ws)
        elif kind == 7:
            t = line(10) + "\n" + r.choice(shared) + "\n" + line(5) + "\n" + r.choice(shared)
        elif kind == 8:
            t = r.choice([None, "", "  \n\t", "x", "same same", "ab " * 300, "one\ntwo\nthree", "\n\none\ntwo\n"])
        else:
            t = line(3000) if i % 20 == 9 else "one\ntwo\nthree\n" + line(8)
        texts.append(t)
    return [(i * 3, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids and columns whose names clash with outputs."""
    rows = [(1, "a b c d e f\nsecond line\nthird", "x", 5), (1, "a b c d e f\nsecond line\nthird", "x", 5), (None, "a b c d e f\nsecond line\nthird", None, 6), (2, None, "x", None), (2, "other", "y", 7), (3, "", "y", 8)]
    extra = "__id long, __starts long, __t long, __key long, __done long, __gone long, __host string, __position long, __low string, component_id long, n_removed long, kept boolean, n_words long, score double, text_ string, ids string, position long, n_lines long, h long"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for name in extra.split(", "):
        df = df.withColumn(name.split()[0], F.lit(None).cast(name.split()[1]))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# kernels


def test_word_kernel_agrees_with_the_pattern():
    texts = ["", " a\tb\x0bc ", "é ß", None, "x", "\x1c a", " "]
    raw, offs = kernels.buffer(pa.array(texts))
    w = kernels.Words(raw, offs)
    got = [[raw[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in itertools.pairwise(w.bounds)]
    assert got == [WORD.findall(t or "") for t in texts]


def test_parts_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 100, 1, 1, 0, 300, 2)])], names=["t"])
    assert sum((p.column(0).to_pylist() for p in kernels.parts(b, 0, 100)), []) == b.column(0).to_pylist()


# 1: line dedup


def lines_brute(rows, k, long=line_dedup.MIN_WORDS):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        all_lines = (t or "").split("\n")
        own = [j for j, s in enumerate(all_lines) if re.search(r"[^\x20\x09-\x0D]", s)]
        gone = set()
        for rule, n, starts in (("run", k, range(len(own) - k + 1)), ("long", 1, [j for j, x in enumerate(own) if len(WORD.findall(all_lines[x])) >= long])):
            for j in starts:
                key = (rule, *(all_lines[x] for x in own[j : j + n]))
                if key in seen:
                    gone |= set(range(j, j + n))
                seen.add(key)
        text = t if not gone else "" if len(gone) == len(own) else "\n".join(s for j, s in enumerate(all_lines) if j not in {own[x] for x in gone})
        out[i] = (text, len(own), len(gone))
    return out


def runs_brute(rows) -> dict:
    """(maximal repeated runs, lines of the longest) of each document, by the longest match of each line with any other."""
    seqs = {i: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for i, t, *_ in rows}
    at = collections.defaultdict(list)
    for i, xs in seqs.items():
        for j, x in enumerate(xs):
            at[x].append((i, j))
    out = {}
    for i, xs in seqs.items():
        ends = set()
        longest = 0
        for j, x in enumerate(xs):
            best = 0
            for d, e in at[x]:
                if (d, e) != (i, j):
                    n = 0
                    while j + n < len(xs) and e + n < len(seqs[d]) and xs[j + n] == seqs[d][e + n]:
                        n += 1
                    best = max(best, n)
            if best:
                ends.add(j + best)
                longest = max(longest, best)
        out[i] = (len(ends), longest)
    return out


def line_corpus(seed: int) -> list[tuple]:
    """Sequences over few lines, with copies of documents, of parts of them, and of parts of themselves, over 64 lines long too."""
    r = random.Random(seed)
    seqs: list[list[str]] = []
    for n in range(40):
        xs = [f"line {r.randrange(8 if n % 4 else 200)}" for _ in range(r.choice((1, 3, 9, 30, 80)))]
        if seqs and n % 3 == 0:
            src = r.choice(seqs)
            a = r.randrange(len(src))
            xs = xs[: len(xs) // 2] + src[a : a + r.randrange(1, 100)] + xs[len(xs) // 2 :]
        if n % 7 == 0:
            xs = xs * 2
        if seqs and n % 5 == 0:
            xs = list(r.choice(seqs))
        seqs.append(xs)
    return [(i, "\n".join(xs), "en", "s", 0) for i, xs in enumerate(seqs)]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup(rows, docs, k):
    got = {i: (r.text, r.n_lines, r.n_removed) for i, r in by_id(line_dedup.dedup_lines(docs, k)).items()}
    assert got == lines_brute(rows, k)


@pytest.mark.parametrize("seed", range(2))
def test_maximal_runs(spark, seed):
    rows = line_corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = by_id(line_dedup.dedup_lines(df, 3, runs=True))
    assert {i: (r.n_runs, r.longest_run) for i, r in got.items()} == runs_brute(rows) and max(r.longest_run for r in got.values()) > 64
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items()} == lines_brute(rows, 3)


def test_suffix_array_of_lines(spark):
    """Ranks are in the order of the suffixes, equal only for suffixes that are equal to the end."""
    rows = line_corpus(7)
    states = line_dedup.suffix_ranks(spark.createDataFrame(rows, SCHEMA).repartition(3))
    ids = {x: hashlib.md5(x.encode()).digest() for _, t, *_ in rows for x in t.split("\n")}
    suffix = {(i, j): [ids[x] for x in t.split("\n")[j:]] for i, t, *_ in rows for j in range(len(t.split("\n")))}
    got = line_dedup.suffix_array(states).orderBy("r", "doc_id", "seq").collect()
    order = [(r.doc_id, r.seq) for r in got]
    first = collections.Counter(s[0] for s in suffix.values())
    assert order == sorted((k for k, s in suffix.items() if first[s[0]] > 1), key=lambda k: (suffix[k], k))
    assert all((bytes(a.r) == bytes(b.r)) == (suffix[a.doc_id, a.seq] == suffix[b.doc_id, b.seq]) for a, b in itertools.pairwise(got))


def test_line_dedup_of_repeated_ids(spark):
    """Rows of one id: equal texts are one document, other texts are documents of their own."""
    two, long = "first line\nsecond line", " ".join(f"w{i}" for i in range(60))
    rows = [(1, two), (1, two), (1, two + "\nthird"), (2, "x\n" + two + "\n" + long), (3, long + "\ny"), (None, two), (4, None)]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_runs, r.longest_run) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), runs=True).collect()]
    assert sorted((x for x in got if x[0] and x[0] > 1), key=str) == [(2, "x\n" + long, 4, 2, 2, 2), (3, "y", 2, 1, 1, 1), (4, None, 0, 0, 0, 0)]
    one = collections.Counter(x for x in got if x[0] == 1)
    assert sum(one.values()) == 3 and one[(1, two, 2, 0, 1, 2)] + one[(1, "", 2, 2, 1, 2)] == 2 and len(one) == 2
    assert [x for x in got if x[0] is None] == [(None, two, 2, 0, 0, 0)]


# 2: BPE


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_agrees_with_the_library(spark, tokenizer, rows):
    r = random.Random(1)
    accents = [chr(0x301), chr(0x130), chr(0x1C5), chr(0x3A3), chr(0x1C), chr(0x2028), chr(0xFDD0), "日"]
    texts = [t for _, t, *_ in rows] + ["<|endoftext|>", "a<|endoftext|>b'<|startoftext|>'s", "it's we'll 'tis ''s !'s", "x" * 300, "½²Ⅷ١٢ 12"]
    texts += ["".join(r.choice([*"ab'strelvmd 1!?.<|>_\n", *accents]) for _ in range(50)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for size in (0, 50, 10_000):
        got = by_id(bpe.encode(df, queries.tokenizer_path(), size))
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), " ".join(map(str, ids)), decoded), repr(t)
            assert (got[i].ids_sha256, got[i].decoded_sha256) == (sha(got[i].ids), sha(decoded))


def test_decoding_ids(spark, tokenizer):
    """Ids back to text without the encoder: what the library decodes, and errors for ids that there aren't."""
    r = random.Random(2)
    lists = [[], [0], *([r.randrange(49_000) for _ in range(r.randrange(1, 80))] for _ in range(60)), [49406, 320, 49407]]
    df = spark.createDataFrame([(i if i % 7 else None, " ".join(map(str, x)) if x or i else None, "y") for i, x in enumerate(lists)], "doc_id long, ids string, decoded string")
    got = sorted((x.doc_id or 0, x.decoded) for x in bpe.decode(df, queries.tokenizer_path()).collect())
    assert got == sorted((i if i % 7 else 0, tokenizer.decode(x, skip_special_tokens=False)) for i, x in enumerate(lists))
    for bad in ("999999", "-1", "x"):
        with pytest.raises(Exception):
            bpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids string"), queries.tokenizer_path()).collect()


def test_lexicon_is_minimal_and_exact():
    words = [b"", *(w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "é"))][1:]
    lex = bpe.Lexicon(*bpe.pack(bpe.compile_lexicon({w: np.array([i, i + 1], np.int32) for i, w in enumerate(words)})))
    at = lex.find([*words, b"ta", b"tapsx", b"", b"x" * 100])
    assert (at[len(words) :] == -1).all()
    assert [lex.ids[lex.start[i] : lex.start[i + 1]].tolist() for i in at[: len(words)]] == [[i, i + 1] for i in range(len(words))]
    assert len(lex.final) < sum(map(len, words))  # suffixes are shared


# 3: fingerprints


def test_fingerprints(rows, docs):
    got = by_id(fingerprints.versions(docs))
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    cells = lambda t: set(fingerprints.cell_keys(pa.array([t]))[1].tolist())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints: dict = {}
    for k, (i, own) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha(edited))
        assert abs(r.near_edited - like(cells(own), cells(edited))) < 1e-9 and abs(r.near_next - like(cells(own), cells(after))) < 1e-9
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprint_gives_back_differing_cells():
    a, b = "One two three. Four five.\nSix.", "One two three. Four six.\nSix."
    print_of = lambda doc, key: fingerprints.serial(*fingerprints.sketch(doc, key, 1), np.array([len(key)]))[0]
    fp = [print_of(*fingerprints.cell_keys(pa.array([t]))) for t in (a, b)]
    want = set(fingerprints.cell_keys(pa.array([a]))[1].tolist()) ^ set(fingerprints.cell_keys(pa.array([b]))[1].tolist())
    assert set(fingerprints.recovered(*fp).tolist()) == want
    x, y = (set(fingerprints.cell_keys(pa.array([t]))[1].tolist()) for t in (a, b))
    assert abs(fingerprints.compared(*fp) - len(x & y) / len(x | y)) < 1e-9
    many = print_of(np.zeros(500, np.int64), np.arange(500, dtype=np.uint64))
    assert fingerprints.recovered(fp[0], many) is None and fingerprints.compared(fp[0], many) is None


def test_differences_retry_larger():
    r = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2], [3000, 100, 3000])
    key = r.integers(0, 2**63, 6100).astype(np.uint64)
    key[3100:] = key[:3000]
    key[-5:] += np.uint64(1)
    each = fingerprints.sketch(doc, key, 3)
    assert fingerprints.differences(each, np.array([0, 0, 0]), np.array([1, 2, 0]), doc, key).tolist() == [3100, 10, 0]


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_fingerprints_do_not_depend_on_ranges(spark, docs, size, monkeypatch):
    """Ranges of one document, of some, and one range for all; each range's first document follows the last of the one before."""
    want = {r.doc_id: r for r in fingerprints.versions(docs).collect()}
    got = fingerprints.with_next(docs, size)
    parts = got.withColumn("p", F.spark_partition_id()).groupBy("g").agg(F.countDistinct("p").alias("n"), F.sum("copy").alias("copies")).collect()
    assert all(r.n == 1 and r.copies == 1 for r in parts) and (size > 300) == (len(parts) == 1)
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (size,))
    assert {r.doc_id: r for r in fingerprints.versions(docs).collect()} == want
    some = next(r for r in want.values() if 0 < r.near_next < 1 or r.near_next == 0 and r.n_chars)
    assert fingerprints.parse(some.fingerprint)[0] > 0


# 4 and 7: repeats


def words_brute(rows, n=35):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    count = collections.Counter(tuple(w[j : j + n]) for w in words.values() for j in range(len(w) - n + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - n + 1):
            if count[tuple(w[j : j + n])] > 1:
                gone |= set(range(j, j + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def bytes_brute(rows, n=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b, gone = (t or "").encode(), set()
        for j in range(len(b) - n + 1):
            if b[j : j + n] in seen:
                gone |= set(range(j, j + n))
            seen.add(b[j : j + n])
        runs = sum(1 for j in gone if j - 1 not in gone)
        out[i] = (len(b), len(gone), runs, sha(bytes(x for j, x in enumerate(b) if j not in gone)))
    return out


@pytest.mark.parametrize("hot", [256, 2, 1])
def test_substring_dedup(rows, docs, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeats, "HOT", hot)
    got = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup.dedup(docs, texts=False)).items()}
    assert got == words_brute(rows)


@pytest.mark.parametrize("hot", [256, 2, 1])
def test_suffix_dedup(rows, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeats, "HOT", hot)
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.dedup(docs, texts=False)).items()}
    assert got == bytes_brute(rows)


def test_buckets_that_share_partitions(rows, docs, monkeypatch):
    """Many small buckets and ranges in few partitions: the same results."""
    from corpusflow.llm import common

    want = {r.doc_id: r for r in fingerprints.versions(docs).collect()}
    monkeypatch.setattr(common, "MOST_PARTITIONS", 3)
    for name in ("BUCKET_BYTES", "BLOCK_BYTES"):
        monkeypatch.setattr(substring_dedup.repeats, name, 500)
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (300,))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup.dedup(docs, texts=False)).items()} == words_brute(rows)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.dedup(docs, texts=False)).items()} == bytes_brute(rows)
    assert {r.doc_id: r for r in fingerprints.versions(docs).collect()} == want


def test_texts_are_returned(rows, docs):
    want = {i: v[2] for i, v in words_brute(rows).items()}
    assert {i: sha(r.kept_text) for i, r in by_id(substring_dedup.dedup(docs)).items()} == want


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    text = r.integers(1, 2 + seed, 400).astype(np.uint8)
    text[:30] = 1
    order = suffix_dedup.suffix_array(text, 100)
    assert sorted(order.tolist()) == list(range(len(text)))
    keys = [bytes(text[i : i + 100]) for i in order]
    assert keys == sorted(keys)


def test_common_prefixes():
    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(1, 3, 300), np.tile(r.integers(1, 5, 40), 8)]).astype(np.uint8)
    order = suffix_dedup.suffix_array(text, 100)
    got = suffix_dedup.common_prefixes(kernels.byte_prefix(text), order, len(text))
    raw = text.tobytes()
    want = [next((k for k in range(100) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= len(raw)), 100) for a, b in itertools.pairwise(order.tolist())]
    assert got.tolist() == [0, *want] and max(want) == 100


def test_factors_are_the_longest(spark):
    """Among several references of one window the longest counts, against all pairs."""
    r = random.Random(5)
    base = [r.randrange(50) for _ in range(70)]
    contexts = [base[:40] + [900 + i] * 20 for i in range(3)] + [base[:60] + [990 + i] * 5 for i in range(3)] + [base[5:65]]
    flat, offs = np.array([x for c_ in contexts for x in c_], np.uint64), np.concatenate([[0], np.cumsum([len(c_) for c_ in contexts])])
    rows = np.zeros(len(contexts), [("ah", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("span", "<i2"), ("many", "u1")])
    rows["span"] = [len(c_) - 35 for c_ in contexts]
    at, n, source = substring_dedup.parse(rows, flat, offs)
    at = np.concatenate([np.arange(o, o + k + 1) for o, k in zip(offs, rows["span"])])[at]  # starts of windows, numbered, to places
    own = np.searchsorted(offs, at, side="right") - 1
    for a, k, o, s in zip(at.tolist(), n.tolist(), own.tolist(), source.tolist()):
        x = contexts[o][a - offs[o] :]
        best = max(next((k for k in range(min(len(x), len(y) - j)) if x[k] != y[j + k]), min(len(x), len(y) - j)) for m, y in enumerate(contexts) if m != o for j in range(len(y)))
        assert k == best and flat[a : a + k].tolist() == flat[s : s + k].tolist()
    assert n.max() == 60 and set(own.tolist()) == set(range(7))


def test_parse_is_greedy():
    words = np.arange(200, dtype=np.uint64)
    rows = np.zeros(2, [("ah", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("span", "<i2"), ("many", "u1")])
    rows["span"] = [60, 20]
    flat = np.concatenate([words[:95], words[10:65]])
    at, n, source = substring_dedup.parse(rows, flat, np.array([0, 95, 150]))
    assert (at[0], n[0], source[0]) == (10, 55, 95)


# 5: chat formatting


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"</s>[INST] ok [/INST]"},{"role":"assistant","content":null}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"<|end|><\\\\|end|>"}]}',
        '{"prompt":"p","response":"r"}', '{"instruction":"i","input":"","output":"o"}', '{"instruction":"i","input":"n","output":"o"}', '{"data":{"prompt":"a","response":"b"}}',
        '{"what":1}', "no json", None, '{"messages":[]}', '{"prompt":5,"response":null}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(records)], "id int, record string")
    out = {r.id: r for r in chat_format.format_records(df).withColumn("back", chat_format.read_turns(c("formatted"))).withColumn("learned", chat_format.read_loss(c("formatted"), c("loss"))).collect()}
    turns = lambda i: [(t.role, t.text) for t in out[i].turns]
    assert turns(0) == [("system", "s"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "")]
    assert turns(1) == [("user", "q"), ("assistant", "<|end|><\\|end|>")]
    assert turns(2) == [("user", "p"), ("assistant", "r")] and turns(3) == [("user", "i"), ("assistant", "o")] and turns(4)[0] == ("user", "i\n\nn") and turns(5) == [("user", "a"), ("assistant", "b")]
    assert out[6].turns is None and out[7].turns is None and out[8].turns is None and turns(10) == [("user", "5"), ("assistant", "")]
    for i in (0, 1, 2, 3, 4, 5, 10):
        assert out[i].back == out[i].turns and out[i].learned == [t.text for t in out[i].turns if t.role == "assistant"]


def test_chat_escaping_is_reversible(spark):
    r = random.Random(0)
    pieces = [*chat_format.CONTROL, "\\", "<", "[", "|", "INST]", "/s>", "a", "\n", "<\\/s>"]
    xs = ["".join(r.choice(pieces) for _ in range(8)) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in xs], "x string").select("x", chat_format.escape(c("x")).alias("e"), chat_format.unescape(chat_format.escape(c("x"))).alias("b")).collect()
    assert all(r.b == r.x for r in rows) and not any(k in r.e for r in rows for k in chat_format.CONTROL)


# 6: quality rules


def test_quality_rules(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    line = lambda k: " ".join(word() for _ in range(k))
    common, rows = line(40), []
    for i in range(120):
        text = line(60) if i % 3 == 0 else (common if i % 3 == 1 else common.upper() + "  !") + "\n" + line(12)
        rows.append((i, text, "en", "h", 0))
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, SCHEMA), limit_docs=50))
    assert all(got[i].kept == (i % 3 == 0) and not got[i].base_failed for i in range(120))


def test_base_counts(docs, rows):
    got = by_id(quality_rules.judge(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        full = [s for s in t.split("\n") if WORD.search(s)]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(full) - len(set(full)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want


def rules_brute(rows, limit_docs=quality_rules.LIMIT_DOCS, share=quality_rules.LIMIT_SHARE, least_left=quality_rules.LEAST_LEFT) -> list[tuple]:
    """(doc_id, words on lines over the limit, kept, text without them) of each row, as given."""
    norm = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "", "".join(ch.lower() if ch < "\x7f" else ch for ch in x)))
    size, held = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, _, h, *_ in rows:
        if i is not None:
            size[h or ""].add(i)
            for x in (t or "").split("\n"):
                if WORD.search(x) and norm(x):
                    held[h or "", norm(x)].add(i)
    out = []
    for i, t, _, h, *_ in rows:
        gone = lambda x: i is not None and norm(x) != "" and len(held[h or "", norm(x)]) > max(limit_docs, share * len(size[h or ""]))  # noqa: E731, B023
        ls, w = (t or "").split("\n"), WORD.findall(t or "")
        n = sum(len(WORD.findall(x)) for x in ls if gone(x))
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((i, n, not failed and len(w) - n >= least_left * len(w), "\n".join(x for x in ls if not gone(x))))
    return out


def test_quality_rules_match_sql_over_the_limits(spark, tmp_path):
    """Hosts on both sides of the floor (3 documents) and of the share (5% of more than 60), with rows that repeat."""
    rows, text = [], lambda i, extra: " ".join(f"w{i}x{k}" for k in range(60)).translate(str.maketrans("0123456789", "abcdefghij")) + "\n" + extra
    menu = "Shared LINE 7, of this host! " + " ".join(f"m{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    for host, size, holds in (("tiny", 3, 3), ("small", 10, 4), ("at", 100, 5), ("over", 100, 6), (None, 70, 60)):
        rows += [(len(rows) + i, text(len(rows) + i, menu if i < holds else ""), "en", host, 0) for i in range(size)]
    rows += [(rows[20][0], rows[20][1], "en", "at", 0)] * 60 + [(5000, text(1, "Once"), "en", "small", 0)] * 20 + [(None, menu, "en", "small", 0), (6000, None, "en", None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = queries.op6_quality_rules(spark, str(tmp_path))
    assert_same(out, con, queries.OP6_SQL)
    host_of = {i: h for i, _, _, h, _ in rows}
    assert {host_of[r.doc_id] for r in out.collect() if r.n_common_words} == {"small", "over", None}
    assert sum(not r.kept and not r.base_failed for r in out.where("n_words > 200").collect()) == 70  # by common lines alone
    order = lambda xs: sorted((i or -1, n, k) for i, n, k in xs)
    assert order((r.doc_id, r.n_common_words, r.kept) for r in out.collect()) == order(x[:3] for x in rules_brute(rows))


def test_common_lines_leave_the_texts(spark):
    """Kept texts without the lines over the limit, against brute force."""
    r = random.Random(1)
    line = lambda k: " ".join("".join(r.choice("abcdefgé") for _ in range(5)) for _ in range(k))
    common = [line(6) + " 12", "Menu | Home | 3"]
    rows = []
    for i in range(160):
        parts = [line(40), *[x.upper() + " !" if i % 2 else x.replace("3", "7") for x in common], "", "***", line(30)]
        r.shuffle(parts)
        rows.append((i, "\n".join(parts) if i % 5 else common[0] + "\n" + line(9), "en", None if i < 30 else "h" if i < 130 else "small", i))
    rows += [rows[3]] * 40 + [(None, common[0] + "\n" + line(60), "en", "h", 7)]  # rows of one document, and of none
    want = sorted((i or -1, t, h or "", chars) for (i, _, kept, t), (_, _, _, h, chars) in zip(rules_brute(rows, 20), rows, strict=True) if kept)
    out = quality_rules.without_common_lines(spark.createDataFrame(rows, SCHEMA).withColumn("__gone", F.lit(1)).repartition(3), limit_docs=20)
    assert sorted((x.doc_id or -1, x.text, x.source or "", x.n_chars) for x in out.collect()) == want and out.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "__gone"]
    texts = {i: t for i, t, *_ in rows}
    assert 0 < sum(t != texts.get(i) for i, t, *_ in want) and len(want) == 169


# 8: mixing


def test_mix_places_every_row(docs, rows):
    out = source_mixing.mix(docs, {"s0": 2, "s1": 1, "s2": 1}, 2)
    got = out.collect()
    assert len(got) == len(rows) == len({r.position for r in got if r.source in ("s0", "s1", "s2")}) + sum(r.source not in ("s0", "s1", "s2") for r in got)
    blocks = [r.source for r in sorted(got, key=lambda r: r.position) if r.source in ("s0", "s1", "s2")]
    n = min(blocks.count("s1"), blocks.count("s2"), blocks.count("s0") // 2) * 4 - 8
    assert abs(blocks[:n].count("s0") - n / 2) <= 2
    assert source_mixing.in_mixed_order(docs, {"s0": 2, "s1": 1}).count() == len(rows)


def of_sizes(spark, sizes: dict):
    rows = [s for s, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, source string")


def assert_pfair(order: list, weights: dict, blocks: dict) -> None:
    """Each prefix of the order, up to where a source runs out, is within a block of the weights as given."""
    exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    ran = collections.Counter()
    for t, s in enumerate(order, 1):
        ran[s] += 1
        assert all(abs(ran[k] - t * w) < 1 for k, w in exact.items())
        if ran[s] == blocks[s]:
            return


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.5} | {f"s{i}": 0.5 / 99 for i in range(99)}, {"a": 0.45, "b": 0.45, "c": 0.05, "d": 0.05}, {f"s{i}": (i + 0.5) ** 0.5 for i in range(23)}])
def test_mix_keeps_the_weights_given(spark, weights):
    total = sum(weights.values())
    sizes = {s: max(1, int(w / total * 4000)) for s, w in weights.items()}
    got = source_mixing.mix(of_sizes(spark, sizes), weights, block_rows=1).orderBy("position").collect()
    assert len(got) == sum(sizes.values())
    assert_pfair([r.source for r in got], weights, sizes)


def test_mix_of_many_sources(spark):
    """Over 400 sources: each has a weight and is in the schedule, and unnamed ones get positions of their own."""
    sizes = {f"s{i:03}": 1 + i % 7 for i in range(450)}
    df = of_sizes(spark, sizes)
    weights = source_mixing.tempered(df)
    assert weights == {s: n**0.5 for s, n in sizes.items()}
    got = source_mixing.mix(df, weights, block_rows=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got))) and len(got) == sum(sizes.values())
    assert_pfair([r.source for r in got], weights, sizes)
    some = source_mixing.mix(df, {"s000": 1.0, "s006": 2.0}, block_rows=2).orderBy("position").collect()
    assert len({r.position for r in some}) == len(some) == len(got)
    assert {r.source for r in some[:8]} == {"s000", "s006"} and [r.source for r in some[8:]] == sorted(r.source for r in some[8:])


@pytest.mark.parametrize("sizes", [{None: 70}, {}])
def test_mix_without_weights(spark, sizes):
    df = of_sizes(spark, sizes)
    weights = source_mixing.tempered(df)
    got = source_mixing.mix(df, weights).collect()
    assert weights == {} and sorted(r.position for r in got) == list(range(sum(sizes.values())))
    assert source_mixing.in_mixed_order(df, weights).count() == len(got)


def test_mix_against_brute_force(spark, docs, rows):
    """Every position, also of rows without a source, that repeat, or are much of one source."""
    many = [(5000 + i, "big", "en", "s1", 1) for i in range(700)]
    some = [r for r in [*rows, *many] if r[0] is not None]
    df = spark.createDataFrame([*some, some[-1]], SCHEMA).repartition(7)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    known = [(i, s) for i, _, _, s, _ in some if s] + [(some[-1][0], "s1")]
    want = mix_brute([(("copy" if n == len(known) - 1 else i), s) for n, (i, s) in enumerate(known)], hashes | {"copy": hashes[some[-1][0]]}, source_mixing.BLOCK_ROWS, str)
    want = sorted((some[-1][0] if i == "copy" else i, p) for i, p in want.items())
    got = source_mixing.mix(df, source_mixing.tempered(df)).collect()
    assert sorted((r.doc_id, r.position) for r in got if r.source) == want
    assert len({r.position for r in got}) == len(got) and min(r.position for r in got if not r.source) > max(p for _, p in want)


def test_block_size():
    assert [source_mixing.block_size(n) for n in (0, 10, 1 << 25, (1 << 25) + 1, 10**12)] == [32, 32, 32, 33, 953675]


# 9: classifier


def statistics_brute(t: str | None) -> list[float]:
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if x]
    if not w:
        return [0.0] * quality_classifier.D
    chars = max(1, sum(not re.match(r"[\x20\x09-\x0D]", x) for x in t))
    n = lambda xs: sum(x in xs for x in t)
    tri = list(zip(w, w[1:], w[2:]))
    upper = sum("A" <= x[0] <= "Z" and not ("a" <= x[-1] <= "z" or ord(x[-1]) < 32) for x in w)
    return [
        math.log1p(len(w)), math.log1p(len(lines)), math.log1p(chars / len(w)), (sum("A" <= x <= "Z" for x in t) / chars) ** 0.5, (sum("0" <= x <= "9" for x in t) / chars) ** 0.5,
        (n("#*$%&|<>@^~=+_\\/{}[]") / len(w)) ** 0.5, (n("!?") / len(w)) ** 0.5, (n(".,") / len(w)) ** 0.5, (n("\"'():;-`") / len(w)) ** 0.5, (sum(ord(x) > 127 for x in t) / chars) ** 0.5,
        len(set(w)) / len(w), 1 - len(set(tri)) / max(1, len(w) - 2), 1 - len(set(lines)) / max(1, len(lines)), (upper / len(w)) ** 0.5, math.log1p(chars / max(1, len(lines))),
    ]


def test_classifier_against_numpy(spark, sf):
    """Statistics in plain Python, and the discriminant from NumPy's means, covariances, inverses and determinants."""
    import zlib

    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts}
    x = {i: np.array(statistics_brute(t)) for i, t in texts.items()}
    both = np.array([x[i] for i in y])
    scale = 1 / np.sqrt(np.maximum(both.var(0), 1e-6))
    own = [np.array([x[i] * scale for i in y if y[i] == k]) for k in (0, 1)]
    cov = [np.cov(a.T, bias=True) for a in own]
    pooled = (len(own[0]) * cov[0] + len(own[1]) * cov[1]) / len(y)

    def density(v, k):
        s = 0.9 * cov[k] + 0.1 * pooled
        s = 0.99 * s + 0.01 * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
        z = v * scale - own[k].mean(0)
        return -0.5 * z @ np.linalg.inv(s) @ z - 0.5 * np.linalg.slogdet(s)[1] + math.log(len(own[k]) / len(y))

    got = by_id(quality_classifier.classify(d, labels))
    for i, v in x.items():
        want = 1 / (1 + math.exp(-min(500, max(-500, density(v, 1) - density(v, 0)))))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(want >= 0.5), i

def test_classifier(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.classify(d, labels).join(labels, "doc_id")
    r = out.where("held_out").agg(F.avg((c("predicted") == c("quality")).cast("int")), F.count("*")).first()
    assert r[1] > 10 and r[0] >= 0.95
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out.collect())


def test_classifier_learns_no_held_out_label(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - c("quality")).otherwise(c("quality")))
    a, b = (by_id(quality_classifier.classify(d, x)) for x in (labels, turned))
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i in a)


def test_classifier_without_labels(docs, spark):
    out = quality_classifier.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in out)


# 10: near duplicates


def near_brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def chain(n: int = 40) -> list[tuple]:
    """Copies that drift: neighbours are similar, the ends are not, and a passage is in all of them."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        out.append((1000 + (i * 7) % n, " ".join(words), "en", "s", 0))
        for _ in range(2):
            words[r.randrange(40, len(words))] = f"v{i}x{r.randrange(99)}"
    return out


def test_near_duplicates(spark, rows, docs):
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(minhash_dedup.near_duplicates(docs)).items()}
    assert got == near_brute(rows)


def test_near_duplicates_of_drifting_copies(spark):
    rows = chain()
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))).items()}
    assert got == near_brute(rows)


def parts_of_a_whole(n: int = 12) -> list[tuple]:
    """A long text, overlapping parts of it, and parts with words of their own: pairs that are similar only inside their hub."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    out = [(1, " ".join(words), "en", "s", 0)]
    for i in range(n):
        a = r.randrange(0, 90)
        own = words[a : a + 205]
        if i % 3 == 0:
            own[r.randrange(len(own))] = f"x{i}"
        out.append((10 + i, " ".join(own), "en", "s", 0))
    return out + [(100 + i, " ".join(words[:210] + [f"y{i}"] * 3), "en", "s", 0) for i in range(6)]


def test_near_duplicates_inside_a_hub(spark):
    rows = parts_of_a_whole()
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))).items()}
    assert got == near_brute(rows)


def test_apart_makes_the_pairs_of_two_components(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), i, r.choice((7, 7, 7, 7, 12, 1 << 40, -3)), r.randrange(20, 60), 0, 0, 0, [0], True) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, a long, c long, n long, inside long, often long, hub long, lacks array<int>, whole boolean")
    got = collections.Counter((x.ax, x.ay, x.cx, x.cy) for x in minhash_dedup._apart(df).collect())
    want = {(x[1], y[1], x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[1] > y[1] and x[2] != y[2] and 4 * min(x[3], y[3]) >= 3 * max(x[3], y[3])}
    assert set(got) >= want and max(got.values()) == 1 and all(a > b and p != q for a, b, p, q in got)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:450], r.integers(0, 2**63, 150).astype(np.uint64)])
    s = minhash_dedup.sketches(np.repeat([0, 1, 2], [600, 600, 2]), np.concatenate([a, b, a[:2]]), 3)
    assert (s != np.iinfo(np.uint64).max).all()  # every coordinate fills, also of two elements
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


# defined cases of all


def test_odd_rows(odd, spark):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 0, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert line_dedup.dedup_lines(odd).count() == n
    assert bpe.encode(odd, queries.tokenizer_path(), 10).count() == n
    assert fingerprints.versions(odd).count() == n
    assert substring_dedup.dedup(odd, False).count() == n and suffix_dedup.dedup(odd, False).count() == n
    assert quality_rules.judge(odd).count() == n
    assert source_mixing.mix(odd, {"x": 1.0}).count() == n and source_mixing.in_mixed_order(odd, {"x": 1.0}).columns == odd.columns
    assert quality_classifier.classify(odd, labels).count() == n
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns
    assert minhash_dedup.near_duplicates(odd).count() >= n and minhash_dedup.keep_first(odd).columns == odd.columns


def test_many_rows_in_one_batch(spark):
    """More rows than any part of a batch holds: each operator returns every one."""
    n = 2500
    df = spark.range(n).select(c("id").alias("doc_id"), F.concat(F.lit("text number "), c("id"), F.lit(" of many\nand one more line")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), c("id") % 3).alias("source"), F.lit(1).cast("long").alias("n_chars")).coalesce(1)
    labels = spark.range(n).select(c("id").alias("doc_id"), (c("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    for out in (
        line_dedup.dedup_lines(df), bpe.encode(df, queries.tokenizer_path(), 10), fingerprints.versions(df), substring_dedup.dedup(df, False), suffix_dedup.dedup(df, False), quality_rules.judge(df),
        source_mixing.mix(df, {"s0": 1.0, "s1": 2.0, "s2": 3.0}), quality_classifier.classify(df, labels), minhash_dedup.near_duplicates(df),
    ):
        r = out.agg(F.count("*"), F.countDistinct("doc_id")).first()
        assert tuple(r) == (n, n)


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        line_dedup.dedup_lines(none), bpe.encode(none, queries.tokenizer_path(), 10), fingerprints.versions(none), substring_dedup.dedup(none, False), suffix_dedup.dedup(none, False), quality_rules.judge(none),
        source_mixing.mix(none, {"x": 1.0}), quality_classifier.classify(none, labels), minhash_dedup.near_duplicates(none), chat_format.rows_to_records(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0


# queries against SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connection(sf), queries.SQL[name])


def test_pipeline_stages(spark, tmp_path, tokenizer):
    """Each stage on what the one before kept, against brute force."""
    import corpus_pipeline as p

    base = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{base}/documents.parquet")
    now, kept = good, {}
    for name, stage in p.STAGES:
        before = now
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, now, base).write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = now
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        if name == "quality classifier":
            scores = by_id(quality_classifier.classify(before, spark.read.parquet(f"{base}/labels.parquet")))
            assert {r.doc_id for r in now.collect()} == {i for i, r in scores.items() if r.predicted} and now.columns == before.columns
        elif name == "line dedup":
            want = {i: t for i, (t, n, gone) in lines_brute(rows, line_dedup.MIN_LINES).items() if gone == 0 or gone < n}
            assert {r.doc_id: r.text for r in now.collect()} == want and now.columns == before.columns
            assert all(r.n_chars == len(r.text) for r in now.collect())
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in now.collect()} == {i for i, v in near_brute(rows).items() if v[2]} and now.columns == before.columns
        elif name == "mixing sources to target weights":
            assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, _ in rows) and now.columns == before.columns
        else:
            for r in now.collect():
                ids = tokenizer.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids
                assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)))
    assert now.count() == p.run(spark, base).count()


def test_pipeline_of_odd_and_empty_tables(odd, none, spark, tmp_path, sf):
    """Every stage on null, empty, repeated rows and on no rows: the columns stay, and nothing is made up."""
    import corpus_pipeline as p

    for n, docs in enumerate((none, odd.withColumn("lang", F.lit("en")))):
        for i, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, sf)
            assert i == len(p.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{n}{i}"))
            back = spark.read.parquet(str(tmp_path / f"{n}{i}"))
            assert back.count() <= docs.count() and {r[0] for r in back.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def mix_brute(rows, hashes: dict, size: int, key=int) -> dict:
    """Position of each document: slot by slot, of the released blocks that of earliest deadline."""
    own = collections.defaultdict(list)
    for i, source in rows:
        own[source].append(i)
    weights = {s: Fraction(len(v) ** 0.5) for s, v in own.items()}
    total, ran, out, slot, t = sum(weights.values()), collections.Counter(), {}, 0, 0
    while len(out) < len(rows):
        free = [s for s in own if ran[s] * size < len(own[s]) and math.floor(ran[s] * total / weights[s]) <= t]
        if free:
            s = min(free, key=lambda s: (math.ceil((ran[s] + 1) * total / weights[s]), -weights[s], s))
            for n, i in enumerate(sorted(own[s], key=lambda i: (hashes[i], key(i)))[ran[s] * size : (ran[s] + 1) * size]):
                out[i] = slot * size + n
            ran[s] += 1
            slot += 1
        t += 1
    return out


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    """The last stage's rows have the mix's positions and are in its order, though its input is dealt otherwise."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.where("doc_id is not null and source is not null").repartition(5, "text")
    got = p.encode(spark, docs, "").collect()
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = mix_brute([(r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()], hashes, source_mixing.BLOCK_ROWS)
    assert [(r.doc_id, r.position) for r in got] == sorted(want.items(), key=lambda x: x[1]) and len(got) == docs.count()
