from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import dates, rx, text, urls

c = F.col


def values(spark, xs, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", column.alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_word_edges_are_ascii(spark):
    xs = ["专家consensus解读", "a consensus.", "preconsensus", "consensus_1", None, ""]
    assert values(spark, xs, rx.matches(c("x"), r"\bconsensus\b")) == [True, True, False, False, False, False]


@pytest.mark.parametrize("pattern", [r"\b(?:a|b c)?\s*end\b", r"\b(?:one|two)(?:s)?\b", r"x\b.?\by", r"\b(?:register|sign[- ]?up)\b", r"\b[\w.]+@\w+\b"])
def test_java_pattern_agrees_with_ascii_python(spark, pattern):
    import re

    xs = ["the end", "a end", "bend", "b c end", "ones", "two!", "twofold", "x-y", "xy", "sign up", "presignup", "me@org", "@x", " end", "aend"]
    want = [re.search(pattern, x, re.A | re.I) is not None for x in xs]
    assert values(spark, xs, rx.matches(c("x"), pattern)) == want


def test_spaces_of_all_kinds(spark):
    nbsp, wide, bom = chr(0xA0), chr(0x3000), chr(0xFEFF)
    assert values(spark, [f"{nbsp}a{wide}", f"{bom} ", "b"], rx.trim(c("x"))) == ["a", "", "b"]
    assert values(spark, [f"{nbsp}{wide}", " x", None], rx.blank(c("x"))) == [True, False, True]


def test_titles(spark):
    xs = ["A&amp;B — C&#233;", "  x--y!z ", "&lt;b&gt;", None, "&#X41; &#99999999;"]
    assert values(spark, xs, text.normalize_title(c("x")))[:4] == ["a&b cé", "x y z", "b", None]
    assert values(spark, ["R&D: Café"], text.normalize_content_title(c("x"))) == ["r d café"]


def test_titles_have_one_compatibility_form(spark):
    import unicodedata

    xs = ["Ｆｕｌｌ　width", "ﬁeld ②", "cafe" + chr(0x301), "ĳ…x", "한글", "Ａ&#38;Ｂ", "日本語「テスト」", ""]
    assert values(spark, xs, text.normalize_title(c("x"))) == [text.normal_phrase(x) for x in xs]
    arrays = spark.createDataFrame([(["Ｃohort  Study", "a&amp;b", None],), ([],), (None,)], "x array<string>").select(text.normalize_titles(c("x")).alias("y")).collect()
    assert [r.y for r in arrays] == [["cohort study", "a&b"], [], []]
    import re

    same = re.compile(f"[{text.UNCHANGED}]")
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and same.match(chr(i)):
            assert unicodedata.normalize("NFKC", chr(i)) == chr(i) and not unicodedata.combining(chr(i)), hex(i)


def test_needles_are_in_every_match():
    import re

    from corpusflow import rules

    assert set(rx.needles(r"\b(?:career|careers|job opening|recruit(?:ment)?)\b")) == {"career", "careers", "job opening", "recruit"}
    assert rx.needles(r"randomi[sz]ed(?: controlled)? trial") == ("randomi",) and rx.needles(r"\b\w+\b") == ()
    words = "original article, research; clinical guideline Consensus randomised trial cohort study 指南解读 FIGO committee statement register webinar meta-analysis".split()
    for pattern in [p for p in vars(rules).values() if isinstance(p, str)] + [p for _, p in rules.CONTENT_TYPES + rules.TITLE_TYPES]:
        for i in range(len(words)):
            t = " ".join(words[i : i + 3])
            if rx.needles(pattern) and re.search(pattern, t, re.I | re.A):
                assert any(n in t.lower() for n in rx.needles(pattern)), (pattern, t)


def test_doi(spark):
    xs = ["https://doi.org/10.1/AB.)", " doi: 10.2/x ;", "  ", None]
    assert values(spark, xs, text.normalize_doi(c("x"))) == ["10.1/ab", "10.2/x", None, None]


def test_canonical_url(spark):
    xs = ["HTTP://Ex.org:80/a/?b=2&utm_x=1&a=1#f", "https://ex.org", "not a url/#x", "https://e.org/?rss=1", None]
    assert values(spark, xs, urls.canonical(c("x"))) == ["http://ex.org/a/?a=1&b=2", "https://ex.org", "not a url", "https://e.org/?rss=1"[:13], None]
    assert values(spark, ["ftp://a.org", "http://a.org", "http:///x", "x", None], urls.is_http(c("x"))) == [False, True, False, False, False]


def test_dates(spark):
    xs = ["2024-2-3", "on 3 Mar 2024", "March 3, 2024", "2024年1月9日", "2023-02-30", "soon", None]
    out = values(spark, xs, F.date_format(dates.from_text(c("x")), "yyyy-MM-dd"))
    assert out == ["2024-02-03", "2024-03-03", "2024-03-03", "2024-01-09", None, None, None]
    xs = ["Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00Z", "1 Jan 2024 10:00:00 +0000", "x", None]
    assert values(spark, xs, F.unix_timestamp(dates.parsed(c("x")))) == [1704103200] * 3 + [None, None]


def test_json(spark):
    xs = ['```json\n{"a":1}\n```', 'so {"a": [1,]} end', '{"a": "x', "none", None]
    bare = text.extract_json(c("x"))
    assert values(spark, xs, bare)[:2] == ['{"a":1}', '{"a": [1,]}']
    fixed = values(spark, xs, text.repair_json(bare))
    assert fixed[0] == '{"a":1}' and fixed[1] == '{"a": [1]}' and fixed[3] is None and fixed[4] is None


def test_loose_json(spark):
    import json

    cases = {
        "{'a': 'it\\'s', b: True, /* c */ \"d\": None}": {"a": "it's", "b": True, "d": None}, '{"a": 1 "b": [1 2, 3,], }': {"a": 1, "b": [1, 2, 3]}, '{"a": "line\nbreak", // end\n"b": -1.5e3}': {"a": "line\nbreak", "b": -1500.0},
        '{“a”: “x”, "b": [{"c": 1}, {"c": "cut': {"a": "x", "b": [{"c": 1}, {"c": "cut"}]}, '{"a": [1, 2}': {"a": [1, 2]}, '[{"u": "\\u00e9\\n"}, bare word]': [{"u": "é\n"}, "bare", "word"], '{"a": , "b": 007}': {"a": None, "b": "007"}, '{"a"': {"a": None},
    }
    got = values(spark, [*cases, "no json", ""], text.repair_json(c("x")))
    assert [json.loads(x) for x in got[:-2]] == list(cases.values()) and got[-2:] == [None, None]


def test_rounding_halves_up(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (1.005,)], "x double")
    assert [r.y for r in df.select(text.round_half_up(c("x"), 0).alias("y")).collect()] == [-2.0, 3.0, 1.0]
