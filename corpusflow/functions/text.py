"""Scalar text functions: entities, identifiers, titles, HTML, numbers, JSON, fingerprints."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .udf import arrow

#: The named entities that are decoded; others stay.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
_ENTITY = re.compile(r"&(#x[0-9a-f]+|#[0-9]+|[a-z]+);", re.I)


def _entity(m: re.Match) -> str:
    e = m[1]
    try:
        return chr(int(e[2:], 16) if e.startswith("#x") else int(e[1:])) if e.startswith("#") else ENTITIES.get(e.lower(), m[0])
    except (ValueError, OverflowError):
        return m[0]  # not a code point


@arrow("string")
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _ENTITY.sub(_entity, x))


@arrow("string")
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def decode_entities(text: Column, numeric: bool = True) -> Column:
    """Named entities by replacement; texts with numeric ones by an Arrow function, as no built-in makes code points."""
    out = text
    for name, value in ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", value)
    out = F.regexp_replace(out, "(?i)&amp;", "&")
    out = F.when(text.contains("&"), out).otherwise(text)  # few texts have any
    return F.coalesce(_decoded(F.when(text.contains("&#"), text)), out) if numeric else out


def strip_tags(html: Column, by: str = "") -> Column:
    """Tags removed (or replaced), spaces collapsed, ends trimmed."""
    return rx.trim(rx.replace(F.regexp_replace(html, "<[^>]+>", by), r"\s+", " "))


def normalize_doi(doi: Column) -> Column:
    out = rx.replace(rx.trim(doi), r"^https?://(?:dx\.)?doi\.org/", "")
    out = rx.replace(rx.replace(out, r"^doi:\s*", ""), r"[\s.,;:)}\]]+$", "")
    return F.nullif(F.lower(out), F.lit(""))


#: Characters that NFKC leaves as they are, whatever stands beside them; texts of these only skip the Arrow function.
UNCHANGED = r"\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0388-\u03CE\u0400-\u045F\u2013\u2014\u2018\u2019\u201C\u201D\u3001\u3002\u3008-\u3011\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"


#: Stands between texts that pass as one: no normal form changes it, and in one it is no letter, so a space stands for it inside a text.
MARK = "\u0001"


@arrow("string")
def _decoded_nfkc(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        parts = x.split(MARK) if "&#" in x else ()  # an entity of a mark is none
        return unicodedata.normalize("NFKC", MARK.join(_ENTITY.sub(_entity, p).replace(MARK, " ") for p in parts) if parts else _ENTITY.sub(_entity, x))

    return s.map(lambda x: None if x is None else one(x))


def nfkc(text: Column) -> Column:
    """Compatibility forms and compositions; only texts that may change pass through Python."""
    return F.coalesce(_nfkc(F.when(_may_change(text), text)), text)


def _may_change(text: Column) -> Column:
    """Whether NFKC may change a text; one of ASCII is told by its length, and an ASCII character by one comparison."""
    return (F.octet_length(text) != F.char_length(text)) & text.rlike(f"[[^\\x00-\\x7F]&&[^{UNCHANGED}]]")


def composed(text: Column) -> Column:
    """Entities decoded, then NFKC: one Arrow function, for texts with numeric entities or characters that may change."""
    return F.coalesce(_decoded_nfkc(F.when(text.contains("&#") | _may_change(text), text)), decode_entities(text, False))


def _only_words(composed_text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(composed_text), r"[^a-z0-9&\p{L}\p{N}]+", " "))  # a-z first, as most are


def normalize_title(title: Column) -> Column:
    """Entities decoded, NFKC, lower case, dashes and anything but letters, digits and & to one space."""
    return _only_words(composed(title))


def normalize_titles(titles: Column) -> Column:
    """The same for each item of an array (null items left out): one text passes, as lambdas can't hold Arrow functions."""
    whole = composed(marked(titles))
    return F.when(F.size(titles) > 0, F.transform(F.split(whole, MARK), _only_words)).otherwise(F.array().cast("array<string>"))


def marked(texts: Column) -> Column:
    """Items of an array (null ones left out) as one text, a mark between them."""
    return F.array_join(F.transform(texts, lambda t: F.replace(t, F.lit(MARK), F.lit(" "))), MARK)


def normal_parts(whole: Column, low: Column) -> Column:
    """normalize_title() of each part of a marked text, as an array; low: the marked text in lower case, which it stays unless it is composed anew."""
    anew = _decoded_nfkc(F.when(whole.contains("&#") | _may_change(whole), whole))
    low = F.when(anew.isNotNull(), F.lower(anew)).when(whole.contains("&"), F.lower(decode_entities(whole, False))).otherwise(low)
    return F.transform(F.split(F.regexp_replace(low, r"[^a-z0-9&\p{L}\p{N}\x01]+", " "), MARK), lambda x: F.trim(x))


def normal_phrase(phrase: str) -> str:
    """normalize_title() of a constant."""
    low = unicodedata.normalize("NFKC", _ENTITY.sub(_entity, phrase)).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c == "&" else " " for c in low).split())


def normalize_content_title(title: Column) -> Column:
    """As above, but entities stay and & is no letter."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def identity_keys(pmid: Column, doi: Column, title: Column) -> Column:
    """Ordered keys of a paper: by number, DOI and title, as far as it has them."""
    named = [F.concat(F.lit("pmid:"), F.nullif(rx.trim(pmid), F.lit(""))), F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("title:"), F.nullif(normalize_title(title), F.lit("")))]
    return F.filter(F.array(*named), lambda k: k.isNotNull())


def joined(sep: str, *parts: Column) -> Column:
    """Parts that are there, joined."""
    return F.concat_ws(sep, *parts)


def includes_phrase(normalized: Column, phrase: str) -> Column:
    """Whether a normalised text holds the phrase's normal form; an empty phrase is nowhere."""
    needle = normal_phrase(phrase)
    return F.coalesce(normalized.contains(needle), F.lit(False)) if needle else F.lit(False)


def round_half_up(x: Column, digits: int, nudge: float = 0.0) -> Column:
    """floor(x * 10**digits + 1/2), scaled back: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor((x + nudge) * scale + 0.5) / scale


def round2(x: Column) -> Column:
    return round_half_up(x, 2, 2.0**-52)


def fixed(x: Column, digits: int, commas: bool = False) -> Column:
    """A double with fixed digits, rounded from its exact binary value; exact halves go away from zero."""
    half, scale = float(2 ** (digits + 1)), float(10**digits)
    tie = (x * half == F.floor(x * half)) & (F.pmod(F.abs(x) * (2 * scale), F.lit(2.0)) == 1)
    out = F.format_number(F.when(tie, (x * scale + F.signum(x) * 0.5) / scale).otherwise(x), digits)
    return out if commas else F.replace(out, F.lit(","), F.lit(""))


def compact_number(n: Column) -> Column:
    """1.2K, 3.4M: one digit."""
    n = n.cast("double")
    return F.when(n >= 1e6, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1e3, F.concat(fixed(n / 1e3, 1), F.lit("K"))).otherwise(fixed(n, 0))


def big_money(n: Column) -> Column:
    """$1.23 T, $4.6 B, $7.9 M, $12."""
    n = n.cast("double")
    of = lambda scale, digits, unit: F.concat(F.lit("$"), fixed(n / scale, digits), F.lit(unit))
    return F.when(n >= 1e12, of(1e12, 2, " T")).when(n >= 1e9, of(1e9, 1, " B")).when(n >= 1e6, of(1e6, 1, " M")).otherwise(of(1.0, 0, ""))


def price(n: Column, digits: int = 2) -> Column:
    """Fixed digits, thousands apart by commas; a dash for what isn't a number."""
    n = n.cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit("—")).otherwise(fixed(n, digits, commas=True))


def signed_percent(x: Column) -> Column:
    """+1.25%; a dash for what isn't a number."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("–")).otherwise(F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), fixed(x, 2), F.lit("%")))


def tokens_of_chars(chars: Column, per_token: int = 3) -> Column:
    return chars / F.lit(per_token)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def extract_json(text: Column) -> Column:
    """From the first { to the last }, outside a code fence if there is one; else the text."""
    bare = rx.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text))
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), bare)


class _Loose:
    """Reads an object or array that isn't strictly JSON: other quotes, bare keys and words, comments, missing or spare
    commas and colons, raw line breaks in strings, Python's names of constants, and an end in the middle."""

    QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
    NAMES = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None}
    _BARE = re.compile(r"[^\s,:\[\]{}\"'“‘`/]+")
    _NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
    _SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|$))+", re.S)

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self, spare: str = "") -> str:
        """The next character that isn't space, comment or spare; empty at the end."""
        while self.at < len(self.text):
            if m := self._SKIP.match(self.text, self.at):
                self.at = m.end()
            elif self.text[self.at] in spare:
                self.at += 1
            else:
                return self.text[self.at]
        return ""

    def value(self):
        ch = self.skip()
        if ch == "{":
            return self.object()
        if ch == "[":
            return self.array()
        if ch in self.QUOTES:
            return self.string()
        m = self._BARE.match(self.text, self.at)
        if not m:
            self.at += 1
            return None
        self.at = m.end()
        if m[0] in self.NAMES:
            return self.NAMES[m[0]]
        return json.loads(m[0]) if self._NUMBER.fullmatch(m[0]) else m[0]

    def object(self) -> dict:
        out: dict = {}
        self.at += 1
        while (ch := self.skip(",;")) and ch != "}":
            if ch == "]":  # closes what is around
                return out
            key = self.value()
            if self.skip() == ":":
                self.at += 1
                out[str(key)] = None if self.skip() in ("", ",", "}") else self.value()
            else:
                out[str(key)] = None
        self.at += 1
        return out

    def array(self) -> list:
        out: list = []
        self.at += 1
        while (ch := self.skip(",;")) and ch != "]":
            if ch == "}":
                return out
            out.append(self.value())
        self.at += 1
        return out

    def string(self) -> str:
        close, out = self.QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text):
            ch = self.text[self.at]
            self.at += 1
            if ch == close:
                break
            if ch == "\\" and self.at < len(self.text):
                m = re.compile(r"u[0-9a-fA-F]{4}").match(self.text, self.at)
                code = m[0] if m else self.text[self.at]
                self.at += len(code)
                ch = chr(int(code[1:], 16)) if m else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(code, code)
            out.append(ch)
        return "".join(out)


@arrow("string")
def repair_json(s: pd.Series) -> pd.Series:
    """JSON that parses strictly, as given or read loosely; null for what is no object or array."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            json.loads(x)
            return x
        except ValueError:
            pass
        loose = _Loose(x)
        return json.dumps(loose.value()) if loose.skip() in ("{", "[") else None  # in ASCII: half a surrogate pair stays an escape

    return s.map(one)


def fingerprint(title: Column, abstract: Column, journal: Column, published: Column, types: Column, authors: Column) -> Column:
    """SHA-256 of six fields as JSON; arrays sorted by code unit, an absent date left out."""
    fields = F.struct(title.alias("title"), abstract.alias("abstract"), journal.alias("journal"), published.alias("publishedAt"), F.array_sort(types).alias("publicationTypes"), F.array_sort(authors).alias("authors"))
    return F.sha2(F.to_json(fields), 256)
