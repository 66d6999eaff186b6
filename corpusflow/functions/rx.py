"""Regular expressions with the source dialect's meaning, and rule lists as expressions.

Rules are written for a dialect whose ``\\b`` and ``\\w`` are ASCII and whose ``\\s``
covers Unicode spaces.  Java's ``\\b`` is Unicode-aware and its ``\\s`` ASCII, so both
are rewritten when a rule list is compiled to a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce
from re import _constants as ops  # the parser of the standard library, on the driver only
from re import _parser as parser
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .scan import Hits

#: Characters that the source dialect's \s stands for.
SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_EACH_SPACE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"


def _starts_word(pattern: str, i: int) -> bool:
    """Whether a word character must follow: half of the edge is then known."""
    if pattern[i : i + 1].isalnum():
        return pattern[i + 1 : i + 2] not in ("?", "*", "{")
    if pattern[i : i + 3] != "(?:":
        return False
    depth, j, first = 0, i, True
    while j < len(pattern):
        ch = pattern[j]
        if ch == "\\":
            if first:
                return False
            j += 1
        elif pattern[j : j + 3] == "(?:":
            depth += 1
            if depth > 1 and first:
                return False
            j += 2
            first = depth == 1
            j += 1
            continue
        elif ch in "([":
            if first:
                return False
            depth += ch == "("
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return pattern[j + 1 : j + 2] not in ("?", "*", "{")
        elif first and not ch.isalnum():
            return False
        first = ch == "|" and depth == 1
        j += 1
    return False


def _ends_word(pattern: str, i: int) -> bool:
    """Whether a word character must precede."""
    return i > 0 and pattern[i - 1].isalnum() and pattern[i - 2 : i - 1] != "\\"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Java: word edges by ASCII letters, spaces of all kinds.

    Case is ignored among ASCII letters; among others only if the pattern holds a letter
    beyond ASCII that has cases, since folding all of Unicode slows every comparison.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(_BEFORE if _starts_word(pattern, i + 2) else _AFTER if _ends_word(pattern, i) else _EDGE)
            i += 2
        elif two == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
            i += 2
        elif two == r"\w":
            out.append("A-Za-z0-9_" if in_class else _WORD)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = (in_class or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    cased = any(ord(x) > 127 and x.lower() != x.upper() for x in pattern)
    return ("(?iu)" if cased else "(?i)" if ignore_case else "") + "".join(out)


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII or caseless strings one of which every match holds; none if the pattern has no such strings.

    Of a sequence the part whose shortest string is longest counts, of alternatives all.
    """

    def best(parts) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""
        for op, value in [*parts, (None, None)]:
            if op is ops.LITERAL and (value < 128 or chr(value).lower() == chr(value).upper()):
                run += chr(value).lower()
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if op is ops.SUBPATTERN:
                inner = best(value[-1])
            elif op is ops.BRANCH:
                each = [best(x) for x in value[1]]
                inner = None if None in each else frozenset().union(*each)
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
                inner = best(value[2])
            else:
                inner = None
            if inner:
                found.append(inner)
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    return tuple(sorted(best(parser.parse(pattern)) or ()))


def may_match(low: Column, pattern: str) -> Column | None:
    """Whether the lower-cased text holds one of the pattern's needles; None if it has none."""
    words = needles(pattern)
    if not words:
        return None
    if len(words) <= 6:
        out = low.contains(words[0])
        for w in words[1:]:
            out = out | low.contains(w)
        return out
    # low stands once, in an array of one: an expression of it would be computed for each word
    return F.exists(F.array(low), lambda text: reduce(Column.__or__, [text.contains(w) for w in words]))


def matches(text: Column, pattern: str, ignore_case: bool = True, low: Column | Hits | None = None) -> Column:
    """Whether the pattern occurs; a null text has no match.

    low is the text in lower case, if the caller has it as a column: plain substrings
    that a match must hold are then looked for first.  Or it is what one scan for all
    patterns found in the text, or in one that holds it.
    """
    hit = text.rlike(java(pattern, ignore_case))
    guard = None if low is None else may_match(low, pattern) if isinstance(low, Column) else low.may(pattern)
    return F.coalesce(hit if guard is None else guard & hit, F.lit(False))


def any_match(text: Column, patterns: Sequence[str], low: Column | Hits | None = None) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p, low=low)
    return out


def first_match(text: Column, rules: Sequence[tuple[object, str]], otherwise: object = None, low: Column | Hits | None = None) -> Column:
    """The label of the first rule (label, pattern) that the text matches."""
    out = None
    for label, pattern in rules:
        hit = matches(text, pattern, low=low)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    end = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return end if out is None else out.otherwise(end)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, java(pattern), group), F.lit(""))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def contains_any(text: Column, words: Sequence[str], low: Column | None = None) -> Column:
    """Whether any word occurs as a substring, in any case; no words, no match."""
    if not words:
        return F.lit(False)
    low = F.lower(text) if low is None else low
    return F.coalesce(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)), F.lit(False))


def contains_any_of(text: Column, words: Column, low: Column | None = None) -> Column:
    """The same with an array column of words (null: none)."""
    low = F.lower(text) if low is None else low
    return F.coalesce(F.exists(words, lambda w: F.contains(low, F.lower(w))), F.lit(False))


def trim(text: Column) -> Column:
    """Without spaces at its ends; looks at the ends only."""
    return F.btrim(text, F.lit(_EACH_SPACE))


def blank(text: Column) -> Column:
    """Whether a text is null or holds nothing but spaces."""
    return F.coalesce(~text.rlike(f"[^{SPACES}]"), F.lit(True))
