"""Many patterns and word lists over a text in one pass.

An Aho-Corasick automaton holds the plain substrings that the patterns' matches must hold
(rx.needles) and the words of lists.  An Arrow function runs it once over each text, in
lower case, and gives a bit for each pattern and list.  A list of words has occurred if its bit is
set; a pattern may match only where its bit is set, and only there its regular expression runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .udf import lean, small_batches

#: Bits in a word of the set: a long without its sign.
BITS = 62


@lru_cache(maxsize=16)
def automaton(entries: tuple[tuple[str, int], ...]):
    """The automaton of (substring, bits): made once in each worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, bits in entries:
        out.add_word(word, bits)
    if entries:
        out.make_automaton()
    return out


def bits_of(entries: tuple[tuple[str, int], ...], texts: Iterable[str | None]) -> list[int]:
    """The bits of all substrings that occur in each text."""
    if not entries:
        return [0 for _ in texts]
    found, occurrences = [], automaton(entries).iter
    for text in texts:
        own = 0
        for _, bits in occurrences(text) if text else ():
            own |= bits
        found.append(own)
    return found


class Scanner:
    """patterns: rules that first_match() and matches() ask for; lists: name -> words, any of which counts.

    A pattern without a plain substring has no bit, and may match anywhere.
    """

    def __init__(self, patterns: Sequence[str] = (), lists: Mapping[str, Sequence[str]] | None = None):
        self.bit: dict[str, int] = {}
        self.lists = {name: tuple(words) for name, words in (lists or {}).items()}
        by_word: dict[str, int] = {}
        for name, words in [*((p, rx.needles(p)) for p in dict.fromkeys(patterns)), *((n, [w.lower() for w in ws if w]) for n, ws in self.lists.items())]:
            if words:
                self.bit[name] = len(self.bit)
                for w in words:
                    by_word[w] = by_word.get(w, 0) | 1 << self.bit[name]
        self.entries = tuple(sorted(by_word.items()))
        self.words = max(1, -(-len(self.bit) // BITS))

    def bits(self, low: Column) -> Column:
        """struct(w0, w1, ...) for lower-cased texts; a null text has none.  To be kept as a column, which hit() reads.

        Declared nondeterministic, though it isn't, so that filters over the bits aren't pushed below it, which
        would scan and make the texts twice.
        """
        entries, words, mask = self.entries, self.words, (1 << BITS) - 1

        def run(texts: pd.Series) -> pd.DataFrame:
            found = bits_of(entries, texts)
            return pd.DataFrame({f"w{k}": pd.Series([x >> BITS * k & mask for x in found], dtype="int64") for k in range(words)})

        small_batches()
        return F.pandas_udf(lean(run), ", ".join(f"w{k} long" for k in range(words))).asNondeterministic()(low)

    def hit(self, bits: Column, name: str) -> Column | None:
        """Whether the pattern's or list's bit is set; None if it has none."""
        at = self.bit.get(name)
        return None if at is None else bits[f"w{at // BITS}"].bitwiseAND(F.lit(1 << at % BITS).cast("long")) != 0


class Hits:
    """A scanner with the column of its bits: stands where rx takes the text in lower case."""

    def __init__(self, scanner: Scanner, column: str):
        self.scanner, self.column = scanner, column

    def may(self, pattern: str) -> Column | None:
        """Whether the pattern may match; None if it always may."""
        if pattern not in self.scanner.bit and rx.needles(pattern):
            raise KeyError(f"not among the scanner's patterns: {pattern}")
        return self.scanner.hit(F.col(self.column), pattern)

    def any(self, name: str) -> Column:
        """Whether any word of the list occurs."""
        hit = self.scanner.hit(F.col(self.column), name)
        return F.lit(False) if hit is None else F.coalesce(hit, F.lit(False))
