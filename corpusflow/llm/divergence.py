"""Source divergence audit: how far the terms of each source of a language are from every other's.

A term is a run of letters (A-Z lower-cased) and characters beyond ASCII.  Each language keeps
the terms that at least ``min_docs`` of its documents hold.  Over the kept terms each group
(lang, source), and each language as a whole, has shares p in billionths, smoothed by one; the
divergence of p from q is the sum over terms of floor((p - q)**2 / q).  All arithmetic is
integer and exact.

Terms are counted by batch, then by partial aggregates over (lang, source, term).  Kept terms are
dealt by hash into blocks of bounded size.  A block is laid out as dense int64 tiles, groups by
terms, and all pairs of groups are computed by broadcasting; the partial pair matrices of the
blocks are summed, and each block's heaps of largest terms by group are merged in two rounds.
Where a language has more than PANEL groups, the groups are dealt into panels and a block is
computed for each pair of panels, so that a tile and a pair matrix stay bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, stored

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Rows of counts in a block; groups of a panel; cells of a tile; cells of one broadcast; text of a batch counted at once.
BLOCK_ROWS = 1 << 16
PANEL = 512
TILE_CELLS = 1 << 17
PAIR_CELLS = 1 << 19
COUNT_BYTES = 2 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, and the index of the text that each is in."""
    raw, offs = K.buffer(texts)
    raw = K.lower_ascii(raw)
    inside = _TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(raw)]
    first[at] = inside[at]
    start = np.flatnonzero(first)
    ends = np.concatenate([np.cumsum(inside, dtype=np.int64)[start] - 1, [np.count_nonzero(inside)]])
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw[inside].tobytes()))
    return found.dictionary_encode(), np.searchsorted(offs, start, side="right") - 1


def _counted(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch, and a row without a term for each group."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    found, doc = terms(texts)
    width = max(1, len(found.dictionary))
    by_doc, n = np.unique(doc * width + found.indices.to_numpy().astype(np.int64), return_counts=True)
    key = group[by_doc // width] * width + by_doc % width
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    docs, n = np.diff(np.append(at, len(key))), np.add.reduceat(n, at) if len(at) else n
    alone = np.unique(group)
    group = np.concatenate([key[at] // width, alone])
    term = found.dictionary.take(pa.array(np.concatenate([key[at] % width, np.zeros(len(alone), np.int64)]), mask=np.arange(len(group)) >= len(at)))
    zero = np.zeros(len(alone), np.int64)
    columns = [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), term.cast(pa.string()), pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and rows of the group that hold it;
    each group has a row of a null term besides.  Null text, lang and source count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 2, COUNT_BYTES, 1 << 16):
                if b.num_rows:
                    yield _counted(*b.columns)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(K.lean(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), by long division in thousands: exact up to totals of 9e15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(count, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(p: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The matrix of sums over terms of floor((p - q)**2 / q), p of the groups rows, q of the groups columns: all pairs by broadcasting."""
    out, q = np.empty((len(rows), len(columns)), np.int64), p[columns]
    step = max(1, PAIR_CELLS // max(1, q.size))
    for at in range(0, len(rows), step):
        out[at : at + step] = _excess(p[rows[at : at + step], None, :], q[None, :, :]).sum(axis=2)
    return out


def _tiles(source: np.ndarray, term: np.ndarray, n: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term codes, dense counts of groups by these terms): a few terms at a time, the counts sorted by term."""
    order = np.argsort(term, kind="stable")
    source, term, n = source[order], term[order], n[order]
    codes, at = np.unique(term, return_index=True)
    at = np.append(at, len(term))
    width = max(1, TILE_CELLS // max(1, groups))
    for i in range(0, len(codes), width):
        some = codes[i : i + width]
        mine = slice(at[i], at[i + len(some)])
        tile = np.zeros((groups, len(some)), np.int64)
        tile[source[mine], np.searchsorted(some, term[mine])] = n[mine]
        yield some, tile


def _block(t: pa.Table, top: int) -> Iterator[pa.Table]:
    """Partial pair sums and largest terms of one block, for one pair of panels; rows without a term are the groups."""
    x, y, block = (t[c][0].as_py() for c in ("x", "y", "block"))
    head = t.filter(pc.is_null(t["term"])).sort_by([("lang", "ascending"), ("source", "ascending")])
    body = t.filter(pc.is_valid(t["term"]))
    for lang in pc.unique(head["lang"]).to_pylist():
        h, b = head.filter(pc.equal(head["lang"], lang)), body.filter(pc.equal(body["lang"], lang))
        v, total = h["v"][0].as_py(), h["t"][0].as_py()
        if not b.num_rows and block:
            continue
        names = h["source"].combine_chunks()
        panel, size = h["panel"].to_numpy(), h["n"].to_numpy()
        first, second = np.flatnonzero(panel == x), np.flatnonzero(panel == y)
        # what a term adds that neither group holds: counted once for all kept terms, and taken off again for those in a tile
        unheld = share(np.ones(len(names), np.int64), size + max(v, 1))[:, None]
        seen = len(pc.unique(b["term"]))
        there, back = ((0 if block else v) - seen) * pair_sums(unheld, first, second), ((0 if block else v) - seen) * pair_sums(unheld, second, first)
        heaps: list[list[tuple[int, bytes]]] = [[] for _ in names]
        term = b["term"].combine_chunks().cast(pa.large_binary()).dictionary_encode()
        whole = np.zeros(len(term.dictionary), np.int64)
        codes = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole[codes] = b["t"].to_numpy()
        source = pc.index_in(b["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        for some, tile in _tiles(source, codes, b["n"].to_numpy(), len(names)):
            p = share(tile + 1, (size + v)[:, None])
            there += pair_sums(p, first, second)
            if x != y:
                back += pair_sums(p, second, first)
                continue
            q = share(whole[some] + 1, np.int64(total + v))
            f = _excess(p, q)
            for g in range(len(names)):
                at = np.flatnonzero((tile[g] > 0) & (p[g] > q))
                if len(heaps[g]) == top:
                    at = at[f[g, at] >= -heaps[g][-1][0]]
                elif len(at) > top:
                    at = at[f[g, at] >= np.partition(f[g, at], len(at) - top)[len(at) - top]]
                if len(at):
                    heaps[g] = heapq.nsmallest(top, heaps[g] + [(-value, word) for value, word in zip(f[g, at].tolist(), term.dictionary.take(pa.array(some[at])).to_pylist())])
        for rows, columns, sums in ((first, second, there), (second, first, back))[: 1 if x == y else 2]:
            a, c = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
            other = a != c
            yield _rows(lang, names.take(pa.array(a[other])), "pair", names.take(pa.array(c[other])), pa.array(sums.ravel()[other]))
        held = [(g, word, -value) for g, heap in enumerate(heaps) for value, word in heap]
        yield _rows(lang, names.take(pa.array([g for g, _, _ in held], pa.int64())), "term", pa.array([w for _, w, _ in held], pa.binary()).cast(pa.string()), pa.array([v for _, _, v in held], pa.int64()))


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: pa.Array) -> pa.Table:
    return pa.table([pa.repeat(pa.scalar(lang), len(source)), source, pa.repeat(pa.scalar(part), len(source)), item, value], schema=_OUT)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS, panel: int = PANEL) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of docs.

    part 'pair': item is each other source of the language, value the divergence of the group's
    shares from that source's; all ranks.  part 'term': item is a term that the group holds more
    of than the language does, value its excess; ranks to ``top``.  rank is from 1 by value
    descending, then item.

    Defined cases: null text, lang and source count as ''; a group without terms has its pairs
    and no terms; a language without kept terms has pairs of value 0, a language of one source
    no pairs; rows that repeat are documents of their own, whatever their ids, which aren't
    read; other columns aren't read; no rows, no output.
    """
    counts = stored(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")
    held = counts.where("term is not null").withColumns({"of_lang": F.sum("docs").over(of_term), "t": F.sum("n").over(of_term), "lead": F.min("source").over(of_term)})
    kept = stored(held.where(F.col("of_lang") >= min_docs).select("lang", "source", "term", "n", "t", (F.col("lead") == F.col("source")).alias("lead")))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("lead").alias("leads"))
    of_lang = Window.partitionBy("lang")
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna(0, ["n", "leads"])
    groups = stored(groups.select("lang", "source", "n", F.sum("n").over(of_lang).alias("t"), F.sum("leads").over(of_lang).alias("v"), F.count("*").over(of_lang).alias("of_lang")))
    discard(counts)
    panels = -(-(groups.agg(F.max("of_lang")).first()[0] or 1) // panel)
    blocks = max(1, -(-kept.count() // block_rows))
    # each row to every unit (block, pair of panels) that its source's panel is in
    own, other = F.pmod(F.xxhash64("source"), F.lit(panels)), F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))
    ends = lambda df: df.withColumn("panel", own).withColumn("o", other).withColumns({"x": F.least("panel", "o"), "y": F.greatest("panel", "o")})
    head = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("term", F.lit(None).cast("string"))
    body = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks))).withColumn("v", F.lit(0).cast("long"))
    names = ["block", "x", "y", "panel", "lang", "source", "term", "n", "t", "v"]

    def run(t: pa.Table) -> pa.Table:
        return pa.concat_tables([_OUT.empty_table(), *_block(t, top)]).combine_chunks()

    parts = ends(body).select(names).unionByName(ends(head).select(names)).groupBy("block", "x", "y").applyInArrow(run, "lang string, source string, part string, item string, value long")
    parts = stored(parts)
    discard(kept, groups)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # heaps merged in two rounds, so that a group's heaps of all blocks don't meet in one task at once
    best = lambda *keys: F.row_number().over(Window.partitionBy("lang", "source", *keys).orderBy(F.desc("value"), "item"))
    some = parts.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(64)))
    some = some.withColumn("r", best("salt")).where(F.col("r") <= top).drop("r", "salt")
    out = pairs.unionByName(some).withColumn("rank", best("part"))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
