"""Quality rules: base counts of a text, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, runs of white space and
punctuation dropped) and hashed; each document hands on each hash once.  A line
is boilerplate if the distinct documents of its host that hold it exceed the
host's limit: ``limit_share`` of the host's distinct documents, or ``limit_docs`` if
that is more, a floor of a few so that the rule works alike on hosts of every size.
Boilerplate lines go; a document of which less than ``least_left`` of its words is
left is depleted and rejected.

Counts are partial aggregates over (host, hash) and hosts' sizes come by a join,
so a host holding a third of all rows is spread over its lines.  Rows are counted
first; only lines with enough rows are counted by distinct documents.  The lines that
are over a limit are stored and joined back to the documents, both sides shuffled for the
join, so that adaptive execution can split a line which a third of all documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import stored, unused

LIMIT_DOCS = 3
LIMIT_SHARE = 0.05
LEAST_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEAT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: What a normalised line keeps: letters (also beyond ASCII) and digits.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def line_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and document of each \n-separated line; a document has one more than it has \n."""
    n = len(offs) - 1
    cut = np.flatnonzero(raw == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(offs, cut, side="right") - 1])
    start = np.concatenate([offs[:-1], cut + 1])
    order = np.lexsort((start, doc))
    end_doc = np.concatenate([np.searchsorted(offs, cut, side="right") - 1, np.arange(n)])
    end = np.concatenate([cut, offs[1:]])
    return start[order], end[np.lexsort((end, end_doc))], doc[order]


def line_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each normalised line, and whether a letter or digit is in it."""
    kept = _LETTER[raw]
    at_kept = np.concatenate([[0], np.cumsum(kept)])
    folded = K.byte_prefix(_FOLD[raw[kept]])
    lo, hi = at_kept[start], at_kept[end]
    return K.mix(folded.of(lo, hi) + (hi - lo).astype(K.U), 5), hi > lo


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts for each text, and its lines: document, normalised hash, words."""
    raw, offs = K.buffer(texts)
    n = len(offs) - 1
    w = K.Words(raw, offs)
    words = np.diff(w.bounds)
    byte_doc = np.repeat(np.arange(n), np.diff(offs))
    points = (raw & 0xC0) != 0x80
    chars = np.bincount(byte_doc[points & ~K._SPACE[raw]], minlength=n)
    symbols = np.bincount(byte_doc[_SYMBOL[raw]], minlength=n)
    h = w.hashes()
    # words in 3-word windows that occur twice or more in the text
    at = K.window_starts(w.bounds, 3)
    tri = K.word_prefix(h).of(at, at + 3)
    order = np.lexsort((tri, w.doc[at]))
    d, v = w.doc[at][order], tri[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    often = np.zeros(len(at), bool)
    often[1:] |= same
    often[:-1] |= same
    covered = np.zeros(len(w) + 1, np.int64)
    hit = at[order[often]]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 3, -1)
    repeat = np.bincount(w.doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    # lines with a word
    start, end, doc = line_bounds(raw, offs)
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = last > first
    start, end, doc, line_words = start[full], end[full], doc[full], (last - first)[full]
    exact = K.byte_prefix(raw).of(start, end)
    duplicates = np.bincount(doc, minlength=n) - np.bincount(K.distinct_by_doc(doc, K.mix(exact, 3) + (end - start).astype(K.U))[0], minlength=n)
    line_hash, named = line_hashes(raw, start, end)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeat,
        "line_doc": doc[named], "line_hash": line_hash[named], "line_words": line_words[named],
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, row, the base counts, lines) for each row of docs; lines: distinct (hash, words) of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, 2):
                m = measure(b.column(2))
                order = np.lexsort((m["line_hash"], m["line_doc"]))
                d, h, n = m["line_doc"][order], m["line_hash"][order], m["line_words"][order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                words = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
                ends = np.searchsorted(d[new], np.arange(b.num_rows + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(words.astype(np.int64))], names=["h", "w"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(m[k].astype(np.int64)) for k in BASE), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["doc_id", "host", *BASE, "lines"])

    schema = "doc_id long, host string, " + "".join(f"{k} long, " for k in BASE) + "lines array<struct<h:long,w:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), schema)


def _over_limit(rows: DataFrame, limit_docs: int, limit_share: float) -> DataFrame:
    """(doc_id, host, gone): the hashes of each document's lines over their host's limit, from measured() rows."""
    known = rows.where("doc_id is not null")
    lines = known.select("doc_id", "host", F.explode("lines.h").alias("h"))
    docs_of = known.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    # as many rows as documents at least: only what has enough rows is counted by distinct documents
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > limit_docs).join(docs_of, "host")
    over = F.col("n") > F.greatest(F.lit(float(limit_docs)), F.col("docs") * limit_share)
    # dealt by document, so that a line which very many documents hold is counted in many tasks
    # the counts are stored, so that each side of the joins is shuffled for it and a line of very many documents can be split
    held = stored(lines.join(stored(often.where(over).select("host", "h", "docs")), ["host", "h"]).repartition("doc_id").distinct())
    common = stored(held.groupBy("host", "h").agg(F.count("*").alias("n"), F.first("docs").alias("docs")).where(over).select("host", "h"))
    return held.join(common, ["host", "h"]).groupBy("doc_id", "host").agg(F.collect_list("h").alias("gone"))


def _judged(rows: DataFrame, over: DataFrame, least_left: float) -> DataFrame:
    gone = over.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), "gone")
    out = rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("host") == F.col("__host")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * MAX_REPEAT)
    mine = F.filter("lines", lambda x: F.array_contains("gone", x["h"]))
    n = F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(mine, F.lit(0).cast("long"), lambda total, x: total + x["w"]))
    out = out.select("doc_id", *BASE, failed.alias("base_failed"), n.alias("n_common_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= F.col("n_words") * least_left))


def judge(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """(doc_id, base counts, base_failed, n_common_words, kept) for every row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows.
    kept: not base_failed, and not depleted by the removal of common lines.

    Defined cases: null text counts as empty and fails; a null source is a host of its
    own, called ''; lines without a letter or digit are nobody's boilerplate; rows of
    one doc_id and host are one document in line frequencies, and each row loses its own
    lines; rows of a null doc_id aren't counted and lose no lines; other columns aren't read.
    """
    rows = stored(measured(docs))
    return _judged(rows, _over_limit(rows, limit_docs, limit_share), least_left)


def remove_lines(texts: pa.Array, gone: list[list[int] | None]) -> pa.Array:
    """Texts without the lines whose normalised hash is in the text's list; null lists change nothing."""
    raw, offs = K.buffer(texts)
    start, end, doc = line_bounds(raw, offs)
    h, named = line_hashes(raw, start, end)
    h, bounds, out = h.view(np.int64), np.searchsorted(doc, np.arange(len(offs))), texts.to_pylist()
    for i, hashes in enumerate(gone):
        if hashes:
            a, b = bounds[i], bounds[i + 1]
            left = ~(np.isin(h[a:b], np.array(hashes, np.int64)) & named[a:b])
            out[i] = "\n".join([x for x, stays in zip(out[i].split("\n"), left) if stays])
    return pa.array(out, pa.string())


def without_common_lines(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The rows that judge() keeps, with docs' columns and ``text`` freed of lines over the limit.

    Texts are measured again where the lines go, against the list of their document's lines
    over the limit, and judged by what is left; all other lines stay as they are.  Cases as in
    judge(); other columns, also counts of characters, pass unread.
    """
    rows = stored(measured(docs))
    given = docs.withColumn("text", F.col("text").cast("string"))
    its_id, its_host, its_gone = unused(docs, "__id", "__host", "__gone")
    gone = _over_limit(rows, limit_docs, limit_share).toDF(its_id, its_host, its_gone)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.parts(batch, at):
                m, lists = measure(b.column(at)), b.column(len(names)).to_pylist()
                left = m["n_words"].copy()
                bounds = np.searchsorted(m["line_doc"], np.arange(b.num_rows + 1))
                for i, hashes in enumerate(lists):
                    if hashes:
                        own = slice(bounds[i], bounds[i + 1])
                        left[i] -= m["line_words"][own][np.isin(m["line_hash"][own].view(np.int64), np.array(hashes, np.int64))].sum()
                kept = (m["n_words"] >= MIN_WORDS) & (m["n_repeat_words"] <= m["n_words"] * MAX_REPEAT) & (left >= m["n_words"] * least_left)
                cols = b.columns[:-1]
                cols[at] = remove_lines(cols[at], lists)
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(kept))

    same = (F.col("doc_id").cast("long") == F.col(its_id)) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(its_host))
    return given.join(gone, same, "left").select(*names, its_gone).mapInArrow(K.lean(run), given.schema)
