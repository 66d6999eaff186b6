"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the whole text.  Its
covariance is shrunk twice: towards the covariance of both classes and towards
a multiple of the identity.  A score is the logistic of the difference of two
log densities, each from a Mahalanobis distance under a cached inverse Cholesky
factor.  Moments are summed over all labelled rows of the training folds; the
driver sees two rows of d + d*d sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap_position, id_bitmap, stored, tested

#: The statistics, in order.
NAMES = (
    "log_words", "log_lines", "word_chars", "upper", "digit", "symbol", "exclaim", "comma_stop", "other_punct",
    "beyond_ascii", "distinct_words", "repeat_words", "dup_lines", "upper_words", "line_chars",
)
D = len(NAMES)

_CLASS = np.zeros(256, np.uint8)  # 0: other letters
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#*$%&|<>@^~=+_\\/{}[]")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b".,")] = 5
_CLASS[list(b"\"'():;-`")] = 6
_CLASS[[0x20, *range(0x09, 0x0E)]] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of D statistics for each text.  An empty or null text gives zeros."""
    raw, offs = K.buffer(texts)
    n = len(offs) - 1
    byte_doc = np.repeat(np.arange(n), np.diff(offs))
    c = np.bincount(byte_doc * 10 + _CLASS[raw], minlength=n * 10).reshape(n, 10).astype(float)
    chars = np.maximum(1, c[:, :9].sum(1) - c[:, 7])
    w = K.Words(raw, offs)
    words = np.diff(w.bounds).astype(float)
    h = w.hashes()
    distinct = np.bincount(K.distinct_by_doc(w.doc, h)[0], minlength=n)
    at = K.window_starts(w.bounds, 3)
    tri = K.word_prefix(h).of(at, at + 3)
    distinct3 = np.bincount(K.distinct_by_doc(w.doc[at], tri)[0], minlength=n)
    upper = np.bincount(w.doc, weights=(_CLASS[raw[w.start]] == 1) & (_CLASS[raw[w.end - 1]] != 0), minlength=n)
    newline = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offs[:-1], newline + 1]))
    starts = starts[: len(starts)]
    ends = np.sort(np.concatenate([offs[1:], newline]))
    line_doc = np.searchsorted(offs[1:], starts, side="right")
    line_doc = np.minimum(line_doc, max(0, n - 1))
    full = ends > starts
    lines = np.bincount(line_doc[full], minlength=n)[:n] if n else np.zeros(0)
    line_hash = K.byte_prefix(raw).of(starts[full], ends[full])
    distinct_lines = np.bincount(K.distinct_by_doc(line_doc[full], line_hash)[0], minlength=n)[:n]
    some = np.maximum(words, 1)
    x = np.column_stack([
        np.log1p(words), np.log1p(lines), np.log1p(chars / some), np.sqrt(c[:, 1] / chars), np.sqrt(c[:, 2] / chars),
        np.sqrt(c[:, 3] / some), np.sqrt(c[:, 4] / some), np.sqrt(c[:, 5] / some), np.sqrt(c[:, 6] / some),
        np.sqrt(c[:, 8] / chars), distinct / some, 1 - distinct3 / np.maximum(1, words - 2), 1 - distinct_lines / np.maximum(1, lines),
        np.sqrt(upper / some), np.log1p(chars / np.maximum(1, lines)),
    ])
    x[words == 0] = 0
    return x


def with_statistics(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(doc_id, x) for each row of docs, or for those whose id may be among wanted (an id_bitmap());
    documents are read in Arrow batches and never moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            batches = (b.filter(pa.array(tested(wanted, np.asarray(b.column(2))))) for b in batches)
        for b in (p for batch in batches for p in K.parts(batch, 1)):
            x = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * D), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if wanted is not None:
        texts = texts.where("doc_id is not null").withColumn("p", bitmap_position("doc_id"))
    return texts.mapInArrow(K.lean(run), "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """What scoring needs: class means, inverse Cholesky factors, constants."""

    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.01) -> Discriminant:
    """labelled: (x, quality).  All its rows count; the sums are exact partial aggregates by
    (class, position).  A class without rows takes the other's moments, so that every score is 0.5."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, D)
            y = np.asarray(b.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(at.ravel()), pa.array(total.ravel())], names=["k", "at", "v"])

    rows = labelled.select("x", F.col("quality").cast("long")).mapInArrow(K.lean(moments), "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + D + D * D))
    for r in rows:
        total[r.k, r.at] = r.v
    n = total[:, 0]
    for k in (0, 1):
        if n[k] == 0:
            total[k] = total[1 - k]
    count = np.maximum(total[:, 0], 1)
    both = total.sum(0) / count.sum()
    variance = np.diag(both[1 + D :].reshape(D, D)) - both[1 : 1 + D] ** 2
    scale = 1 / np.sqrt(np.maximum(variance, 1e-6))
    means = total[:, 1 : 1 + D] / count[:, None] * scale
    cov = [total[k, 1 + D :].reshape(D, D) / count[k] * np.outer(scale, scale) - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / count.sum()
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / D, 1e-3) * np.eye(D)
        low = np.linalg.cholesky(c + 1e-9 * np.eye(D))
        factors.append(np.linalg.inv(low))
        constants.append(-np.log(np.diag(low)).sum() + np.log(count[k] / count.sum()))
    return Discriminant(scale, means, np.array(factors), np.array(constants))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.asarray(b.column(1).flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(K.lean(run), "doc_id long, score double")


def held_out():
    """Rows whose labels are never learned: crc32 of the id's decimals, mod 3, is 1.  A null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the ids that may be learned from: labelled 0 or 1 and not held out."""
    some = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    return some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).alias("quality"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Defined cases: null, empty and blank texts have zero statistics and are
    scored like any other; label rows without id or with a quality other than 0
    or 1 are left out; several labels of one id count as their rounded mean;
    repeated rows of docs are scored each (and, labelled, learned each); without
    any labels every score is 0.5.  Other columns of docs and labels are not read.
    """
    stats = stored(with_statistics(docs))
    model = fit(stats.join(learnable(labels), "doc_id"))
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs.

    Only labelled rows outside the held-out fold are measured to fit; then each text is
    measured once, scored where it is read.  Defined cases are those of classify().
    """
    known = learnable(labels)
    model = fit(with_statistics(docs, id_bitmap(known, "doc_id")).join(known, "doc_id"))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in K.parts(batch, at)):
            good = model.score(statistics(b.column(at).cast(pa.string()))) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(K.lean(run), schema)
