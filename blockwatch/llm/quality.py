"""Quality classifier: regularised quadratic discriminant over document statistics.

``features`` turns each whole text into one vector of transformed statistics. ``fit`` sums, on
Spark, the count, mean and cross products of each class and shrinks the class covariances.
``score`` is the posterior of class 1 from the difference of the two Mahalanobis log densities,
using the Cholesky factors stored in the model.

Null texts count as empty. Null labels and labels other than 0 and 1 are left out; a doc_id with
several label rows counts once for each distinct label. Repeated documents are scored each. Where
a class has no labelled row, every score is 0.5 (an empty table gives an empty result).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import (
    byte_table, byte_view, lean, prefix_hash, query, row_slices, span_hash, table, words_of,
)

THRESHOLD = 0.3
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
POOL, RIDGE = 0.3, 0.05
#: Added to the denominators of shares, so that a text of a few words is not at an extreme.
SMOOTH = 10.0
#: Scores are the logistic of the log-density difference over this temperature.
TEMPERATURE = 4.0

NAMES = ("log_words", "word_len", "upper", "digit", "mark", "symbol", "bang", "bar", "word_variety",
         "line_variety", "line_len", "odd_words", "short_words", "echo")

_UPPER = byte_table(lambda b: 65 <= b <= 90)
_LOWER = byte_table(lambda b: 97 <= b <= 122)
_DIGIT = byte_table(lambda b: 48 <= b <= 57)
_MARK = byte_table(lambda b: chr(b) in ".,;:?'\"()-")
_SYMBOL = byte_table(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-!|")
_BANG = byte_table(lambda b: b == 33)
_BAR = byte_table(lambda b: b == 124)
_WORD = byte_table(lambda b: b > 32)
_LETTER = _UPPER | _LOWER | byte_table(lambda b: b >= 128)


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if len(h) == 0:
        return np.zeros(n)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    return np.bincount(rs[new], minlength=n)


def _counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of each row of a byte buffer."""
    n = len(off) - 1
    start, end, row = words_of(data, off, _WORD)
    prefix = prefix_hash(data)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    chars = np.maximum(_counts((data & 0xC0) != 0x80, off), 1)
    letters = np.maximum(_counts(_LETTER[data], off), 1)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data] | _BANG[data] | _BAR[data] | _DIGIT[data], out=marks[1:])
    odd = (marks[end] - marks[start]) > 0
    breaks = data == 10
    l_start, l_end, l_row = words_of(data, off, ~byte_table(lambda b: b == 10))
    lines = np.bincount(l_row, minlength=n).astype(float)
    distinct_lines = _distinct(span_hash(prefix, l_start, l_end), l_row, n)
    h = span_hash(prefix, start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    distinct_words = _distinct(h, row, n)
    share = lambda part, whole: np.sqrt(part / (whole + SMOOTH))
    return np.column_stack([
        np.log(words + SMOOTH),
        np.log1p(_per_row((end - start).astype(float), row, n) / some),
        share(_counts(_UPPER[data], off), letters),
        share(_counts(_DIGIT[data], off), chars),
        share(_counts(_MARK[data], off), chars),
        share(_counts(_SYMBOL[data], off), chars),
        share(_counts(_BANG[data], off), chars),
        share(_counts(_BAR[data], off), chars),
        np.log(distinct_words + SMOOTH) - np.log(words + SMOOTH),
        np.log(distinct_lines + 2) - np.log(lines + 2),
        np.log1p(chars / (_counts(breaks, off) + 1)),
        share(_per_row(odd.astype(float), row, n), some),
        share(_per_row((end - start <= 3).astype(float), row, n), some),
        share(_per_row(same.astype(float), row, n), some),
    ])


def _batch_statistics(col: pa.Array) -> np.ndarray:
    data, off = byte_view(col)
    parts = [statistics(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in row_slices(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its vector of statistics, for every row."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _batch_statistics(b.column(1))
            values = pa.array(x.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)],
                                             names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Model:
    """Of each class: mean, lower Cholesky factor of the covariance, its log determinant, log prior."""

    mean: tuple
    factor: tuple
    log_det: tuple
    prior: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 0.5)
        density = []
        for m, f, d, p in zip(self.mean, self.factor, self.log_det, self.prior, strict=True):
            z = np.linalg.solve(f, (x - m).T)
            density.append(p - 0.5 * (d + (z * z).sum(axis=0)))
        gap = np.clip((density[1] - density[0]) / TEMPERATURE, -700, 700)
        return 1 / (1 + np.exp(-gap))


def _class_sums(labelled: DataFrame) -> DataFrame:
    """Count, sums and cross products of each class: one row a class and partition, then one a class."""
    p = len(NAMES)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c, t in total.items():
                v = x[y == c]
                t += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_pydict({"c": pa.array([0, 1], pa.int32()),
                                          "s": pa.array([list(total[0]), list(total[1])], pa.list_(pa.float64()))})

    part = labelled.select("x", "label").mapInArrow(run, "c int, s array<double>")
    return (part.select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(feats: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled row that is not held out (class sums only reach the driver)."""
    own = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
           .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct())
    p, sums = len(NAMES), {0: np.zeros(1 + len(NAMES) * (1 + len(NAMES))), 1: None}
    sums[1] = sums[0].copy()
    for r in _class_sums(feats.join(own, "doc_id")).collect():
        sums[r["c"]][r["i"]] = r["v"]
    n = [sums[c][0] for c in (0, 1)]
    if min(n) < 2:
        return Model((), (), (), ())
    mean = [sums[c][1:p + 1] / n[c] for c in (0, 1)]
    cov = [sums[c][p + 1:].reshape(p, p) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    floor = np.diag(np.diag(pooled)) + 1e-4 * np.eye(p)
    factor = [np.linalg.cholesky((1 - POOL - RIDGE) * cov[c] + POOL * pooled + RIDGE * floor) for c in (0, 1)]
    return Model(tuple(mean), tuple(factor), tuple(2 * np.log(np.diag(f)).sum() for f in factor),
                 tuple(np.log(n[c] / sum(n)) for c in (0, 1)))


def score(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``features``."""
    p = len(NAMES)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return feats.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; no shuffle."""
    where = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(_batch_statistics(b.column(where))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op10_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The vectors are a few hundred bytes a document; fit and score both read the checkpoint.
    feats = features(table(spark, sf_dir, "documents")).checkpoint()
    model = fit(feats, table(spark, sf_dir, "labels"))
    return (score(feats, model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
