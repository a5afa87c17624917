"""F7, trained: word vectors from co-occurrence, by a distributed truncated SVD.

Words that stand within ``window`` tokens of each other in a line are counted as pairs; the counts
become positive pointwise mutual information, a sparse symmetric matrix M over the vocabulary; its
leading singular vectors are the word vectors. A block's vector is the mean over its tokens.

Pairs are counted by one aggregate with map-side partial sums, whatever the size of a block. The SVD
is randomised: M is multiplied with a thin matrix (dim + oversample columns) a few times. The products
run over blocks of M's rows in tasks; the thin matrix, vocabulary x columns, goes to every task and is
orthonormalised on the driver. Its size is bounded by ``max_vocab``, a parameter, as is that of the
result, and both are checked. Rows of M are summed in the order of their columns, so the result does
not depend on partitions; signs are fixed by each vector's largest entry.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwatch.functions.text import tokens
from blockwatch.session import ship_by_value, written

#: Words of the vocabulary, at most: the thin matrix then has max_vocab * (dim + OVERSAMPLE) doubles.
MAX_VOCAB = 20_000
WINDOW, DIM, OVERSAMPLE, POWER_STEPS, SEED = 4, 32, 10, 3, 42
#: Rows of M that are multiplied in one group.
ROW_BLOCK = 512


def vocabulary(lines: DataFrame, content_col: str = "content", min_count: int = 1, max_vocab: int = MAX_VOCAB) -> DataFrame:
    """term, idx, n: the ``max_vocab`` most frequent terms (ties by term), numbered from 0."""
    counted = lines.select(F.explode(tokens(content_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where(F.col("n") >= min_count).orderBy(F.desc("n"), "term").limit(max_vocab)
    # At most max_vocab rows: one small window numbers them.
    return top.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("idx"), "n")


def cooccurrence(lines: DataFrame, content_col: str = "content", window: int = WINDOW) -> DataFrame:
    """a, b, n: how often term b stands within ``window`` tokens of term a in a line, either side."""
    tok = lines.select(tokens(content_col).alias("t")).where(F.size("t") > 1)
    ahead = []
    for d in range(1, window + 1):
        left = F.slice(F.col("t"), F.lit(1), F.greatest(F.size("t") - d, F.lit(0)))
        right = F.slice(F.col("t"), F.lit(d + 1), F.greatest(F.size("t") - d, F.lit(0)))
        ahead.append(F.arrays_zip(left.alias("a"), right.alias("b")))
    pairs = tok.select(F.explode(F.concat(*ahead)).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return (pairs.select("n", F.explode(both).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .agg(F.sum("n").alias("n")))


def positive_pmi(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """i, j, value: max(0, ln(n_ab * N / (n_a * n_b))) over pairs of vocabulary terms, zeros left out."""
    ia, ib = (vocab.select(F.col("term").alias(c), F.col("idx").alias(i)) for c, i in (("a", "i"), ("b", "j")))
    known = written(pairs.join(ia, "a").join(ib, "b").select("i", "j", "n"), "pairs")
    rows = known.groupBy("i").agg(F.sum("n").alias("n_i"))
    total = known.select(F.sum("n")).scalar()
    cols = rows.select(F.col("i").alias("j"), F.col("n_i").alias("n_j"))
    pmi = F.log(F.col("n") * total.cast("double") / (F.col("n_i").cast("double") * F.col("n_j")))
    return known.join(rows, "i").join(cols, "j").select("i", "j", pmi.alias("value")).where(F.col("value") > 0)


def _times(matrix: DataFrame, thin: np.ndarray) -> np.ndarray:
    """matrix @ thin: blocks of rows in tasks, the products gathered (as many doubles as ``thin``)."""
    shared = matrix.sparkSession.sparkContext.broadcast(thin)

    def run(group: pa.Table) -> pa.Table:
        i, j, v = (group.column(c).to_numpy() for c in ("i", "j", "value"))
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        out = np.stack([(shared.value[j[a:b]] * v[a:b, None]).sum(axis=0) for a, b in zip(first, [*first[1:], len(i)], strict=True)])
        offsets = np.arange(len(first) + 1, dtype=np.int32) * out.shape[1]
        return pa.table({"i": pa.array(i[first], pa.int32()),
                         "y": pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))})

    block = F.call_function("div", F.col("i"), F.lit(ROW_BLOCK))
    got = matrix.withColumn("block", block).groupBy("block").applyInArrow(run, "i int, y array<double>").collect()
    out = np.zeros(thin.shape)
    for r in got:
        out[r["i"]] = r["y"]
    shared.unpersist()
    return out


def truncated_svd(matrix: DataFrame, n: int, dim: int = DIM, power_steps: int = POWER_STEPS,
                  seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Leading left singular vectors (n x at most dim) and values of the symmetric matrix (i, j, value)."""
    if n > MAX_VOCAB:
        raise ValueError(f"{n} rows are above the bound of {MAX_VOCAB}")
    if n == 0:
        return np.zeros((0, 0)), np.zeros(0)
    columns = min(n, dim + OVERSAMPLE)
    thin = np.random.default_rng(seed).standard_normal((n, columns))
    q, _ = np.linalg.qr(_times(matrix, thin))
    for _ in range(power_steps):
        q, _ = np.linalg.qr(_times(matrix, q))
    # q spans the leading space; M = q (M q)^T on it, so the SVD of the thin M q gives that of M.
    right, values, left = np.linalg.svd(_times(matrix, q), full_matrices=False)
    vectors = (q @ left.T)[:, :dim]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign), values[:dim]


def word_vectors(lines: DataFrame, content_col: str = "content", dim: int = DIM, window: int = WINDOW,
                 min_count: int = 1, max_vocab: int = MAX_VOCAB, seed: int = SEED) -> DataFrame:
    """term, vec (``dim`` doubles): singular vectors scaled by the roots of their values. Dimensions that
    the vocabulary has not are 0, as are terms without a companion."""
    spark = lines.sparkSession
    vocab = written(vocabulary(lines, content_col, min_count, max_vocab), "vocabulary")
    terms = [r["term"] for r in vocab.orderBy("idx").select("term").collect()]  # at most max_vocab
    matrix = written(positive_pmi(cooccurrence(lines, content_col, window), vocab), "pmi")
    vectors, values = truncated_svd(matrix, len(terms), dim, seed=seed)
    full = np.zeros((len(terms), dim))
    full[:, :vectors.shape[1]] = vectors * np.sqrt(values)
    return spark.createDataFrame([(t, v.tolist()) for t, v in zip(terms, full, strict=True)], "term string, vec array<double>")


def embed_blocks(lines: DataFrame, vectors: DataFrame, block_col: str = "block_id", content_col: str = "content",
                 dim: int = DIM, out_col: str = "embedding") -> DataFrame:
    """The mean vector of a block's tokens that have one, as ``dim`` sums reduced map-side; zeros without
    any. ``vectors`` has at most max_vocab rows and is broadcast."""
    counted = (lines.select(block_col, F.explode_outer(tokens(content_col)).alias("term"))
               .groupBy(block_col, "term").agg(F.count(F.lit(1)).alias("n")))
    both = counted.join(F.broadcast(vectors), "term", "left")
    hit = F.when(F.col("vec").isNotNull(), F.col("n")).otherwise(F.lit(0))
    sums = both.groupBy(block_col).agg(*[F.sum(F.col("vec")[j] * F.col("n")).alias(f"s{j}") for j in range(dim)], F.sum(hit).alias("hits"))

    def mean(j: int) -> Column:
        return F.when(F.col("hits") > 0, F.col(f"s{j}") / F.col("hits")).otherwise(F.lit(0.0))

    return sums.select(block_col, F.array(*[mean(j) for j in range(dim)]).alias(out_col))


# Python task bodies in this module travel with the task (see session.ship_by_value).
ship_by_value(__name__)
