"""Cosine top-k neighbours of each block among a bounded container.

The container (a capped sample: at most ``sum(caps)`` rows of dimension d) is
the only thing shipped to every task. It is cut into slices of at most
``max_broadcast_bytes``; the query rows pass through the slices one after the other in
narrow steps, carrying their k best so far, so the result is exact and the same
whatever the number of slices.

Scoring is a ``mapInArrow`` over the query rows: matrix products of at most
``QUERY_ROWS`` queries, top-k by (similarity rounded to 9 digits desc, container id
asc). Vectors come from Arrow buffers and neighbours go into them, ``QUERY_ROWS`` rows at a time, so a
worker's memory does not follow the rows of a batch. No pair rows are ever materialised and the query
side is never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIM_DIGITS = 9
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024
# Queries of one matrix product: with a 7,000-row container each temporary is 7 MB.
QUERY_ROWS = 128
# Columns of one group when the best are bounded by the maxima of groups.
GROUP = 32
# Slices that follow each other in one stage: each is a Python process of the task.
CHAIN = 2

NEIGHBOR_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("nbr_ids", T.ArrayType(T.LongType())),
    T.StructField("nbr_sims", T.ArrayType(T.DoubleType())),
    T.StructField("nbr_labels", T.ArrayType(T.IntegerType())),
])


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    out = np.zeros_like(m)
    nz = norms[:, 0] > 0
    out[nz] = m[nz] / norms[nz]
    return out


def _topk_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the top-k per row by (similarity rounded to 9 digits desc, id asc).

    ``ids`` must be ascending (the container is collected sorted by id), so a column's
    index is its id rank. Each (rounded similarity, id rank) pair becomes one exact
    int64 key, ``-round(sim * 1e9) * n + rank``; the k smallest keys are found with
    ``argpartition`` and ordered with a sort of k values: vectorised, ties exact.
    """
    n = sims.shape[1]
    k = min(k, n)
    best = _topk_of_few(sims, k)
    if best is not None:
        return best
    key = _rank_keys(sims, np.arange(n, dtype=np.int64)[None, :], n)
    if k < n:
        part = np.argpartition(key, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(n), key.shape).copy()
    order = np.argsort(np.take_along_axis(key, part, axis=1), axis=1)
    return np.take_along_axis(part, order, axis=1)


def _rank_keys(sims: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    return -np.rint(sims * 10.0 ** SIM_DIGITS).astype(np.int64) * np.int64(n) + columns


def _topk_of_few(sims: np.ndarray, k: int) -> np.ndarray | None:
    """The same from the few columns of a row that can be among its k best; None where they aren't few.

    The k-th largest of the maxima of groups of columns is a bound that at least k columns of the row
    reach, so a column below it by more than the rounding can't be among them.
    """
    rows, n = sims.shape
    groups = n // GROUP
    if groups < 2 * k:
        return None
    tops = sims[:, :groups * GROUP].reshape(rows, groups, GROUP).max(axis=2)
    bound = np.partition(tops, groups - k, axis=1)[:, groups - k] - 2 * 10.0 ** -SIM_DIGITS
    at = np.flatnonzero(sims >= bound[:, None])
    row, column = np.divmod(at, n)
    count = np.bincount(row, minlength=rows)
    if count.min() < k or len(at) > 8 * k * rows or count.max() > 64 * k:
        return None  # many ties, or values that can't be compared
    key = np.full((rows, count.max()), np.iinfo(np.int64).max)
    first = np.cumsum(count) - count
    key[row, np.arange(len(at)) - first[row]] = _rank_keys(sims.ravel()[at], column, n)
    key.sort(axis=1)
    return key[:, :k] % n


def best_of_slice(q: np.ndarray, own_ids: np.ndarray | None, ids: np.ndarray, cnorm: np.ndarray, k: int):
    """For up to ``QUERY_ROWS`` queries at a time: (rows, columns, similarities) of their best.

    With ``own_ids`` a query never meets the container row of its own id.
    """
    for i in range(0, len(q), QUERY_ROWS):
        sims = _normalize_rows(q[i:i + QUERY_ROWS]) @ cnorm.T
        if own_ids is not None:
            at = np.searchsorted(ids, own_ids[i:i + QUERY_ROWS])
            hit = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own_ids[i:i + QUERY_ROWS]))
            sims[hit, at[hit]] = -2.0  # below any cosine
        top = _topk_rows(sims, ids, k)
        yield i, top, np.take_along_axis(sims, top, axis=1)


def vector_rows(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as one matrix."""
    if column.null_count:
        raise ValueError("a row has no vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _padded(column: pa.Array, width: int, fill, dtype) -> np.ndarray:
    """A column of arrays of up to ``width`` items as one matrix."""
    size = pc.list_value_length(column).to_numpy()
    out = np.full((len(column), width), fill, dtype)
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _score_fn(bc, k: int, vec_col: str, exclude_self: bool):
    def score(batches):
        ids, labels, cmat = bc.value
        cnorm = _normalize_rows(cmat)
        last = np.iinfo(np.int64).max
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                own = part["query_id"].to_numpy() if exclude_self else None
                _, top, s = next(best_of_slice(vector_rows(part[vec_col]), own, ids, cnorm, k))
                n, y = ids[top], labels[top].astype(np.int32)
                width = pc.max(pc.list_value_length(part["nbr_ids"])).as_py()
                if width or exclude_self:
                    # The k best of those carried so far and of this slice; -2 is below any cosine.
                    n = np.concatenate([_padded(part["nbr_ids"], width, last, np.int64), np.where(s > -2.0, n, last)], axis=1)
                    s = np.concatenate([_padded(part["nbr_sims"], width, -2.0, np.float64), s], axis=1)
                    y = np.concatenate([_padded(part["nbr_labels"], width, 0, np.int32), y], axis=1)
                    order = np.lexsort((n, -np.rint(s * 10.0 ** SIM_DIGITS)), axis=1)[:, :k]
                    n, s, y = (np.take_along_axis(x, order, axis=1) for x in (n, s, y))
                real = (s > -2.0).sum(axis=1)
                kept = np.arange(s.shape[1])[None, :] < real[:, None]
                ends = pa.array(np.concatenate([[0], np.cumsum(real)]), pa.int32())
                found = {"nbr_ids": n, "nbr_sims": s, "nbr_labels": y}
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(ends, pa.array(found[f.name][kept], f.type.value_type), type=f.type) if f.name in found else part[f.name]
                    for f in part.schema], schema=part.schema)
    return score


def _collect_container(container: DataFrame, id_col: str, vec_col: str, label_col: str):
    """The bounded container as numpy arrays, sorted by id (see ``_topk_rows``)."""
    pdf = container.select(id_col, vec_col, label_col).toPandas().sort_values(id_col, kind="stable")
    ids = pdf[id_col].astype("int64").to_numpy()
    labels = pdf[label_col].astype("int64").to_numpy()
    mat = (np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
           if len(pdf) else np.zeros((0, 0)))
    return ids, labels, mat


def top_k_neighbors(queries: DataFrame, container: DataFrame, k: int, *, id_col: str = "block_id",
                    vec_col: str = "embedding", label_col: str = "label", container_id_col: str | None = None,
                    max_rows: int, max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                    exclude_self: bool = False) -> DataFrame:
    """G1 + G2: per query row, the top-k container rows as ordered arrays.

    ``max_rows`` is the proven bound on the container (the sum of its sample caps);
    a larger container is refused rather than silently broadcast. ``exclude_self`` leaves
    out the container row with the query's own id.
    """
    spark = queries.sparkSession
    cid = container_id_col or id_col
    # One small job: row count and vector width, to check the bound and cut the slices.
    stats = container.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    n_rows, dim = int(stats["n"]), int(stats["d"] or 0)
    if n_rows > max_rows:
        raise ValueError(f"container has {n_rows} rows, above its bound {max_rows}")
    if n_rows == 0:
        return spark.createDataFrame([], NEIGHBOR_SCHEMA)
    per_slice = max(1, max_broadcast_bytes // (max(dim, 1) * 8 + 16))
    q = queries.select(
        F.col(id_col).cast("bigint").alias("query_id"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.array().cast("array<bigint>").alias("nbr_ids"), F.array().cast("array<double>").alias("nbr_sims"),
        F.array().cast("array<int>").alias("nbr_labels"))
    ids, labels, cmat = _collect_container(container, cid, vec_col, label_col)
    for number, at in enumerate(range(0, n_rows, per_slice)):
        if number and number % CHAIN == 0:
            q = q.checkpoint(eager=True)
        part = slice(at, at + per_slice)
        bc = spark.sparkContext.broadcast((ids[part], labels[part], cmat[part]))
        q = q.mapInArrow(_score_fn(bc, k, "vec", exclude_self), q.schema)
    return q.drop("vec")


def neighbor_long(nbrs: DataFrame) -> DataFrame:
    """G2 long form: (query_id, rank, neighbor_id, similarity, label)."""
    z = nbrs.select("query_id", F.posexplode(F.arrays_zip("nbr_ids", "nbr_sims", "nbr_labels")).alias("i", "z"))
    return z.select("query_id", (F.col("i") + 1).alias("rank"), F.col("z.nbr_ids").alias("neighbor_id"),
                    F.col("z.nbr_sims").alias("similarity"), F.col("z.nbr_labels").alias("neighbor_label"))


def normal_probability(nbrs: DataFrame) -> DataFrame:
    """Mean label of the neighbours (probability of 'normal')."""
    mean = F.aggregate("nbr_labels", F.lit(0.0), lambda a, x: a + x) / F.size("nbr_labels")
    return nbrs.select("query_id", mean.alias("prob"))


def anomaly_percent(nbrs: DataFrame) -> DataFrame:
    """100 * (1 - mean neighbour label)."""
    mean = F.aggregate("nbr_labels", F.lit(0.0), lambda a, x: a + x) / F.size("nbr_labels")
    return nbrs.select("query_id", (F.lit(100.0) * (F.lit(1.0) - mean)).alias("score"))


def score_profile(nbrs: DataFrame) -> DataFrame:
    """G3 + G5 from one pass over the neighbours."""
    mean = F.aggregate("nbr_labels", F.lit(0.0), lambda a, x: a + x) / F.size("nbr_labels")
    return nbrs.select("query_id", mean.alias("prob"), F.sort_array("nbr_sims").alias("similarities"))


def similarity_profile(nbrs: DataFrame) -> DataFrame:
    """Neighbour similarities sorted ascending."""
    return nbrs.select("query_id", F.sort_array("nbr_sims").alias("similarities"))


# Python task bodies in this module travel with the task (see session.ship_by_value).
from blockwatch.session import ship_by_value  # noqa: E402

ship_by_value(__name__)

