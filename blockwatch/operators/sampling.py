"""Labels, splits, class partitions, and capped stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_to_label(status: Column | str) -> Column:
    """E1: 'success' (any case) -> 1 normal, anything else -> 0 anomalous."""
    return F.when(F.lower(_c(status)) == "success", F.lit(1)).otherwise(F.lit(0))


def flip_label(label: Column | str) -> Column:
    """A 0 = normal label becomes 1 = normal."""
    return F.when(_c(label) == 0, F.lit(1)).otherwise(F.lit(0))


def sample_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order: md5('seed:id'). Independent of partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def capped_sample(df: DataFrame, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """E7 for one class: the first ``cap`` rows by (md5(seed:id), id), without replacement.

    The keys are uniform, so the first ``cap`` of n lie under about cap / n of their range.
    Rows under a bound with 20 % to spare are counted; if there are too few, the bound is
    widened. Only the rows under it meet in the final top-n, whatever the size of the class.
    """
    keyed = df.withColumn("_bw_key", sample_key(id_col, seed))
    n = keyed.count()
    share = min(1.0, (1.2 * cap + 100) / max(n, 1))
    while share < 1.0:
        near = keyed.filter(F.col("_bw_key") < f"{int(share * 2 ** 32):08x}")
        if near.count() >= cap:
            keyed = near
            break
        share = min(1.0, 2 * share)
    return keyed.orderBy("_bw_key", id_col).limit(int(cap)).drop("_bw_key")


def stratified_sample(df: DataFrame, id_col: str, label_col: str, caps: dict[int, int],
                      seed: int = 42) -> DataFrame:
    """E6 + E7: per class ``c`` (filter, no shuffle on the 2-valued label), keep up to
    ``caps[c]`` rows; the union is bounded by ``sum(caps)`` rows."""
    parts = [capped_sample(df.filter(F.col(label_col) == c), id_col, cap, seed)
             for c, cap in sorted(caps.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gather(sample_ids: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """Features of the sampled ids. The sample is bounded by its caps, so it is
    broadcast; the large side is never shuffled."""
    return features.join(F.broadcast(sample_ids.select(id_col).distinct()), id_col, "left_semi")


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
