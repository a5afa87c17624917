"""Unsupervised pseudo labels from clustering.

k-means runs in Spark ML on the (capped) sample; centres are k x d and travel
as literals. Distances, the percentile filter, the majority relabel, and the
half split are aggregates and joins keyed on the row id.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwatch.operators.position import exact_percentile, with_position


def kmeans_clusters(df: DataFrame, vec_col: str = "embedding", k: int = 2, seed: int = 42,
                    out_col: str = "cluster") -> tuple[DataFrame, list[list[float]]]:
    """Spark ML k-means; returns rows with ``cluster`` and the centres."""
    model = KMeans(k=k, seed=seed, featuresCol="_bw_features", predictionCol=out_col).fit(
        df.withColumn("_bw_features", array_to_vector(vec_col)))
    out = model.transform(df.withColumn("_bw_features", array_to_vector(vec_col))).drop("_bw_features")
    return out, [list(map(float, c)) for c in model.clusterCenters()]


def label_mean_centres(df: DataFrame, vec_col: str, label_col: str) -> list[list[float]]:
    """Centres as the mean vector of each label (k rows of d values, collected)."""
    dim = df.select(F.max(F.size(vec_col))).first()[0]
    agg = df.groupBy(label_col).agg(*[F.avg(F.col(vec_col)[j]).alias(f"d{j}") for j in range(dim)])
    rows = {r[label_col]: [r[f"d{j}"] for j in range(dim)] for r in agg.collect()}
    return [rows[c] for c in sorted(rows)]


def _dist(vec: Column, centre: list[float]) -> Column:
    c = F.array(*[F.lit(float(x)) for x in centre])
    return F.sqrt(F.aggregate(F.zip_with(vec.cast("array<double>"), c, lambda a, b: (a - b) * (a - b)),
                              F.lit(0.0), lambda acc, x: acc + x))


def nearest_centre(df: DataFrame, centres: list[list[float]], vec_col: str = "embedding",
                   out_col: str = "cluster") -> DataFrame:
    """Assign the nearest centre (ties to the lower id)."""
    dists = [_dist(F.col(vec_col), c) for c in centres]
    best = F.lit(0)
    best_d = dists[0]
    for i, d in enumerate(dists[1:], start=1):
        best = F.when(d < best_d, F.lit(i)).otherwise(best)
        best_d = F.least(best_d, d)
    return df.withColumn(out_col, best)


def centre_distance(df: DataFrame, centres: list[list[float]], vec_col: str = "embedding",
                    cluster_col: str = "cluster", out_col: str = "distance") -> DataFrame:
    """Distance of each row to its own centre."""
    d = F.lit(None).cast("double")
    for i, c in enumerate(centres):
        d = F.when(F.col(cluster_col) == i, _dist(F.col(vec_col), c)).otherwise(d)
    return df.withColumn(out_col, d)


def percentile_filter(df: DataFrame, col: str, p: float = 70.0, id_col: str | None = None) -> DataFrame:
    """U4: keep rows strictly below the p-th percentile (exact, linear interpolation), found by radix
    selection; ``id_col`` is not needed for it."""
    t = exact_percentile(df, col, id_col, p)
    return df.filter(F.col(col) < F.lit(t))


def majority_relabel(df: DataFrame, cluster_col: str = "cluster", out_col: str = "pseudo_label") -> DataFrame:
    """The larger cluster is normal (1), the others anomalous (0); ties to the lower id."""
    counts = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_bw_n"))
    top = counts.orderBy(F.col("_bw_n").desc(), F.col(cluster_col)).limit(1) \
        .select(F.col(cluster_col).alias("_bw_major"))
    major = top.select("_bw_major").scalar()
    return df.withColumn(out_col, F.when(F.col(cluster_col) == major, F.lit(1)).otherwise(F.lit(0)))


def overwrite_labels(df: DataFrame, pseudo: DataFrame, id_col: str, label_col: str = "label",
                     pseudo_col: str = "pseudo_label", out_col: str = "final_label") -> DataFrame:
    """The pseudo label where one exists, else the original label (kept as its own column)."""
    return (df.join(pseudo.select(id_col, pseudo_col), id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(pseudo_col), F.col(label_col))))


def half_split_by_class(df: DataFrame, id_col: str, class_col: str, out_col: str = "role") -> DataFrame:
    """Per class, the first floor(n_c / 2) rows by id go to the container, the rest to tuning.

    Rows are numbered in (class, id) order with ``with_position`` and compared with
    the start of their class (a table with one row per class).
    """
    numbered = with_position(df, [class_col, id_col], name="_bw_cp")
    stats = numbered.groupBy(class_col).agg(F.min("_bw_cp").alias("_bw_start"), F.count(F.lit(1)).alias("_bw_n"))
    out = numbered.join(F.broadcast(stats), class_col)
    first_half = (F.col("_bw_cp") - F.col("_bw_start")) < F.floor(F.col("_bw_n") * F.lit(0.5))
    return (out.withColumn(out_col, F.when(first_half, F.lit("container")).otherwise(F.lit("tuning")))
            .drop("_bw_cp", "_bw_start", "_bw_n"))
