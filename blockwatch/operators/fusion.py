"""Fused score, weight fit, threshold search, prediction.

Grid searches are one aggregation pass each: the 101 weight losses are summed up by weight
inside the tasks, so that one row a weight leaves each; for the 100 thresholds each score is put
into a bin, the bins are counted, and suffix sums over 101 rows give every threshold's
counts. The grid size is a parameter, never data-dependent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_DIGITS = 9
F1_DIGITS = 12


def fused_score(p: Column, e: Column, w: Column | float) -> Column:
    """W * p + (1 - w) * e (two softmax weights that sum to 1)."""
    wc = w if isinstance(w, Column) else F.lit(float(w))
    return wc * p + (F.lit(1.0) - wc) * e


def _clamped_log(x: Column) -> Column:
    return F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.log(x), F.lit(-100.0)))


def bce(s: Column, y: Column) -> Column:
    """Binary cross-entropy with PyTorch's log clamp at -100; s clipped to [0, 1]."""
    sc = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return -(y * _clamped_log(sc) + (F.lit(1.0) - y) * _clamped_log(F.lit(1.0) - sc))


def fit_fusion_weight(train: DataFrame, p_col: str, e_col: str, y_col: str,
                      steps: int = 100, sigmoid: bool = False) -> DataFrame:
    """The w in {0, 1/steps, ..., 1} minimising mean BCE(score, y) on ``train``.

    BCE is convex in w, so the grid minimum is the global optimum up to grid
    resolution. Ties (losses equal to 9 digits) go to the lowest w. One row out.
    """
    p, e, y = F.col(p_col), F.col(e_col), F.col(y_col).cast("double")

    # The grid meets each row inside the task and is summed up there, by weight.
    points = train.select(p.alias("p"), e.alias("e"), y.alias("y"),
                          F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("w"))
    score = fused_score(F.col("p"), F.col("e"), F.col("w"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) if sigmoid else score
    losses = points.select("w", "y", score.alias("s")).groupBy("w").agg(F.avg(bce(F.col("s"), F.col("y"))).alias("loss"))
    best = losses.agg(F.min(F.struct(F.round("loss", LOSS_DIGITS).alias("key"), "w", "loss")).alias("best"))
    return best.where("best.loss IS NOT NULL").select("best.w", "best.loss")


def threshold_grid_search(scored: DataFrame, score_col: str, y_col: str, n: int = 100,
                          positive: int = 1) -> DataFrame:
    """T5 + T6: thresholds min + i * (max - min) / (n - 1), i = 0..n-1, over the scores;
    predict positive iff score > t; keep the best F1 of the positive class (first
    strict improvement wins = lowest i among equal F1); F1 0 everywhere -> t = 0.
    """
    ends = scored.agg(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).first()
    lo, hi = F.lit(ends["lo"]).cast("double"), F.lit(ends["hi"]).cast("double")
    step = (hi - lo) / F.lit(float(n - 1))

    def at(i: Column) -> Column:
        return F.when(i == n - 1, hi).otherwise(lo + i * step)  # the last one is the maximum itself

    # Thresholds below a score: a first guess by division, settled by comparing with the thresholds.
    s = F.col(score_col)
    guess = F.least(F.greatest(F.coalesce(F.floor(F.try_divide(s - lo, step)), F.lit(0)) - 1, F.lit(0)), F.lit(n)).cast("int")
    below = guess
    for k in range(4):
        below = below + F.when((guess + k < n) & (at(guess + k) < s), 1).otherwise(0)
    y = F.when(F.col(y_col) == positive, 1).otherwise(0)
    bins = scored.select(below.alias("i"), y.alias("y")).groupBy("i").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # n + 1 rows from here. Scores with more than i thresholds below them are predicted positive at i.
    empty = scored.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    bins = bins.unionByName(empty).groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = bins.select(
        "i", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
        F.sum("pos").over(every).alias("all_pos")).where(F.col("i") < n)
    denom = F.col("tp") + F.col("fp") + F.col("all_pos")
    f1 = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0))
    best = (counts.withColumn("f1", f1).withColumn("threshold", at(F.col("i")))
            .orderBy(F.round("f1", F1_DIGITS).desc(), "i").limit(1))
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold"),
                       F.col("f1").alias("train_f1"))


def predict(df: DataFrame, score_col: str, threshold: Column, out_col: str = "pred") -> DataFrame:
    """1 (normal) iff score > threshold."""
    return df.withColumn(out_col, F.when(F.col(score_col) > threshold, F.lit(1)).otherwise(F.lit(0)))
