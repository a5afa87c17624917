"""Metrics and the classification report, from one grouped count.

Only the 2x2 (or n x n) confusion counts leave the data: the report is computed
from a table with one row per (label, prediction) pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Counts per (label, prediction); rows with a NULL on either side are excluded."""
    return (df.filter(F.col(label_col).isNotNull() & F.col(pred_col).isNotNull())
            .groupBy(F.col(label_col).alias("y"), F.col(pred_col).alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                   positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (1 = normal) in one pass."""
    y, p = F.col(label_col), F.col(pred_col)
    valid = df.filter(y.isNotNull() & p.isNotNull())
    c = valid.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("correct"),
        F.count_if((y == positive) & (p == positive)).alias("tp"),
        F.count_if((y != positive) & (p == positive)).alias("fp"),
        F.count_if((y == positive) & (p != positive)).alias("fn"))
    prec = _safe_div(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = _safe_div(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    f1 = _safe_div(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    return c.select(F.col("n").cast("bigint").alias("n"),
                    _safe_div(F.col("correct").cast("double"), F.col("n").cast("double")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                          classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages.

    Zero denominators give 0.0. Rows: '0', '1', 'accuracy', 'macro avg', 'weighted avg'.
    One aggregate produces every number; the rows are unpacked from it with ``inline``.
    """
    y, p = F.col(label_col), F.col(pred_col)
    valid = df.filter(y.isNotNull() & p.isNotNull())
    aggs = [F.count(F.lit(1)).alias("total")]
    for c in classes:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"),
                 F.count_if(p == c).alias(f"pn{c}"),
                 F.count_if(y == c).alias(f"sp{c}")]
    one = valid.agg(*aggs)
    cols = []
    for c in classes:
        tp, pn, sp = (F.col(f"{x}{c}").cast("double") for x in ("tp", "pn", "sp"))
        one = one.withColumn(f"p{c}", _safe_div(tp, pn)).withColumn(f"r{c}", _safe_div(tp, sp)) \
            .withColumn(f"f{c}", _safe_div(2.0 * tp, pn + sp))
        cols.append(c)
    n_cls = float(len(classes))
    tot_sup = sum((F.col(f"sp{c}") for c in classes), F.lit(0)).cast("double")

    def wavg(prefix):
        return _safe_div(sum((F.col(f"{prefix}{c}") * F.col(f"sp{c}") for c in classes), F.lit(0.0)), tot_sup)

    def mavg(prefix):
        return sum((F.col(f"{prefix}{c}") for c in classes), F.lit(0.0)) / F.lit(n_cls)

    total = F.col("total").cast("bigint")
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(str(c)).alias("row"), F.col(f"p{c}").alias("precision"),
                     F.col(f"r{c}").alias("recall"), F.col(f"f{c}").alias("f1_score"),
                     F.col(f"sp{c}").cast("bigint").alias("support")) for c in classes]
    accuracy = _safe_div(sum((F.col(f"tp{c}") for c in classes), F.lit(0)).cast("double"),
                         F.col("total").cast("double"))
    rows.append(F.struct(F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"),
                         accuracy.alias("f1_score"), total.alias("support")))
    rows.append(F.struct(F.lit("macro avg").alias("row"), mavg("p").alias("precision"),
                         mavg("r").alias("recall"), mavg("f").alias("f1_score"), total.alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("row"), wavg("p").alias("precision"),
                         wavg("r").alias("recall"), wavg("f").alias("f1_score"), total.alias("support")))
    return one.select(F.inline(F.array(*rows)))
