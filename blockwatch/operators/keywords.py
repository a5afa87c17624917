"""K1-K4: keyword labels and their agreement with real labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwatch.functions.text import GOOD_WORDS, NEGATIVE_WORDS, keyword_score


def keyword_labels(blocks: DataFrame, content_col: str = "content", negative=NEGATIVE_WORDS,
                   good=GOOD_WORDS) -> DataFrame:
    """K1 + K2: ``kw_score`` and ``kw_label`` (1 normal when the score is exactly 0;
    any non-zero score, negative too, is anomalous)."""
    score = keyword_score(content_col, negative, good)
    return (blocks.withColumn("kw_score", score)
            .withColumn("kw_label", F.when(F.col("kw_score") == 0, F.lit(1)).otherwise(F.lit(0))))


def dedupe_last_wins(df: DataFrame, key_col: str, value_col: str, order_col: str) -> DataFrame:
    """K3: one row per key with the value of its last row (by ``order_col``).

    ``max_by`` is a partial aggregate: a hot key is reduced map-side, never gathered.
    """
    return df.groupBy(key_col).agg(F.max_by(value_col, order_col).alias(value_col))


def label_agreement(df: DataFrame, fake_col: str, real_col: str,
                    classes: tuple[int, ...] = (1, 0)) -> DataFrame:
    """K4: per class c, |fake = c and real = c| / |real = c| (0 when the class is empty)."""
    aggs = []
    for c in classes:
        aggs += [F.count_if(F.col(real_col) == c).alias(f"real{c}"),
                 F.count_if((F.col(real_col) == c) & (F.col(fake_col) == c)).alias(f"agree{c}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("class"), F.col(f"real{c}").cast("bigint").alias("n_real"),
                     F.col(f"agree{c}").cast("bigint").alias("n_agree"),
                     F.when(F.col(f"real{c}") > 0, F.col(f"agree{c}") / F.col(f"real{c}"))
                     .otherwise(F.lit(0.0)).alias("accuracy")) for c in classes]
    return one.select(F.inline(F.array(*rows)))


def keyword_labelling(blocks: DataFrame, tail_ratio: float = 0.8, negative=NEGATIVE_WORDS,
                      good=GOOD_WORDS) -> DataFrame:
    """P5: keyword labels on the tail slice (block position >= floor(n * ratio)) and their
    per-class agreement with the status labels."""
    from blockwatch.operators.position import tail_slice
    from blockwatch.operators.sampling import status_to_label
    tail = tail_slice(blocks.withColumn("_bw_bpos", F.col("block_id") - 1), "_bw_bpos", tail_ratio)
    lab = keyword_labels(tail, negative=negative, good=good).withColumn("label", status_to_label("status"))
    return label_agreement(lab, "kw_label", "label")




def keyword_labels_from_lines(lines: DataFrame, block_col: str = "block_id", content_col: str = "content",
                              negative=NEGATIVE_WORDS, good=GOOD_WORDS) -> DataFrame:
    """K1 + K2 from lines: a block's content is its lines joined by ' | ', and '|' splits
    segments, so the block score is the sum of per-line scores - a partial aggregate,
    with no block gathered into one string."""
    per_line = lines.select(block_col, keyword_score(content_col, negative, good).alias("_bw_k"))
    return (per_line.groupBy(block_col).agg(F.sum("_bw_k").cast("int").alias("kw_score"))
            .withColumn("kw_label", F.when(F.col("kw_score") == 0, F.lit(1)).otherwise(F.lit(0))))


def keyword_labelling_blocks(scored: DataFrame, tail_ratio: float = 0.8) -> DataFrame:
    """P5 on blocks already scored (block_id, status, kw_label): tail slice and agreement."""
    from blockwatch.operators.position import tail_slice
    from blockwatch.operators.sampling import status_to_label
    tail = tail_slice(scored.withColumn("_bw_bpos", F.col("block_id") - 1), "_bw_bpos", tail_ratio)
    return label_agreement(tail.withColumn("label", status_to_label("status")), "kw_label", "label")
