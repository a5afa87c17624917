"""Template-set rules and the verdict cascade.

Sets are DataFrames (one row per template / sequence), tests are semi and anti
joins on exploded lists, so nothing here depends on a set fitting in memory.
The container the sets come from is capped, which bounds all three sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ_SEP = "\u0001"


def _exploded(blocks: DataFrame, id_col: str, list_col: str) -> DataFrame:
    return blocks.select(id_col, F.explode(list_col).alias("template"))


def normal_template_set(container: DataFrame, list_col: str = "event_list",
                        label_col: str = "label") -> DataFrame:
    """Distinct templates of the normal container blocks."""
    return (container.filter(F.col(label_col) == 1)
            .select(F.explode(list_col).alias("template")).distinct())


def _remainders(container: DataFrame, normal_set: DataFrame, id_col: str, list_col: str,
                label_col: str) -> DataFrame:
    anomalous = container.filter(F.col(label_col) == 0)
    return (_exploded(anomalous, id_col, list_col).distinct()
            .join(normal_set, "template", "left_anti"))


def abnormal_template_set(container: DataFrame, normal_set: DataFrame, id_col: str = "block_id",
                          list_col: str = "event_list", label_col: str = "label") -> DataFrame:
    """R2: for each anomalous container block, its templates outside the normal set;
    when exactly one remains, that template is abnormal."""
    rem = _remainders(container, normal_set, id_col, list_col, label_col)
    single = (rem.groupBy(id_col).agg(F.count(F.lit(1)).alias("_bw_n"), F.min("template").alias("template"))
              .filter(F.col("_bw_n") == 1))
    return single.select("template").distinct()


def known_bad_sequences(container: DataFrame, normal_set: DataFrame, id_col: str = "block_id",
                        list_col: str = "event_list", label_col: str = "label") -> DataFrame:
    """Event lists of anomalous container blocks whose templates are all normal
    (an empty list qualifies)."""
    rem = _remainders(container, normal_set, id_col, list_col, label_col).select(id_col).distinct()
    anomalous = container.filter(F.col(label_col) == 0)
    return (anomalous.join(rem, id_col, "left_anti")
            .select(F.col(list_col).alias("event_list")).distinct())


def sequence_key(list_col: str | Column) -> Column:
    c = F.col(list_col) if isinstance(list_col, str) else list_col
    return F.concat(F.lit("["), F.array_join(c, SEQ_SEP), F.lit("]"))


def percentile_threshold(scores: DataFrame, score_col: str, p: float) -> Column:
    """Exact percentile with linear interpolation (numpy's default), p in [0, 100].

    Neighbour scores take at most k + 1 distinct values (multiples of 100 / k), so the
    built-in aggregate's value map is bounded; for continuous values use
    ``position.exact_percentile`` (radix selection, distributed).
    """
    return scores.select(F.percentile(F.col(score_col), F.lit(p / 100.0))).scalar()


def score_flag(score: Column, threshold: Column, inclusive: bool = True) -> Column:
    """Score reaches the threshold (``>=``) or exceeds it (``>``)."""
    return score >= threshold if inclusive else score > threshold


def verdict_cascade(blocks: DataFrame, normal_set: DataFrame, abnormal_set: DataFrame,
                    bad_sequences: DataFrame, threshold: Column, *, id_col: str = "block_id",
                    list_col: str = "event_list", score_col: str = "score",
                    inclusive: bool = True) -> DataFrame:
    """First match wins.

    known bad sequence -> 0; any abnormal template -> 0; score passes threshold -> 0;
    all templates normal -> 1; otherwise -> 1. A NULL list is kept with a NULL verdict.
    Adds ``verdict`` and ``reason``.
    """
    ex = _exploded(blocks.filter(F.col(list_col).isNotNull()), id_col, list_col)
    bad_tpl = (ex.join(abnormal_set, "template", "left_semi").select(id_col).distinct()
               .withColumn("_bw_bad_tpl", F.lit(True)))
    unknown = (ex.join(normal_set, "template", "left_anti").select(id_col).distinct()
               .withColumn("_bw_unknown", F.lit(True)))
    bad_seq = (bad_sequences.select(sequence_key("event_list").alias("_bw_seq")).distinct()
               .withColumn("_bw_bad_seq", F.lit(True)))
    b = (blocks.withColumn("_bw_seq", sequence_key(list_col))
         .join(bad_seq, "_bw_seq", "left")
         .join(bad_tpl, id_col, "left")
         .join(unknown, id_col, "left"))
    passes = F.coalesce(score_flag(F.col(score_col), threshold, inclusive), F.lit(False))
    is_null = F.col(list_col).isNull()
    reason = (F.when(is_null, F.lit("unparseable"))
              .when(F.coalesce("_bw_bad_seq", F.lit(False)), F.lit("bad_sequence"))
              .when(F.coalesce("_bw_bad_tpl", F.lit(False)), F.lit("bad_template"))
              .when(passes, F.lit("score"))
              .when(~F.coalesce("_bw_unknown", F.lit(False)), F.lit("all_normal"))
              .otherwise(F.lit("default")))
    verdict = (F.when(F.col("reason") == "unparseable", F.lit(None).cast("int"))
               .when(F.col("reason").isin("bad_sequence", "bad_template", "score"), F.lit(0))
               .otherwise(F.lit(1)))
    return (b.withColumn("reason", reason).withColumn("verdict", verdict)
            .drop("_bw_seq", "_bw_bad_seq", "_bw_bad_tpl", "_bw_unknown"))


# ---- line-level forms: no block is ever gathered into one row ---------------------------------

def _member_lines(lines: DataFrame, blocks: DataFrame, block_col: str) -> DataFrame:
    """Lines of a bounded set of blocks (the capped container): broadcast semi join."""
    return lines.join(F.broadcast(blocks.select(block_col)), block_col, "left_semi")


def normal_set_from_lines(container: DataFrame, lines: DataFrame, block_col: str = "block_id",
                          label_col: str = "label", template_col: str = "template") -> DataFrame:
    """R1 from lines: distinct templates of the normal container blocks."""
    normal_blocks = container.filter(F.col(label_col) == 1)
    return (_member_lines(lines, normal_blocks, block_col)
            .select(F.col(template_col).alias("template")).distinct())


def _remainders_from_lines(container: DataFrame, lines: DataFrame, normal_set: DataFrame,
                           block_col: str, label_col: str, template_col: str) -> DataFrame:
    anomalous = container.filter(F.col(label_col) == 0)
    return (_member_lines(lines, anomalous, block_col)
            .select(block_col, F.col(template_col).alias("template")).distinct()
            .join(normal_set, "template", "left_anti"))


def abnormal_set_from_lines(container: DataFrame, lines: DataFrame, normal_set: DataFrame,
                            block_col: str = "block_id", label_col: str = "label",
                            template_col: str = "template") -> DataFrame:
    """R2 from lines: a template is abnormal when it is the only non-normal template
    of an anomalous container block."""
    rem = _remainders_from_lines(container, lines, normal_set, block_col, label_col, template_col)
    single = (rem.groupBy(block_col).agg(F.count(F.lit(1)).alias("_bw_n"), F.min("template").alias("template"))
              .filter(F.col("_bw_n") == 1))
    return single.select("template").distinct()


def bad_blocks_from_lines(container: DataFrame, lines: DataFrame, normal_set: DataFrame,
                          block_col: str = "block_id", label_col: str = "label",
                          template_col: str = "template") -> DataFrame:
    """R3 from lines: anomalous container blocks whose templates are all normal."""
    rem = _remainders_from_lines(container, lines, normal_set, block_col, label_col, template_col)
    anomalous = container.filter(F.col(label_col) == 0).select(block_col)
    return anomalous.join(rem.select(block_col).distinct(), block_col, "left_anti")


def block_facts(lines: DataFrame, normal_set: DataFrame, abnormal_set: DataFrame, block_col: str = "block_id",
                template_col: str = "template") -> DataFrame:
    """Of each block, from one grouping of its lines: number of lines, whether it has an abnormal
    template, and whether it has one outside the normal set.

    Lines are reduced to distinct (block, template) with counts before they meet the flags; the
    flags have a row for each template of the capped container.
    """
    flags = (normal_set.select("template", F.lit(True).alias("_bw_normal"))
             .join(abnormal_set.select("template", F.lit(True).alias("_bw_abnormal")), "template", "full"))
    each = lines.groupBy(block_col, F.col(template_col).alias("template")).agg(F.count(F.lit(1)).alias("_bw_n"))
    return (each.join(flags, "template", "left").groupBy(block_col).agg(
        F.sum("_bw_n").alias("_bw_lines"), F.bool_or(F.coalesce("_bw_abnormal", F.lit(False))).alias("_bw_bad_tpl"),
        F.bool_or(F.col("_bw_normal").isNull()).alias("_bw_unknown")))


def blocks_with_sequence(lines: DataFrame, facts: DataFrame, bad_lists: DataFrame, block_col: str = "block_id",
                         pos_col: str = "pos", template_col: str = "template") -> DataFrame:
    """The blocks whose ordered templates equal one of ``bad_lists`` (column ``event_list``).

    A known bad sequence has normal templates only and one of a few lengths, so most blocks are
    ruled out by their facts; the lists of the others are gathered (none is longer than the
    longest bad sequence) and compared item by item.
    """
    lengths = bad_lists.select(F.size("event_list").cast("bigint").alias("_bw_lines")).distinct()
    near = facts.filter(~F.col("_bw_unknown")).join(lengths, "_bw_lines", "left_semi").select(block_col)
    lists = (lines.join(near, block_col, "left_semi").groupBy(block_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(template_col).alias("t"))))["t"]
        .alias("event_list")))
    return lists.join(bad_lists.select("event_list").distinct(), "event_list", "left_semi").select(block_col)


def verdicts_from_lines(blocks: DataFrame, lines: DataFrame, normal_set: DataFrame, abnormal_set: DataFrame,
                        bad_lists: DataFrame, threshold: Column, *, block_col: str = "block_id",
                        score_col: str = "score", inclusive: bool = True) -> DataFrame:
    """R4, R5, R8, R9 with every test computed from lines: same first-match-wins
    cascade as ``verdict_cascade``."""
    tl = lines.join(blocks.select(block_col), block_col, "left_semi")
    facts = block_facts(tl, normal_set, abnormal_set, block_col).checkpoint(eager=True)  # a row a block, read twice
    bad_seq = blocks_with_sequence(tl, facts, bad_lists, block_col).withColumn("_bw_bad_seq", F.lit(True))
    b = blocks.join(facts.drop("_bw_lines"), block_col, "left").join(bad_seq, block_col, "left")
    passes = F.coalesce(score_flag(F.col(score_col), threshold, inclusive), F.lit(False))
    reason = (F.when(F.coalesce("_bw_bad_seq", F.lit(False)), F.lit("bad_sequence"))
              .when(F.coalesce("_bw_bad_tpl", F.lit(False)), F.lit("bad_template"))
              .when(passes, F.lit("score"))
              .when(~F.coalesce("_bw_unknown", F.lit(False)), F.lit("all_normal"))
              .otherwise(F.lit("default")))
    verdict = F.when(F.col("reason").isin("bad_sequence", "bad_template", "score"), F.lit(0)).otherwise(F.lit(1))
    return (b.withColumn("reason", reason).withColumn("verdict", verdict)
            .drop("_bw_bad_seq", "_bw_bad_tpl", "_bw_unknown"))
