"""Log-shaped views derived from the driver tables (the V_* views of the survey).

``events`` plays the part of a structured log: one line per event, in event_id
order. Every view is a plain DataFrame expression over the parquet scan, so it
grows with the input and keeps pushdown/pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.operators.blocks import fixed_count_blocks, key_blocks, summarize_blocks
from blockwatch.operators.position import with_position
from blockwatch.session import written
from blockwatch.sources.tables import read_table


def lines(spark: SparkSession, sf_dir: str, with_pos: bool = True) -> DataFrame:
    """V_lines: line_no, ts, user_id, event_type, k, label ('-' normal / 'FAIL'),
    template_id (fine, <=500 values), coarse (20 values), content, [pos]."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    out = (ev.withColumn("k", k)
           .select(
               F.col("event_id").alias("line_no"), "ts", "user_id", "event_type", "k",
               F.when((F.col("event_type") == "error") & ((F.col("k") < 3) | (F.col("value") > 200)),
                      F.lit("FAIL")).otherwise(F.lit("-")).alias("label"),
               F.concat_ws(":", "event_type", F.col("k").cast("string")).alias("template_id"),
               F.concat_ws(":", "event_type", (F.col("k") / 25).cast("int").cast("string")).alias("coarse"),
               F.concat_ws(" ", "event_type", F.lit("user"), F.col("user_id").cast("string"),
                           F.lit("k"), F.col("k").cast("string")).alias("content")))
    if not with_pos:
        return out
    return written(with_position(out, ["ts", "line_no"]), "lines")  # several branches read it


# Fixed mapping used to render events as log levels.
LEVEL_OF_EVENT = {"error": "ERROR", "purchase": "WARN", "view": "DEBUG"}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_raw: lines rendered as '[-] yyyy-MM-dd HH:mm:ss,SSS [thread] LEVEL message'.

    k = 99 renders a stack-trace continuation line and k = 98 a FATAL line; the
    parser must reject both. Messages of k = 97 and 96 hold a next-line character and a line
    separator, and the marker of k = 94 a no-break space; the parser must keep all of them.
    """
    base = lines(spark, sf_dir, with_pos=False)
    level = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(l)) for e, l in LEVEL_OF_EVENT.items()],
                       F.lit("INFO"))
    level = F.when(F.col("k") == 98, F.lit("FATAL")).otherwise(level)
    blank = F.when(F.col("k") == 94, F.lit("\u00a0")).otherwise(F.lit(" "))
    marker = F.when(F.col("label") == "-", F.concat(F.lit("-"), blank)).otherwise(F.lit(""))
    tail = F.when(F.col("k") == 97, F.lit("\u0085tail")).when(F.col("k") == 96, F.lit("\u2028tail")).otherwise(F.lit(""))
    line = F.concat(marker, F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [user-"),
                    F.col("user_id").cast("string"), F.lit("] "), level, F.lit(" "), F.col("content"), tail)
    value = F.when(F.col("k") == 99, F.concat(F.lit("    at "), F.col("content"))).otherwise(line)
    return base.select("line_no", value.alias("value"))


def hdfs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the compact HDFS shape: Date yymmdd and Time HHMMSS as integers
    (leading zeros lost). Lines of odd users are dated 30 years earlier, so the
    two-digit-year pivot is exercised."""
    base = lines(spark, sf_dir, with_pos=False)
    shifted = F.when(F.col("user_id") % 2 == 1, F.add_months("ts", -360).cast("timestamp_ntz")) \
        .otherwise(F.col("ts"))
    return base.select("line_no",
                       F.date_format(shifted, "yyMMdd").cast("int").alias("date"),
                       F.date_format("ts", "HHmmss").cast("int").alias("time"),
                       F.when(F.col("k") == 98, F.lit("FATAL")).when(F.col("event_type") == "error", F.lit("ERROR"))
                       .otherwise(F.lit("INFO")).alias("level"), "label", "template_id")


def dotted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the supercomputer shape: Date 'yyyy.MM.dd', Time 'HH:mm:ss'; k = 97 has a bad time."""
    base = lines(spark, sf_dir, with_pos=False)
    time = F.when(F.col("k") == 97, F.lit("bad")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return base.select("line_no", F.date_format("ts", "yyyy.MM.dd").alias("date"),
                       time.alias("time"), "label", "template_id")


def blocks20_lines(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """Lines of V_lines with their fixed-count block id."""
    return fixed_count_blocks(lines(spark, sf_dir), size)


def blocks20(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """V_blocks20: fixed-count blocks of ``size`` lines with fine templates."""
    return summarize_blocks(blocks20_lines(spark, sf_dir, size), F.col("label") == "-")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of V_lines with their (user_id, date) session block id (ordered by first line)."""
    ln = lines(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return written(key_blocks(ln, ["user_id", "day"]), "session-lines")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_sessions: one block per (user_id, date) with coarse templates, ids by first line."""
    return summarize_blocks(session_lines(spark, sf_dir), F.col("label") == "-", template_col="coarse")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_vec: embeddings with a binary label (1 = normal when label >= 2)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                      F.when(F.col("label") >= 2, 1).otherwise(0).alias("label"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_text: documents with their quality label (documents without a label drop out)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return docs.join(lab, "doc_id")
