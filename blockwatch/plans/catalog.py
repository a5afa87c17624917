"""Query registry: one Spark builder and (where SQL can say it) one DuckDB oracle per key.

Builders take ``(spark, sf_dir)`` and return a DataFrame; they read the driver
tables (or views Spark derives from them) in full. Oracles are self-contained
DuckDB statements over the pre-registered tables. Column names, and value
shapes (arrays rendered as joined strings, floats rounded), match one to one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.plans.sqlviews import with_ctes

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Event times are TIMESTAMP_NTZ; epoch arithmetic and window rendering must
            # not depend on the caller's session zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---- shared output shaping -------------------------------------------------

def joined(arr: str | Column, sep: str = " ") -> Column:
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(c, sep)


def intervals_us(arr: str | Column) -> Column:
    """Interval seconds rendered as comma-joined integer microseconds (exact in both engines)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(c, lambda x: F.round(x * F.lit(1e6)).cast("bigint").cast("string")), ",")


def r6(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def block_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("block_id").cast("bigint").alias("block_id"), "status",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("first_pos").cast("bigint").alias("first_pos"),
        joined("event_list").alias("event_list"),
        intervals_us("event_intervals").alias("intervals_us"),
        "content")


BLOCK_SQL_COLS = ("block_id::BIGINT AS block_id, status, n_lines::BIGINT AS n_lines, "
                  "first_pos::BIGINT AS first_pos, array_to_string(event_list, ' ') AS event_list, "
                  "intervals_us, content")


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *ctes)


# Import the modules that register queries (side effect: fills QUERIES/ORACLES).
from blockwatch.plans import q_blocks, q_fusion, q_misc, q_rules, q_stream, q_templates  # noqa: E402,F401
