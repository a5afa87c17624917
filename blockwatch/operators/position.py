"""Global row positions and positional splits.

A DataFrame has no order, so every positional operation of the log model
(fixed-count blocks, head/tail splits) goes through an explicit order key.

``with_position`` numbers rows 0..n-1 by a total (unique) order without moving
all rows to one task and without materialising anything:

1. range bounds for the order key come from one seeded sample and are embedded
   in the plan as one literal array; each row's bucket is a pure function of its key
   (a binary search in that array, log2(buckets) comparisons per row);
2. rows are numbered inside their bucket (``row_number`` over a window
   partitioned by bucket: sort-based, spills, one bucket per task);
3. each bucket is shifted by the row count of all earlier buckets, from a count
   table with one row per bucket (the only thing broadcast).

Because the bucket is a function of the key, every branch of the plan and every
re-execution after a lost executor agrees on it. Because the key is unique,
quantile buckets are balanced even when one timestamp, user, or session holds a
large share of the rows.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwatch.session import written

# Rows meant for one bucket (a bucket is sorted by one task, and spills) and the fewest buckets (so
# that small inputs run the same plan). The bounds are one literal of the plan: a bucket in 2 million rows.
ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 8
SAMPLES_PER_BUCKET = 32
#: Rows of the first sample, one of each class of a hash.
FIRST_SAMPLE = 1024


def _sortable(df: DataFrame, name: str) -> Column:
    """An expression that orders like ``name`` and has a plain literal type."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(col)
    return col


def _with_bounds_below(df: DataFrame, bounds: list[tuple], key_type: T.StructType, key: Column, name: str) -> DataFrame:
    """Add ``name`` = number of bounds <= key, by binary search in one literal array of structs.

    Each halving is a projection of its own, so that all of them are compiled and each is taken once a
    row; the number is never NULL, so a join on it infers no filter that would search once more.
    """
    text = json.dumps([dict(zip(key_type.fieldNames(), b)) for b in bounds])
    array = F.from_json(F.lit(text), T.ArrayType(key_type))
    out = df.withColumn("_bw_bkey", key).withColumn(name, F.lit(0))
    for step in (2 ** i for i in reversed(range(len(bounds).bit_length()))):
        # The bound ``step`` places on, if there is one (a place outside the array is NULL).
        below = F.get(array, F.col(name) + (step - 1)) <= F.col("_bw_bkey")
        out = out.withColumn(name, F.col(name) + F.when(below, F.lit(step)).otherwise(F.lit(0)))
    return out.drop("_bw_bkey")


def bucketed(df: DataFrame, order_cols: list[str], num_buckets: int | None = None, seed: int = 7,
             name: str = "_bw_bucket") -> DataFrame:
    """Add ``name``: the range bucket of the (unique) order key, a deterministic function of the key.

    The number of buckets follows the number of rows, not the cluster; the bounds come from one
    seeded sample. Inputs of every size take this path.
    """
    keys = [_sortable(df, c).alias(f"k{i}") for i, c in enumerate(order_cols)]
    key_df = df.select(*keys)
    # One pass counts the rows and draws one row from each class of a hash, which is enough for few buckets.
    drawn = key_df.groupBy(F.pmod(F.xxhash64(*[f"k{i}" for i in range(len(keys))], F.lit(seed)), F.lit(FIRST_SAMPLE)).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*key_df.columns), F.xxhash64(*key_df.columns)).alias("k")).collect()
    n_rows = sum(r["n"] for r in drawn)
    n = num_buckets or max(MIN_BUCKETS, -(-n_rows // ROWS_PER_BUCKET))
    if n * SAMPLES_PER_BUCKET <= FIRST_SAMPLE:
        sample = sorted(tuple(r["k"]) for r in drawn)
    else:
        fraction = min(1.0, n * SAMPLES_PER_BUCKET / max(n_rows, 1))
        sample = sorted(tuple(r) for r in key_df.sample(False, fraction, seed).collect())
    bounds: list[tuple] = []
    for i in range(1, n):
        b = sample[(i * len(sample)) // n] if sample else None
        if b is not None and (not bounds or b > bounds[-1]):
            bounds.append(b)
    return _with_bounds_below(df, bounds, key_df.schema, F.struct(*keys), name)


def _offsets(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` over ``key`` (a table with one row per bucket)."""
    return counts.select(key, F.coalesce(F.sum(value).over(
        Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(out))


def with_position(df: DataFrame, order_cols: list[str], name: str = "pos",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank of each row under ``order_cols`` (unique, non-null)."""
    b = bucketed(df, order_cols, num_partitions)
    counts = b.groupBy("_bw_bucket").agg(F.count(F.lit(1)).alias("_bw_n"))
    offsets = _offsets(counts, "_bw_bucket", "_bw_n", "_bw_off")
    w = Window.partitionBy("_bw_bucket").orderBy(*order_cols)
    numbered = b.withColumn("_bw_rn", F.row_number().over(w))
    return (numbered.join(F.broadcast(offsets), "_bw_bucket")
            .withColumn(name, (F.col("_bw_off") + F.col("_bw_rn") - 1).cast("bigint"))
            .drop("_bw_bucket", "_bw_rn", "_bw_off"))


def forward_fill(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """Carry the last non-null ``value_col`` forward in global ``order_col`` order
    (``value_col`` non-decreasing where set): filled inside each bucket, and each
    bucket's leading gap filled from the largest value of earlier buckets."""
    b = bucketed(df, [order_col])
    w = Window.partitionBy("_bw_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_bw_ff", F.last(value_col, ignorenulls=True).over(w))
    tails = b.groupBy("_bw_bucket").agg(F.max(value_col).alias("_bw_tail"))
    carry = tails.select("_bw_bucket", F.max("_bw_tail").over(
        Window.orderBy("_bw_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_bw_carry"))
    return (local.join(F.broadcast(carry), "_bw_bucket")
            .withColumn(value_col, F.coalesce("_bw_ff", "_bw_carry"))
            .drop("_bw_bucket", "_bw_ff", "_bw_carry"))


def row_count(df: DataFrame) -> Column:
    """Scalar subquery with the row count; stays inside the plan (no driver round trip)."""
    return df.select(F.count(F.lit(1))).scalar()


def split_positional(df: DataFrame, pos_col: str, ratio: float,
                     split_col: str = "split") -> DataFrame:
    """The first ``floor(n * ratio)`` positions are 'train', the rest 'test'.

    ``pos_col`` must be a dense 0-based position (or a dense 1-based id minus 1).
    """
    cut = F.floor(row_count(df) * F.lit(float(ratio)))
    return df.withColumn(split_col, F.when(F.col(pos_col) < cut, F.lit("train"))
                         .otherwise(F.lit("test")))


def tail_slice(df: DataFrame, pos_col: str, ratio: float) -> DataFrame:
    """E5: rows at positions ``>= floor(n * ratio)``."""
    cut = F.floor(row_count(df) * F.lit(float(ratio)))
    return df.filter(F.col(pos_col) >= cut)


def split_hash(df: DataFrame, id_col: str, ratio: float, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """Reproducible random split; order by md5(seed:id) and cut at floor(n*ratio).

    The hash order is independent of partitioning (``randomSplit`` is not).
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    ranked = with_position(df.withColumn("_bw_h", key), ["_bw_h", id_col], name="_bw_hpos")
    cut = F.floor(row_count(df) * F.lit(float(ratio)))
    return (ranked.withColumn(split_col, F.when(F.col("_bw_hpos") < cut, F.lit("train"))
                              .otherwise(F.lit("test")))
            .drop("_bw_h", "_bw_hpos"))


#: Bits of one pass of a radix selection: its histogram has at most 2 ** RADIX_BITS rows for each rank.
RADIX_BITS = 16


def ordered_bits(value: Column) -> Column:
    """A double as a long that orders like it (negatives by their flipped bits; NaN above infinity)."""
    known = F.coalesce(value.cast("double"), F.lit(0.0))  # the method takes no null
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), known).cast("bigint")
    return F.when(value.isNull(), F.lit(None)).when(bits < 0, bits.bitwiseXOR(F.lit(2 ** 63 - 1))).otherwise(bits)


def _double_of(bits: int) -> float:
    return struct.unpack(">d", struct.pack(">q", bits if bits >= 0 else bits ^ (2 ** 63 - 1)))[0]


def order_statistics(df: DataFrame, value_col: str, ranks: Callable[[int], list[int]]) -> list[float]:
    """The values of rank ``ranks(n)`` (from 0, ascending, repeats counted) among the n non-null values,
    by radix selection: nothing is sorted or numbered.

    Each pass is one histogram of the next RADIX_BITS of the ordered bits, over the values that share
    the bits found so far with a wanted value; it tells the bin of each wanted rank. A bin with one
    distinct value ends the search, so few-valued columns take one pass and no column more than four.
    What reaches the driver is a histogram, of a size that does not depend on the data.
    """
    keys = written(df.select(ordered_bits(F.col(value_col)).alias("key")).where(F.col("key").isNotNull()), "ordered-bits")
    wanted: dict[int, tuple[int | None, int]] = {}  # rank -> (bits found so far, rank among their values)
    found: dict[int, int] = {}
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        prefix = sorted({p for p, _ in wanted.values()}) if wanted else None
        part = keys if prefix is None else keys.where(F.shiftright("key", shift + RADIX_BITS).isin(prefix))
        bins = (part.groupBy(F.shiftright("key", shift).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        bins = sorted(bins, key=lambda r: r["bin"])
        if not wanted and not found:
            total = sum(r["n"] for r in bins)
            if total == 0:
                return []
            wanted = {r: (None, r) for r in ranks(total)}
        left = {}
        for rank, (p, within) in wanted.items():
            for r in bins:
                if p is not None and r["bin"] >> RADIX_BITS != p:
                    continue
                if within < r["n"]:
                    if r["low"] == r["high"]:
                        found[rank] = r["low"]
                    else:
                        left[rank] = (r["bin"], within)
                    break
                within -= r["n"]
        wanted = left
        if not wanted:
            break
    return [_double_of(found[r]) for r in sorted(found)]


def exact_percentile(df: DataFrame, value_col: str, id_col: str | None, p: float) -> float | None:
    """Exact percentile with linear interpolation (numpy's default), p in [0, 100], of the
    non-null values; None without any. By radix selection, for any number of distinct values (a row id
    is not needed; ``id_col`` is read by nothing)."""
    place: dict[str, float] = {}

    def ranks(n: int) -> list[int]:
        place["at"] = (p / 100.0) * (n - 1)
        return sorted({math.floor(place["at"]), math.ceil(place["at"])})

    got = order_statistics(df, value_col, ranks)
    if not got:
        return None
    low, high, part = got[0], got[-1], place["at"] - math.floor(place["at"])
    if low == high or part == 0:
        return low
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def previous_values(df: DataFrame, order_cols: list[str], value_cols: list[str],
                    prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row in the global (unique)
    ``order_cols`` order (NULL for the first row).

    Inside each range bucket this is ``lag``; the first row of a bucket takes the last
    row of the previous non-empty bucket, from a table with one row per bucket.
    """
    b = bucketed(df, order_cols)
    w = Window.partitionBy("_bw_bucket").orderBy(*order_cols)
    for c in value_cols:
        b = b.withColumn(prefix + c, F.lag(c).over(w))
    last = b.groupBy("_bw_bucket").agg(
        F.max_by(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(value_cols)]),
                 F.struct(*order_cols)).alias("_bw_last"))
    prev_last = last.select("_bw_bucket", F.lag("_bw_last").over(Window.orderBy("_bw_bucket")).alias("_bw_pl"))
    b = b.join(F.broadcast(prev_last), "_bw_bucket")
    for i, c in enumerate(value_cols):
        # the first row of a bucket has no in-bucket predecessor: use the carried row
        first = F.row_number().over(w) == 1
        b = b.withColumn(prefix + c, F.when(first, F.col(f"_bw_pl.v{i}")).otherwise(F.col(prefix + c)))
    return b.drop("_bw_bucket", "_bw_pl")
