"""Cutting a stream of log lines into blocks.

A block is (block_id, status, n_lines, event_list, event_intervals, content).
Block *assignment* is always arithmetic on a position or timestamp (no scans per
window, no unpartitioned windows over lines); block *summaries* are one
``groupBy(block_id)``. Decomposable facts (status, counts, first/last line) use
partial aggregation; the ordered list columns are gathered per block and are
bounded by the block size for fixed-count blocks.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwatch.functions.timefmt import micros
from blockwatch.session import written
from blockwatch.operators.position import bucketed, previous_values, with_position

CONTENT_SEP = " | "
#: Lines of one part of a block's list, at most.
PART_LINES = 1000


def fixed_count_blocks(lines: DataFrame, size: int, pos_col: str = "pos",
                       id_col: str = "block_id") -> DataFrame:
    """B1: ``block_id = pos div size + 1`` (last partial block kept)."""
    if size <= 0:
        raise ValueError("block size must be positive")
    return lines.withColumn(id_col, (F.col(pos_col) / F.lit(size)).cast("bigint") + 1)


def all_normal(normal: Column) -> Column:
    """A block is normal when every row is; a NULL row counts as not normal."""
    return F.when(F.bool_and(F.coalesce(normal, F.lit(False))), F.lit("success")) \
        .otherwise(F.lit("fail"))


def intervals_from_times(ts_array: Column) -> Column:
    """Gap in seconds to the previous row; first row and unparseable -> 0.0."""
    us = F.transform(ts_array, lambda t: micros(t))
    return F.transform(us, lambda u, i: F.when(
        (i == 0) | u.isNull() | F.element_at(us, i).isNull(), F.lit(0.0))
        .otherwise((u - F.element_at(us, i)) / F.lit(1e6)))


def summarize_blocks(rows: DataFrame, normal: Column, block_col: str = "block_id",
                     pos_col: str = "pos", template_col: str | None = "template_id",
                     content_col: str | None = "content", ts_col: str | None = "ts",
                     content_sep: str = CONTENT_SEP) -> DataFrame:
    """One row per block with status, ordered event list, intervals and content."""
    fields = [F.col(pos_col).alias("p")]
    if template_col:
        fields.append(F.col(template_col).alias("t"))
    if content_col:
        fields.append(F.col(content_col).alias("c"))
    if ts_col:
        fields.append(F.col(ts_col).alias("ts"))
    aggs = [
        all_normal(normal).alias("status"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min(pos_col).alias("first_pos"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"),
    ]
    out = rows.groupBy(block_col).agg(*aggs)
    cols = [block_col, "status", "n_lines", "first_pos"]
    if template_col:
        out = out.withColumn("event_list", F.col("_rows.t"))
        cols.append("event_list")
    if ts_col:
        out = out.withColumn("event_intervals", intervals_from_times(F.col("_rows.ts")))
        cols.append("event_intervals")
    if content_col:
        out = out.withColumn("content", F.array_join(F.col("_rows.c"), content_sep))
        cols.append("content")
    return out.select(*cols)


def _anchor_offsets(lines: DataFrame, ts_col: str) -> tuple[Column, Column]:
    """Offset of each row from min(ts) in micros, and the span max-min (scalar subqueries)."""
    us = micros(ts_col)
    bounds = lines.select(F.min(us).alias("lo"), F.max(us).alias("hi"))
    lo = bounds.select("lo").scalar()
    span = bounds.select(F.col("hi") - F.col("lo")).scalar()
    return us - lo, span


def window_index(lines: DataFrame, ts_col: str, interval_s: float, step_s: float,
                 k_col: str = "window_k") -> DataFrame:
    """Assign each row to every window ``[min + k*step, min + k*step + interval)``
    that contains it, for windows with ``k*step < max - min``.

    Tumbling (step == interval): one window per row. Hopping (step < interval):
    several. Gapped (step > interval): rows between windows get none.
    """
    step_us = int(round(step_s * 1e6))
    interval_us = int(round(interval_s * 1e6))
    d, span = _anchor_offsets(lines, ts_col)
    k_hi = F.floor(d / F.lit(step_us))
    k_lo = F.greatest(F.lit(0), F.floor((d - F.lit(interval_us)) / F.lit(step_us)) + 1)
    with_k = (lines.withColumn("_bw_klo", k_lo).withColumn("_bw_khi", k_hi)
              .filter(F.col("_bw_klo") <= F.col("_bw_khi")))
    if step_us >= interval_us:
        with_k = with_k.withColumn(k_col, F.col("_bw_khi"))
    else:
        with_k = with_k.withColumn(k_col, F.explode(F.sequence("_bw_klo", "_bw_khi")))
    return (with_k.filter(F.col(k_col) * F.lit(step_us) < span)
            .drop("_bw_klo", "_bw_khi"))


def hopping_facts(lines: DataFrame, ts_col: str, interval_s: float, step_s: float, normal: Column,
                  pos_col: str = "pos", id_col: str = "block_id") -> DataFrame:
    """B2/B3/B5/B9 without copies of lines: block_id (dense), window_k, status, n_lines, first_pos and
    last_pos of each non-empty window, whatever interval / step is.

    Lines are reduced once, to panes of gcd(interval, step): a window is a run of whole panes. Panes are
    put into stretches as long as an interval, so a window is the end of one stretch and the beginning
    of the next: a running aggregate from the back of the first and one from the front of the second,
    looked up at the window's edges and merged. Each window costs two rows, each pane one. Rows without
    a time are in no window.
    """
    step_us, interval_us = int(round(step_s * 1e6)), int(round(interval_s * 1e6))
    pane_us = math.gcd(step_us, interval_us)
    step, width = step_us // pane_us, interval_us // pane_us  # in panes
    d, span = _anchor_offsets(lines, ts_col)
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    panes = written(
        lines.withColumn("at", div(d, pane_us)).where(F.col("at").isNotNull()).groupBy("at").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(normal, F.lit(False))).alias("bad"),
            F.min(pos_col).alias("first"), F.max(pos_col).alias("last"))
        .withColumn("stretch", div(F.col("at"), width)), "panes")
    # Windows that begin in the stretch of a pane or in the one before.
    low = F.greatest(F.lit(0).cast("bigint"), div((F.col("stretch") - 1) * width + step - 1, step))
    high = div((F.col("stretch") + 1) * width - 1, step)
    starts = (panes.select("stretch").distinct().select(F.explode(F.sequence(low, high)).alias("k")).distinct()
              .where(F.col("k") * F.lit(step_us) < span).withColumn("from", F.col("k") * step))
    none = [F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"),
            F.lit(None).cast(panes.schema["first"].dataType).alias("first"), F.lit(None).cast(panes.schema["last"].dataType).alias("last")]
    begin = starts.select("k", F.lit(True).alias("back"), F.col("from").alias("at"), div(F.col("from"), width).alias("stretch"), *none)
    end = starts.where(F.col("from") % width != 0).select(
        "k", F.lit(False).alias("back"), (F.col("from") + width - 1).alias("at"), (div(F.col("from"), width) + 1).alias("stretch"), *none)
    rows = (panes.select(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("boolean").alias("back"), "at", "stretch", "n", "bad", "first", "last")
            .unionByName(begin).unionByName(end))
    front = Window.partitionBy("stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("stretch").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = [("n", F.sum), ("bad", F.sum), ("first", F.min), ("last", F.max)]
    edges = rows.select("k", "back", *[fn(c).over(front).alias(f"front_{c}") for c, fn in runs],
                        *[fn(c).over(back).alias(f"back_{c}") for c, fn in runs]).where(F.col("k").isNotNull())
    merged = edges.groupBy("k").agg(*[fn(F.when(F.col("back"), F.col(f"back_{c}")).otherwise(F.col(f"front_{c}"))).alias(c) for c, fn in runs])
    blocks = with_position(written(merged.where("n > 0"), "hopping-blocks"), ["k"], name="_bw_pos")
    return blocks.select((F.col("_bw_pos") + 1).alias(id_col), F.col("k").alias("window_k"),
                         F.when(F.col("bad") == 0, F.lit("success")).otherwise(F.lit("fail")).alias("status"),
                         F.col("n").alias("n_lines"), F.col("first").alias("first_pos"), F.col("last").alias("last_pos"))


def dense_ids(rows: DataFrame, key_cols: list[str], order_cols: list[str],
              id_col: str = "block_id") -> DataFrame:
    """1-based dense ids over the distinct keys present in ``rows``, by ``order_cols``.

    The distinct-key table is written, numbered with ``with_position`` (no single-task sort), written
    again and joined back: rows are grouped once, and a table of a known small size is broadcast, so
    that rows are not shuffled for it.
    """
    keys = written(rows.groupBy(*key_cols).agg(*[F.min(c).alias(f"_bw_o{i}") for i, c in enumerate(order_cols)]), "block-keys")
    order = [f"_bw_o{i}" for i in range(len(order_cols))] + list(key_cols)
    numbered = with_position(keys, order, name="_bw_pos")
    numbered = written(numbered.select(*[F.col(c).alias(f"_bw_j{i}") for i, c in enumerate(key_cols)],
                                       (F.col("_bw_pos") + 1).alias(id_col)), "block-ids")
    # Rows whose key is NULL form a block of their own: the join compares NULL with NULL.
    same = [F.col(c).eqNullSafe(F.col(f"_bw_j{i}")) for i, c in enumerate(key_cols)]
    return rows.join(numbered, functools.reduce(operator.and_, same)).drop(*[f"_bw_j{i}" for i in range(len(key_cols))])


def time_blocks(lines: DataFrame, ts_col: str, interval_s: float, step_s: float | None = None,
                id_col: str = "block_id") -> DataFrame:
    """Rows with a dense block id per non-empty window (a row may repeat)."""
    step = interval_s if step_s is None else step_s
    windowed = window_index(lines, ts_col, interval_s, step, k_col="window_k")
    return dense_ids(windowed, ["window_k"], ["window_k"], id_col=id_col)


def key_blocks(lines: DataFrame, keys: list[str | Column], pos_col: str = "pos",
               id_col: str = "block_id") -> DataFrame:
    """One block per session key; ids ordered by each block's first line."""
    named = []
    tmp = lines
    for i, k in enumerate(keys):
        if isinstance(k, str):
            named.append(k)
        else:
            tmp = tmp.withColumn(f"_bw_key{i}", k)
            named.append(f"_bw_key{i}")
    out = dense_ids(tmp, named, [pos_col], id_col=id_col)
    return out.drop(*[n for n in named if n.startswith("_bw_key")])


def idle_gap_sessions(lines: DataFrame, key: str, ts_col: str, gap_s: float,
                      pos_col: str = "pos", id_col: str = "block_id") -> DataFrame:
    """B4 (idle-gap form): a new session starts after more than ``gap_s`` of silence per key.

    One pass over range buckets of the (key, ts, pos) order (see ``position``): inside a
    bucket, ``lag`` gives each line's predecessor and a running sum of session starts
    gives its session number. Only bucket edges need outside information: the last line
    of the previous bucket and the number of starts in earlier buckets, both from tables
    with one row per bucket. A hot key spans many buckets, so no task holds it whole.
    Block ids are then dense in order of each session's first line.
    """
    order = [key, ts_col, pos_col]
    b = bucketed(lines, order).withColumn("_bw_us", micros(ts_col))
    w = Window.partitionBy("_bw_bucket").orderBy(*order)
    b = b.withColumn("_bw_pk", F.lag(F.struct(F.col(key).alias("k"), F.col("_bw_us").alias("u"))).over(w))
    last = b.groupBy("_bw_bucket").agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col("_bw_us").alias("u")), F.struct(*order)).alias("_bw_last"))
    prev_last = last.select("_bw_bucket", F.lag("_bw_last").over(Window.orderBy("_bw_bucket")).alias("_bw_pl"))
    b = b.join(F.broadcast(prev_last), "_bw_bucket").withColumn("_bw_prev", F.coalesce("_bw_pk", "_bw_pl"))
    # The first row of all has no predecessor; a NULL key is a key like any other.
    start = (F.col("_bw_prev").isNull() | ~F.col("_bw_prev.k").eqNullSafe(F.col(key))
             | ((F.col("_bw_us") - F.col("_bw_prev.u")) > F.lit(int(round(gap_s * 1e6)))))
    # Read by the running sums and by the sums of the buckets.
    b = written(b.withColumn("_bw_start", F.coalesce(start, F.lit(True)).cast("int")).drop("_bw_pk", "_bw_pl", "_bw_prev"),
                "session-starts")
    b = b.withColumn("_bw_local", F.sum("_bw_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = b.groupBy("_bw_bucket").agg(F.sum("_bw_start").alias("_bw_ns"))
    offsets = starts.select("_bw_bucket", F.coalesce(F.sum("_bw_ns").over(
        Window.orderBy("_bw_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bw_soff"))
    b = (b.join(F.broadcast(offsets), "_bw_bucket")
         .withColumn("_bw_snum", F.col("_bw_soff") + F.col("_bw_local")).drop("_bw_soff"))
    b = b.drop("_bw_bucket", "_bw_us", "_bw_start", "_bw_local")
    return dense_ids(b, ["_bw_snum"], [pos_col], id_col=id_col).drop("_bw_snum")


def gap_to_previous_in_block(rows: DataFrame, block_col: str = "block_id", pos_col: str = "pos",
                             ts_col: str = "ts", out: str = "interval_s") -> DataFrame:
    """C4 per row: seconds since the previous row of the same block (0.0 for the first
    row of a block, or when either time is NULL).

    The previous row in (block, pos) order comes from ``previous_values`` (range buckets,
    ``lag`` inside a bucket): no block, however large, lands in a single task, and no
    line-sized join is needed.
    """
    b = previous_values(rows.withColumn("_bw_us", micros(ts_col)), [block_col, pos_col],
                        [block_col, "_bw_us"], prefix="_bw_p_")
    gap = F.when(F.col(f"_bw_p_{block_col}") == F.col(block_col),
                 (F.col("_bw_us") - F.col("_bw_p__bw_us")) / F.lit(1e6))
    return (b.withColumn(out, F.coalesce(gap, F.lit(0.0)))
            .drop("_bw_us", f"_bw_p_{block_col}", "_bw_p__bw_us"))


def annotate_rows(rows: DataFrame, blocks: DataFrame, block_col: str = "block_id",
                  attrs: tuple[str, ...] = ("status",)) -> DataFrame:
    """Copy block attributes back onto each member row (join on the block id)."""
    return rows.join(blocks.select(block_col, *attrs), block_col)


def block_status(rows: DataFrame, normal: Column, block_col: str = "block_id",
                 pos_col: str = "pos") -> DataFrame:
    """B5 without the list columns: (block, status, n_lines, first_pos), all decomposable."""
    return rows.groupBy(block_col).agg(all_normal(normal).alias("status"),
                                       F.count(F.lit(1)).alias("n_lines"),
                                       F.min(pos_col).alias("first_pos"))


def ordered_lists(rows: DataFrame, block_col: str = "block_id", pos_col: str = "pos",
                  template_col: str = "template") -> DataFrame:
    """B6 for a chosen set of blocks: the ordered template list of each block."""
    return rows.groupBy(block_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(template_col).alias("t"))))
        ["t"].alias("event_list"))


def list_parts(rows: DataFrame, item_col: str, block_col: str = "block_id", pos_col: str = "pos",
               size: int = PART_LINES) -> DataFrame:
    """B6 for blocks of any size: the ordered items of each block in parts (block, part, n_lines, items).

    A part holds the block's lines of one run of ``size`` positions, so no group is larger than that
    and a block with a third of all lines is spread over as many groups as it needs. Parts are
    numbered by that run, ascending in the order of the lines.
    """
    part = F.expr(f"{pos_col} div {size}").cast("bigint")
    return rows.groupBy(block_col, part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(item_col).alias("t"))))["t"].alias("items"))
