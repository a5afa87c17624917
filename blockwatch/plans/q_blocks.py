"""Queries: views, positions, block building, parsing and time scalars (S, L1-L5, C, B, E1-E2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.functions import lists, parsing, timefmt
from blockwatch.operators import blocks as B
from blockwatch.operators.position import with_position
from blockwatch.plans.catalog import (BLOCK_SQL_COLS, block_columns, intervals_us, joined,
                                      register, sql)
from blockwatch.sources import views


@register("global_position", sql("SELECT line_no, pos::BIGINT AS pos FROM v_lines", "v_lines"))
def global_position(spark, sf):
    return views.lines(spark, sf).select("line_no", "pos")


@register("blocks_fixed_20", sql(f"SELECT {BLOCK_SQL_COLS} FROM v_blocks20", "v_blocks20"))
def blocks_fixed_20(spark, sf):
    return block_columns(views.blocks20(spark, sf))


@register("blocks_fixed_100", sql(f"SELECT {BLOCK_SQL_COLS} FROM v_blocks100", "v_blocks100"))
def blocks_fixed_100(spark, sf):
    return block_columns(views.blocks20(spark, sf, size=100))


@register("blocks_by_key", sql(f"SELECT {BLOCK_SQL_COLS} FROM v_sessions", "v_sessions"))
def blocks_by_key(spark, sf):
    return block_columns(views.sessions(spark, sf))


@register("blocks_by_nullable_key", sql("""
WITH l AS (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS k, line_no, ts, label FROM v_lines),
p AS (SELECT *, row_number() OVER (ORDER BY ts, line_no) - 1 AS pos FROM l),
g AS (SELECT k, count(*) AS n, min(pos) AS first_pos,
             CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status FROM p GROUP BY k)
SELECT row_number() OVER (ORDER BY first_pos)::BIGINT AS block_id, k, n::BIGINT AS n_lines, first_pos::BIGINT AS first_pos,
       status FROM g""", "v_lines"))
def blocks_by_nullable_key(spark, sf):
    ln = views.lines(spark, sf).withColumn("k", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    rows = B.key_blocks(ln, ["k"])
    key = rows.groupBy("block_id").agg(F.first("k").alias("k"))
    return (B.block_status(rows, F.col("label") == "-").join(key, "block_id")
            .select(F.col("block_id").cast("bigint"), "k", F.col("n_lines").cast("bigint"),
                    F.col("first_pos").cast("bigint"), "status"))


@register("class_balance", sql("""
SELECT 'fixed20' AS view, status, count(*)::BIGINT AS n_blocks FROM v_blocks20 GROUP BY status
UNION ALL
SELECT 'sessions' AS view, status, count(*)::BIGINT AS n_blocks FROM v_sessions GROUP BY status""",
                               "v_blocks20", "v_sessions"))
def class_balance(spark, sf):
    a = B.block_status(views.blocks20_lines(spark, sf), F.col("label") == "-").groupBy("status").agg(F.count(F.lit(1)).alias("n_blocks"))
    b = B.block_status(views.session_lines(spark, sf), F.col("label") == "-").groupBy("status") \
        .agg(F.count(F.lit(1)).alias("n_blocks"))
    return (a.select(F.lit("fixed20").alias("view"), "status", "n_blocks")
            .unionByName(b.select(F.lit("sessions").alias("view"), "status", "n_blocks")))


@register("status_to_label", sql("""
SELECT block_id::BIGINT AS block_id, CASE WHEN lower(status) = 'success' THEN 1 ELSE 0 END AS label
FROM v_blocks20""", "v_blocks20"))
def status_to_label(spark, sf):
    from blockwatch.operators.sampling import status_to_label as s2l
    blocks = B.block_status(views.blocks20_lines(spark, sf), F.col("label") == "-")
    return blocks.select("block_id", s2l("status").alias("label"))


@register("label_flip", sql("""
SELECT block_id::BIGINT AS block_id, hadoop_status, CASE WHEN hadoop_status = 0 THEN 1 ELSE 0 END AS label
FROM (SELECT block_id, CASE WHEN status = 'success' THEN 0 ELSE 1 END AS hadoop_status FROM v_blocks20)""",
                            "v_blocks20"))
def label_flip(spark, sf):
    from blockwatch.operators.sampling import flip_label
    b = B.block_status(views.blocks20_lines(spark, sf), F.col("label") == "-").select(
        "block_id", F.when(F.col("status") == "success", 0).otherwise(1).alias("hadoop_status"))
    return b.withColumn("label", flip_label("hadoop_status"))


@register("event_intervals", sql("SELECT block_id::BIGINT AS block_id, intervals_us FROM v_blocks20",
                                 "v_blocks20"))
def event_intervals(spark, sf):
    return views.blocks20(spark, sf).select("block_id", intervals_us("event_intervals").alias("intervals_us"))


# ---- time blocks -------------------------------------------------------------

def _time_block_sql(interval_s: int, step_s: int) -> str:
    iv, st = interval_s * 1_000_000, step_s * 1_000_000
    return sql(f"""
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM v_lines),
d AS (SELECT l.*, epoch_us(l.ts) - b.lo AS off, b.hi - b.lo AS span FROM v_lines l, b),
w AS (SELECT d.*, wk FROM d, range(0, (d.off // {st}) + 1) t(wk)
      WHERE wk >= greatest(0, floor((d.off - {iv}) / {st}) + 1) AND wk * {st} < span),
ids AS (SELECT wk, row_number() OVER (ORDER BY wk) AS block_id FROM (SELECT DISTINCT wk FROM w))
SELECT ids.block_id::BIGINT AS block_id, w.wk::BIGINT AS window_k,
       CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
       count(*)::BIGINT AS n_lines, min(line_no)::BIGINT AS first_line, max(line_no)::BIGINT AS last_line,
       string_agg(template_id, ' ' ORDER BY pos) AS event_list
FROM w JOIN ids USING (wk) GROUP BY 1, 2""", "v_lines")


def _time_blocks(spark, sf, interval_s, step_s):
    rows = B.time_blocks(views.lines(spark, sf), "ts", interval_s, step_s)
    agg = rows.groupBy("block_id", "window_k").agg(
        B.all_normal(F.col("label") == "-").alias("status"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.array_sort(F.collect_list(F.struct("pos", "template_id"))).alias("_r"))
    return agg.select(F.col("block_id").cast("bigint"), F.col("window_k").cast("bigint"), "status",
                      "n_lines", "first_line", "last_line",
                      joined(F.col("_r.template_id")).alias("event_list"))


@register("blocks_tumbling_30m", _time_block_sql(1800, 1800))
def blocks_tumbling_30m(spark, sf):
    return _time_blocks(spark, sf, 1800, 1800)


@register("blocks_hopping", _time_block_sql(3600, 1800))
def blocks_hopping(spark, sf):
    return _time_blocks(spark, sf, 3600, 1800)


@register("blocks_hopping_panes", sql("""
WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM v_lines),
d AS (SELECT epoch_us(ts) - lo AS d, span, pos, label FROM v_lines, b),
w AS (SELECT pos, label, span, unnest(range(greatest(0, (d - 18000000000) // 180000000 + 1), d // 180000000 + 1)) AS k
      FROM d WHERE d >= 18000000000 UNION ALL
      SELECT pos, label, span, unnest(range(0, d // 180000000 + 1)) AS k FROM d WHERE d < 18000000000),
a AS (SELECT k, CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
             count(*) AS n_lines, min(pos) AS first_pos, max(pos) AS last_pos
      FROM w WHERE k * 180000000 < span GROUP BY k)
SELECT row_number() OVER (ORDER BY k) AS block_id, k::BIGINT AS window_k, status, n_lines::BIGINT AS n_lines,
       first_pos::BIGINT AS first_pos, last_pos::BIGINT AS last_pos FROM a""", "v_lines"))
def blocks_hopping_panes(spark, sf):
    """Windows of five hours, one every three minutes: each line is in a hundred, and is read once."""
    out = B.hopping_facts(views.lines(spark, sf), "ts", 18000, 180, F.col("label") == "-")
    return out.select(*[F.col(c).cast("bigint") if c != "status" else F.col(c) for c in out.columns])


@register("blocks_gapped", _time_block_sql(600, 1800))
def blocks_gapped(spark, sf):
    return _time_blocks(spark, sf, 600, 1800)


# ---- the two slicers from raw date and time texts -------------------------------

@register("slice_fixed_dotted", sql("""
WITH d AS (SELECT line_no, label, template_id,
                  try_strptime(strftime(ts, '%Y.%m.%d') || ' ' || CASE WHEN k = 97 THEN 'bad' ELSE strftime(ts, '%H:%M:%S') END,
                               '%Y.%m.%d %H:%M:%S') AS t,
                  row_number() OVER (ORDER BY line_no) - 1 AS pos FROM v_lines),
g AS (SELECT *, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY pos // 20 ORDER BY pos) AS gap FROM d)
SELECT (pos // 20 + 1)::BIGINT AS block_id,
       CASE WHEN bool_and(label = '-') THEN 'success' ELSE 'fail' END AS status, count(*)::BIGINT AS n_lines,
       string_agg(template_id, ' ' ORDER BY pos) AS event_list,
       string_agg(coalesce(gap, 0)::BIGINT::VARCHAR, ',' ORDER BY pos) AS intervals_us
FROM g GROUP BY 1""", "v_lines"))
def slice_fixed_dotted(spark, sf):
    """Dotted dates and times, coerced (a bad one is NULL and its gaps 0), in file order, 20 lines a block."""
    d = views.dotted_lines(spark, sf).withColumn("ts", timefmt.coerce_datetime("date", "time"))
    rows = B.fixed_count_blocks(with_position(d, ["line_no"]), 20)
    out = B.summarize_blocks(rows, F.col("label") == "-", content_col=None)
    return out.select(F.col("block_id").cast("bigint"), "status", F.col("n_lines").cast("bigint"),
                      joined("event_list").alias("event_list"), intervals_us("event_intervals").alias("intervals_us"))


@register("slice_time_compact", sql("""
WITH h AS (SELECT line_no, CASE WHEN k = 98 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
                  date_trunc('second', CASE WHEN user_id % 2 = 1 THEN ts - INTERVAL 30 YEAR ELSE ts END) AS t FROM v_lines),
b AS (SELECT min(epoch_us(t)) AS lo, max(epoch_us(t)) AS hi FROM h),
w AS (SELECT h.*, (epoch_us(t) - lo) // 1800000000 AS wk FROM h, b),
i AS (SELECT wk, row_number() OVER (ORDER BY wk) AS block_id FROM (SELECT DISTINCT wk FROM w, b WHERE wk * 1800000000 < hi - lo))
SELECT block_id::BIGINT AS block_id, count(*)::BIGINT AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line,
       CASE WHEN bool_and(level = 'INFO') THEN 'success' ELSE 'fail' END AS status
FROM w JOIN i USING (wk) GROUP BY 1""", "v_lines"))
def slice_time_compact(spark, sf):
    """Compact dates and times whose zeros are lost, 30-minute blocks, normal where every level is INFO."""
    h = views.hdfs_lines(spark, sf).withColumn("ts", timefmt.parse_compact_datetime("date", "time"))
    rows = B.time_blocks(h, "ts", 1800)
    return (rows.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        B.all_normal(F.col("level") == "INFO").alias("status")).withColumn("block_id", F.col("block_id").cast("bigint")))


_TUMBLING = """
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM v_lines),
w AS (SELECT l.*, (epoch_us(l.ts) - b.lo) // 1800000000 AS wk FROM v_lines l, b
      WHERE ((epoch_us(l.ts) - b.lo) // 1800000000) * 1800000000 < b.hi - b.lo),
ids AS (SELECT wk, row_number() OVER (ORDER BY wk) AS block_id FROM (SELECT DISTINCT wk FROM w))"""


@register("block_rows_annotated", sql(_TUMBLING + """,
blk AS (SELECT wk, CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status
        FROM w GROUP BY wk)
SELECT w.line_no, ids.block_id::BIGINT AS block_id, blk.status,
       coalesce(epoch_us(w.ts) - lag(epoch_us(w.ts)) OVER (PARTITION BY w.wk ORDER BY w.pos), 0)::BIGINT
         AS interval_us
FROM w JOIN ids USING (wk) JOIN blk USING (wk)""", "v_lines"))
def block_rows_annotated(spark, sf):
    rows = B.time_blocks(views.lines(spark, sf), "ts", 1800, 1800)
    summary = rows.groupBy("block_id").agg(B.all_normal(F.col("label") == "-").alias("status"))
    rows = B.gap_to_previous_in_block(rows, "block_id", "pos", "ts")
    out = B.annotate_rows(rows, summary, attrs=("status",))
    return out.select("line_no", F.col("block_id").cast("bigint"), "status",
                      F.round(F.col("interval_s") * F.lit(1e6)).cast("bigint").alias("interval_us"))


@register("block_text_parts", sql(_TUMBLING + f"""
SELECT ids.block_id::BIGINT AS block_id, (pos // {B.PART_LINES})::BIGINT AS part, count(*)::BIGINT AS n_lines,
       string_agg(template_id, '|' ORDER BY pos) AS translated_event
FROM w JOIN ids USING (wk) GROUP BY 1, 2""", "v_lines"))
def block_text_parts(spark, sf):
    """The joined events of each block, once a block and in parts of a bounded size."""
    rows = B.time_blocks(views.lines(spark, sf), "ts", 1800, 1800)
    parts = B.list_parts(rows, "template_id")
    return parts.select(F.col("block_id").cast("bigint"), "part", "n_lines", F.array_join("items", "|").alias("translated_event"))


@register("blocks_idle_gap", sql("""
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, pos) AS gap
           FROM v_lines),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS sess
      FROM g),
a AS (SELECT user_id, sess, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_lines,
             CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status
      FROM s GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY first_pos)::BIGINT AS block_id, user_id, status,
       n_lines::BIGINT AS n_lines, first_pos::BIGINT AS first_pos, last_pos::BIGINT AS last_pos
FROM a""", "v_lines"))
def blocks_idle_gap(spark, sf):
    rows = B.idle_gap_sessions(views.lines(spark, sf), "user_id", "ts", 21600)
    return rows.groupBy("block_id").agg(
        F.first("user_id").alias("user_id"),
        B.all_normal(F.col("label") == "-").alias("status"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


# ---- parsing ---------------------------------------------------------------------

LOG_RE = parsing.LOG_LINE_PATTERN.replace("'", "''")


@register("parse_log_lines", sql(f"""
SELECT line_no, regexp_extract(value, '{LOG_RE}', 2) AS ts_text,
       regexp_extract(value, '{LOG_RE}', 3) AS level,
       regexp_extract(value, '{LOG_RE}', 4) AS content,
       CASE WHEN regexp_extract(value, '{LOG_RE}', 1) = '-' THEN 'success' ELSE 'fail' END AS status
FROM v_raw WHERE regexp_matches(value, '{LOG_RE}')""", "v_raw"))
def parse_log_lines(spark, sf):
    p = parsing.parse_lines(views.raw_lines(spark, sf), "value")
    return p.select("line_no", "p.ts_text", "p.level", "p.content", "p.status")


@register("parse_rejects", sql(f"""
SELECT line_no, value FROM v_raw WHERE NOT regexp_matches(value, '{LOG_RE}')""", "v_raw"))
def parse_rejects(spark, sf):
    raw = views.raw_lines(spark, sf)
    return raw.filter(~parsing.is_log_line("value"))


IP_RE = parsing.IP_PATTERN


@register("mask_variables", f"""
SELECT page_id, md5(m) AS masked_md5, length(m)::BIGINT AS masked_len,
       ((length(m) - length(replace(m, '<*>', ''))) // 3)::BIGINT AS n_masks
FROM (SELECT page_id, regexp_replace(html, '{IP_RE}', '<*>', 'g') AS m FROM pages)""")
def mask_variables(spark, sf):
    from blockwatch.sources.tables import read_table
    pages = read_table(spark, sf, "pages", ["page_id", "html"])
    m = pages.select("page_id", parsing.mask_variables("html").alias("m"))
    return m.select("page_id", F.md5("m").alias("masked_md5"), F.length("m").cast("bigint").alias("masked_len"),
                    ((F.length("m") - F.length(F.replace("m", F.lit("<*>"), F.lit("")))) / 3)
                    .cast("bigint").alias("n_masks"))


# ---- time scalars --------------------------------------------------------------

@register("parse_compact_datetime", sql("""
WITH h AS (SELECT line_no, CAST(strftime(CASE WHEN user_id % 2 = 1 THEN ts - INTERVAL 30 YEAR ELSE ts END, '%y%m%d')
                                 AS INTEGER) AS date,
                  CAST(strftime(ts, '%H%M%S') AS INTEGER) AS time FROM v_lines),
p AS (SELECT *, lpad(date::VARCHAR, 6, '0') AS d6, lpad(time::VARCHAR, 6, '0') AS t6 FROM h)
SELECT line_no, date, time,
       strftime(make_timestamp(
           CASE WHEN substr(d6, 1, 2)::INT >= 69 THEN 1900 ELSE 2000 END + substr(d6, 1, 2)::INT,
           substr(d6, 3, 2)::INT, substr(d6, 5, 2)::INT, 0, 0, 0)
         + to_seconds(substr(t6, 1, 2)::INT * 3600 + substr(t6, 3, 2)::INT * 60 + substr(t6, 5, 2)::INT),
         '%Y-%m-%d %H:%M:%S') AS datetime
FROM p""", "v_lines"))
def parse_compact_datetime(spark, sf):
    h = views.hdfs_lines(spark, sf)
    return h.select("line_no", "date", "time",
                    F.date_format(timefmt.parse_compact_datetime("date", "time"), "yyyy-MM-dd HH:mm:ss")
                    .alias("datetime"))


@register("coerce_datetime", sql("""
SELECT line_no, date, time,
       strftime(try_strptime(date || ' ' || time, '%Y.%m.%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS datetime
FROM (SELECT line_no, strftime(ts, '%Y.%m.%d') AS date,
             CASE WHEN k = 97 THEN 'bad' ELSE strftime(ts, '%H:%M:%S') END AS time FROM v_lines)""",
                                 "v_lines"))
def coerce_datetime(spark, sf):
    d = views.dotted_lines(spark, sf)
    return d.select("line_no", "date", "time",
                    F.date_format(timefmt.coerce_datetime("date", "time"), "yyyy-MM-dd HH:mm:ss")
                    .alias("datetime"))


# ---- list literals -----------------------------------------------------------------

@register("parse_event_list", sql("""
WITH r AS (
  SELECT block_id,
         CASE WHEN status = 'fail' THEN '[' || array_to_string(list_transform(event_list, lambda x: '''' || x || ''''), ', ')
              ELSE '[' || array_to_string(list_transform(event_list, lambda x: '''' || x || ''''), ', ') || ']' END
           AS event_literal,
         '[' || array_to_string(list_transform(event_list, lambda x: split_part(x, ':', 2)), ', ') || ']' AS k_literal
  FROM v_blocks20)
SELECT block_id::BIGINT AS block_id,
       CASE WHEN json_valid(replace(event_literal, '''', '"'))
            THEN array_to_string(from_json(replace(event_literal, '''', '"'), '["VARCHAR"]'), ',') END AS events,
       array_to_string(from_json(replace(k_literal, '''', '"'), '["VARCHAR"]'), ',') AS ks
FROM r""", "v_blocks20"))
def parse_event_list(spark, sf):
    b = views.blocks20(spark, sf)
    quoted = F.array_join(F.transform("event_list", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    literal = F.when(F.col("status") == "fail", F.concat(F.lit("["), quoted)) \
        .otherwise(F.concat(F.lit("["), quoted, F.lit("]")))
    k_literal = F.concat(F.lit("["), F.array_join(
        F.transform("event_list", lambda x: F.split_part(x, F.lit(":"), F.lit(2))), ", "), F.lit("]"))
    return b.select(F.col("block_id").cast("bigint"),
                    F.array_join(lists.parse_list_literal(literal), ",").alias("events"),
                    F.array_join(lists.parse_list_literal(k_literal), ",").alias("ks"))
