"""Queries: Structured Streaming forms (X1-X3), run with ``availableNow`` over files
derived from the driver tables, read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.functions.parsing import LOG_LINE_PATTERN
from blockwatch.operators import features as FT
from blockwatch.plans import detectors as D
from blockwatch.plans.catalog import r6, register, sql
from blockwatch.plans.q_rules import _view
from blockwatch.session import scratch_path, written
from blockwatch.sources import views
from blockwatch.sources.tables import read_table
from blockwatch.streaming import ingest as X

LOG_RE = LOG_LINE_PATTERN.replace("'", "''")


@register("stream_parse_log_lines", sql(f"""
SELECT regexp_extract(value, '{LOG_RE}', 2) AS ts_text, regexp_extract(value, '{LOG_RE}', 3) AS level,
       regexp_extract(value, '{LOG_RE}', 4) AS content,
       CASE WHEN regexp_extract(value, '{LOG_RE}', 1) = '-' THEN 'success' ELSE 'fail' END AS status
FROM v_raw WHERE regexp_matches(value, '{LOG_RE}')""", "v_raw"))
def stream_parse_log_lines(spark, sf):
    base = scratch_path(spark, "raw-stream")
    views.raw_lines(spark, sf).select("value").write.mode("overwrite").text(f"{base}/in")
    raw = spark.readStream.text(f"{base}/in")
    X.run_available_now(X.parse_stream(raw), f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out").select("ts_text", "level", "content", "status")


def _run_in_parts(spark, sf, name, build, rocksdb=False):
    """Runs ``build`` (of a stream of lines) over the events as they arrive in three parts in the order
    of time, and the end marker; the query stops and resumes in between, so state is carried."""
    base = scratch_path(spark, name)
    events = read_table(spark, sf, "events")
    ends = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("lo"),
                      F.unix_micros(F.max("ts").cast("timestamp")).alias("hi")).first()
    width = (ends["hi"] - ends["lo"]) // 3 + 1
    third = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {ends['lo']}) div {width}")
    for part in [events.filter(third == i) for i in range(3)] + [X.end_marker(events)]:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        X.run_available_now(build(X.stream_lines(stream)), f"{base}/out", f"{base}/cp", rocksdb=rocksdb)
    return spark.read.parquet(f"{base}/out")


@register("stream_blocks_tumbling_30m", sql("""
WITH l AS (SELECT line_no, ts, label FROM v_lines),
w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ws, count(*) AS n_lines,
             CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
             min(line_no) AS first_line, max(line_no) AS last_line FROM l GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n_lines::BIGINT AS n_lines, status,
       first_line, last_line
FROM w""", "v_lines"))
def stream_blocks_tumbling_30m(spark, sf):
    out = _run_in_parts(spark, sf, "events-stream", lambda s: X.window_blocks(s, "30 minutes", "1 hour"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "n_lines", "status", "first_line", "last_line")


@register("stream_verdict_cascade", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, reason, verdict FROM sess_verdicts""",
                                        "sess_verdicts"))
def stream_verdict_cascade(spark, sf):
    from blockwatch.operators.blocks import ordered_lists
    blocks, lines = _view(spark, sf, "sess")
    parts = D.cascade_parts(blocks, lines)
    emb = written(FT.embed_lines_to_blocks(lines), "embeddings")
    container = parts["container"].select("block_id", "label").join(emb, "block_id")
    # The test blocks arrive as a file stream of (block, label, event list, embedding) records.
    base = scratch_path(spark, "blocks-stream")
    test_lists = ordered_lists(parts["lines"].join(parts["test"].select("block_id"), "block_id", "left_semi"))
    parts["test"].select("block_id", "label").join(test_lists, "block_id").join(emb, "block_id") \
        .write.mode("overwrite").parquet(f"{base}/in")
    # One stream scores each block once; the threshold is fitted on its scores (the surveyed
    # behaviour) and published with the template sets; the second stream gives the verdicts.
    scored = X.score_stream(X.stream_of(spark, f"{base}/in"), container, D.CASCADE_K, sum(D.CASCADE_CAPS.values()))
    X.run_available_now(scored, f"{base}/scored", f"{base}/cp-scores")
    done = spark.read.parquet(f"{base}/scored")
    threshold = done.select(F.percentile("score", F.lit(D.CASCADE_PERCENTILE / 100)).alias("threshold"))
    bad_lists = ordered_lists(parts["lines"].join(F.broadcast(parts["bad_blocks"]), "block_id", "left_semi"))
    X.publish_sets(f"{base}/sets", parts["normal"], parts["abnormal"], bad_lists, threshold)
    X.run_verdicts(X.stream_of(spark, f"{base}/scored"), f"{base}/sets", f"{base}/out", f"{base}/cp-verdicts")
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


@register("stream_sessions_idle_gap", sql("""
WITH l AS (SELECT line_no, ts, user_id, label FROM v_lines),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, line_no) IS NULL
                       OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, line_no) + INTERVAL 6 HOUR
                     THEN 1 ELSE 0 END AS is_start FROM l),
s AS (SELECT *, sum(is_start) OVER (PARTITION BY user_id ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING) AS sess
      FROM g),
a AS (SELECT user_id, sess, min(ts) AS s_start, max(ts) + INTERVAL 6 HOUR AS s_end, count(*) AS n_lines,
             CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
             min(line_no) AS first_line, max(line_no) AS last_line
      FROM s GROUP BY 1, 2)
SELECT user_id, strftime(s_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, n_lines::BIGINT AS n_lines, status,
       first_line, last_line
FROM a""", "v_lines"))
def stream_sessions_idle_gap(spark, sf):
    out = _run_in_parts(spark, sf, "session-stream", lambda s: X.session_blocks(s, "user_id", "6 hours", "1 hour"))
    return out.select("user_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                      "n_lines", "status", "first_line", "last_line")


@register("stream_keyed_count_blocks", sql("""
WITH q AS (SELECT user_id, line_no, label, row_number() OVER (PARTITION BY user_id ORDER BY ts, line_no) AS rn
           FROM v_lines),
r AS (SELECT *, (rn - 1) // 5 AS block_no FROM q)
SELECT user_id, block_no::BIGINT AS block_no, count(*)::BIGINT AS n_lines,
       arg_min(line_no, rn) AS first_line, arg_max(line_no, rn) AS last_line,
       CASE WHEN bool_and(label = '-') THEN 'success' ELSE 'fail' END AS status
FROM r GROUP BY user_id, block_no""", "v_lines"))
def stream_keyed_count_blocks(spark, sf):
    out = _run_in_parts(spark, sf, "keyed-blocks-stream", lambda s: X.keyed_count_blocks(s, 5, "1 hour"), rocksdb=True)
    return out.drop("last_ts")
