"""Streams close their own blocks: late lines, restarts between batches, idle keys, end of input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from blockwatch.streaming import ingest as X

SCHEMA = "line_no long, ts timestamp, user_id long, label string, template_id string"
T0 = dt.datetime(2024, 1, 1)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _run(spark, base, parts, build, end=True, rocksdb=False):
    """The query over parts that arrive one after the other; it stops and resumes in between."""
    folder, emitted = str(base), []
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in parts + ([None] if end else []):
        df = X.end_marker(spark.createDataFrame([], SCHEMA)) if part is None else spark.createDataFrame(part, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        X.run_available_now(build(stream), f"{folder}/out", f"{folder}/cp", rocksdb=rocksdb)
        emitted.append(spark.read.schema(build(spark.createDataFrame([], SCHEMA)).schema if not rocksdb else X.KEYED_BLOCK_SCHEMA)
                       .parquet(f"{folder}/out").count())
    return spark.read.parquet(f"{folder}/out"), emitted


@pytest.fixture(autouse=True)
def _one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_windows_and_sessions_close_at_the_end(spark, tmp_path):
    line = lambda n, m, user=1, label="-": (n, _at(m), user, label, "t")
    parts = [[line(1, 1), line(2, 29, label="FAIL"), line(3, 31)],
             [line(4, 200), line(5, 20), line(6, 10, user=None)],  # 20 and 10: late, but within the hour
             [line(7, 201), line(8, 3)]]  # 3: later than the watermark allows, dropped
    out, emitted = _run(spark, tmp_path / "w", parts, lambda s: X.window_blocks(s, "30 minutes", "1 hour"))
    got = sorted((r["window"]["start"], r["n_lines"], r["status"], r["first_line"], r["last_line"]) for r in out.collect())
    assert got == [(_at(0), 4, "fail", 1, 6), (_at(30), 1, "success", 3, 3), (_at(180), 2, "success", 4, 7)]
    assert emitted[-2] < emitted[-1] == 3  # the last window left by the end marker
    out, _ = _run(spark, tmp_path / "s", parts, lambda s: X.session_blocks(s, "user_id", "15 minutes", "1 hour"))
    got = sorted((r["user_id"] or 0, r["session"]["start"], r["n_lines"]) for r in out.collect())
    assert got == [(0, _at(10), 1), (1, _at(1), 1), (1, _at(20), 3), (1, _at(200), 2)]


def test_keyed_blocks_in_event_time_order(spark, tmp_path):
    line = lambda n, m, user=1, label="-": (n, _at(m), user, label, "t")
    parts = [[line(1, 0), line(3, 20), line(4, 30, label="FAIL"), line(50, 5, user=2), line(60, 6, user=None)],
             [line(2, 10), line(5, 40)],  # 2 arrives after 3 and 4
             [line(6, 300), line(7, 301), line(8, 302), line(51, 299, user=2)],
             [line(9, 303), line(99, 1)]]  # 99: behind the watermark
    out, emitted = _run(spark, tmp_path / "k", parts, lambda s: X.keyed_count_blocks(s, 3, "1 hour"), rocksdb=True)
    got = sorted((r["user_id"] or 0, r["block_no"], r["n_lines"], r["first_line"], r["last_line"], r["last_ts"], r["status"]) for r in out.collect())
    assert got == [(0, 0, 1, 60, 60, _at(6), "success"),
                   (1, 0, 3, 1, 3, _at(20), "success"), (1, 1, 3, 4, 6, _at(300), "fail"), (1, 2, 3, 7, 9, _at(303), "success"),
                   (2, 0, 2, 50, 51, _at(299), "success")]
    assert emitted == [0, 0, 1, 1, 5]  # nothing before the watermark passes it, nothing twice


def test_idle_blocks_leave_by_timer(spark, tmp_path):
    line = lambda n, m, user=1: (n, _at(m), user, "-", "t")
    parts = [[line(1, 0), line(2, 1), line(9, 0, user=2)], [line(3, 120)], [line(4, 400)]]
    build = lambda s: X.keyed_count_blocks(s, 3, "10 minutes", idle_ms=30 * 60_000)
    out, emitted = _run(spark, tmp_path / "i", parts, build, end=False, rocksdb=True)
    got = sorted((r["user_id"], r["block_no"], r["n_lines"], r["first_line"]) for r in out.collect())
    # Open at the end: only the line of minute 400.
    assert got == [(1, 0, 2, 1), (1, 1, 1, 3), (2, 0, 1, 9)]
    assert emitted[0] == 0


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    """Many keys: as a plain loop, and without a state of its own for each key."""
    import random
    rng, size, idle = random.Random(5), 3, 30
    rows = [(n, _at(rng.randrange(600)), rng.choice([None, *range(6000)]) if n % 3 else rng.choice([None, 1, 2]), rng.choice(["-", "FAIL", None]), "t")
            for n in range(9000)]
    parts = [[r for r in rows if lo <= (r[1] - T0).seconds // 60 < lo + 300] for lo in (0, 300)]
    out, _ = _run(spark, tmp_path / "b", parts, lambda s: X.keyed_count_blocks(s, size, "1 hour", idle_ms=idle * 60_000), rocksdb=True)
    want = []
    for key in {r[2] for r in rows}:
        blocks = []
        for n, ts, _, label, _ in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0], r[3] == "-")):
            if not blocks or len(blocks[-1]) == size or ts > blocks[-1][-1][1] + dt.timedelta(minutes=idle):
                blocks.append([])
            blocks[-1].append((n, ts, label))
        want += [(-1 if key is None else key, i, len(b), b[0][0], b[-1][0], b[-1][1], "success" if all(x[2] == "-" for x in b) else "fail")
                 for i, b in enumerate(blocks)]
    got = [(-1 if r["user_id"] is None else r["user_id"], *tuple(r)[1:]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = X.keyed_count_blocks(spark.readStream.schema(schema).parquet(f"{tmp_path}/b/in"), size, "20 hours")
    q = (stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/again").trigger(once=True).start())
    q.awaitTermination()
    keys = len({r[2] for r in rows})
    assert keys > 3500 and 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < keys


def test_the_marker_is_no_line(spark):
    events = spark.createDataFrame([(1, _at(0), 1, "-", "t")], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    marker = X.end_marker(events)
    assert marker.schema.names == events.schema.names and marker.schema["ts"].dataType == events.schema["ts"].dataType
    assert X.watermarked(marker.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").count() == 0


def _sets(spark, normal, abnormal, sequences, threshold):
    return (spark.createDataFrame([(t,) for t in normal], "template string"), spark.createDataFrame([(t,) for t in abnormal], "template string"),
            spark.createDataFrame([(s,) for s in sequences], "event_list array<string>"),
            spark.createDataFrame([(threshold,)], "threshold double"))


def test_a_new_version_of_the_sets_is_taken_up(spark, tmp_path):
    base, schema = str(tmp_path), "block_id long, event_list array<string>, score double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        X.run_verdicts(X.stream_of(spark, f"{base}/in"), f"{base}/sets", f"{base}/out", f"{base}/cp")
        return {r["block_id"]: (r["verdict"], r["reason"], r["version"]) for r in spark.read.parquet(f"{base}/out").collect()}

    assert X.publish_sets(f"{base}/sets", *_sets(spark, ["A", "B"], ["X"], [["A", "B", "A"]], 50.0)) == 1
    first = arrive([(1, ["A", "B", "A"], 0.0), (2, ["A", "X"], 0.0), (3, ["A", "B"], 50.0), (4, ["A", "A"], None), (5, ["A", "Q"], 1.0),
                    (6, None, 99.0), (7, [], 0.0)])
    assert first == {1: (0, "bad_sequence", 1), 2: (0, "bad_template", 1), 3: (0, "score", 1), 4: (1, "all_normal", 1),
                     5: (1, "default", 1), 6: (None, "unparseable", 1), 7: (1, "all_normal", 1)}
    assert X.publish_sets(f"{base}/sets", *_sets(spark, ["A", "Q"], ["B"], [], 60.0)) == 2
    second = arrive([(8, ["A", "B", "A"], 0.0), (9, ["A", "X"], 55.0), (10, ["A", "Q"], 60.0)])
    assert second == first | {8: (0, "bad_template", 2), 9: (1, "default", 2), 10: (0, "score", 2)}


def test_sets_of_any_size_have_the_same_plan(spark, tmp_path):
    blocks = spark.createDataFrame([(i, [f"t{i}", "t1"], 1.0) for i in range(50)], "block_id long, event_list array<string>, score double")
    sizes = []
    for n in (10, 100_000):
        base = str(tmp_path / str(n))
        X.publish_sets(base, *_sets(spark, [f"t{i}" for i in range(n)], [f"x{i}" for i in range(n)], [], 50.0))
        out = X.verdicts_with_published_sets(blocks, base)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert out.where("reason = 'all_normal'").count() == min(n, 50)
    assert abs(sizes[0] - sizes[1]) < 200
