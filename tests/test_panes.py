"""Hopping windows by panes against every line in every window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from blockwatch.operators import blocks as B

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "pos long, ts timestamp_ntz, label string, n int, at string, k int"


def _plain(rows, interval, step):
    times = [ts for _, ts, *_ in rows if ts is not None]
    if not times:
        return []
    us = lambda t: (t - min(times)) // dt.timedelta(microseconds=1)
    interval, step = round(interval * 1e6), round(step * 1e6)
    out, span = [], us(max(times))
    k = 0
    while k * step < span:
        own = [(p, x) for p, t, x, *_ in rows if t is not None and k * step <= us(t) < k * step + interval]
        if own:
            good = all(x == "-" for _, x in own)
            out.append((len(out) + 1, k, "success" if good else "fail", len(own), min(p for p, _ in own), max(p for p, _ in own)))
        k += 1
    return out


@pytest.mark.parametrize("interval,step", [(100, 1), (10, 10), (7, 3), (3, 7), (60, 0.5), (0.75, 0.5), (500, 499), (4, 2)])
def test_against_all_lines_in_all_windows(spark, interval, step):
    rng = random.Random(interval * 7 + step)
    rows = [(i, T0 + dt.timedelta(microseconds=rng.randrange(300) * 500_000 + rng.choice([0, 0, 1, 250_000])),
             rng.choice(["-", "-", "-", "FAIL", None]), 1, "x", 2) for i in range(150)]
    rows += [(200 + i, T0 + dt.timedelta(seconds=400), "-", 1, "x", 2) for i in range(50)]  # one hot instant behind a gap
    rows += [(300, None, "-", 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in B.hopping_facts(df, "ts", interval, step, F.col("label") == "-").collect())
    assert got == _plain(rows, interval, step)


def test_one_line_and_none(spark):
    one = spark.createDataFrame([(0, T0, "-", 1, "x", 2)], SCHEMA)
    assert B.hopping_facts(one, "ts", 10, 5, F.lit(True)).collect() == []  # no window begins before the last line
    assert B.hopping_facts(one.limit(0), "ts", 10, 5, F.lit(True)).collect() == []


def test_lines_are_not_copied(spark):
    """1,000 lines, 100 steps an interval: a pane a line and two rows a window, not 100 rows a line."""
    df = spark.range(1000).select(F.col("id").alias("pos"), F.timestamp_seconds(F.col("id") * 100).cast("timestamp_ntz").alias("ts"),
                                  F.lit("-").alias("label"))
    got = B.hopping_facts(df, "ts", 1000, 10, F.col("label") == "-")
    assert got.count() == 9990
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()  # what was exploded are windows, written before
