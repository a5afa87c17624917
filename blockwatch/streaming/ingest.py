"""Structured Streaming forms of ingest, windowed blocks, and scoring.

Streams are anchored at the epoch (``window``/``session_window``), batch time
blocks at min(ts); positions (fixed-count blocks, dense ids) need a global order
and exist only in the batch forms. All queries write with a checkpoint location
under the shared ``spark.checkpoint.dir`` so a restarted job resumes exactly.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from blockwatch.functions import parsing
from blockwatch.operators.neighbors import _collect_container, _normalize_rows, best_of_slice, vector_rows
from blockwatch.operators.blocks import all_normal
from blockwatch.operators.rules import verdict_cascade
from blockwatch.session import written


# ---- X1: raw text stream -> parsed lines -> append sink ------------------------------------------

def parse_stream(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """L1-L3 on a stream of raw lines; non-matching lines are dropped (L2)."""
    return (parsing.parse_lines(raw, value_col)
            .select("p.ts_text", "p.ts", "p.level", "p.content", "p.status"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append", rocksdb: bool = False) -> None:
    """Process everything available, write it with exactly-once file-sink semantics, stop."""
    if rocksdb:
        df.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ---- X2: event-time blocks with a watermark ---------------------------------------------------------

def stream_lines(events: DataFrame) -> DataFrame:
    """The V_lines projection for a stream of events (no positions; ts as TIMESTAMP for watermarks)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (events.withColumn("k", k).select(
        F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.when((F.col("event_type") == "error") & ((F.col("k") < 3) | (F.col("value") > 200)),
               F.lit("FAIL")).otherwise(F.lit("-")).alias("label"),
        F.concat_ws(":", "event_type", F.col("k").cast("string")).alias("template_id")))


#: The event time of a marker that ends the input: later than any line. It moves the watermark past
#: every open window, session and block, and is no line itself.
END_OF_INPUT = "2262-01-01 00:00:00"


def end_marker(events: DataFrame, ts: str = "ts") -> DataFrame:
    """One row of the columns of ``events``, null but for the time: append it to a stream's source when
    nothing more will come, and what is open leaves by the watermark."""
    spark = events.sparkSession
    return spark.range(1).select(*[
        (F.to_timestamp_ntz(F.lit(END_OF_INPUT)) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in events.schema.fields])


def watermarked(lines: DataFrame, watermark: str) -> DataFrame:
    """``lines`` with a watermark, the end marker taken out behind it. (A condition on the event time is
    not pushed below the watermark, so the marker still moves it.)"""
    return lines.withWatermark("ts", watermark).where(F.col("ts") < F.lit(END_OF_INPUT).cast("timestamp"))


def window_blocks(lines: DataFrame, interval: str, watermark: str, slide: str | None = None,
                  normal: Column | None = None) -> DataFrame:
    """B2/B3 on a stream: epoch-aligned tumbling (or sliding) windows, emitted in append
    mode once the watermark passes the window end. Aggregates are decomposable, so
    the state per window is a handful of values, not the window's rows."""
    normal = normal if normal is not None else (F.col("label") == "-")
    w = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return (watermarked(lines, watermark).groupBy(w.alias("window"))
            .agg(F.count(F.lit(1)).alias("n_lines"), all_normal(normal).alias("status"),
                 F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")))


def session_blocks(lines: DataFrame, key: str, gap: str, watermark: str,
                   normal: Column | None = None) -> DataFrame:
    """B4 (idle gap) on a stream: ``session_window`` per key."""
    normal = normal if normal is not None else (F.col("label") == "-")
    return (watermarked(lines, watermark).groupBy(key, F.session_window("ts", gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_lines"), all_normal(normal).alias("status"),
                 F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")))


# ---- X3: stream-static scoring ----------------------------------------------------------------------

def _score_stream_fn(bc, k: int, vec_col: str):
    # Task bodies refer to helper functions, never to module objects: a module pickled by
    # value would carry its whole namespace to the executors.
    def score(batches):
        ids, labels, cmat = bc.value
        cnorm = _normalize_rows(cmat)
        for b in batches:
            if b.num_rows == 0:
                continue
            best = [labels[top].mean(axis=1) for _, top, _ in best_of_slice(vector_rows(b[vec_col]), None, ids, cnorm, k)]
            yield b.drop_columns([vec_col]).append_column("score", pa.array(100.0 * (1.0 - np.concatenate(best)), pa.float64()))
    return score


def score_stream(blocks: DataFrame, container: DataFrame, k: int, max_rows: int,
                 id_col: str = "block_id", vec_col: str = "embedding") -> DataFrame:
    """G1-G4 on a stream of blocks: anomaly percent against a static, bounded container.

    Other input columns pass through unchanged; no join with the stream is needed.
    """
    n = container.count()
    if n > max_rows:
        raise ValueError(f"container has {n} rows, above its bound {max_rows}")
    bc = blocks.sparkSession.sparkContext.broadcast(_collect_container(container, id_col, vec_col, "label"))
    fields = [f for f in blocks.schema.fields if f.name != vec_col] + [T.StructField("score", T.DoubleType())]
    return blocks.mapInArrow(_score_stream_fn(bc, k, vec_col), T.StructType(fields))


# The template sets of the rules are tables with versions: a job that learns anew publishes the next
# version, and a running stream takes it up with its next micro-batch. Nothing of them is in a plan.

def latest_sets(spark: SparkSession, base: str) -> tuple[int, str]:
    """Number and folder of the newest published version."""
    row = spark.read.schema("version long, path string").parquet(f"{base}/versions").agg(
        F.max(F.struct("version", "path")).alias("v")).first()["v"]
    if row is None:
        raise ValueError(f"no template sets are published under {base}")
    return row["version"], row["path"]


def publish_sets(base: str, normal: DataFrame, abnormal: DataFrame, bad_lists: DataFrame, threshold: DataFrame) -> int:
    """Write the template sets (``template``), the known bad sequences (``event_list``) and the threshold
    (one row, ``threshold``) as the next version under ``base``. The version counts from the moment that
    it is entered into ``versions``, when its tables are complete."""
    spark = normal.sparkSession
    try:
        version = latest_sets(spark, base)[0] + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        version = 1
    path = f"{base}/v{version:08d}-{uuid.uuid4().hex}"
    for name, table in (("normal", normal.select("template").distinct()), ("abnormal", abnormal.select("template").distinct()),
                        ("sequences", bad_lists.select("event_list").distinct()), ("threshold", threshold.select("threshold"))):
        table.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{base}/versions")
    return version


def verdicts_with_published_sets(blocks: DataFrame, base: str, inclusive: bool = True) -> DataFrame:
    """R4-R10 of ``blocks`` (block_id, event_list, score) with the newest published sets, as joins;
    ``version`` says which they were."""
    spark = blocks.sparkSession
    version, path = latest_sets(spark, base)
    sets = {n: spark.read.parquet(f"{path}/{n}") for n in ("normal", "abnormal", "sequences", "threshold")}
    out = verdict_cascade(blocks, sets["normal"], sets["abnormal"], sets["sequences"],
                          sets["threshold"].select("threshold").scalar(), inclusive=inclusive)
    return out.withColumn("version", F.lit(version))


def run_verdicts(scored: DataFrame, base: str, path: str, checkpoint: str, inclusive: bool = True) -> None:
    """Verdicts of a stream of scored blocks, written under ``path`` by micro-batch. A batch that is
    run again after a failure overwrites its own folder, so each block is written once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        # The batch is read by several joins: it is written once, so that its blocks are not made anew.
        own = written(batch, "scored-batch")
        verdicts_with_published_sets(own, base, inclusive).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = scored.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_of(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file stream over a parquet folder written earlier (schema from the folder)."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


# Python task bodies in this module travel with the task (see session.ship_by_value).
from blockwatch.session import ship_by_value  # noqa: E402

ship_by_value(__name__)


# ---- B1 per key on a stream: transformWithState and event-time timers -----------------------------

KEYED_BLOCK_SCHEMA = ("user_id long, block_no long, n_lines long, first_line long, last_line long, "
                      "last_ts timestamp, status string")
_OUT_SCHEMA = "user_id long, block_no long, n_lines long, first_line long, last_line long, last_us long, ok boolean"
_NAMES = [c.split()[0] for c in _OUT_SCHEMA.split(", ")]
#: Buckets that the keys are dealt to by hash: the state of a bucket is that of all its keys, so its size
#: is a share of 1 / KEY_BUCKETS of all (or that of its largest key). A checkpoint keeps its number.
KEY_BUCKETS = 512
#: A waiting line, and the pending block of a key. ``none`` marks the null key, ``unnumbered`` a null line number.
_LINE = np.dtype([("none", "?"), ("key", "i8"), ("us", "i8"), ("unnumbered", "?"), ("line_no", "i8"), ("ok", "?")])
_PENDING = np.dtype([("none", "?"), ("key", "i8"), ("block", "i8"), ("n", "i8"), ("no_first", "?"), ("first", "i8"),
                     ("no_last", "?"), ("last", "i8"), ("last_us", "i8"), ("ok", "?")])
#: Milliseconds at which what is open closes for good: a day before the end marker's time, so that
#: the marker's watermark passes it whatever its delay up to a day.
_END_MS = int((pd.Timestamp(END_OF_INPUT) - pd.Timestamp("1970-01-01") - pd.Timedelta(days=1)) // pd.Timedelta(milliseconds=1))


def _heads(pending: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """``pending`` and an empty block 0 for each new key of ``lines``, in the order of keys."""
    new = np.zeros(len(lines), _PENDING)
    new["none"], new["key"], new["ok"] = lines["none"], lines["key"], True
    both = np.concatenate([pending, new])
    both = both[np.lexsort((both["key"], both["none"]))]  # stable: what is pending stays before
    return both[_changes(both)]


def _changes(rows: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its key, for rows in the order of keys."""
    first = np.ones(len(rows), bool)
    first[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["none"][1:] != rows["none"][:-1])
    return first


def _next_blocks(pending: np.ndarray, lines: np.ndarray, size: int, idle_us: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pending blocks of all keys and ``lines`` that come next: the blocks that these make, as rows of
    ``_PENDING`` in the order of key and block (those without lines included), and whether each is its
    key's last."""
    heads = _heads(pending, lines)
    items = np.zeros(len(lines), _PENDING)
    for to, of in (("none", "none"), ("key", "key"), ("no_first", "unnumbered"), ("first", "line_no"),
                   ("no_last", "unnumbered"), ("last", "line_no"), ("last_us", "us"), ("ok", "ok")):
        items[to] = lines[of]
    items["n"] = 1
    # A key's pending block, then its lines in event-time order.
    is_line = np.arange(len(heads) + len(items)) >= len(heads)
    items = np.concatenate([heads, items])
    order = np.lexsort((items["ok"], items["first"], items["no_first"], np.where(is_line, items["last_us"], 0), is_line,
                        items["key"], items["none"]))
    items, is_line = items[order], is_line[order]
    at = np.arange(len(items))
    # A run starts at the pending block, and at a line after an idle time; its lines are counted from ``origin``.
    starts = ~is_line
    if idle_us is not None:
        us, n = items["last_us"], items["n"]
        starts[1:] |= is_line[1:] & (n[:-1] > 0) & (us[1:] > us[:-1] + idle_us)
    origin = np.where(is_line, at, at + 1 - items["n"])[np.maximum.accumulate(np.where(starts, at, 0))]
    # An empty pending block is the start of its first line's.
    opens = np.where(is_line, (at - origin) % size == 0, True)
    after_empty = np.concatenate([[False], (~is_line & (items["n"] == 0))[:-1]]) & is_line
    opens &= ~after_empty
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(items)) - 1
    out = items[first]
    if len(out):
        empty = (out["n"] == 0) & (last > first)
        for c in ("no_first", "first"):
            out[c][empty] = items[c][first[empty] + 1]
        out["n"] = np.add.reduceat(items["n"], first)
        out["ok"] = np.logical_and.reduceat(items["ok"], first)
        for c in ("no_last", "last", "last_us"):
            out[c] = items[c][last]
        head = np.flatnonzero(_changes(out))
        of = np.cumsum(_changes(out)) - 1
        out["block"] = out["block"][head][of] + np.arange(len(out)) - head[of]
    return out, np.append(_changes(out)[1:], [True] * (len(out) > 0))


class KeyedBlocks(StatefulProcessor):
    """Blocks of ``size`` consecutive lines of a key, in the order of event time; for the keys of a bucket.

    State of a bucket: the pending block of each key (its number, lines so far, first and last line,
    whether all are normal) and the lines that the watermark has not passed, as later lines may still go
    before them. Both are arrays, so that a bucket of many keys is read, taken on and stored at once.
    A timer at the oldest waiting line takes the passed ones in order. It also closes blocks that are
    not full: ``idle_ms`` after their last line, or when the input ends.
    """

    def __init__(self, size: int, idle_ms: int | None):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "blocks binary")
        self.waiting = handle.getListState("waiting", "lines binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """A timer at ``ms``, unless an earlier one waits; one that it replaces does nothing when it expires."""
        if not self.timer.exists() or ms < self.timer.get()[0]:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        oldest = None
        for pdf in rows:
            new = np.zeros(len(pdf), _LINE)
            for c in _LINE.names:
                new[c] = pdf[c].to_numpy()
            if len(new):
                self.waiting.appendValue((new.tobytes(),))
                oldest = min(int(new["us"].min()), _END_MS * 1000 if oldest is None else oldest)
        if oldest is not None:
            self._wake(oldest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.timer.exists() or self.timer.get()[0] > passed:
            return iter(())
        self.timer.clear()
        chunks = [np.frombuffer(bytes(r[0]), _LINE) for r in self.waiting.get()] if self.waiting.exists() else []
        lines = np.concatenate(chunks) if chunks else np.zeros(0, _LINE)
        ready = lines["us"] <= passed * 1000
        rest, lines = lines[~ready], lines[ready]
        if len(lines):
            if len(rest):
                self.waiting.put([(rest.tobytes(),)])
            else:
                self.waiting.clear()
        pending = np.frombuffer(bytes(self.pending.get()[0]), _PENDING) if self.pending.exists() else np.zeros(0, _PENDING)
        blocks, newest = _next_blocks(pending, lines, self.size, None if self.idle_ms is None else self.idle_ms * 1000)
        ends = np.full(len(blocks), _END_MS - 1)
        if self.idle_ms is not None:
            ends = np.minimum(ends, blocks["last_us"] // 1000 + self.idle_ms + 1)
        closed = (blocks["n"] > 0) & ((blocks["n"] == self.size) | ~newest | (ends <= passed))
        done, after = blocks[closed], blocks[newest].copy()
        shut = closed[newest]
        after["block"] += shut
        after["n"][shut], after["ok"][shut] = 0, True
        self.pending.update((after.tobytes(),))
        wake = [int(rest["us"].min()) // 1000 + 1] if len(rest) else []
        wake += [int(ends[newest][~shut & (after["n"] > 0)].min())] if (after["n"] > 0).any() else []
        if wake:
            self._wake(min(wake))
        if not len(done):
            return iter(())
        return iter([pd.DataFrame(dict(zip(_NAMES, (
            pd.array(done["key"], "Int64"), done["block"], done["n"], pd.array(done["first"], "Int64"),
            pd.array(done["last"], "Int64"), done["last_us"], done["ok"]), strict=True)))
            .assign(user_id=lambda d: d["user_id"].mask(done["none"]), first_line=lambda d: d["first_line"].mask(done["no_first"]),
                    last_line=lambda d: d["last_line"].mask(done["no_last"]))])

    def close(self) -> None:
        pass


def keyed_count_blocks(lines: DataFrame, size: int, watermark: str, key: str = "user_id",
                       idle_ms: int | None = None, buckets: int = KEY_BUCKETS) -> DataFrame:
    """B1 per key on a stream: every ``size`` consecutive lines of a key, in event-time order, form one
    block, emitted (append) when the watermark has passed its last line. A block that is not full is
    emitted ``idle_ms`` after its last line (event time), if given, else when the input ends
    (``end_marker``). Lines that arrive out of order by less than the watermark's delay (at most a
    day) find their place; later ones are dropped by the watermark, as in the other stream blocks.

    Keys are dealt to ``buckets`` by hash; the state of a bucket is the pending blocks of its keys and
    their lines within the watermark's delay. Needs the RocksDB state store
    (``run_available_now(..., rocksdb=True)`` sets it).
    """
    # A null key is a key of its own: it is told apart by a flag, as keys reach the processor without nulls.
    own = watermarked(lines, watermark).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bw_bucket"), "ts", F.col(key).isNull().alias("none"),
        F.coalesce(key, F.lit(0)).cast("bigint").alias("key"), F.unix_micros("ts").alias("us"),
        F.col("line_no").isNull().alias("unnumbered"), F.coalesce("line_no", F.lit(0)).cast("bigint").alias("line_no"),
        F.coalesce(F.col("label") == "-", F.lit(False)).alias("ok"))
    out = own.groupBy("_bw_bucket").transformWithStateInPandas(KeyedBlocks(size, idle_ms), _OUT_SCHEMA, "append", "eventTime")
    return out.select("user_id", "block_no", "n_lines", "first_line", "last_line", F.timestamp_micros("last_us").alias("last_ts"),
                      F.when(F.col("ok"), "success").otherwise("fail").alias("status"))
