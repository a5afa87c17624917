"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.session import ensure_checkpoint_dir

#: A null doc_id sorts after every other one.
NULL_ID = np.iinfo(np.int64).max
#: Text bytes that one numpy pass handles at a time (its 8-byte arrays then stay small).
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch between the JVM and a Python task.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20

#: Rows that a Parquet scan decodes at a time.
READ_ROWS = 512
#: Bytes that a task of ``written`` gathers before it writes them out.
WRITE_BYTES = 16 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its DuckDB SQL) under ``name``."""
    def deco(fn):
        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return deco


def prepare(spark: SparkSession) -> None:
    """Name the shared folder for checkpoints, and bound an Arrow batch: texts are long, and a batch
    is held whole by a task."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": str(WRITE_BYTES)} | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])


# ---- inside tasks -----------------------------------------------------------

def release() -> None:
    """Hand freed memory back to the system: a Python worker is kept for the next task, and what it
    holds would count against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn):
    """A function of batches that gives its memory back when the task is done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()
    return run


def lean_group(fn):
    """The same for a function of a group."""
    def run(group: pa.Table) -> pa.Table:
        out = fn(group)
        release()
        return out
    return run


def lean_pair(fn):
    """The same for a function of a pair of groups."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        release()
        return out
    return run


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = pc.fill_null(col, b"" if "binary" in str(col.type) else "")
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def ids_of(col: pa.Array) -> np.ndarray:
    """A long column as int64, null as the largest value."""
    return pc.fill_null(col.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:n]


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least ``n`` of each; the longest asked for are kept."""
    kept = _TABLES.get("powers")
    if kept is None or len(kept[0]) < n:
        size = -(-n // 65536) * 65536
        kept = powers(BASE, size), powers(BASE_INV, size)
        if size <= 4 << 20:
            _TABLES["powers"] = kept
    return kept


#: A fixed table of one random 64-bit value for each byte, made from a seed.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of value(byte) * BASE**position over [i, j)."""
    up, _ = power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, whatever their place (equal bytes, equal hash)."""
    _, down = power_tables(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start])


def words_of(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; runs end with their row.

    ``data`` holds the rows back to back, ``off`` starts at 0, ``is_word`` is a table of 256 flags.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    mask = is_word[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def _mix_other(h: np.ndarray) -> np.ndarray:
    """Another finaliser, of other multipliers and shifts."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: Words of more bytes are hashed by XXH3; masks that keep the first 0 to 8 bytes of a lane.
_LANE_BYTES = 64
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated 64-bit hashes of the bytes of each word.

    Bytes go through a bijective mixer eight at a time, so different words of one length of up to
    eight bytes never collide, and no arithmetic pattern of letters (as of a polynomial) does for
    longer ones. Words over _LANE_BYTES take the two halves of XXH3-128.
    """
    size = (end - start).astype(np.uint64)
    one, two = mix(size + np.uint64(0x9E3779B97F4A7C15)), _mix_other(size ^ np.uint64(0xA0761D6478BD642F))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero((size > 0) & (size <= _LANE_BYTES))
    done = 0
    while len(live):
        left = (size[live] - np.uint64(done)).astype(np.int64)
        lane = eights[start[live] + done].view(np.uint64)[:, 0] & _KEEP[np.minimum(left, 8)]
        one[live], two[live] = mix(one[live] ^ lane), _mix_other(two[live] ^ lane)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LANE_BYTES):
        digest = xxhash.xxh3_128_digest(data[start[i]:end[i]].tobytes())
        one[i], two[i] = np.frombuffer(digest, np.uint64)
    return one, two


def byte_table(flag: Callable[[int], bool]) -> np.ndarray:
    return np.array([flag(b) for b in range(256)])
