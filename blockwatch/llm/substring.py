"""Substring dedup: words under a window of 13 words that a document with a smaller id also has.

A count-min sketch, made block by block and merged by slices (``blocks.py``), overestimates how
often each window occurs. Only windows estimated repeated go to the second pass, which groups them
exactly by a digest of their words (64 bits made from another hash of each word's bytes, unrelated to
the one of the sketch, and 32 of the sketch's own beside those that chose the slice) and takes the
smallest doc_id of each. A block sends a window once, however many of its documents hold it, so a
hot window costs one entry a block; no window is lost, because the sketch never counts too few.

Windows are judged on the input. Null and empty texts have no words; texts of fewer than 13 words
have no window. Documents with equal ids do not count as smaller than each other, and a null id is
larger than every other. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.blocks import distinct_windows, flags_of, pack, repeated_windows, slice_of, slices_for, unpack
from blockwatch.llm.common import (
    NULL_ID, byte_table, lean_group, lean_pair, power_tables, query, row_slices, span_hash, table, word_hashes,
    words_of, written,
)

WINDOW = 13
_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_LOW32 = np.uint64(0xFFFFFFFF)


def _block_words(data: np.ndarray, off: np.ndarray):
    """Start, end, row and two unrelated hashes of each word of a block."""
    got = []
    for i, j in row_slices(off):
        own = data[off[i]:off[j]]
        start, end, row = words_of(own, off[i:j + 1] - off[i], _WORD)
        got.append((start + off[i], end + off[i], row + i, *word_hashes(own, start, end)))
    if not got:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _over_windows(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the sequence of WINDOW words that begins at each of ``first``."""
    up, _ = power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[:len(h)], out=total[1:])
    return span_hash(total, first, first + WINDOW)


def _starts(row: np.ndarray) -> np.ndarray:
    """Words that begin a window: the last of its words is in the same document."""
    if len(row) < WINDOW:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[WINDOW - 1:] == row[:len(row) - WINDOW + 1])


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, row, h, _ = _block_words(data, off)
    first = _starts(row)
    return _over_windows(h, first), row[first]


def _windows_of(ids: np.ndarray, data: np.ndarray, off: np.ndarray):
    """Words (with their second hash) and windows of a block; its distinct windows: hash, smallest id, where each one's
    windows begin in their order, and that order."""
    start, end, row, h, other = _block_words(data, off)
    first = _starts(row)
    u, _, at, order = distinct_windows(_over_windows(h, first), row[first])
    least = np.minimum.reduceat(ids[row[first]][order], at) if len(at) else np.zeros(0, np.int64)
    return start, end, row, other, first, u, least, at, order


def _answers(table_: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    rows = zip(*(table_.column(c).to_pylist() for c in ("kind", "slice", "n", "bits")), strict=True)
    return [(s, n, b) for k, s, n, b in rows if k == kind]


def _candidates(blocks: DataFrame, bits: DataFrame, slices: int) -> DataFrame:
    """slice, block, n, keys: digests and smallest ids of a block's windows estimated repeated."""
    @lean_pair
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = left.column("block")[0].as_py(), []
        ids, data, off = unpack(left.column("n_docs")[0].as_py(), left.column("blob")[0].as_py())
        _, _, _, other, first, u, least, at, order = _windows_of(ids, data, off)
        some = flags_of(_answers(right, 0), len(u))
        u, least, one = u[some], least[some], order[at[some]]
        second = _over_windows(other, first[one])
        cuts = np.searchsorted(slice_of(u, slices), np.arange(slices + 1))
        for s in range(slices):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out.append((s, block, int(b - a), second[a:b].tobytes() + least[a:b].tobytes()
                            + (u[a:b] & _LOW32).astype(np.uint32).tobytes()))
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int64()),
                         "block": pa.array([x[1] for x in out], pa.int64()),
                         "n": pa.array([x[2] for x in out], pa.int64()),
                         "keys": pa.array([x[3] for x in out], pa.binary())})

    return (blocks.groupBy("block").cogroup(bits.groupBy("block"))
            .applyInArrow(run, "slice bigint, block bigint, n bigint, keys binary"))


def _earlier(candidates: DataFrame) -> DataFrame:
    """For each entry of a block: whether another block has the window under a smaller id."""
    @lean_group
    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_pylist()
        raw = group.column("keys").to_pylist()
        second = np.concatenate([np.frombuffer(r, np.uint64, n) for n, r in zip(sizes, raw, strict=True)])
        least = np.concatenate([np.frombuffer(r, np.int64, n, 8 * n) for n, r in zip(sizes, raw, strict=True)])
        low = np.concatenate([np.frombuffer(r, np.uint32, n, 16 * n) for n, r in zip(sizes, raw, strict=True)])
        order = np.lexsort((low, second))
        new = np.ones(len(order), bool)
        new[1:] = (second[order][1:] != second[order][:-1]) | (low[order][1:] != low[order][:-1])
        group_of = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        found = np.empty(len(order), bool)
        found[order] = smallest[group_of] < least[order]
        at = np.concatenate([[0], np.cumsum(sizes)])
        bits = [np.packbits(found[at[i]:at[i + 1]]).tobytes() for i in range(len(sizes))]
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "n": group.column("n"),
                         "bits": pa.array(bits, pa.binary())})

    return candidates.groupBy("slice").applyInArrow(run, "block bigint, slice bigint, n bigint, bits binary")


def _kept_text(data: np.ndarray, off: np.ndarray, start, end, row, removed) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each row joined by one space: bytes and row offsets."""
    s, e, r = start[~removed], end[~removed], row[~removed]
    joined = np.zeros(len(s), bool)
    joined[:-1] = r[1:] == r[:-1]  # another kept word follows: the byte behind this one becomes the space
    out = data.copy()
    out[e[joined]] = 32
    step = np.zeros(len(data) + 2, np.int8)
    np.add.at(step, s, 1)
    np.add.at(step, e + joined, -1)
    keep = np.cumsum(step[:len(data)], dtype=np.int8).astype(bool)
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[off]


def _applied(blocks: DataFrame, answers: DataFrame, slices: int) -> DataFrame:
    @lean_pair
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, off = unpack(left.column("n_docs")[0].as_py(), left.column("blob")[0].as_py())
        start, end, row, _, first, u, least, at, order = _windows_of(ids, data, off)
        some = flags_of(_answers(right, 0), len(u))
        elsewhere = np.zeros(len(u), bool)
        elsewhere[some] = flags_of(_answers(right, 1), int(some.sum()))
        sizes = np.diff(np.append(at, len(order)))
        by_window = first[order]
        hit = by_window[np.repeat(elsewhere, sizes) | (ids[row[by_window]] > np.repeat(least, sizes))]
        step = np.zeros(len(row) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        removed = np.cumsum(step[:-1]) > 0
        kept, at = _kept_text(data, off, start, end, row, removed)
        texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int32).tobytes()),
                                            pa.py_buffer(kept.tobytes()))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                         "n_words": pa.array(np.bincount(row, minlength=len(ids)), pa.int64()),
                         "n_removed": pa.array(np.bincount(row[removed], minlength=len(ids)), pa.int64()),
                         "kept": texts})

    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of every row."""
    blocks = pack(docs, text)
    # A word has at least one byte and one separator; the estimate only sets the number of slices.
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    slices = slices_for(total // 6)
    sketch = written(repeated_windows(blocks, _windows, slices), "sketch").withColumn("kind", F.lit(0))
    exact = _earlier(_candidates(blocks, sketch, slices)).withColumn("kind", F.lit(1))
    return _applied(blocks, sketch.unionByName(exact), slices)


_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (win) WHERE first < doc_id),
e AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS t
      FROM e ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(kept, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""".replace("\\\\", "\\")


@query("op8_substring_dedup", _SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
