"""Documents packed into blocks, and a count-min sketch of window hashes merged by slices.

The two substring operators look for windows that several documents share. They work on blocks of
a few MB of text, packed once into compressed rows in the shared folder, so that a block keeps its
name and its order of windows whichever task reads it.

The sketch is one wide row of counters, cut into slices by the leading bits of the hash; the
number of slices grows with the input and a slice's width is fixed. Each block sends each slice
its own part of the sketch in sparse form (the sorted cells of its distinct windows, and which of
them several of its own documents hold: two bytes a window). A slice adds the parts, saturating at
two, and answers each block with one bit a window: whether the count reaches two. Counts are never
too small, so no repeated window is lost; a window alone in its cell is never sent further. A
window that millions of documents share costs one cell a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwatch.llm.common import byte_view, ids_of, lean, lean_group, written

BLOCK_BYTES = 4 << 20
#: Cells of a slice, and windows it is meant for (a unique window then meets another in 1 of 16).
CELL_BITS = 25
SLICE_WINDOWS = 1 << 21
_LOW_BITS = 16


def pack(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of documents: block, n_docs, n_bytes, blob. Null texts are empty, null ids the largest.

    Written to the shared folder: a block's name is the partition that made it and a number.
    """
    limit = BLOCK_BYTES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Level 1 of zstd; the parts are doc ids, offsets and bytes.
        press = zstandard.ZstdCompressor(level=1)
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, texts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            n = sum(len(x) for x in ids)
            raw = b"".join([np.concatenate(ids).tobytes(), np.concatenate(sizes).tobytes(), *texts])
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) + number], pa.int64()), "n_docs": pa.array([n], pa.int64()),
                "n_bytes": pa.array([held], pa.int64()), "blob": pa.array([press.compress(raw)], pa.binary())})

        for b in batches:
            data, off = byte_view(b.column(1))
            every = ids_of(b.column(0))
            i = 0
            while i < b.num_rows:
                j = int(np.searchsorted(off, off[i] + max(limit - held, 0), side="right")) - 1
                j = min(max(j, i + 1), b.num_rows)
                ids.append(every[i:j])
                sizes.append(np.diff(off[i:j + 1]))
                texts.append(data[off[i]:off[j]].tobytes())
                held += len(texts[-1])
                i = j
                if held >= limit or i < b.num_rows:
                    yield block()
                    number += 1
                    ids, sizes, texts, held = [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(
        run, "block bigint, n_docs bigint, n_bytes bigint, blob binary")
    return written(rows, "blocks", {"parquet.block.size": str(BLOCK_BYTES), "compression": "none"})


def unpack(n_docs: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, UTF-8 bytes and offsets of a block."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    ids = raw[:8 * n_docs].view(np.int64)
    off = np.concatenate([[0], np.cumsum(raw[8 * n_docs:16 * n_docs].view(np.int64))]).astype(np.int64)
    return ids, raw[16 * n_docs:], off


def slices_for(windows: int) -> int:
    return max(8, -(-windows // SLICE_WINDOWS))


def _scaled(h: np.ndarray, slices: int) -> np.ndarray:
    """Hash times slices, over 2**32: the slice above 32 bits, the place in the slice below."""
    n, low = np.uint64(slices), np.uint64(32)
    return (h >> low) * n + (((h & np.uint64(0xFFFFFFFF)) * n) >> low)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (_scaled(h, slices) >> np.uint64(32)).astype(np.int64)


def cell_of(h: np.ndarray, slices: int) -> np.ndarray:
    """Cell in its slice. Slices and cells ascend with the hash, so hashes in order are cells in order."""
    return ((_scaled(h, slices) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CELL_BITS)).astype(np.int64)


def distinct_windows(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of a block, ascending; whether several of its documents (``doc``, places
    in the block) hold each; where the windows of each begin in ``order``; and that order."""
    order = np.argsort(h)
    hs, ds = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(hs), 1), bool), hs[1:] != hs[:-1]]))
    if len(first) == 0:
        return hs, np.zeros(0, bool), first, order
    return hs[first], np.minimum.reduceat(ds, first) != np.maximum.reduceat(ds, first), first, order


def _encode(cells: np.ndarray, several: np.ndarray) -> bytes:
    """Sorted cells: counts of their high bits, then low bits, then the flags."""
    high = np.bincount(cells >> _LOW_BITS, minlength=1 << (CELL_BITS - _LOW_BITS)).astype(np.uint32)
    return high.tobytes() + (cells & 0xFFFF).astype(np.uint16).tobytes() + np.packbits(several).tobytes()


def _decode(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = 4 << (CELL_BITS - _LOW_BITS)
    high = np.repeat(np.arange(1 << (CELL_BITS - _LOW_BITS)), np.frombuffer(raw[:width], np.uint32))
    low = np.frombuffer(raw[width:width + 2 * n], np.uint16)
    flags = np.unpackbits(np.frombuffer(raw[width + 2 * n:], np.uint8), count=n).astype(bool)
    return (high << _LOW_BITS) + low, flags


Windows = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeated_windows(blocks: DataFrame, windows: Windows, slices: int) -> DataFrame:
    """block, slice, n, bits: of the block's distinct windows in that slice, ascending,
    whether the merged sketch counts at least two. ``windows(data, off)`` gives hash and place of
    the document of each window of a block."""
    @lean
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n_docs, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _, data, off = unpack(n_docs, blob)
                u, several, _, _ = distinct_windows(*windows(data, off))
                cuts = np.searchsorted(slice_of(u, slices), np.arange(slices + 1))
                some = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
                cells = cell_of(u, slices)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(some, pa.int64()), "block": pa.array([block] * len(some), pa.int64()),
                    "n": pa.array([int(cuts[s + 1] - cuts[s]) for s in some], pa.int64()),
                    "cells": pa.array([_encode(cells[cuts[s]:cuts[s + 1]], several[cuts[s]:cuts[s + 1]])
                                       for s in some], pa.binary())})

    @lean_group
    def merge(group: pa.Table) -> pa.Table:
        sketch = np.zeros(1 << CELL_BITS, np.uint8)
        rows = list(zip(*(group.column(c).to_pylist() for c in ("n", "cells")), strict=True))
        for n, raw in rows:
            cells, several = _decode(n, raw)
            twin = cells[1:] == cells[:-1]
            twice = several.copy()
            twice[1:] |= twin
            twice[:-1] |= twin
            # A block's cell adds one, or two where several windows or documents of it share the cell.
            sketch[cells] = np.minimum(sketch[cells] + 1 + twice, 2)
        bits = [np.packbits(sketch[_decode(n, raw)[0]] >= 2).tobytes() for n, raw in rows]
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "n": group.column("n"),
                         "bits": pa.array(bits, pa.binary())})

    sent = blocks.select("block", "n_docs", "blob").mapInArrow(
        parts, "slice bigint, block bigint, n bigint, cells binary")
    return sent.groupBy("slice").applyInArrow(merge, "block bigint, slice bigint, n bigint, bits binary")


def flags_of(bits: list[tuple[int, int, bytes]], total: int) -> np.ndarray:
    """Flags of a block's distinct windows from its (slice, n, bits) answers."""
    got = [np.unpackbits(np.frombuffer(raw, np.uint8), count=n) for _, n, raw in sorted(bits)]
    out = np.concatenate(got).astype(bool) if got else np.zeros(0, bool)
    if len(out) != total:
        raise RuntimeError(f"a block has {total} windows and answers for {len(out)}")
    return out
