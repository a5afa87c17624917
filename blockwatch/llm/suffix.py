"""Suffix-array dedup: bytes under a string of 50 that a document with a smaller id also has.

The corpus is cut so that equal strings meet: each 50-byte window goes by the smallest hash among
its 16-byte parts (its anchor), and neighbouring windows with one anchor make a segment. A sketch of
the 33 bytes to the left and to the right of each anchor, merged by slices (``blocks.py``), drops
anchors whose neighbourhood is in one document only: of two equal windows, one of the two sides lies
inside the window, so no shared window is lost. The segments that stay go to the slice of their
anchor, each once a block. Anchors are counted in cells first: where a cell holds more than one index
may, as for a passage that very many documents share with other text beside it, its segments are cut
to single windows, each once a block, and dealt anew by a hash of the window's own bytes.

A slice indexes its distinct segments: suffixes are sorted, the Burrows-Wheeler transform is
run-length compressed with sampled run ends, and the segments are streamed through the runs from
their ends. At each place where 50 bytes match, the rows that share them name the smallest document;
the match is long, and marked, if that is smaller than the segment's own. Blocks get a bit a window.

Texts are UTF-8 bytes, null is empty; matches stay within a document and are judged on the input.
Documents with equal ids are not smaller than each other, a null id is larger than every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.blocks import distinct_windows, flags_of, pack, repeated_windows, slice_of, slices_for, unpack
from blockwatch.llm.common import (
    NULL_ID, lean, lean_group, lean_pair, mix, prefix_hash, query, row_slices, span_hash, table, written,
)
from blockwatch.llm.rindex import RunIndex

LENGTH, ANCHOR = 50, 16
#: Bytes on one side of an anchor, with the anchor, that are in every window that has as many there.
REACH = (LENGTH - ANCHOR) // 2
SIDE = ANCHOR + REACH
#: Bytes of documents behind one slice, and of segments behind one index.
SLICE_BYTES, INDEX_BYTES = 8 << 20, 3 << 18
#: Cells of a slice in which segments are counted by their anchors.
CELLS = 64
#: Bytes of a segment beside its text: smallest document, anchor, number of windows.
HEAD = 13

_SALT = np.uint64(0x2545F4914F6CDD1D)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _anchored(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a block: start, windows, row, place and hash of the anchor, and hash of each side
    (has_left and has_right say whether it lies inside the document)."""
    names = ("start", "windows", "row", "place", "anchor", "left", "has_left", "right", "has_right")
    parts = []
    for i, j in row_slices(off):
        own, at = data[off[i]:off[j]], off[i:j + 1] - off[i]
        n = len(own)
        if n < LENGTH:
            continue
        prefix = prefix_hash(own)
        kmer = span_hash(prefix, np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
        low = (kmer & _HIGH) | np.arange(len(kmer), dtype=np.uint64)
        # The smallest of LENGTH - ANCHOR + 1 values from each place on, by doubling.
        width, reach = LENGTH - ANCHOR + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[:n - LENGTH + 1], low[width - reach:width - reach + n - LENGTH + 1])
        place = (low & ~_HIGH).astype(np.int64)
        cut = np.zeros(n + 1, np.int32)
        np.add.at(cut, np.maximum(at[1:] - LENGTH + 1, at[:-1]), 1)
        np.add.at(cut, at[1:], -1)
        inside = np.cumsum(cut[:len(place)]) == 0
        change = np.flatnonzero(np.concatenate(
            [[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])]))
        windows = np.diff(np.append(change, len(place)))
        keep = inside[change]
        start, windows = change[keep], windows[keep]
        p = place[start]
        row = np.searchsorted(at, start, side="right") - 1
        has_left, has_right = p - REACH >= at[row], p + SIDE <= at[row + 1]
        left = span_hash(prefix, np.maximum(p - REACH, 0), p + ANCHOR)
        right = mix(span_hash(prefix, p, np.minimum(p + SIDE, n)) ^ _SALT)
        # Anchors are small hashes; hashed anew they spread over the slices.
        parts.append((start + off[i], windows, row + i, p + off[i], mix(kmer[p] ^ _SALT), left, has_left, right, has_right))
    if not parts:
        none = {"anchor": np.uint64, "left": np.uint64, "right": np.uint64, "has_left": bool, "has_right": bool}
        return {k: np.zeros(0, none.get(k, np.int64)) for k in names}
    return dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))


def _sides(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([s["left"][s["has_left"]], s["right"][s["has_right"]]]),
            np.concatenate([s["row"][s["has_left"]], s["row"][s["has_right"]]]))


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sides(_anchored(data, off))


def _segments(ids: np.ndarray, data: np.ndarray, off: np.ndarray, bits, slices: int):
    """Start, windows and row of the segments near a side estimated repeated, cut to the windows that
    hold such a side; the first of each distinct one, in the order of their slices, its anchor and
    smallest document; and of every segment its distinct one."""
    s = _anchored(data, off)
    u, _, first, order = distinct_windows(*_sides(s))
    found = np.empty(len(order), bool)
    found[order] = np.repeat(flags_of(bits, len(u)), np.diff(np.append(first, len(order))))
    n = int(s["has_left"].sum())
    left, right = np.zeros(len(s["start"]), bool), np.zeros(len(s["start"]), bool)
    left[s["has_left"]], right[s["has_right"]] = found[:n], found[n:]
    # A window holds the left side if it begins REACH bytes before the anchor or sooner, the right
    # side if it begins there or later.
    turn = s["place"] - REACH
    start = np.where(left, s["start"], np.maximum(s["start"], turn))
    end = s["start"] + s["windows"]
    end = np.where(right, end, np.minimum(end, turn + 1))
    keep = (left | right) & (end > start)
    start, windows, row, anchor = start[keep], (end - start)[keep], s["row"][keep], s["anchor"][keep]
    size = windows + LENGTH - 1
    at = np.concatenate([[0], np.cumsum(size)])
    h = mix(span_hash(prefix_hash(_gather(data, start, size)), at[:-1], at[1:]) + size.astype(np.uint64))
    u, _, first, order = distinct_windows(h, row)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(u)), np.diff(np.append(first, len(order))))
    one = order[first]
    least = np.minimum.reduceat(ids[row][order], first) if len(first) else np.zeros(0, np.int64)
    place = slice_of(anchor[one], slices)
    by_slice = np.argsort(place, kind="stable")
    back = np.empty(len(by_slice), np.int64)
    back[by_slice] = np.arange(len(by_slice))
    return (start, windows, row), one[by_slice], anchor[one][by_slice], least[by_slice], place[by_slice], back[group]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges, back to back."""
    at = np.cumsum(size) - size
    return data[np.repeat(start - at, size) + np.arange(size.sum())]


def _of_kind(rows: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    every = zip(*(rows.column(c).to_pylist() for c in ("kind", "slice", "n", "bits")), strict=True)
    return [(s, n, b) for k, s, n, b in every if k == kind]


def _body(least: np.ndarray, key: np.ndarray, windows: np.ndarray, text: np.ndarray) -> bytes:
    """Segments as bytes; those with equal windows have equal keys (32 bits)."""
    return least.tobytes() + key.astype(np.uint32).tobytes() + windows.astype(np.uint8).tobytes() + text.tobytes()


def _parsed(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint32, n, 8 * n),
            np.frombuffer(raw, np.uint8, n, 12 * n).astype(np.int64), np.frombuffer(raw, np.uint8, offset=HEAD * n))


def _candidates(blocks: DataFrame, sketch: DataFrame, slices: int) -> DataFrame:
    """slice, block, n (segments), body: windows, smallest documents, anchors and bytes of a block's segments."""
    @lean_pair
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        ids, data, off = unpack(left.column("n_docs")[0].as_py(), left.column("blob")[0].as_py())
        (start, windows, _), one, anchor, least, place, _ = _segments(ids, data, off, _of_kind(right, 0), slices)
        start, windows = start[one], windows[one]
        cuts, out = np.searchsorted(place, np.arange(slices + 1)), []
        for k in range(slices):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                text = _gather(data, start[a:b], windows[a:b] + LENGTH - 1)
                low = anchor[a:b] & np.uint64(0xFFFFFFFF)
                out.append((k, block, int(b - a), _body(least[a:b], low, windows[a:b], text)))
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int64()),
                         "block": pa.array([x[1] for x in out], pa.int64()),
                         "n": pa.array([x[2] for x in out], pa.int64()),
                         "body": pa.array([x[3] for x in out], pa.binary())})

    return (blocks.groupBy("block").cogroup(sketch.groupBy("block"))
            .applyInArrow(run, "slice bigint, block bigint, n bigint, body binary"))


def _over(candidates: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the slices with a cell over the bound of an index: for each cell its first piece and its
    number of pieces, 0 where it stays whole. There are at most as many as the bound goes into the input."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _, anchor, windows, _ = _parsed(n, raw)
                cell, own = anchor % CELLS, total.setdefault(k, np.zeros((2, CELLS), np.int64))
                own[0] += np.bincount(cell, windows + LENGTH - 1, CELLS).astype(np.int64)
                own[1] += np.bincount(cell, windows, CELLS).astype(np.int64)
        for k, own in total.items():
            some = np.flatnonzero(own[0])
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k] * len(some), pa.int64()), "cell": pa.array(some),
                                              "n_bytes": pa.array(own[0][some]), "n_windows": pa.array(own[1][some])})

    cells = candidates.select("slice", "n", "body").mapInArrow(
        run, "slice bigint, cell bigint, n_bytes bigint, n_windows bigint")
    cells = cells.groupBy("slice", "cell").agg(F.sum("n_bytes").alias("b"), F.sum("n_windows").alias("w"))
    count: dict[int, np.ndarray] = {}
    for r in cells.where(F.col("b") > INDEX_BYTES).collect():
        count.setdefault(r["slice"], np.zeros(CELLS, np.int64))[r["cell"]] = -(-r["w"] * (LENGTH + HEAD) // SLICE_BYTES)
    return {k: (1 + np.cumsum(n) - n, n) for k, n in count.items()}


def _cut(n: int, raw: bytes, first_piece: np.ndarray, pieces: np.ndarray):
    """A block's segments of a slice, those in cells over the bound cut to windows: which segments
    stay whole; the distinct windows (start, smallest document, hash and piece of each); and of every
    cut window its place among all, its distinct one and its segment's document."""
    least, anchor, windows, text = _parsed(n, raw)
    cell = anchor % CELLS
    cut = np.flatnonzero(pieces[cell])
    w, size = windows[cut], windows + LENGTH - 1
    step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    start = np.repeat((np.cumsum(size) - size)[cut], w) + step
    place = np.repeat((np.cumsum(windows) - windows)[cut], w) + step
    own = np.repeat(least[cut], w)
    u, _, first, order = distinct_windows(span_hash(prefix_hash(text), start, start + LENGTH), own)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(u)), np.diff(np.append(first, len(order))))
    doc = np.minimum.reduceat(own[order], first) if len(first) else own
    one = order[first]
    its = np.repeat(cell[cut], w)[one]
    piece = first_piece[its] + ((u >> np.uint64(32)) % np.maximum(pieces[its], 1).astype(np.uint64)).astype(np.int64)
    return np.flatnonzero(pieces[cell] == 0), (start[one], doc, u, piece), (place, which, own)


def _by_piece(piece: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(piece, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1) if len(x)]


def _dealt(candidates: DataFrame, over: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Candidates with their piece of the slice: 0 of whole segments, others of cut ones."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, block, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k not in over:
                    out.append((k, 0, block, n, raw))
                    continue
                whole, (start, doc, h, piece), _ = _cut(n, raw, *over[k])
                least, anchor, windows, text = _parsed(n, raw)
                if len(whole):
                    size = windows + LENGTH - 1
                    own = _gather(text, (np.cumsum(size) - size)[whole], size[whole])
                    out.append((k, 0, block, len(whole), _body(least[whole], anchor[whole], windows[whole], own)))
                for x in _by_piece(piece):
                    own = _gather(text, start[x], np.full(len(x), LENGTH))
                    out.append((k, int(piece[x[0]]), block, len(x),
                                _body(doc[x], h[x] & np.uint64(0xFFFFFFFF), np.ones(len(x), np.int64), own)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)],
                                             names=["slice", "piece", "block", "n", "body"])

    return candidates.select("slice", "block", "n", "body").mapInArrow(
        run, "slice bigint, piece bigint, block bigint, n bigint, body binary")


def _rejoined(candidates: DataFrame, answers: DataFrame, over: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The answers to a block's whole segments and cut windows, in the order of its segments."""
    @lean_pair
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k, n, raw = (left.column(c)[0].as_py() for c in ("slice", "n", "body"))
        bits = {p: np.unpackbits(np.frombuffer(b, np.uint8), count=m).astype(bool) for p, m, b in
                zip(*(right.column(c).to_pylist() for c in ("piece", "n", "bits")), strict=True)}
        whole, (_, doc, _, piece), (place, which, own) = _cut(n, raw, *over[k])
        windows = _parsed(n, raw)[2]
        marks = np.zeros(windows.sum(), bool)
        if len(whole):
            w = windows[whole]
            marks[np.repeat((np.cumsum(windows) - windows)[whole] - (np.cumsum(w) - w), w) + np.arange(w.sum())] = bits[0]
        found = np.zeros(len(doc), bool)
        for x in _by_piece(piece):
            found[x] = bits[int(piece[x[0]])]
        marks[place] = found[which] | (doc[which] < own)
        return pa.table({"block": left.column("block"), "slice": left.column("slice"),
                         "n": pa.array([len(marks)], pa.int64()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    return (candidates.groupBy("block", "slice").cogroup(answers.groupBy("block", "slice"))
            .applyInArrow(run, "block bigint, slice bigint, n bigint, bits binary"))


def _answers(candidates: DataFrame) -> DataFrame:
    """For each window of a block's segments: whether a document smaller than the segment's has it."""
    candidates = written(candidates, "segments")
    over = _over(candidates)
    marked = _marked(_dealt(candidates, over))
    if not over:
        return marked.drop("piece")
    marked, cut = written(marked, "marks"), F.col("slice").isin(list(over))
    return marked.where(~cut).drop("piece").unionByName(_rejoined(candidates.where(cut), marked.where(cut), over))


def _first_documents(text: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the smallest document that has it, and the segments' offsets."""
    at = np.concatenate([[0], np.cumsum(size)])
    h = mix(span_hash(prefix_hash(text), at[:-1], at[1:]) + size.astype(np.uint64))
    _, _, first, order = distinct_windows(h, least)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    one, doc = order[first], np.minimum.reduceat(least[order], first)
    own = size[one]
    index = RunIndex.of(_gather(text, at[one], own), own, doc, LENGTH)
    found, offset = index.matches(own)
    windows = size - LENGTH + 1
    return _gather(found, offset[which], windows), np.concatenate([[0], np.cumsum(windows)])


def _marked(candidates: DataFrame) -> DataFrame:
    """The same for each piece of a slice."""
    limit = INDEX_BYTES

    @lean_group
    def run(group: pa.Table) -> pa.Table:
        sizes, raw = group.column("n").to_pylist(), group.column("body").to_pylist()
        col = lambda kind, skip: np.concatenate(
            [np.frombuffer(r, kind, n, skip * n) for n, r in zip(sizes, raw, strict=True)])
        least, anchor = col(np.int64, 0), col(np.uint32, 8)
        size = col(np.uint8, 12).astype(np.int64) + LENGTH - 1
        text = np.concatenate([np.frombuffer(r, np.uint8, offset=13 * n) for n, r in zip(sizes, raw, strict=True)])
        del raw
        at = np.concatenate([[0], np.cumsum(size)])
        w_at = np.concatenate([[0], np.cumsum(size - LENGTH + 1)])
        marks = np.zeros(w_at[-1], bool)
        # Indexes of a bounded size: equal windows have equal keys, so they stay together.
        part = (anchor % np.uint32(-(-len(text) // limit))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            first, _ = _first_documents(_gather(text, at[own], size[own]), size[own], least[own])
            windows = size[own] - LENGTH + 1
            to = np.repeat(w_at[own] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            marks[to] = first < np.repeat(least[own], windows)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        cut = [(int(w_at[edge[i]]), int(w_at[edge[i + 1]])) for i in range(len(sizes))]
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "piece": group.column("piece"),
                         "n": pa.array([b - a for a, b in cut], pa.int64()),
                         "bits": pa.array([np.packbits(marks[a:b]).tobytes() for a, b in cut], pa.binary())})

    return candidates.groupBy("slice", "piece").applyInArrow(
        run, "block bigint, slice bigint, piece bigint, n bigint, bits binary")


def _applied(blocks: DataFrame, answers: DataFrame, slices: int) -> DataFrame:
    @lean_pair
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, off = unpack(left.column("n_docs")[0].as_py(), left.column("blob")[0].as_py())
        (start, n, row), one, _, least, _, which = _segments(ids, data, off, _of_kind(right, 0), slices)
        windows = n[one]
        at = np.cumsum(windows) - windows
        marks = flags_of(_of_kind(right, 1), int(windows.sum()))
        # Every place of a segment: its own marks, or all of it if the block has a smaller document.
        hit = _gather(marks, at[which], n) | np.repeat(ids[row] > least[which], n)
        begin = (np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()))[hit]
        step = np.zeros(len(data) + 1, np.int32)
        step[:len(data)] += np.bincount(begin, minlength=len(data))[:len(data)].astype(np.int32)
        step -= np.bincount(begin + LENGTH, minlength=len(data) + 1).astype(np.int32)
        gone = np.cumsum(step[:-1]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
        head[inner] = gone[inner]
        total = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(head)])
        kept = data[~gone]
        kept_at = (off - total[off]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(kept_at.tobytes()),
                                                              pa.py_buffer(kept.tobytes())])
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                         "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(total[off])),
                         "n_spans": pa.array(np.diff(runs[off])), "kept": texts})

    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def remove_long_matches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row."""
    blocks = pack(docs, text)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    # About one anchor, so two sides, in 18 bytes; the estimate only sets the number of slices.
    sketch_slices, slices = slices_for(total // 9), max(8, -(-total // SLICE_BYTES))
    sketch = written(repeated_windows(blocks, _windows, sketch_slices), "sides").withColumn("kind", F.lit(0))
    marked = _answers(_candidates(blocks, sketch, slices)).withColumn("kind", F.lit(1))
    return _applied(blocks, sketch.unionByName(marked), slices)


_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(*) > 1),
o AS (SELECT doc_id, i FROM g JOIN m USING (s) WHERE first < doc_id),
b AS (SELECT doc_id, list(i ORDER BY i) AS at FROM o GROUP BY doc_id),
u AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 >= i, false) AS joins FROM o),
k AS (SELECT doc_id, i, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed,
             list(a ORDER BY a) AS aa, list(z ORDER BY a) AS zz FROM r GROUP BY doc_id)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN aa IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(aa) + 1), lambda j:
         substring(x, 2 * (CASE WHEN j = 0 THEN 0 ELSE zz[j] END) + 1,
                   2 * ((CASE WHEN j = len(aa) THEN length(x) // 2 ELSE aa[j + 1] END)
                        - (CASE WHEN j = 0 THEN 0 ELSE zz[j] END)))), '') END)) AS kept_sha256
FROM h LEFT JOIN p USING (doc_id)
"""


@query("op5_suffix_dedup", _SQL)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_long_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
