"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ten
consecutive words of an item, or the whole of a shorter one. A window is contained in a document
only if its rarest word is (the necessary prefix for a containment of 1 is one token), so words
are ranked by their frequency in all documents and each window is indexed by its rarest word and
that word's place. A document word that is such a prefix proposes a window at one position; the
length bound (enough words left) and the positional bound (inside the same document) come next,
then all its words are compared, first by hash and then by their characters.

Items are cut into parts of at most ``PART_BYTES`` of text (one item may be longer); each part's
index is broadcast, and the documents go through one part after another in narrow passes (written
between each two), so the bound on what is broadcast does not limit the benchmark. Documents are
not shuffled.

Null and empty texts have no words, are never hit, and as items have no window. Items that share
an id count as one; a null item_id stands as "null". Repeated documents are judged each. An empty
benchmark contaminates nothing. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import (
    byte_table, byte_view, input_bytes, lean, prefix_hash, query, row_slices, span_hash, table, words_of, written,
)

WINDOW = 10
#: Bound of the item text behind one broadcast index.
PART_BYTES = 4 << 20
#: Parts that follow each other in one stage: each is a Python process of the task.
CHAIN = 2

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def _words(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes; start, end, row and hash of each word."""
    low = _LOWER[data]
    start, end, row = words_of(low, off, _WORD)
    return low, start, end, row, span_hash(prefix_hash(low), start, end)


@dataclass
class Items:
    """Words of one part of the benchmark, and its windows by their rarest words."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    vocab: np.ndarray
    names: list[str]
    first: np.ndarray        # of each window: first word,
    length: np.ndarray       # number of words,
    item: np.ndarray         # and item
    prefix: np.ndarray = None    # sorted rarest-word hashes, one for each window
    offset: np.ndarray = None    # place of that word in the window
    order: np.ndarray = None     # window of each entry of prefix

    @staticmethod
    def of(rows: list) -> Items:
        texts = [(r["text"] or "").encode() for r in rows]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        low, start, end, row, h = _words(np.frombuffer(b"".join(texts), np.uint8), off)
        count = np.bincount(row, minlength=len(texts))
        head = np.concatenate([[0], np.cumsum(count)])[:-1]
        windows = np.where(count >= WINDOW, count - WINDOW + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(texts)), windows)
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        return Items(low, start, end, h, np.unique(h), ["null" if r["item_id"] is None else str(r["item_id"]) for r in rows],
                     head[item] + within, np.minimum(count[item], WINDOW), item)

    def rank_by(self, frequency: np.ndarray) -> Items:
        """Choose each window's rarest word; ``frequency`` goes with ``vocab``."""
        rank = np.empty(len(self.vocab), np.int64)
        rank[np.lexsort((self.vocab, frequency))] = np.arange(len(self.vocab))
        best = np.full(len(self.first), len(self.vocab), np.int64)
        at = np.zeros(len(self.first), np.int64)
        ranks = rank[np.searchsorted(self.vocab, self.hash)]
        for j in range(WINDOW):
            inside = np.flatnonzero(j < self.length)
            r = ranks[self.first[inside] + j]
            better = inside[r < best[inside]]
            best[better] = ranks[self.first[better] + j]
            at[better] = j
        key = self.hash[self.first + at] if len(self.first) else np.zeros(0, np.uint64)
        self.order = np.argsort(key, kind="stable")
        self.prefix, self.offset = key[self.order], at[self.order]
        return self


def _frequencies(docs: DataFrame, text: str, items: Items) -> np.ndarray:
    """Occurrences in all documents of each word of a part of the benchmark."""
    vocab = docs.sparkSession.sparkContext.broadcast(items.vocab)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.value
        seen = np.zeros(len(own), np.int64)
        near = _filter(own)
        for b in batches:
            data, off = byte_view(b.column(0))
            for i, j in row_slices(off):
                h = _words(data[off[i]:off[j]], off[i:j + 1] - off[i])[4]
                h = h[near[h >> np.uint64(44)]]
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                seen += np.bincount(at[own[at] == h], minlength=len(own))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"w": pa.array(some), "n": pa.array(seen[some])})

    out = np.zeros(len(items.vocab), np.int64)
    if len(out):
        for r in docs.select(text).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect():
            out[r["w"]] = r["n"]
    return out


def _filter(hashes: np.ndarray) -> np.ndarray:
    near = np.zeros(1 << 20, bool)
    near[hashes >> np.uint64(44)] = True
    return near


def _find(ix: Items, near: np.ndarray, data: np.ndarray, off: np.ndarray):
    """Words of each row; document, first word, length and item of each contained window."""
    low, start, end, row, h = _words(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    word0 = np.concatenate([[0], np.cumsum(count)])
    at = np.flatnonzero(near[h >> np.uint64(44)])
    lo = np.searchsorted(ix.prefix, h[at], side="left")
    n = np.searchsorted(ix.prefix, h[at], side="right") - lo
    place = np.repeat(at, n)
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window = ix.order[entry]
    first = place - ix.offset[entry]
    # Positional and length bounds: the window begins and ends in the document of its prefix.
    doc = row[place]
    fits = (first >= word0[doc]) & (first + ix.length[window] <= word0[doc + 1])
    first, window, doc = first[fits], window[fits], doc[fits]
    for j in range(WINDOW):
        inside = j < ix.length[window]
        a = np.where(inside, first + j, 0)
        b = np.where(inside, ix.first[window] + j, 0)
        same = ~inside | (h[a] == ix.hash[b])
        first, window, doc = first[same], window[same], doc[same]
    # Equal hashes: compare the characters.
    keep = np.ones(len(first), bool)
    for k, (f, w) in enumerate(zip(first.tolist(), window.tolist(), strict=True)):
        g = int(ix.first[w])
        keep[k] = all(
            low[start[f + j]:end[f + j]].tobytes() == ix.low[ix.start[g + j]:ix.end[g + j]].tobytes()
            for j in range(int(ix.length[w])))
    first, window, doc = first[keep], window[keep], doc[keep]
    return count, doc, first - word0[doc], ix.length[window], ix.item[window]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_STATE = "n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"


def _pass(rows: DataFrame, items: Items) -> DataFrame:
    """One part of the benchmark over all rows (body, spans and items so far, and the rest)."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    names = rows.columns
    schema = rows.drop("n_words", "spans", "items").schema.simpleString()[7:-1] + ", " + _STATE
    kept = [i for i, c in enumerate(names) if c not in ("n_words", "spans", "items")]
    body, spans_at, items_at = names.index("body"), names.index("spans"), names.index("items")
    span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        near = _filter(ix.prefix)
        for b in batches:
            data, off = byte_view(b.column(body))
            words = np.zeros(b.num_rows, np.int64)
            spans = [[(x["s"], x["e"]) for x in v] for v in b.column(spans_at).to_pylist()]
            found = [set(v) for v in b.column(items_at).to_pylist()]
            for i, j in row_slices(off):
                count, doc, first, length, item = _find(ix, near, data[off[i]:off[j]], off[i:j + 1] - off[i])
                words[i:j] = count
                for d, f, n, m in zip(doc.tolist(), first.tolist(), length.tolist(), item.tolist(), strict=True):
                    spans[i + d].append((f, f + n))
                    found[i + d].add(ix.names[m])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in kept), pa.array(words),
                 pa.array([[{"s": s, "e": e} for s, e in _merged(v)] for v in spans], span_type),
                 pa.array([sorted(v) for v in found], pa.list_(pa.string()))],
                names=[*(names[k] for k in kept), "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def contained_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of its columns, or of those in ``keep``) and ``body`` (its text), with
    ``n_words``, ``spans`` (merged word ranges that are hit) and ``items`` (sorted ids)."""
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bench = benchmark.select("item_id", "text")
    parts = max(1, -(-input_bytes(bench, "text") // PART_BYTES))
    rows = rows.select("*", F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"),
                       F.array().cast("array<string>").alias("items"))
    for p in range(parts):
        if p and p % CHAIN == 0:
            rows = written(rows, "contained")
        own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        items = Items.of(own.collect())
        rows = _pass(rows, items.rank_by(_frequencies(docs, text, items)))
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark window."""
    return contained_windows(docs, benchmark).where(F.size("spans") == 0).select("row.*")


_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
_SQL = _SQL.replace("\\\\", "\\")


@query("op3_decontaminate", _SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contained_windows(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
