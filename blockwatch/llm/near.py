"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide.

Shingles are five consecutive words (runs without white space); a text of fewer words is one
shingle. Words count as equal if a 64-bit hash of their bytes is; texts are the same if two unrelated
hashes of their words are. Texts with the same words are one representative from the start. Each representative has a
MinHash signature, dealt to the trees of a forest as paths of ``MAX_DEPTH`` values. Two texts meet
in a tree if their paths share a prefix; the prefix is shortened from the full path until pairs at
the threshold meet in some tree with at least the target recall (``prefix_depth``). Texts are
sorted by prefix by the shuffle; only the link to the first of a prefix is made, so a prefix that
very many share costs one row a text.

Texts that prefixes connect are verified together: all pairs of such a candidate group have their
exact Jaccard similarity taken, from products of their shingle incidence. Groups are packed into
bins; a large group is split into parts and each pair of parts is a bin of its own, so no task
holds more than two parts. Links are counted there, never emitted as pairs; what leaves a bin are
counts and a spanning forest of the links, whose components are the classes.

Each row gets ``class_id`` (the smallest doc_id of its class; its own without links) and
``n_links`` (other rows at or over the threshold, copies among them). Texts without words, null ones
too, link to nothing. A null doc_id sorts last; repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwatch.llm.common import (
    byte_table, byte_view, lean, lean_group, mix, power_tables, query, row_slices, span_hash, table, word_hashes,
    words_of, written,
)
from blockwatch.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 32, 8, 0.9999
#: Texts and bytes of one part of a large group, and bytes of a bin of small ones.
PART_TEXTS, PART_BYTES = 1024, 4 << 20

_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_RANDOM = np.random.default_rng(20240307).integers(1, 1 << 63, (TREES * MAX_DEPTH, 2), dtype=np.uint64)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = MAX_DEPTH,
                 recall: float = TARGET_RECALL) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _shingles(data: np.ndarray, off: np.ndarray):
    """Words of each row; hash and row of each shingle; two 64-bit digests of each row's words."""
    n = len(off) - 1
    start, end, row = words_of(data, off, _WORD)
    h, other = word_hashes(data, start, end)
    count = np.bincount(row, minlength=n)
    word0 = np.concatenate([[0], np.cumsum(count)])

    def sequence(values: np.ndarray):
        up, _ = power_tables(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[:len(values)], out=total[1:])
        return lambda a, b: span_hash(total, a, b)

    hashed = sequence(h)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    s_row = np.repeat(np.arange(n), shingles)
    first = word0[s_row] + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    s = hashed(first, first + np.minimum(count[s_row], SHINGLE))
    digest = (hashed(word0[:-1], word0[1:]), sequence(other)(word0[:-1], word0[1:]))
    return count, s, s_row, digest


def _digests(pair: tuple[np.ndarray, np.ndarray], count: np.ndarray) -> pa.Array:
    """Digests as 16-byte values, null where a row has no words."""
    raw = np.stack(pair, axis=1).astype(">u8").tobytes()
    return pa.array([raw[16 * i:16 * i + 16] if c else None for i, c in enumerate(count.tolist())], pa.binary())


def _paths(s: np.ndarray, s_row: np.ndarray, n: int, depth: int) -> np.ndarray:
    """For each row and tree, a 64-bit hash of the first ``depth`` values of its path."""
    out = np.zeros((n, TREES), np.int64)
    has = np.flatnonzero(np.bincount(s_row, minlength=n))
    if len(has) == 0:
        return out
    at = np.searchsorted(s_row, has)
    low = (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for t in range(TREES):
            label = np.full(len(has), t + 1, np.uint64)
            for a, b in _RANDOM[t * MAX_DEPTH:t * MAX_DEPTH + depth]:
                least = np.minimum.reduceat((low ^ np.uint32(b >> np.uint64(31))) * np.uint32((a >> np.uint64(31)) | np.uint64(1)), at)
                label = mix(label * np.uint64(0x9E3779B97F4A7C15) + least)
            out[has, t] = label.view(np.int64)
    return out


def signatures(docs: DataFrame, depth: int, text: str = "text") -> DataFrame:
    """doc_id, digest of the words (null without words), n_bytes, paths of every row."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = byte_view(b.column(1))
            for i, j in row_slices(off):
                count, s, s_row, digest = _shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
                paths = _paths(s, s_row, j - i, depth)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), _digests(digest, count), pa.array(np.diff(off[i:j + 1])),
                     pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * TREES), pa.array(paths.ravel()))],
                    names=["doc_id", "digest", "n_bytes", "paths"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(
        run, "doc_id bigint, digest binary, n_bytes bigint, paths array<bigint>")


def with_digest(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row as ``row`` (a struct of its columns, or those in ``keep``), and the digest of its words."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = byte_view(b.column(1))
            for i, j in row_slices(off):
                count, _, _, digest = _shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _digests(digest, count)],
                                                 names=["row", "digest"])

    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, digest binary")


def _similar(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Whether each pair of two lists of sets (or of one list) reaches the threshold, exactly."""
    every = sets + (others or [])
    size = np.array([len(x) for x in every])
    ids, n = np.concatenate(every), len(sets)
    owner = np.repeat(np.arange(len(every)), size)
    _, col, df = np.unique(ids, return_inverse=True, return_counts=True)
    shared = df[col] > 1  # a shingle of one set adds to no intersection
    col, owner = col[shared], owner[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    width, right = int(col[-1]) + 1 if len(col) else 0, n if others is not None else 0
    both = np.zeros((n, len(every) - right), np.float32)
    for c in range(0, width, 2048):  # a band of shingles at a time: 0/1 incidence, counts below 2**24
        a, b = np.searchsorted(col, [c, c + 2048])
        x = np.zeros((len(every), min(2048, width - c)), np.float32)
        x[owner[a:b], col[a:b] - c] = 1
        both += x[:n] @ x[right:].T
    total = size[:n, None] + size[None, right:]
    # J >= p/q as integers: both * q >= p * (total - both).
    return both.astype(np.int64) * 5 >= 4 * (total - both.astype(np.int64))


def _forest(similar: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(texts: DataFrame) -> DataFrame:
    """digest, links (rows linked, by their copies) and root, of the texts of each bin."""
    @lean_group
    def run(group: pa.Table) -> pa.Table:
        data, off = byte_view(group.column("body"))
        digest = group.column("digest").to_pylist()
        copies = group.column("copies").to_numpy()
        comp = group.column("comp").to_pylist()
        part = group.column("part").to_numpy()
        whole = group.column("whole").to_pylist()
        sets: list[np.ndarray] = []
        for i, j in row_slices(off):
            _, s, s_row, _ = _shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
            sets += [np.unique(x) for x in np.split(s, np.searchsorted(s_row, np.arange(1, j - i)))]
        members: dict[bytes, list[int]] = {}
        for i, c in enumerate(comp):
            members.setdefault(c, []).append(i)
        out = []
        for own in members.values():
            left = [i for i in own if part[i] == 0]
            right = [i for i in own if part[i] == 1]
            if whole[own[0]]:
                near = _similar([sets[i] for i in left])
                np.fill_diagonal(near, False)
                links = near @ copies[left]
                root = _forest(near)
                out += [(digest[left[k]], int(links[k]), digest[left[root[k]]]) for k in range(len(left))]
            elif left and right:
                # Links between the parts only; those inside a part have their own bin. With one
                # part empty there are none.
                near = _similar([sets[i] for i in left], [sets[i] for i in right])
                n = len(left)
                square = np.zeros((n + len(right),) * 2, bool)
                square[:n, n:], square[n:, :n] = near, near.T
                root = _forest(square)
                links = np.concatenate([near @ copies[right], near.T @ copies[left]])
                both = left + right
                out += [(digest[both[k]], int(links[k]), digest[both[root[k]]]) for k in range(len(both))]
        return pa.table({"digest": pa.array([x[0] for x in out], pa.binary()),
                         "links": pa.array([x[1] for x in out], pa.int64()),
                         "root": pa.array([x[2] for x in out], pa.binary())})

    return texts.groupBy("bin").applyInArrow(run, "digest binary, links bigint, root binary")


def _candidate_groups(reps: DataFrame) -> DataFrame:
    """digest, comp: texts that prefixes connect."""
    paths = reps.select("digest", F.explode("paths").alias("path"))
    heads = paths.groupBy("path").agg(F.min("digest").alias("head"), F.count("*").alias("n")).where("n > 1")
    # A text is linked to the smallest of its heads (one a tree at most), and its other heads are linked to
    # that one: the same components, with as many links as texts and few between heads.
    near = (paths.join(heads, "path").groupBy("digest").agg(F.collect_set("head").alias("heads"))
            .withColumn("head", F.array_min("heads")))
    own = near.select("digest", "head")
    between = near.select(F.explode("heads").alias("digest"), "head").distinct()
    edges = own.unionByName(between).where("digest <> head")
    return components(edges, "digest", "head").select(F.col("node").alias("digest"), F.col("root").alias("comp"))


def _binned(members: DataFrame, bins: int) -> DataFrame:
    """Members with their bins: one for a small group, one for each pair of parts of a large one."""
    sizes = (members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
             .select("comp", F.greatest(F.ceil(F.col("n") / PART_TEXTS), F.ceil(F.col("b") / PART_BYTES))
                     .cast("int").alias("parts")))
    # Large groups are hot keys of this join; adaptive execution splits them.
    own = members.join(sizes, "comp").withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    small = own.where("parts <= 1").select(
        "digest", "comp", "copies", F.lit(0).alias("part"), F.lit(True).alias("whole"),
        F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("string").alias("bin"))
    large = own.where("parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    large = large.select("digest", "comp", "copies", (F.col("mine") > F.col("other")).cast("int").alias("part"),
                         (lo == hi).alias("whole"),
                         F.concat_ws("-", F.hex("comp"), lo.cast("string"), hi.cast("string")).alias("bin"))
    return small.unionByName(large)


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest, class_id, class_digest, n_links of every row (the class of a row without
    words is its own)."""
    if threshold != THRESHOLD:
        raise ValueError("the exact comparison is written for a similarity of 4/5")
    rows = written(signatures(docs, prefix_depth(), text), "signatures")
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("owner"),
        F.first("n_bytes").alias("n_bytes"), F.first("paths").alias("paths"))
    reps = written(reps, "representatives")
    groups = _candidate_groups(reps)
    members = groups.join(reps.select("digest", "copies", "n_bytes", "owner"), "digest").checkpoint()
    total = members.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    # The text of one row of each member: the rows of its owner, of which repeated ones are equal.
    wanted = members.select("digest", F.col("owner.doc_id").alias("wanted_id"))
    body = F.coalesce(F.col(text), F.lit(""))
    found = with_digest(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body")), "body")
    texts = (found.join(wanted, (found["digest"] == wanted["digest"]) & found["row.doc_id"].eqNullSafe(F.col("wanted_id")))
             .select(wanted["digest"], F.col("row.body").alias("body")).dropDuplicates(["digest"]))
    binned = _binned(members, max(8, total // PART_BYTES)).join(texts, "digest")
    links = written(_verified(binned.select("bin", "comp", "part", "whole", "copies", "digest", "body")), "links")
    tree = components(links.where("digest <> root").select("digest", "root"), "digest", "root")
    linked = links.groupBy("digest").agg(F.sum("links").alias("links"))
    known = (reps.select("digest", "copies", "owner")
             .join(linked, "digest", "left").join(tree.withColumnRenamed("node", "digest"), "digest", "left")
             .select("digest", "copies", "owner", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("root", "digest").alias("root")))
    first = known.groupBy("root").agg(F.min(F.struct("owner", "digest")).alias("first"))
    known = known.join(first, "root").select(
        "digest", "first", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    plain = rows.select("doc_id", "digest")
    return plain.join(known, "digest", "left").select(
        "doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.owner.doc_id")).alias("class_id"),
        F.col("first.digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id (rows with the same
    doc_id and words count as one); documents without words stay."""
    kept = (classes(docs).where("digest IS NOT NULL").select("class_id", "class_digest").distinct())
    rows = with_digest(docs)
    own = rows.join(kept, (rows["digest"] == kept["class_digest"])
                    & F.col("row.doc_id").cast("bigint").eqNullSafe(kept["class_id"]))
    own = own.select("row", rows["digest"], "class_id")
    # Rows of one owner with the same words: the first in the order of their hash.
    order = Window.partitionBy("digest", "class_id").orderBy(F.xxhash64("row"))
    one = own.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
    return one.unionByName(rows.where("digest IS NULL").select("row.*"))


_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 5 >= 4 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links FROM r GROUP BY a
""".replace("\\\\", "\\")


@query("op9_ngram_jaccard", _SQL)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
