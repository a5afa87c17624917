"""Merkle dataset manifest: a digest tree over the rows of each source, and one over the sources.

Each row is a leaf; the leaves of a source ascend by doc_id, and 16 consecutive nodes at a time
become their digest until one, the subroot, remains. Subroots in the order of their sources become
the root in the same way. Every row gets the proof that leads from it to the root, and the root that
is folded from a (perhaps altered) leaf and that proof.

Method, a cogrouped subtree exchange. Leaves are numbered within their source in range buckets, so no
source is gathered by one task. 4,096 consecutive nodes are a superblock. Going up, each superblock
is reduced to one node, round by round, until each tree has one. Going down, the nodes of a
superblock are cogrouped with the outer nodes that they need (the runs on the way from the superblock
to the root, one row a level): one call reduces the superblock, joins the proofs and folds them.
Only digests are shuffled; the number of rounds is the logarithm of the rows to the base 4,096.

Null fields are written ``-``, so a null text and an empty one have different leaves. A null doc_id
stands before all others of its source, a null source before all other sources. Rows of equal source
and doc_id are ordered by their leaf; equal rows have equal leaves and a place each. A row with a null
doc_id is never tampered with. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwatch.llm.common import query, table, written
from blockwatch.operators.position import bucketed, with_position

#: Nodes of one run, and runs of runs in a superblock: a superblock holds ARITY ** DEPTH nodes.
ARITY, DEPTH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST_ID = np.iinfo(np.int64).min


# ---- leaves -------------------------------------------------------------------

def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, colon, value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.translate(text, _CAPITALS, _SMALL)


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _numbered(docs: DataFrame) -> DataFrame:
    """tree, block, pos, n, doc_id, leaf, changed: leaves with their place among the n of their source.

    The bucket of a row is a function of (source, doc_id), read without the texts. Rows are numbered
    within (bucket, source); a table of one row for each of those shifts them, joined on the same keys.
    """
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST_ID)).alias("id_key"),
        *[F.col(c) for c in FIELDS])
    own = bucketed(own, ["tree", "id_key"], name="bucket")
    counts = own.groupBy("bucket", "tree").agg(F.count(F.lit(1)).alias("own_n"))
    before = Window.partitionBy("tree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("bucket", "tree", F.coalesce(F.sum("own_n").over(before), F.lit(0)).alias("shift"),
                          F.sum("own_n").over(Window.partitionBy("tree")).alias("n"))
    values = [F.col(c) for c in FIELDS]
    leaves = own.select(
        "bucket", "tree", "id_key", "doc_id", leaf(values).alias("leaf"),
        F.when(tampered_with(F.col("doc_id")), leaf(values[:-1] + [lowered(F.col("text"))])).alias("changed"))
    place = Window.partitionBy("bucket", "tree").orderBy("id_key", "leaf")
    at = F.col("rank") - 1 + F.col("shift")
    return (leaves.withColumn("rank", F.row_number().over(place)).join(shift, ["bucket", "tree"])
            .select("tree", F.expr(f"(rank - 1 + shift) div {ARITY ** DEPTH}").alias("block"),
                    at.cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"), "doc_id", "leaf", "changed"))


# ---- inside tasks ---------------------------------------------------------------

def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(digests: list[str], n: int) -> list[list[str]]:
    """Nodes of a superblock level by level: DEPTH levels up, or until the n nodes of its tree are one."""
    out = [digests]
    while len(out) <= DEPTH and n > 1:
        last = out[-1]
        out.append([digest_of(last[i:i + ARITY]) for i in range(0, len(last), ARITY)])
        n = -(-n // ARITY)
    return out


def steps_of(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """For node ``at`` of the lowest level: its place in its run, and the run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % ARITY
        out.append((at % ARITY, nodes[first:first + ARITY]))
        at //= ARITY
    return out


def siblings(steps: list[tuple[int, list[str]]]) -> str:
    return "".join(x for at, run in steps for x in run[:at] + run[at + 1:])


def folded(node: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a node and the siblings on its way."""
    for at, run in steps:
        node = digest_of(run[:at] + [node] + run[at + 1:])
    return node


def _runs(outer: pd.DataFrame) -> tuple[list[tuple[int, list[str]]], int]:
    """Steps above a superblock, lowest first, and how many of them are inside the source's tree."""
    outer = outer.sort_values("level")
    steps = [(int(at), [run[i:i + 64] for i in range(0, len(run), 64)])
             for at, run in zip(outer["at"], outer["run"], strict=True)]
    return steps, int((~outer["among_sources"].astype(bool)).sum())


# ---- up and down ------------------------------------------------------------------

def _up(nodes: DataFrame) -> DataFrame:
    """tree, block, pos, n, digest of the superblocks of ``nodes``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, block = int(pdf["n"].iloc[0]), int(pdf["block"].iloc[0])
        top = levels_of(pdf["digest"].tolist(), n)[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "block": block // ARITY ** DEPTH, "pos": block,
                             "n": -(-n // ARITY ** DEPTH), "digest": top})

    return (nodes.select("tree", "block", "pos", "n", "digest").groupBy("tree", "block")
            .applyInPandas(run, "tree string, block bigint, pos bigint, n bigint, digest string"))


_OUTER = "tree string, block bigint, level int, at int, run string, among_sources boolean"


def _down(nodes: DataFrame, outer: DataFrame, among_sources: bool) -> DataFrame:
    """The runs above each node of ``nodes``, as outer nodes of the superblock that the node stands for."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"tree": [], "block": [], "level": [], "at": [], "run": [], "among_sources": []})
        left = left.sort_values("pos")
        levels = levels_of(left["digest"].tolist(), int(left["n"].iloc[0]))
        above, inside = _runs(right)
        out = []
        for i, (tree, pos) in enumerate(zip(left["below"], left["below_block"], strict=True)):
            steps = steps_of(levels, i)
            flags = [among_sources] * len(steps) + [False] * inside + [True] * (len(above) - inside)
            out += [(tree, pos, k, at, "".join(r), f)
                    for k, ((at, r), f) in enumerate(zip(steps + above, flags, strict=True))]
        return pd.DataFrame(out, columns=["tree", "block", "level", "at", "run", "among_sources"])

    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, _OUTER)


def _exchange(leaves: DataFrame, outer: DataFrame, proofs: bool) -> DataFrame:
    """Leaves cogrouped with the outer nodes of their superblock: reduced, joined with proofs, folded."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        own = left["leaf"].tolist()
        levels = levels_of(own, int(left["n"].iloc[0])) if own else [[]]
        above, inside = _runs(right)
        out = []
        if own:
            subroot = folded(levels[-1][0], above[:inside])
            root, rest = folded(subroot, above[inside:]), siblings(above)
        for i, (doc_id, node, changed) in enumerate(zip(left["doc_id"], own, left["changed"], strict=True)):
            steps = steps_of(levels, i)
            proof = siblings(steps) + rest
            again = folded(changed if isinstance(changed, str) else node, steps + above)
            out.append((None if pd.isna(doc_id) else int(doc_id), node, subroot, root, digest_of([proof]), again,
                        again == root, *([proof] if proofs else [])))
        got = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        return got.astype({"doc_id": "Int64"})

    schema = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean") + (", proof string" if proofs else "")
    return leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def _climb(nodes: DataFrame, n: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tables of superblock nodes above them, until each tree of at most ``n`` has one."""
    out = [nodes]
    while n > 1:
        out.append(written(_up(out[-1]), name))
        n = -(-n // ARITY ** DEPTH)
    return out


def manifest(docs: DataFrame, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; with ``proofs``
    also the proof itself (the siblings' digests, joined)."""
    spark = docs.sparkSession
    leaves = written(_numbered(docs), "leaves")
    n = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    rounds = _climb(leaves.withColumn("digest", F.col("leaf")), n, "subtrees")
    tops = with_position(rounds[-1].select(F.col("tree").alias("below"), "digest"), ["below"])
    sources = tops.count()
    tops = written(tops.select(
        F.lit("").alias("tree"), F.expr(f"pos div {ARITY ** DEPTH}").alias("block"), "pos",
        F.lit(sources).cast("bigint").alias("n"), "digest", "below", F.lit(0).cast("bigint").alias("below_block")), "subroots")
    among = _climb(tops, sources, "roots")
    outer = spark.createDataFrame([], _OUTER)
    for nodes in reversed(among[1:-1]):
        outer = written(_down(nodes.select("*", F.col("tree").alias("below"), F.col("pos").alias("below_block")),
                              outer, True), "outer")
    outer = written(_down(tops, outer, True), "outer")
    for nodes in reversed(rounds[1:-1]):
        outer = written(_down(nodes.select("*", F.col("tree").alias("below"), F.col("pos").alias("below_block")),
                              outer, False), "outer")
    return _exchange(leaves, outer, proofs)


# ---- the query --------------------------------------------------------------------

def _reduced(name: str, levels: int) -> str:
    """CTEs that take ``{name}0`` (tree, pos, digest, leaf-independent) up level by level."""
    out = []
    for k in range(levels):
        # A tree of one node stays as it is.
        out.append(f"""
{name}r{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, list(digest ORDER BY pos) AS ds,
          (SELECT count(*) FROM {name}{k} c WHERE c.tree IS NOT DISTINCT FROM x.tree) > 1 AS many
        FROM {name}{k} x GROUP BY tree, pos // 16),
{name}{k + 1} AS MATERIALIZED (SELECT tree, run AS pos,
          CASE WHEN many THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest FROM {name}r{k})""")
    return ",".join(out)


def _followed(walk: str, name: str, levels: int) -> str:
    """CTEs that carry each row's proof and folded digest through the runs of ``name``."""
    out = []
    for k in range(levels):
        out.append(f"""
{walk}{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (pos, proof, fold), pos // 16 AS pos,
          CASE WHEN many THEN proof || array_to_string(ds[:pos % 16] || ds[pos % 16 + 2:], '') ELSE proof END AS proof,
          CASE WHEN many THEN sha256(array_to_string(ds[:pos % 16] || [fold] || ds[pos % 16 + 2:], '')) ELSE fold END AS fold
        FROM {walk}{k} w JOIN {name}r{k} r ON r.run = w.pos // 16 AND r.tree IS NOT DISTINCT FROM w.tree)""")
    return ",".join(out)


#: Levels that the SQL follows: enough for 16 ** 6 rows of one source and 16 ** 4 sources.
_IN, _AMONG = 6, 4


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = ("xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: "
        "list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT >> b) & 1))), "
        "lambda c, x: xor(c >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)")

_SQL = f"""
WITH d AS (SELECT *, {_sql_leaf("text")} AS leaf,
    CASE WHEN coalesce({_CRC} % 5 = 0, false) THEN {_sql_leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} END AS changed
  FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, source AS tree, leaf, changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
s0 AS (SELECT tree, pos, leaf AS digest FROM leaves),{_reduced("s", _IN)},
t0 AS MATERIALIZED (SELECT 1 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, digest, tree AS source FROM s{_IN}),
{_reduced("t", _AMONG)},
w0 AS (SELECT doc_id, tree, leaf, pos, '' AS proof, coalesce(changed, leaf) AS fold FROM leaves),{_followed("w", "s", _IN)},
v0 AS (SELECT w.doc_id, w.leaf, t.digest AS subroot, 1 AS tree, t.pos AS pos, proof, fold
       FROM w{_IN} w JOIN t0 t ON t.source IS NOT DISTINCT FROM w.tree),{_followed("v", "t", _AMONG)}
SELECT doc_id, v.leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = digest AS verified
FROM v{_AMONG} v JOIN t{_AMONG} t ON t.tree = v.tree
"""


@query("op11_merkle_manifest", _SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
