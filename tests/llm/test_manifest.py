"""The dataset manifest against a plain tree, on awkward rows and on trees of several superblocks."""

import zlib

from pyspark.sql import functions as F

from blockwatch.llm import manifest
from blockwatch.llm.common import prepare
from tests.llm.brute import sha

SCHEMA = "leaf int, doc_id long, source string, lang string, n_chars long, text string, pos string, tree int, block string, n double"


def plain_leaf(row, text):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def plain_paths(digests):
    """Root, and for each node its steps (place in its run, run)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % 16
            paths[i].append((p % 16, level[first:first + 16]))
            at[i] = p // 16
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = plain_paths([x[2] for x in groups[s]])
    root, above = plain_paths([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, above, strict=True):
        for (known, _, leaf, r), path in zip(groups[s], trees[s][1], strict=True):
            steps = path + over
            proof = sha("".join(x for at, run in steps for x in run[:at] + run[at + 1:]))
            text, node = r["text"], leaf
            if known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                node = plain_leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for at, run in steps:
                node = sha("".join(run[:at] + [node] + run[at + 1:]))
            out.append((r["doc_id"], leaf, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=repr)


def test_awkward_rows(spark):
    prepare(spark)
    texts = [None, "", "Ab Ç", "ab", "X" * 40000, "ÀA\x00\U0001F600", "a:b-", "-"]
    rows = [(1, i % 23 if i % 9 else None, [None, "", "s", "é", "z", "Z"][i % 6], [None, "en"][i % 2],
             [None, 3, -1][i % 3], texts[i % 8], "p", 2, "b", 0.5) for i in range(90)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = docs.columns
    want = plain_manifest([dict(zip(names, r, strict=True)) for r in rows])
    assert found(docs) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)
    one = docs.where("doc_id = 5").limit(1)
    leaf, subroot, root = one.transform(manifest.manifest).select("leaf", "subroot", "root").first()
    assert leaf == subroot == root
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_trees_of_several_superblocks(spark):
    """70,000 rows of one source (five levels, two rounds up) and 300 other sources."""
    prepare(spark)
    docs = spark.range(70300).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 70000, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("T"), F.col("id")).alias("text"))
    assert found(docs) == plain_manifest([r.asDict() for r in docs.collect()])


def test_the_proof_itself(spark):
    """The siblings joined are what proof_sha256 is of, and fold to the root."""
    prepare(spark)
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "'en' AS lang", "1L AS n_chars", "'t' AS text")
    for r in manifest.manifest(docs, proofs=True).collect():
        assert sha(r["proof"]) == r["proof_sha256"] and r["leaf"] not in r["proof"]
