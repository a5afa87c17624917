"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Method. A CountVectorizer with a minimum document frequency and the largest vocabulary size that an
integer holds turns the documents into exact sparse vectors, a chunk of them at a time: one of the terms
that a chunk has of a (lang, source), and one for each binary digit of what their counts have over one,
so a chunk is handed over in about as many keys as it has different terms; its vector is their sum by the
digits' weights. The fit is given each term once for each document of a chunk, but no more often than
the minimum asks for in all, which no threshold can tell from the whole. The terms carry their language, which
makes one fit a vectorizer for each language: a term counts documents of its own language only. The
vocabulary of one model is bounded: terms are dealt by hash to as many models as an estimate of the
kept terms asks for (one up to MODEL_TERMS), and the results of the models are put together by adding.
A mark in every chunk keeps a vocabulary from being empty. The vectors are written, and sums by
group are taken over their indices and values, never over dense buffers. Divergences of pairs of
sources are evaluated from the sparse group vectors: terms in blocks, sources in tiles, so that no
task holds more than a block of terms of two tiles of sources; what a pair owes to terms that neither
has is one product. All arithmetic is on integers, within 64 bits.

Null text, lang and source are read as ''. Every (lang, source) that occurs is a group, with or
without terms; a language without kept terms has pairs of value 0 and no term rows. A source alone in
its language has no pairs. Equal values are ranked by item. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwatch.llm.common import byte_table, byte_view, lean, lean_group, query, row_slices, table, words_of, written
from blockwatch.session import ensure_checkpoint_dir

#: Documents of its language that a kept term is in, ranks of the term part, and the scale of a share.
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Kept terms of one model, terms of a block and sources of a tile in the evaluation of pairs.
MODEL_TERMS, BLOCK_TERMS, TILE = 1 << 21, 4096, 128
#: One term in ESTIMATE is counted to estimate the kept terms (it only sets the number of models).
ESTIMATE = 64
#: Bytes of the documents of a chunk, and keys of a row.
CHUNK_BYTES, ROW_KEYS = 18 << 20, 2000
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_TERM = byte_table(lambda b: 97 <= b <= 122 or b >= 128)
#: Stands between a term and its language, and alone as the mark of a document; no term or code has it.
_MARK = "\x1f"


def _lang_code(lang: Column) -> Column:
    """A language as letters, digits, ``_`` and ``-``; others as base64 behind a ``=``."""
    return F.when(lang.rlike("^[A-Za-z0-9_-]*$"), lang).otherwise(
        F.concat(F.lit("="), F.base64(lang.cast("binary"))))


def _lang_of(code: Column) -> Column:
    return F.when(code.startswith("="), F.unbase64(F.substr(code, F.lit(2))).cast("string")).otherwise(code)


def _documents(docs: DataFrame) -> DataFrame:
    """lang, source, layer, keys: the terms of chunks of documents, with their language behind them.

    Layers from 0 on are sums of a chunk's documents of one (lang, source): layer 0 has each of their
    terms once, and the mark; the others are the binary digits of what the counts have over one: a term in
    layer b > 0 occurs 2 ** (b - 1) more times. Layers below 0 are what the fit counts documents by: a term
    of n documents of the chunk's is in min(n, MIN_DOCS) of its rows, so a term is in MIN_DOCS rows of all
    chunks exactly if it is in that many documents. The mark stands for a term of all documents. Rows of
    more than ROW_KEYS keys are cut; parts behind the first are of layer -2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield from _chunks(held)
                held, size = [], 0
        if held:
            yield from _chunks(held)

    own = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return own.withColumn("code", _lang_code(F.col("lang"))).mapInArrow(
        lean(run), "lang string, source string, layer int, keys array<string>")


def _chunks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the chunks that batches make: one, unless a batch is large."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()
    held.clear()
    for b in rows:
        data, off = byte_view(b.column("text"))
        for i, j in row_slices(off, CHUNK_BYTES):
            yield from _chunk(*_counts(b.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]))


def _counts(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> tuple[pa.Table, pa.Table, list, list]:
    """word, of, n: documents of each word by the number of its language's code, and occurrences by the
    number of its (lang, source, code), in the order of these; the codes and groups. The empty word is the
    mark: of code 0 for the documents, once in each group."""
    low, n = _LOWER[data], rows.num_rows
    start, end, row = words_of(low, off, _TERM)
    step = np.zeros(len(low) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    packed = np.ascontiguousarray(low[np.cumsum(step[:-1], dtype=np.int8).astype(bool)])
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    del start, end, step, low
    words = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    del at, packed
    size = len(words.dictionary) + 1
    names = pa.concat_arrays([words.dictionary, pa.array([""], pa.large_string())])
    codes, groups = {"": 0}, {}
    lang, source, code = (rows.column(c).to_pylist() for c in ("lang", "source", "code"))
    of_code = np.array([codes.setdefault(c, len(codes)) for c in code], np.int64)
    of_group = np.array([groups.setdefault(g, len(groups)) for g in zip(lang, source, code, strict=True)], np.int64)
    index = words.indices.to_numpy().astype(np.int64)

    def table(keys: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"word": names.take(pa.array(keys % size)), "of": keys // size, "n": n})

    # Counts make ``unique`` sort, which is faster here than its hashing.
    own = np.unique(row * size + index, return_counts=True)[0]
    terms, n_docs = np.unique(of_code[own // size] * size + own % size, return_counts=True)
    seen = table(np.append(terms, size - 1), np.append(n_docs, n))
    marks = np.arange(len(groups)) * size + size - 1
    return seen, table(*np.unique(np.concatenate([of_group[row] * size + index, marks]), return_counts=True)), list(codes), list(groups)


def _chunk(seen: pa.Table, sums: pa.Table, codes: list, groups: list) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, see ``_documents``."""
    def keys_of(t: pa.Table, code: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(t["word"].combine_chunks(), code, pa.scalar(_MARK, pa.large_string())).cast(pa.string())

    def cut(keys: pa.Array, of: np.ndarray, layer: int, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
        """A row for each run of ``of``, cut at ROW_KEYS keys."""
        at = np.arange(len(of))
        new = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % ROW_KEYS == 0)
        layers = np.full(len(first), layer)
        if layer < 0:
            layers[1:] = -2
        whose = pa.array(of[first])
        return pa.RecordBatch.from_arrays(
            [lang.take(whose), source.take(whose), pa.array(layers, pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), keys)], names=["lang", "source", "layer", "keys"])

    none = pa.array([None], pa.string())
    n = seen["n"].to_numpy()
    keys = keys_of(seen, pa.array(codes, pa.large_string()).take(seen["of"].combine_chunks()))
    for i in range(MIN_DOCS):
        own = np.flatnonzero(n > i)
        if len(own):
            yield cut(keys.take(pa.array(own)), np.zeros(len(own), np.int64), -1, none, none)
    lang, source, code = (pa.array(c, pa.string()) for c in zip(*groups, strict=True))
    of, mark = sums["of"].to_numpy(), pc.equal(sums["word"].combine_chunks(), "").to_numpy(zero_copy_only=False)
    keys = keys_of(sums, pc.if_else(pa.array(mark), "", code.take(pa.array(of))).cast(pa.large_string()))
    more, layer = sums["n"].to_numpy() - 1, 0
    while layer == 0 or (more >> (layer - 1)).any():
        own = np.arange(len(of)) if layer == 0 else np.flatnonzero((more >> (layer - 1)) & 1)
        if len(own):
            yield cut(keys.take(pa.array(own)), of[own], layer, lang, source)
        layer += 1


def _models_for(terms: DataFrame) -> int:
    """Models that hold the vocabulary, from the kept terms among one in ESTIMATE, by their hash."""
    some = terms.where("layer < 0").select(F.explode("keys").alias("key")).where(
        F.pmod(F.xxhash64("key", F.lit(7)), F.lit(ESTIMATE)) == 0)
    kept = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).count()
    return max(1, -(-kept * ESTIMATE * 5 // (4 * MODEL_TERMS)))


def _vectors(terms: DataFrame, names: DataFrame, models: int, model: int) -> tuple[DataFrame, DataFrame]:
    """group (its number in ``names``), at, count (occurrences of a vocabulary index in a layer of a chunk), and the
    vocabulary (at, term, lang) of one model."""
    spark = terms.sparkSession
    docs = terms
    if models > 1:
        docs = terms.withColumn("keys", F.filter("keys", lambda k: (k == _MARK) | (F.pmod(F.xxhash64(k), F.lit(models)) == model)))
    # The layers below 0 count documents, the others occurrences.
    fitted = CountVectorizer(inputCol="keys", outputCol="vector", minDF=float(MIN_DOCS),
                             vocabSize=2**31 - 1).fit(docs.where("layer < 0"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-vectorizer-{uuid.uuid4().hex}"
    fitted.write().save(f"{path}/model")
    fitted.transform(docs.where("layer >= 0")).select("lang", "source", "layer", "vector").write.parquet(f"{path}/vectors")
    # A sparse vector is stored as its type, size, indices and values: read those as columns.
    sparse = spark.read.schema("lang string, source string, layer int, vector struct<type: tinyint, size: int, "
                               "indices: array<int>, values: array<double>>").parquet(f"{path}/vectors")
    saved = spark.read.parquet(f"{path}/model/data")
    mark = saved.select((F.array_position("vocabulary", _MARK) - 1).alias("at")).first()["at"]
    vocabulary = (saved.select(F.posexplode("vocabulary").alias("at", "key")).where(F.col("at") != mark)
                  .select("at", F.substring_index("key", _MARK, 1).alias("term"),
                          _lang_of(F.substring_index("key", _MARK, -1)).alias("lang")))
    weight = F.expr("CASE WHEN layer = 0 THEN 1L ELSE shiftleft(1L, layer - 1) END")
    # The entries meet by numbers, not by the texts of their groups.
    entries = sparse.join(names, ["lang", "source"]).select("group", weight.alias("weight"), F.inline(F.arrays_zip("vector.indices", "vector.values")).alias("at", "value"))
    return entries.where(F.col("at") != mark).select(
        "group", "at", (F.col("value").cast("bigint") * F.col("weight")).alias("count")), vocabulary


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 * v)), digit by digit so that no product leaves 64 bits."""
    total = n + 2 * v
    rest = count + 2  # as large as the total if the vocabulary is one term
    quotient, rest = F.call_function("div", rest, total), rest % total
    for _ in range(3):
        quotient, rest = quotient * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return quotient + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _far(p, q):
    d = p - q
    return d * d // (p + q)


def _tile_sums(group: pa.Table) -> pa.Table:
    """Sums over a block of terms for the pairs of two tiles.

    Rows with ``at`` < 0 name the sources (with the share of an absent term); the others are the
    shares of terms that occur. For sources a < b, the sum over terms that either has of
    distance(a, b) less the distance of absent terms; in block -1, that distance times the terms of
    the language.
    """
    col = {c: group.column(c).to_numpy(zero_copy_only=False) for c in ("at", "no", "p", "v", "block", "left", "right", "tile")}
    head = np.flatnonzero(col["at"] < 0)
    head = head[np.argsort(col["no"][head])]
    names = group.column("source").take(pa.array(head)).to_pylist()
    nos, absent, tile = col["no"][head], col["p"][head], col["tile"][head]
    lang = group.column("lang")[0].as_py()
    rows = np.flatnonzero(col["at"] >= 0)
    who = np.searchsorted(nos, col["no"][rows])
    order = np.lexsort((col["at"][rows], who))
    rows, who = rows[order], who[order]
    terms, term = np.unique(col["at"][rows], return_inverse=True)
    p = col["p"][rows]
    first = np.searchsorted(who, np.arange(len(nos) + 1))
    at_left, at_right = np.flatnonzero(tile == col["left"][0]), np.flatnonzero(tile == col["right"][0])
    out_a, out_b, out = [], [], []
    for a in at_left:
        others = at_right[at_right > a]
        if not len(others):
            continue
        base = _far(absent[a], absent[others])
        if col["block"][0] < 0:
            total = base * col["v"][head[0]]
        else:
            own = slice(first[a], first[a + 1])
            mine = np.full(len(terms), absent[a])
            mine[term[own]] = p[own]
            has = np.zeros(len(terms), bool)
            has[term[own]] = True
            # Terms of b, against what a has of them; less what a's own terms count for below.
            span = slice(first[others[0]], first[others[-1] + 1])
            b = who[span] - others[0]
            m, q = mine[term[span]], p[span]
            part = _far(m, q) - base[b]
            both = has[term[span]]
            part[both] -= _far(m[both], absent[others][b[both]]) - base[b[both]]
            total = np.zeros(len(others), np.int64)
            np.add.at(total, b, part)
            # Terms of a, against the absent share of each b.
            total += _far(p[own][:, None], absent[others][None, :]).sum(axis=0) - (own.stop - own.start) * base
        out_a += [names[a]] * len(others)
        out_b += [names[o] for o in others]
        out.append(total)
    return pa.table({"lang": pa.array([lang] * len(out_a), pa.string()), "a": pa.array(out_a, pa.string()),
                     "b": pa.array(out_b, pa.string()),
                     "part_sum": pa.array(np.concatenate(out) if out else [], pa.int64())})


def pair_values(shares: DataFrame, groups: DataFrame, words: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language.

    ``groups``: lang, source, no (from 0 in its lang), sources (of the lang), v, absent;
    ``shares``: lang, no, model, at, p; ``words``: lang, model, at of every kept term.
    """
    named = groups.withColumn("tile", F.expr(f"no div {TILE}")).withColumn("tiles", F.expr(f"(sources - 1) div {TILE}"))
    block = F.expr(f"at div {BLOCK_TERMS}").cast("bigint").alias("block")
    own = (shares.select("lang", "no", "model", "at", "p", block)
           .withColumn("source", F.lit(None).cast("string")).withColumn("v", F.lit(None).cast("bigint"))
           .join(named.select("lang", "no", "tile", "tiles"), ["lang", "no"]))
    blocks = words.select("lang", "model", block).distinct()
    every = blocks.unionByName(named.select("lang", F.lit(-1).alias("model"), F.lit(-1).cast("bigint").alias("block")).distinct())
    heads = named.join(every, "lang").select(
        "lang", "no", "model", F.lit(-1).alias("at"), F.coalesce("absent", F.lit(1)).alias("p"), "block", "source", "v", "tile", "tiles")
    rows = own.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "tiles")))
    keyed = rows.select("lang", "model", "block", "at", "no", "p", "source", F.coalesce("v", F.lit(0)).alias("v"), "tile",
                        F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    sums = (keyed.groupBy("lang", "model", "block", "left", "right")
            .applyInArrow(lean_group(_tile_sums), "lang string, a string, b string, part_sum bigint")
            .groupBy("lang", "a", "b").agg(F.sum("part_sum").alias("value")))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", "x.item", "value")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: sources by their distance, and the terms that stand out."""
    terms = written(_documents(docs), "terms")
    # As many as the documents, or MIN_DOCS and more.
    n_docs = terms.where("layer = -1").count()
    names = written(terms.where("layer = 0").select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()), "names")
    models = _models_for(terms)
    counted, vocabulary = [], []
    # Fewer documents than a kept term needs: no term is kept.
    for k in range(models if n_docs >= MIN_DOCS else 0):
        found, words = _vectors(terms, names, models, k)
        sums = found.groupBy("group", "at").agg(F.sum("count").alias("count")).join(names, "group")
        counted.append(sums.select("lang", "source", "at", "count", F.lit(k).alias("model")))
        vocabulary.append(words.withColumn("model", F.lit(k)))
    if not counted:
        spark = docs.sparkSession
        counted = [spark.createDataFrame([], "lang string, source string, at int, count bigint, model int")]
        vocabulary = [spark.createDataFrame([], "at int, term string, lang string, model int")]
    words = written(_union(vocabulary), "vocabulary")
    counts = written(_union(counted), "counts")
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = (names.select("lang", "source")
              .join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
              .join(sizes, "lang", "left").fillna(0, ["n", "v"]))
    in_lang = Window.partitionBy("lang")
    groups = written(groups.select(
        "lang", "source", "n", "v", F.sum("n").over(in_lang).alias("lang_n"), F.count(F.lit(1)).over(in_lang).alias("sources"),
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint").alias("no"))
        .withColumn("absent", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("n"), F.col("v")))), "groups")
    shares = (counts.join(groups.select("lang", "source", "n", "v", "lang_n", "no"), ["lang", "source"])
              .withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))))
    pairs = pair_values(shares, groups, words)
    # Terms that stand out: ties at the last rank stay until their text decides.
    over = Window.partitionBy("lang", "model", "at")
    out = (shares.withColumn("q", share(F.sum("count").over(over), F.col("lang_n"), F.col("v"))).where("p > q")
           .select("lang", "source", "model", "at", distance(F.col("p"), F.col("q")).alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    top = (out.withColumn("first", F.rank().over(best)).where(F.col("first") <= TOP)
           .join(words.select("model", "at", "term"), ["model", "at"])
           .withColumn("rank", F.row_number().over(
               Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")))
           .where(F.col("rank") <= TOP)
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
    ranked = pairs.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(top)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
lt AS (SELECT lang, sum(total)::HUGEINT AS total FROM gt GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (total + 2 * v))::HUGEINT AS p
      FROM gt JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000 * (sum(c.n)::HUGEINT + 2)) // (any_value(total) + 2 * any_value(v)))::HUGEINT AS q
      FROM c JOIN lt USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_divergence", _SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
