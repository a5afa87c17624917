"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import numpy as np

import corpus_pipeline as P
from blockwatch.llm import bpe, pii, quality
from blockwatch.llm.common import prepare
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_stages(spark):
    from tokenizers import Tokenizer
    prepare(spark)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(quality.features(docs), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.score(quality.features(docs), model).collect()}
    left = sorted(d for d, s in score.items() if s >= quality.THRESHOLD)
    assert 0 < len(left) < len(text)
    own = brute.classes([(d, text[d]) for d in left])
    left = [d for d, (c, _) in zip(left, own, strict=True) if c == d or not brute.words(text[d])]
    left = [d for d in left if not brute.contained(text[d], bench)[2]]
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
             for r in pii.find_spans(docs).select("row.doc_id", "spans").collect()}
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    want = {}
    for d in left:
        ids = tokenizer.encode(brute.redact(text[d] or "", spans[d]), add_special_tokens=False).ids
        want[d] = (len(ids), ids, brute.sha(np.array(ids, "<u4").tobytes()),
                   brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["ids_sha256"], r["decoded_sha256"])
           for r in P.run(spark, SF_SMALL).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert len(P.STAGES) == 5
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
