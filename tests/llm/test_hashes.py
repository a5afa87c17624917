"""Words whose polynomial hashes collide are different words to the operators that hash words."""

import numpy as np

from blockwatch.llm import near, substring
from blockwatch.llm.common import prepare, word_hashes

#: The Thue-Morse word of 2,048 letters and its complement: equal modulo 2**64 under every odd base.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))


def test_word_hashes():
    words = ["x", MORSE, OTHER, "x", "", "é"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    start = np.concatenate([[0], end[:-1]])
    keep = end > start
    for h in word_hashes(data, start[keep], end[keep]):
        assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4
    assert [len(h) for h in word_hashes(data, start[:0], end[:0])] == [0, 0]


def test_windows_that_differ_in_one_word_stay(spark):
    prepare(spark)
    head = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{head} {MORSE}"), (2, f"{head} {OTHER}"), (3, f"{head} {MORSE}")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 13)]


def test_texts_of_one_word_are_not_linked(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, MORSE)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near.classes(docs).collect())
    assert got == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]
