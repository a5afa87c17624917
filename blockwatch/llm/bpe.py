"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut before white-space bytes that a rolling hash of the eight bytes before them chooses,
so equal passages are cut alike wherever they stand. Each distinct chunk is encoded once and its
ids are reused by all documents of the task that hold it, within a bound of memory. Then every
join is repaired: the words on its two sides are encoded apart and together. Where that agrees, and
the ids of the chunks end and begin with those of the words, the join is exact; where the words
don't agree, their joint encoding replaces theirs; where a chunk doesn't end or begin with the ids
of its words, more of its text is taken, up to the whole chunk, until it does.

Where the tokenizer's own rules keep words apart (``words_apart``), the words are the smallest chunks:
a chunk seen for the first time is put together from its distinct words, each encoded once. The
joins of chunks are still checked against the tokenizer's encoding of both sides together.

Reuse is within a task: sharing chunks between tasks would shuffle every text once more (README).
Null and empty texts have no ids and decode to the empty text. Repeated rows are each encoded; no
text is cut short. The vocabulary is a file whose text is broadcast (its size is fixed).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import (
    byte_table, byte_view, lean, mix, prefix_hash, query, row_slices, span_hash, table, words_of,
)

#: A white-space byte is a cut in one of so many cases.
CHUNK_WORDS = 128
#: Bytes of chunk texts and ids that a task keeps for reuse; older chunks go first.
CACHE_BYTES = 16 << 20
#: Distinct words that a task keeps; beyond it they are learnt anew.
WORDS = 1_000_000

_SPACE = byte_table(lambda b: b in (9, 10, 13, 32))
_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before which a text is cut, by content."""
    if len(data) < 10:
        return np.zeros(0, np.int64)
    before = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 8,), (1,))
    at = np.flatnonzero(_SPACE[data[8:-1]])  # a window of eight bytes ends just before each
    return at[mix(before[at]) % np.uint64(CHUNK_WORDS) == 0] + 8


def words_apart(tokenizer) -> bool:
    """Whether the tokenizer's own rules never join what white space parts: its first rule removes all
    but runs without white space, and its normalisers look at one character or at white space only."""
    spec = json.loads(tokenizer.to_str())
    normal, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    normal = normal.get("normalizers", [normal] if normal else [])
    split = split.get("pretokenizers", [split])[0]
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert"):
        return False
    if any(n["type"] not in ("NFC", "Lowercase") and n.get("pattern") != {"Regex": r"\s+"} for n in normal):
        return False
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return False
    probe = " ".join(f"{x} {y}" for x in "a1.'\u00e9\u65e5-" for y in "a1.'\u00e9\u65e5-")
    at = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
    return not any(" " in probe[i:j] for i, j in at)


class WordEncoder:
    """Encodes chunks whose words the tokenizer keeps apart: each distinct word once.

    Known words are kept as arrays, by their hashes; a hash that is known counts only if the bytes
    of the word are the same.
    """

    def __init__(self, tokenizer, limit: int = WORDS):
        self.tokenizer, self.limit = tokenizer, limit
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)                       # ascending
        self.text_at, self.text_size, self.ids_at, self.ids_size = (np.zeros(0, np.int32) for _ in range(4))
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        got = []
        for i in range(0, len(words), 4096):  # what a call returns is many times the size of its ids
            some = self.tokenizer.encode_batch_fast([w.decode() for w in words[i:i + 4096]], add_special_tokens=False)
            got += [np.array(e.ids, np.uint32) for e in some]
        return got

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        ids = self._encoded(words)
        for name, new in (("text", [np.frombuffer(w, np.uint8) for w in words]), ("ids", ids)):
            size = np.fromiter(map(len, new), np.int32, len(new))
            old = getattr(self, name)
            at = (len(old) + np.cumsum(size) - size).astype(np.int32)
            setattr(self, name, np.concatenate([old, *new]))
            setattr(self, f"{name}_at", np.concatenate([getattr(self, f"{name}_at"), at]))
            setattr(self, f"{name}_size", np.concatenate([getattr(self, f"{name}_size"), size]))
        self.hash = np.concatenate([self.hash, h])
        order = np.argsort(self.hash)
        for name in ("hash", "text_at", "text_size", "ids_at", "ids_size"):
            setattr(self, name, getattr(self, name)[order])

    def _same(self, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words at ``start`` are the known ones at ``at``, byte by byte."""
        same = self.text_size[at] == size
        n = np.where(same, size, 0)
        where = np.cumsum(n) - n
        step = np.arange(n.sum())
        differ = data[np.repeat(start - where, n) + step] != self.text[np.repeat(self.text_at[at] - where, n) + step]
        return same & (np.bincount(np.repeat(np.arange(len(at)), n)[differ], minlength=len(at)) == 0)

    def encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        if len(self.hash) > self.limit:
            self._clear()
        data = np.frombuffer(b"".join(chunks), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(c) for c in chunks], dtype=np.int64)]).astype(np.int64)
        start, end, row = words_of(data, off, _WORD)
        u, one, which = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        start, size = start[one], (end - start)[one]
        at = np.minimum(np.searchsorted(self.hash, u), max(len(self.hash) - 1, 0))
        seen = self.hash[at] == u if len(self.hash) else np.zeros(len(u), bool)
        if not seen.all():
            new = np.flatnonzero(~seen)
            self._learn(u[new], [data[start[i]:start[i] + size[i]].tobytes() for i in new])
            at = np.searchsorted(self.hash, u)
        n, ids, ids_at = self.ids_size[at].astype(np.int64), self.ids, self.ids_at[at].astype(np.int64)
        other = np.flatnonzero(~self._same(at, data, start, size))  # two words of one hash
        if len(other):
            own = self._encoded([data[start[i]:start[i] + size[i]].tobytes() for i in other])
            n[other] = [len(x) for x in own]
            ids_at[other] = len(ids) + np.cumsum(n[other]) - n[other]
            ids = np.concatenate([ids, *own])
        n, ids_at = n[which], ids_at[which]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(ids_at - before[:-1], n) + np.arange(before[-1])]
        edge = before[np.searchsorted(row, np.arange(len(chunks) + 1))]
        return [flat[edge[i]:edge[i + 1]] for i in range(len(chunks))]


class ChunkEncoder:
    """Encodes texts by chunks; keeps the ids of chunks and of the words at joins."""

    def __init__(self, tokenizer, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = tokenizer
        self.limit = cache_bytes
        self.by_word = WordEncoder(tokenizer) if words_apart(tokenizer) else None
        self.chunks: dict[bytes, np.ndarray] = {}
        self.words: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.encoded = self.reused = self.repaired = 0

    def _ids(self, texts: list[bytes], whole: bool = False) -> list[np.ndarray]:
        """``whole``: each text in one call of the tokenizer, not from its words."""
        if self.by_word is not None and not whole:
            return self.by_word.encode(texts)
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _learn(self, wanted: dict[bytes, np.ndarray], texts: set[bytes], whole: bool = False) -> None:
        new = [t for t in texts if t not in wanted]
        for t, ids in zip(new, self._ids(new, whole), strict=True):
            wanted[t] = ids
            self.held += 2 * len(t) + ids.nbytes + 200

    def _trim(self) -> None:
        """Forget the oldest chunks and words beyond the bound (between batches)."""
        for kept in (self.words, self.chunks):
            for t in list(kept):
                if self.held <= self.limit // 2:
                    break
                self.held -= 2 * len(t) + kept.pop(t).nbytes + 200

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of each text, given as its chunks."""
        if self.held > self.limit:
            self._trim()
        every = {c for t in texts for c in t}
        self.reused += sum(len(t) for t in texts) - len(every - self.chunks.keys())
        self.encoded += len(every - self.chunks.keys())
        self._learn(self.chunks, every)
        ends = [[(_tail(a), _head(b)) for a, b in zip(t, t[1:], strict=False)] for t in texts]
        self._learn(self.words, {w for t in ends for x, y in t for w in (x, y, x + y)}, whole=True)
        return [self._joined(t, e) for t, e in zip(texts, ends, strict=True)]

    def _of(self, text: bytes) -> np.ndarray:
        got = self.chunks.get(text)
        if got is None:
            got = self.words.get(text)
        return self._ids([text], whole=True)[0] if got is None else got

    def _joined(self, chunks: list[bytes], ends: list[tuple[bytes, bytes]]) -> np.ndarray:
        if not chunks:
            return np.zeros(0, np.uint32)
        out = [self.chunks[chunks[0]]]
        done = chunks[0]  # the text that the last part of ``out`` stands for
        for chunk, (left, right) in zip(chunks[1:], ends, strict=True):
            ids, part = self.chunks[chunk], out[-1]
            x, y, both = self.words[left], self.words[right], self.words[left + right]
            if _ends(part, x) and _ends(ids[::-1], y[::-1]) and len(both) == len(x) + len(y) \
                    and (both[:len(x)] == x).all() and (both[len(x):] == y).all():
                out.append(ids)
                done = chunk
                continue
            self.repaired += 1
            while True:
                x, y = self._of(left), self._of(right)
                fits_left, fits_right = _ends(part, x), _ends(ids[::-1], y[::-1])
                if fits_left and fits_right:
                    break
                if not fits_left:
                    left = done[-2 * len(left):]
                    left = done if len(left) == len(done) else _whole(left)
                if not fits_right:
                    right = chunk if 2 * len(right) >= len(chunk) else chunk[:2 * len(right) + len(_head(chunk[2 * len(right):]))]
            out[-1] = np.concatenate([part[:len(part) - len(x)], self._of(left + right), ids[len(y):]])
            done += chunk
        return np.concatenate(out)


def _ends(ids: np.ndarray, tail: np.ndarray) -> bool:
    return len(tail) == 0 or (len(ids) >= len(tail) and bool((ids[len(ids) - len(tail):] == tail).all()))


def _whole(tail: bytes) -> bytes:
    """A tail cut back to begin at a character."""
    i = 0
    while i < len(tail) and tail[i] & 0xC0 == 0x80:
        i += 1
    return tail[i:]


def _tail(chunk: bytes) -> bytes:
    """From the last white space that has a word behind it, or the whole chunk."""
    body = chunk.rstrip(b" \n\t\r")
    at = max(body.rfind(b" "), body.rfind(b"\n"), 0)
    return chunk[at:]


def _head(chunk: bytes) -> bytes:
    """The leading white space and the word behind it, or the whole chunk."""
    skip = len(chunk) - len(chunk.lstrip(b" \n\t\r"))
    ends = [x for x in (chunk.find(b" ", skip), chunk.find(b"\n", skip)) if x >= 0]
    return chunk[:min(ends)] if ends else chunk


def chunks_of(data: np.ndarray, off: np.ndarray) -> list[list[bytes]]:
    """The chunks of each row."""
    out = []
    for i in range(len(off) - 1):
        own = data[off[i]:off[i + 1]]
        at = [0, *cuts(own).tolist(), len(own)]
        raw = own.tobytes()
        out.append([raw[a:b] for a, b in zip(at, at[1:], strict=False) if b > a])
    return out


def encode(docs: DataFrame, vocab: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row as ``row`` (a struct of its columns, or of those in ``keep``), with ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocab, encoding="utf-8").read())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encoder = ChunkEncoder(tokenizer)
        for b in batches:
            data, off = byte_view(b.column(1))
            for i, j in row_slices(off):
                ids = encoder.encode(chunks_of(data, off[i:j + 1]))
                texts = [tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())],
                    names=["row", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_tokens bigint, ids binary, decoded string")


@query("op6_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
