"""WARC archives: what is written comes back, and damaged archives lose only what is damaged."""

import base64
import gzip
import hashlib
import random
import re

import pytest

from blockwatch.llm import warc
from blockwatch.llm.common import prepare

SCHEMA = "html string, page_id long, url string, payload int, sha string, revisit int, size int, original int, copies int"
EXTRA = [1, "s", 2, 3, 4, 5]


def plain(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each (page_id, html)."""
    best = {}
    for page_id, html in rows:
        best.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        known = [p for p in best[html or ""] if p is not None]
        original = max(known) if known else None
        first = page_id == original
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if first else "revisit", None if first else original))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    bodies = [None, "", "a", "é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "\x00" * 9, "x" * 300_000,
              "\U0001F600<p>", "WARC/1.0\r\n", "\x1f\x8b\x08", "tail\r\n\r\n"]
    out = [(i, bodies[i % len(bodies)], f"http://h/{i} ü%41\n\x7f" if i % 4 else None) for i in range(45)]
    return out + [(7, "a", "u"), (44, bodies[4], None), (None, "only null", "u"), (None, "a", ""), (None, "only null", "u")] + [(100, "hot", "u")] * 30


def test_round_trip(spark, rows, tmp_path):
    prepare(spark)
    pages = spark.createDataFrame([(h, p, u, *EXTRA) for p, h, u in rows], SCHEMA).repartition(4)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path, payloads=True)
    assert warc.gaps(read).count() == 0
    got = [r for r in warc.records(read).collect() if r["record_type"] != "warcinfo"]
    number = lambda s: None if s in (None, "<urn:page:null>") else int(s[10:-1])
    assert sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))
                   for r in got), key=repr) == plain([(p, h) for p, h, _ in rows])
    texts = {(p, h or "") for p, h, _ in rows}
    assert all((number(r["record_id"]), bytes(r["payload"]).decode()) in texts for r in got if r["record_type"] == "response")
    assert {r["target_uri"] for r in got} == {u for _, _, u in rows}
    # The files are what gzip readers read: the members in a row, padded with zeros.
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID: <urn:page:") for f in files) == len(rows)
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.records(warc.read_archives(spark, str(tmp_path / "b"))).count() == 0


def test_small_payloads_are_not_shared(spark, tmp_path):
    prepare(spark)
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["revisit"], r["refers_to"]) for r in warc.with_originals(pages, least=3).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, 4), 4: (False, None)}


def archive(zipped, n=12):
    """Records of n pages, and where each begins."""
    out, at = [], [0]
    for i in range(n):
        record = warc.page_record(i, f"http://x/{i}", (f"page {i} " * (20 + i)).encode(), None, False)
        out.append(warc._member(record) + b"\0" if zipped else record)
        at.append(at[-1] + len(out[-1]))
    return b"".join(out), at


def read(data):
    rows = list(warc.salvage(data))
    return ([int(r["record_id"][10:-1]) for r in rows if r["kind"] == "record"],
            [(r["start"], r["end"], r["reason"]) for r in rows if r["kind"] == "gap"])


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_of_one_damaged_record(zipped):
    data, at = archive(zipped)
    every = list(range(12))
    assert read(data) == (every, [])
    rng = random.Random(3)
    for k in (0, 5, 11):
        others = [i for i in every if i != k]
        # Any byte of a member but the padding behind it; of a plain record any of its block and end.
        first = at[k] if zipped else data.index(b"\r\n\r\n", at[k]) + 4
        for _ in range(25):
            p = rng.randrange(first, at[k + 1] - 1)
            bad = data[:p] + bytes([data[p] ^ (1 + rng.randrange(255))]) + data[p + 1:]
            found, gaps = read(bad)
            assert [i for i in found if i in others] == others
            assert (found == every) == (not gaps)
            if gaps:
                assert gaps[0][0] == at[k] and at[k + 1] - 1 <= gaps[-1][1] <= at[k + 1]
        if not zipped:
            said = re.compile(rb"\r\nContent-Length: [0-9]+\r\n\r\n").search(data, at[k])
            for n in (b"", b"x", b"7", b"999999", b"9" * 18):
                bad = data[:said.start()] + b"\r\nContent-Length: " + n + b"\r\n\r\n" + data[said.end():]
                assert read(bad)[0] == others
        cut = data[:at[k] + 30] + data[at[k + 1]:]  # the rest of the record is lost
        found, gaps = read(cut)
        assert found == others and gaps[0][0] == at[k]
        junk = data[:at[k]] + b"\x1f\x8b\x08WARC/1.0\r\njunk\r\n\r\n" * 3 + data[at[k]:]
        found, gaps = read(junk)
        assert found == every and [g[:2] for g in gaps] == [(at[k], at[k] + 3 * 21)] or sum(e - s for s, e, _ in gaps) == len(junk) - len(data)
    assert read(data[:at[11] + 40])[0] == every[:11]


def test_salvage_takes_nothing_from_inside_a_damaged_record():
    inner = warc.page_record(99, "u", b"forged", None, False)
    outer = warc.page_record(1, "u", b"text " + inner + b" text", None, False)
    bad = outer.replace(b"text ", b"next ", 1)  # the digest fails, the length holds
    good = warc.page_record(2, "u", b"ok", None, False)
    assert read(bad + good) == ([2], [(0, len(bad), "block digest differs")])
    assert read(warc._member(bad) + warc._member(good))[0] == [2]


def test_mixed_foreign_and_empty_files():
    plain_, _ = archive(False, 3)
    zipped, _ = archive(True, 3)
    assert read(plain_ + zipped) == ([0, 1, 2, 0, 1, 2], [])
    assert read(gzip.compress(plain_)) == ([0, 1, 2], [])  # one member for a whole file
    assert read(b"") == ([], []) and read(b"\0" * 9) == ([], [])
    assert read(b"<html>no archive</html>") == ([], [(0, 23, "no version line")])
    assert read(gzip.compress(b""))[0] == []
    folded = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:a>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [r["record_type"] for r in warc.salvage(folded)] == ["metadata"]
