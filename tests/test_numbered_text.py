"""Line numbers of text files by their splits, against reading the files in Python."""

import random

import pytest

from blockwatch.sources.files import read_numbered_text


def _write(folder, rng):
    """Files of several splits, with every kind of line end; what Python reads of them."""
    out = []
    for i, end in enumerate(["\n", "\r\n", "\r", "mixed", "\n"]):
        lines = ["" if rng.random() < 0.1 else "é" * rng.randint(0, 3) + f"line {j} " + "x" * rng.randint(0, 90)
                 for j in range(rng.randint(500, 900))]
        text = "".join(x + (rng.choice(["\n", "\r\n"]) if end == "mixed" else end) for x in lines)
        if i % 2:
            text = text[:-len(end)] if end != "mixed" else text.rstrip("\r\n")
        path = folder / f"f{i}.log"
        path.write_bytes(text.encode())
        with open(path, encoding="utf-8") as f:  # universal line ends
            out.append((path.name, [x.rstrip("\n") for x in f]))
    (folder / "empty.log").write_bytes(b"")
    (folder / "one.log").write_bytes(b"only")
    return sorted([*out, ("one.log", ["only"])])


@pytest.mark.parametrize("split", ["4096b", "1000b", "128m"])
def test_numbers_are_those_of_the_files(spark, tmp_path, split):
    want = _write(tmp_path, random.Random(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        df = read_numbered_text(spark, str(tmp_path))
        if split != "128m":
            assert df.rdd.getNumPartitions() > 20
        rows = df.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    flat, n = [], 0
    for name, lines in want:
        for i, x in enumerate(lines):
            flat.append((name, i, n, x))
            n += 1
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["pos"], r["value"]) for r in rows) == sorted(flat)


def test_no_sort_of_lines(spark, tmp_path):
    _write(tmp_path, random.Random(2))
    plan = read_numbered_text(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan


def test_a_file_that_changed_is_an_error(spark, tmp_path):
    (tmp_path / "a.log").write_text("1\n2\n3\n")
    df = read_numbered_text(spark, str(tmp_path))
    assert df.count() == 3
    (tmp_path / "a.log").write_text("1\n2\n3\n4\n5\n")
    with pytest.raises(Exception, match="not counted|FAILED_READ_FILE|modified|does not exist"):
        df.collect()
