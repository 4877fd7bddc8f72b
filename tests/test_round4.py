"""Tests of the fourth round: many small files, rotation in blocks, chains of one block."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import fnv
from tickloom.operators import scan
from tickloom.operators.checksum import chained_checksum
from tickloom.sources import audit_log, files


def test_small_files_share_a_task(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"f{n:02d}").write_bytes(b"a\n" * n + b"end")
    paths = [str(tmp_path / f"f{n:02d}") for n in range(40)]
    lines = files.ordered_lines(spark, paths)
    assert lines.rdd.getNumPartitions() == 1
    counts = {r.file_no: r["count"] for r in lines.groupBy("file_no").count().collect()}
    assert counts == {n: n + 1 for n in range(40)}
    assert {r.ended for r in lines.filter(F.col("raw") == b"end").collect()} == {False}


def test_ranges_of_a_long_file_stay_apart():
    part = lambda begin, end: files.FileRange("x", 0, begin, end, 100)
    tasks = files.packed([part(0, 10), part(10, 20), part(20, 23), part(0, 4), part(0, 40)], 10)
    assert [[(r.begin, r.end) for r in t.ranges] for t in tasks] == [
        [(0, 10)], [(10, 20)], [(20, 23), (0, 4)], [(0, 40)]
    ]


@pytest.mark.parametrize("block_rows", [3, 7, 50, 1000])
def test_chains_followed_in_blocks(spark, block_rows):
    steps = np.random.default_rng(block_rows).integers(1, 12, 300)
    to = {at: int(at + steps[at]) for at in range(300) if at % 29 != 28 or at < 200}
    jumps = spark.createDataFrame(list(to.items()), "at BIGINT, to BIGINT")
    start = spark.createDataFrame([(1,)], "at BIGINT")
    expected, at = [], 1
    while at is not None:
        expected.append(at)
        at = to.get(at)
    found = scan.follow_blocks(start, jumps, block_rows).collect()
    assert sorted(r.at for r in found) == expected


def test_files_are_renamed_by_tasks(spark, tmp_path):
    path = f"{tmp_path}/log/audit.jsonl"
    rows = [(n // 3, n, None if n == 4 else f"line {n}") for n in range(10)]
    lines = spark.createDataFrame(rows, "file_no BIGINT, n BIGINT, value STRING")
    audit_log.write_files(lines, path)
    names = ["audit.jsonl", "audit.1.jsonl", "audit.2.jsonl", "audit.3.jsonl"]
    assert sorted(os.listdir(f"{tmp_path}/log")) == sorted(names)
    texts = [open(p, "rb").read() for p in audit_log.rotated_paths(path)]
    assert texts == [b"line 0\nline 1\nline 2\n", b"line 3\n\nline 5\n",
                     b"line 6\nline 7\nline 8\n", b"line 9\n"]
    with pytest.raises(FileExistsError):
        audit_log.write_files(lines.filter("file_no = 2"), path)
    assert [open(p, "rb").read() for p in audit_log.rotated_paths(path)] == texts


def test_keys_of_one_block_need_no_map(spark, monkeypatch):
    rows = [(k if k != 2 else None, n, bytes([65 + k, n])) for k in range(4)
            for n in range(30 if k == 3 else 5)]
    df = spark.createDataFrame(rows, "k BIGINT, n BIGINT, p BINARY")
    block = scan.block_of("n", 10)
    found = chained_checksum(df, ["k"], ["n"], F.col("p"), block).collect()
    expected = {}
    for k, _, payload in rows:
        expected[k] = fnv.fnv1a(payload, expected.get(k, fnv.OFFSET))
    assert {r.k: int(r.checksum) for r in found} == expected
    # Python tasks that would ask for a map fail.
    monkeypatch.setattr(fnv, "low_byte_map", None)
    short = chained_checksum(df.filter("k < 2"), ["k"], ["n"], F.col("p"), block)
    assert "_map" not in short._jdf.queryExecution().toString()
