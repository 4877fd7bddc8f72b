"""Files written and read back: rotation, manifests as tables, binary log filters, summaries."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import fnv
from tickloom.operators import audit, checksum, quality
from tickloom.operators.scan import follow
from tickloom.sources import audit_log, event_log


def plain_rotation(sizes, max_bytes, max_records):
    out, used, count, number = [], 0, 0, 0
    for size in sizes:
        full = max_records and count >= max_records
        if full or (max_bytes and used and used + size > max_bytes):
            used, count, number = 0, 0, number + 1
        used, count = used + size, count + 1
        out.append(number)
    return out


@pytest.mark.parametrize("limits", [(60, 0), (0, 7), (90, 4), (10**9, 0), (1, 0)])
def test_rotation_is_greedy(spark, limits):
    rng = random.Random(5)
    lines = ["x" * rng.choice([0, 3, 9, 20, 100]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lines)), "at_ns BIGINT, value STRING")
    got = audit_log.rotate(df, "at_ns", *limits, block_rows=16).orderBy("n").collect()
    assert [r.value for r in got] == lines
    assert [r.file_no for r in got] == plain_rotation([len(x) + 1 for x in lines], *limits)


def test_rotation_needs_a_limit_and_takes_an_empty_log(spark):
    df = spark.createDataFrame([], "at_ns BIGINT, value STRING")
    with pytest.raises(ValueError, match="limit"):
        audit_log.rotate(df, "at_ns")
    assert audit_log.rotate(df, "at_ns", 10).count() == 0


def test_rotated_names():
    assert audit_log.rotated_path("/a/log.jsonl", 0) == "/a/log.jsonl"
    assert audit_log.rotated_path("/a/log.jsonl", 12) == "/a/log.12.jsonl"
    assert audit_log.rotated_path("/a/log", 2) == "/a/log.2"


def _audit_rows(spark, n):
    rows = [(k, k, 1, "Buy", k % 2 == 0, "None", "accepted", 5, k, k) for k in range(n)]
    names = [c for c in schema.AUDIT.fieldNames() if c != "checksum"]
    kinds = {f.name: f.dataType.simpleString() for f in schema.AUDIT.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in names) + ", arrival BIGINT"
    return audit_log.with_chain(spark.createDataFrame(rows, ddl), "arrival", block_rows=7)


def test_rotated_log_verifies_and_manifest_names_the_damage(spark, tmp_path):
    path = f"{tmp_path}/log.jsonl"
    rows = _audit_rows(spark, 60)
    audit_log.write_rotating_audit(rows, path, "arrival", max_bytes_per_file=900)
    paths = audit_log.rotated_paths(path)
    assert len(paths) > 11 and paths[:2] == [path, f"{tmp_path}/log.1.jsonl"]
    assert paths[-1].endswith(f"log.{len(paths) - 1}.jsonl")
    assert all((tmp_path / p).stat().st_size <= 900 for p in paths)
    ok = audit.verify_chain(spark, paths).first()
    assert ok.valid and ok.entries_checked == 60
    with pytest.raises(FileExistsError):
        audit_log.write_rotating_audit(rows, path, "arrival", max_bytes_per_file=900)

    manifest = audit.generate_manifest(spark, paths)
    assert [f.byte_size for f in manifest.files] == [(tmp_path / p).stat().st_size for p in paths]
    whole = (tmp_path / paths[3]).read_bytes()
    assert manifest.files[3].content_checksum == fnv.fnv1a(whole)
    assert audit.verify_manifest(spark, manifest, str(tmp_path)).valid
    (tmp_path / "log.1.jsonl").rename(tmp_path / "elsewhere")
    (tmp_path / "log.2.jsonl").write_bytes(
        (tmp_path / "log.2.jsonl").read_bytes().replace(b'"Buy"', b'"Buz"', 1))
    cut = (tmp_path / "log.3.jsonl").read_bytes().splitlines(keepends=True)[:-1]
    (tmp_path / "log.3.jsonl").write_bytes(b"".join(cut))
    (tmp_path / "log.4.jsonl").write_bytes(b"")
    found = audit.verify_manifest(spark, manifest, str(tmp_path)).issues
    three = ["size_mismatch", "content_checksum_mismatch", "record_count_mismatch"]
    assert [(i[0], i[1]) for i in found] == [
        ("missing_file", "log.1.jsonl"), ("content_checksum_mismatch", "log.2.jsonl"),
        *[(kind, name) for name in ("log.3.jsonl", "log.4.jsonl") for kind in three],
    ]


def test_chains_by_doubling(spark):
    jumps = spark.createDataFrame(
        [("a", k, k + 3) for k in range(40)] + [("b", 5, 6)], "key STRING, at BIGINT, to BIGINT")
    start = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "key STRING, at BIGINT")
    got = {tuple(r) for r in follow(start, jumps, ["key"]).collect()}
    assert got == {("a", k) for k in range(1, 43, 3)} | {("b", 5), ("b", 6), ("c", 9)}


def test_binary_filters_reach_the_records(spark, make_events, tmp_path):
    rows = [(k, k, 1 + k % 3, "Add", "Buy", 100, 5, k + 1) for k in range(200)]
    path = f"{tmp_path}/log.bin"
    event_log.write_events(make_events(rows).coalesce(1), path)
    wanted = "symbol_id = 2 AND timestamp_ns >= 50 AND order_id IN (53, 60, 62) AND side = 'Buy'"
    plain = event_log.read_events(spark, path).filter(wanted)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = event_log.read_events(spark, path).filter(wanted)
        assert sorted(pushed.collect()) == sorted(plain.collect())
        assert {r.order_id for r in pushed.collect()} == {53, 62}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("column,value", [
    ("side", "Both"), ("event_type", None), ("symbol_id", 2**32), ("flags", -1)])
def test_writer_rejects_what_the_format_cannot_hold(spark, make_events, tmp_path, column, value):
    events = make_events([(1, 1, 1, "Add", "Buy", 100, 5, 1)])
    kind = events.schema[column].dataType
    with pytest.raises(Exception, match=f"cannot write {column}"):
        event_log.write_events(
            events.withColumn(column, F.lit(value).cast(kind)), f"{tmp_path}/log.bin")


def test_headers_are_checked_in_empty_logs_too(spark, tmp_path):
    good, bad = tmp_path / "a.bin", tmp_path / "b.bin"
    good.write_bytes(event_log.header_bytes())
    assert event_log.read_binary(spark, [str(good)]).count() == 0
    bad.write_bytes(event_log.header_bytes().replace(b"1", b"2", 1))
    with pytest.raises(Exception, match="magic"):
        event_log.read_binary(spark, [str(bad)]).count()


def test_replay_summary_checksums(spark, make_events):
    events = make_events([
        (1, 1, 1, "Add", "Buy", 100, 5, 1), (2, 2, 1, "Execute", "Buy", 100, 2, 1, 9),
        (3, 3, 1, "Add", "Sell", 105, 4, 2), (1, 1, 2, "Add", "None", 100, 5, 3),
        (2, 2, 2, "Execute", "Buy", 100, 1, 3, 9),
    ])
    found = quality.diagnostics(events, quality.ReplayOptions(snapshots=False, book=False))
    for block in (1, 1000):
        got = {r.symbol_id: r for r in checksum.replay_summary(events, found, block).collect()}
        le = lambda v, w: (v % 2**(8 * w)).to_bytes(w, "little")
        event = lambda r: b"".join(
            le(v, w) for v, w in zip(r, (8, 8, 4, 1, 1, 8, 8, 8, 8, 4), strict=True))
        log = [(1, 1, 1, 1, 1, 100, 5, 1, 0, 0), (2, 2, 1, 4, 1, 100, 2, 1, 9, 0),
               (3, 3, 1, 1, 2, 105, 4, 2, 0, 0)]
        assert int(got[1].event_log_checksum) == fnv.fnv1a(b"".join(map(event, log)))
        assert int(got[1].activity_checksum) == fnv.fnv1a(event(log[1]))
        assert int(got[1].diagnostics_checksum) == fnv.OFFSET
        # The second symbol stops at its first row: nothing applied, an empty book.
        assert int(got[2].activity_checksum) == fnv.OFFSET
        empty = le(2, 4) + b"\1" + le(0, 8) + b"\2" + le(0, 8)
        assert int(got[2].final_book_checksum) == fnv.fnv1a(empty)
        assert got[2].error == "invalid side" and not got[2].sequence_valid
