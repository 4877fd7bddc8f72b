import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_book_quality import HOT_PATH
from tickloom.functions import codec, fnv
from tickloom.operators import audit, book, checksum, depth
from tickloom.sources import audit_log, documents, event_log

# The golden inputs that the published checksums below belong to.
RAW = [
    '{"_fixture": "hand-curated", "synthetic": true}',
    '{"_captured_at_ns": 1716950000000000000, "symbol": "BTCUSDT", "data": {"lastUpdateId": 1000,'
    ' "bids": [["60000.00", "1.00000000"], ["59999.00", "2.00000000"]],'
    ' "asks": [["60001.00", "1.50000000"], ["60002.00", "2.50000000"]]}}',
    '{"e": "depthUpdate", "E": 1716950001000, "s": "BTCUSDT", "U": 1001, "u": 1001,'
    ' "b": [["60000.50", "0.75000000"]], "a": []}',
    '{"e": "depthUpdate", "E": 1716950002000, "s": "BTCUSDT", "U": 1002, "u": 1003,'
    ' "b": [["60000.00", "1.25000000"]], "a": [["60001.00", "0"]]}',
    '{"e": "depthUpdate", "E": 1716950003000, "s": "BTCUSDT", "U": 1004, "u": 1004,'
    ' "b": [], "a": [["60001.50", "3.00000000"]]}',
    '{"e": "depthUpdate", "E": 1716950004000, "s": "BTCUSDT", "U": 1005, "u": 1005,'
    ' "b": [["60000.50", "0"]], "a": []}',
]
AUDIT = [
    '{"timestamp_ns":10,"client_order_id":1,"symbol_id":1,"side":"Buy","accepted":true,'
    '"reject_reason":"None","check_name":"accepted","limit_value":1000000,'
    '"observed_value":10000,"checksum":3867997698480826350}',
    '{"timestamp_ns":11,"client_order_id":1,"symbol_id":1,"side":"Buy","accepted":false,'
    '"reject_reason":"DuplicateClientOrderId","check_name":"duplicate_client_order_id",'
    '"limit_value":0,"observed_value":1,"checksum":18204584603026375655}',
]


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "raw_index BIGINT, line STRING")


def test_fnv_kernels_match_plain_chain():
    rng = random.Random(2)
    for n in (0, 1, 255, 256, 257, 2000):
        data = bytes(rng.randrange(256) for _ in range(n))
        array = np.frombuffer(data, dtype=np.uint8)
        for seed in (fnv.OFFSET, 98765432109876):
            want = fnv.fnv1a(data, seed)
            assert fnv.low_byte_map(array)[seed & 255] == want & 255
            assert fnv.advance(seed, n, fnv.affine_part(array, seed & 255)) == want
    data = bytes(rng.randrange(256) for _ in range(300))
    ends = np.array([10, 10, 150, 300])
    got = fnv.running(np.frombuffer(data, dtype=np.uint8), ends, fnv.OFFSET)
    assert [int(x) for x in got] == [fnv.fnv1a(data[:e]) for e in ends]


def test_golden_depth_log(spark):
    tables = depth.normalise(_lines(spark, RAW), block_rows=2)
    rows = [
        (r.sequence_number, r.event_type, r.side, r.price_ticks, r.quantity, r.order_id, r.flags)
        for r in tables.events.orderBy("sequence_number").collect()
    ]
    assert rows == [
        (1, "Snapshot", "None", 0, 0, 0, 1),
        (2, "Snapshot", "Buy", 6000000000000, 100000000, 1, 0),
        (3, "Snapshot", "Buy", 5999900000000, 200000000, 2, 0),
        (4, "Snapshot", "Sell", 6000100000000, 150000000, 3, 0),
        (5, "Snapshot", "Sell", 6000200000000, 250000000, 4, 0),
        (6, "Snapshot", "None", 0, 0, 0, 2),
        (7, "Add", "Buy", 6000050000000, 75000000, 5, 0),
        (8, "Replace", "Buy", 6000000000000, 125000000, 1, 0),
        (9, "Cancel", "Sell", 6000100000000, 0, 3, 0),
        (10, "Add", "Sell", 6000150000000, 300000000, 6, 0),
        (11, "Cancel", "Buy", 6000050000000, 0, 5, 0),
    ]
    assert tables.diagnostics.count() == 0
    events = tables.events
    assert int(checksum.event_checksums(events, 3).first().event_log_checksum) == 9673906315134520083
    sums = checksum.book_checksums(
        book.live_orders(events), events.select("symbol_id").distinct(), block_rows=2
    )
    assert int(sums.first().final_book_checksum) == 2539005926052284398
    got = depth.report(tables).first()
    assert (got.normalised_event_count, got.raw_message_count, got.metadata_line_count) == (11, 5, 1)


def test_depth_diagnostics_matrix(spark):
    lines = [
        "not json",
        "[1]",
        '{"e": "trade", "s": "X"}',
        '{"U": 1, "u": 2, "b": [["1", "1"]], "a": []}',
        '{"E": 10, "s": "X", "U": 1, "u": 5, "b": [["bad", "1"], ["2", "-1"], ["3", "0"]], "a": []}',
        '{"E": 9, "s": "X", "U": 9, "u": 9, "b": [["4", "1"]], "a": []}',
        '{"E": 10, "s": "X", "U": 3, "u": 4, "b": [], "a": [["4", "1"]]}',
    ]
    got = depth.normalise(_lines(spark, lines), block_rows=2).diagnostics.collect()
    assert {(r.raw_index, r.severity, r.reason) for r in got} == {
        (0, "error", "malformed_message"),
        (1, "error", "malformed_message"),
        (2, "warning", "unsupported_message_type"),
        (3, "error", "missing_fields"),
        (4, "error", "invalid_price"),
        (4, "error", "invalid_quantity"),
        (4, "info", "level_remove_absent"),
        (5, "warning", "non_monotonic_event_time"),
        (5, "warning", "update_gap"),
        (6, "warning", "stale_update"),
        (6, "warning", "crossed_book"),
    }


def test_log_formats_round_trip(spark, make_events, tmp_path):
    events = make_events(HOT_PATH)
    event_log.write_events(events, f"{tmp_path}/log.bin")
    event_log.write_events(events, f"{tmp_path}/csv")
    plain = events.drop("event_index")
    for path in ("log.bin", "csv"):
        back = event_log.read_events(spark, f"{tmp_path}/{path}")
        assert checksum.same_rows(plain, back.drop("event_index"))
        assert int(checksum.event_checksums(back, 5).first().event_log_checksum) == 8204296528451087376
    # Tiny splits: every record range and every line range is its own partition.
    assert event_log.read_binary(spark, [f"{tmp_path}/log.bin"], 58).count() == 12
    assert event_log.read_csv(spark, [f"{tmp_path}/csv"], split=20).count() == 12


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "# comment\n\ntimestamp_ns,sequence_number,symbol_id,event_type,side,price_ticks,quantity,"
        "order_id,trade_id,flags\n 1 , 1, 1, A, B, 100, 5, 1, 0, 0\n1,2,1,Add,Buy,1x,5,1,0,0\n"
        "1,2,1,Add\n1,2,1,Nope,Buy,1,5,1,0,0\nsymbol_id,side\n1,-2,1,Add,Buy,1,5,1,0,0\n"
    )
    good = event_log.read_csv(spark, [str(path)], strict=False).collect()
    assert [(r.event_type, r.side, r.price_ticks) for r in good] == [("Add", "Buy", 100)]
    errors = {r.line_number: r.error for r in event_log.quarantine(spark, [str(path)]).collect()}
    assert errors[5] == "failed to parse CSV numeric field price_ticks"
    assert errors[6].startswith("CSV column drift: expected 10 fields")
    assert errors[7] == "failed to parse CSV event_type spelling field event_type"
    assert errors[8].startswith("CSV column drift: expected v1 header")
    assert errors[9] == "failed to parse CSV numeric field sequence_number"
    with pytest.raises(event_log.EventLogError, match="line 5"):
        event_log.read_csv(spark, [str(path)])


def test_binary_header_checks():
    head = bytearray(event_log.header_bytes())
    event_log.check_header(bytes(head))
    for place, text in ((0, "magic"), (8, "version"), (10, "header size"), (12, "record size"), (14, "reserved")):
        broken = bytearray(head)
        broken[place] ^= 0x7F
        with pytest.raises(event_log.EventLogError, match=text):
            event_log.check_header(bytes(broken))
    with pytest.raises(event_log.EventLogError, match="truncated"):
        event_log.check_header(b"AST")


def test_audit_chain_and_manifest(spark, tmp_path):
    first, second = tmp_path / "a.jsonl", tmp_path / "a.1.jsonl"
    first.write_text(AUDIT[0] + "\n")
    second.write_text(AUDIT[1] + "\n")
    paths = [str(first), str(second)]
    ok = audit.verify_chain(spark, paths).first()
    assert ok.valid and ok.entries_checked == 2 and int(ok.final_checksum) == 18204584603026375655
    entries = audit_log.read_audit(spark, paths)
    total = audit.summary(entries, ["file_no", "offset"]).first()
    assert (total.entry_count, total.accepted_count, int(total.last_checksum)) == (2, 1, 18204584603026375655)
    chained = audit_log.with_chain(
        entries.drop("checksum").withColumn("n", F.col("file_no").cast("bigint")), "n", block_rows=1
    )
    assert {int(r.checksum) for r in chained.collect()} == {3867997698480826350, 18204584603026375655}

    manifest = audit.generate_manifest(spark, paths, signing_key=b"key")
    assert manifest.files[0].content_checksum == fnv.fnv1a(first.read_bytes())
    again = audit.parse_manifest("\n".join(audit.manifest_lines(manifest)))
    good = audit.verify_manifest(spark, again, str(tmp_path), signing_key=b"key")
    assert good.valid and good.signature_valid and good.entries_checked == 2
    kinds = lambda check: {i[0] for i in check.issues}
    assert kinds(audit.verify_manifest(spark, again, str(tmp_path))) == {"key_missing"}
    assert kinds(audit.verify_manifest(spark, again, str(tmp_path), signing_key=b"x")) == {
        "signature_mismatch"
    }
    second.write_text(AUDIT[1].replace('"observed_value":1', '"observed_value":2') + "\n")
    bad = audit.verify_chain(spark, paths).first()
    assert not bad.valid and "a.1.jsonl:1: checksum mismatch" in bad.error
    assert kinds(audit.verify_manifest(spark, again, str(tmp_path), signing_key=b"key")) == {
        "content_checksum_mismatch"
    }


def test_text_audit_format(spark, tmp_path):
    rows = audit_log.read_audit(spark, [_write(tmp_path / "b.jsonl", AUDIT)])
    audit_log.write_audit(rows.withColumn("n", F.col("offset")), f"{tmp_path}/text", "n", "text")
    files = sorted(str(p) for p in (tmp_path / "text").glob("part-*"))
    assert audit.verify_chain(spark, files, "text").first().valid


def _write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_documents(spark, tmp_path):
    bench = {"benchmarks": [{"name": "a", "iterations": 1, "total_ns": 10, "avg_ns": 10}]}
    (tmp_path / "b.json").write_text(json.dumps(bench))
    assert documents.read_benchmarks(spark, f"{tmp_path}/b.json").first().avg_ns == 10
    bench["benchmarks"] *= 2
    (tmp_path / "c.json").write_text(json.dumps(bench))
    with pytest.raises(ValueError, match="duplicate benchmark name: a"):
        documents.read_benchmarks(spark, f"{tmp_path}/c.json")
    risk = {
        "limits": {"max_open_order_quantity": 150},
        "market_data": [{"symbol_id": 1, "reference_price_ticks": 1000, "timestamp_ns": 0}],
        "orders": [{"client_order_id": 1, "side": "Buy", "quantity": 5}],
        "disconnect_timestamp_ns": 30,
    }
    (tmp_path / "r.json").write_text(json.dumps(risk))
    tables = documents.read_risk_document(spark, f"{tmp_path}/r.json")
    assert tables["market_data"].first().reference_price_ticks == 1000
    assert [tuple(r) for r in tables["controls"].collect()] == [("disconnect", 30)]


def test_codecs(spark):
    row = spark.createDataFrame([(" A ", "B", "12", "+3", "sliding_window")], "t STRING, s STRING, a STRING, b STRING, m STRING")
    got = row.select(
        codec.decode_event_type(F.col("t")).alias("t"), codec.decode_side(F.col("s")).alias("s"),
        codec.strict_integer(F.col("a")).alias("a"), codec.strict_integer(F.col("b")).alias("b"),
        codec.rate_limit_mode(F.col("m")).alias("m"),
        codec.opposite_side(F.lit("Buy")).alias("o"),
    ).first()
    assert tuple(got) == ("Add", "Buy", 12, None, "sliding-window", "Sell")
