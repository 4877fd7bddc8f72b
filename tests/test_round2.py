"""Faults found by review: appends, mixed folders, whole division, tick rounding, shared folder."""

import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.operators import audit, book, features, limits
from tickloom.operators.depth import to_ticks
from tickloom.operators.scan import whole_div
from tickloom.sources import audit_log, event_log


def _events(make_events, start, n=10):
    return make_events([(i, i + 1, 1, "Add", "Buy", 100, 5, i + 1)
                        for i in range(start, start + n)])


def test_two_appends_keep_all_rows(spark, make_events, tmp_path):
    path = str(tmp_path / "log")
    for start in (0, 10):
        event_log.write_binary(_events(make_events, start), path)
    rows = event_log.read_events(spark, path, "binary").orderBy("event_index").collect()
    assert [r.timestamp_ns for r in rows] == list(range(20))


def test_mixed_folder_has_own_positions(spark, make_events, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    for name, start, fmt in (("a", 0, "csv"), ("b", 10, "binary"), ("c", 20, "csv")):
        event_log.write_events(_events(make_events, start).coalesce(1), str(tmp_path / name), fmt)
        for k, part in enumerate(sorted((tmp_path / name).glob("part-*"))):
            part.rename(folder / f"{name}{k}{part.suffix}")
    rows = event_log.read_events(spark, str(folder)).orderBy("event_index").collect()
    assert len({r.event_index for r in rows}) == 30
    assert [r.timestamp_ns for r in rows] == list(range(30))


def test_whole_division(spark):
    day = 86_400_000_000_000
    values = [day * 199 - 1, day * 199, -1, 0, 2**53 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(whole_div("v", day)).collect()] == [v // day for v in values]


def test_ticks_round_once(spark):
    df = spark.createDataFrame([("0.000000014999999999",), ("0.000000015",), ("0.000000025",),
                                ("-0.000000015",), ("123456789.5",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(to_ticks(F.col("s"), 100_000_000)).collect()]
    assert got == [1, 2, 2, -2, 12345678950000000, None, None]


def test_shuffle_width_is_the_users(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "200")
    assert session.configure(own).conf.get("spark.sql.shuffle.partitions") == "200"


def test_no_unshared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_audit_log_in_two_appends_is_one_chain(spark, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("n"), F.col("id").alias("timestamp_ns"), F.lit(1).alias("symbol_id"),
        F.col("id").alias("client_order_id"), F.lit("Buy").alias("side"),
        F.lit(True).alias("accepted"), F.lit("None").alias("reject_reason"),
        F.lit("accepted").alias("check_name"), F.lit(5).alias("limit_value"),
        F.col("id").alias("observed_value"),
    )
    first = audit_log.with_chain(rows.filter("n < 15"), "n", block_rows=4)
    seed = int(first.orderBy(F.desc("n")).first().checksum)
    second = audit_log.with_chain(rows.filter("n >= 15"), "n", block_rows=4, seed=seed)
    whole = audit_log.with_chain(rows, "n", block_rows=7)
    assert first.unionByName(second).exceptAll(whole).isEmpty()
    path = tmp_path / "log"
    for part in (first, second):
        audit_log.write_audit(part, str(path), "n", max_records_per_file=6)
    files = sorted(str(p) for p in path.glob("part-*"))
    assert len(files) > 6 and not list(path.glob("_append*"))
    found = audit.verify_chain(spark, files, "jsonl").first()
    assert found.valid and found.entries_checked == 40


def _reports(spark, rows):
    return spark.createDataFrame(rows, (
        "timestamp_ns BIGINT, client_order_id BIGINT, exchange_order_id BIGINT, "
        "exec_type STRING, order_status STRING, remaining_quantity BIGINT, "
        "resting_price_ticks BIGINT"))


def test_working_orders_follow_reports_in_order(spark):
    accepted = spark.createDataFrame(
        [(k, 1, 7, "Buy", 100, 10) for k in range(1, 8)],
        "client_order_id BIGINT, client_id INT, symbol_id INT, side STRING, price_ticks BIGINT, "
        "quantity BIGINT")
    new, part, gone = ("New", "New"), ("Trade", "PartiallyFilled"), ("Canceled", "Canceled")
    got = limits.working_orders(accepted, _reports(spark, [
        (1, 1, 51, *new, 10, 105), (2, 1, 51, *part, 6, 0),  # the price stays
        (1, 2, 52, *new, 10, 100), (2, 0, 52, *part, 3, 100),  # no client id: ignored
        (1, 3, 53, *new, 10, 100), (2, 93, 53, *part, 4, 103),  # found by the exchange id
        (1, 4, 54, *new, 10, 100), (2, 94, 54, *gone, 0, 0),  # another id never releases
        (1, 5, 55, *new, 10, 100), (2, 5, 55, *gone, 0, 0), (3, 5, 55, *new, 9, 9),  # stays gone
        (1, 6, 56, *new, 10, 100), (2, 6, 66, *new, 8, 100), (3, 96, 56, *part, 1, 1),
        (4, 97, 66, *part, 2, 101),  # rebound: only the new exchange id counts
    ]))
    assert {r.client_order_id: (r.price_ticks, r.quantity) for r in got.collect()} == {
        1: (105, 6), 2: (100, 10), 3: (103, 4), 4: (100, 10), 6: (101, 2), 7: (100, 10)}


def test_book_levels_cross_wide_gaps(spark):
    far = 1 << 40  # the step between two files of a log
    deltas = spark.createDataFrame(
        [(1, 0, 0, "Buy", 100, 5), (1, 0, 3 * far, "Buy", 101, 2), (1, 0, 5 * far, "Buy", 101, -2)],
        "symbol_id INT, epoch BIGINT, event_index BIGINT, side STRING, price_ticks BIGINT, "
        "delta BIGINT")
    probes = spark.createDataFrame(
        [(1, k * far + 7, k) for k in (0, 2, 3, 4, 6)],
        "symbol_id INT, event_index BIGINT, probe_id BIGINT")
    rows = book.walk_books(deltas, probes, block_rows=1000).collect()
    assert {r.probe_id: r.bid_price for r in rows} == {0: 100, 2: 100, 3: 101, 4: 101, 6: 100}


def test_contract_violations(spark):
    sound = dict(model_name="m", feature_count=4, window_length=3, feature_version=1,
                 input_shape=[1, 3, 4], output_shape=[1, 2], expected_test_input=[0.0] * 12,
                 expected_test_output=[0.0] * 2, reference_weights=[0.0] * 4,
                 artefact_type="trained_recorded_public_l2", trained_model=True)
    cases = [
        ({}, []),
        ({"reference_weights": None, "artefact_type": None, "trained_model": None}, []),
        ({"model_name": ""}, ["name"]),
        ({"input_shape": [4, 3, 1]}, ["recorded_input"]),
        ({"input_shape": [1 << 32, 1 << 32, 4]},
         ["input_shape", "frame_size", "sample_input", "recorded_input"]),
        ({"output_shape": None}, ["output_shape", "sample_output", "recorded_output"]),
        ({"trained_model": None, "reference_weights": [0.0]}, ["weights", "kind_untrained"]),
        ({"feature_count": 1 << 62, "artefact_type": "other"}, ["frame_size", "weights", "kind"]),
    ]
    ddl = ("n long, model_name string, feature_count long, window_length long, feature_version long,"
           "input_shape array<long>, output_shape array<long>, expected_test_input array<double>,"
           "expected_test_output array<double>, reference_weights array<double>,"
           "artefact_type string, trained_model boolean")
    rows = [(n, *(sound | change).values()) for n, (change, _) in enumerate(cases)]
    found = features.contract_violations(spark.createDataFrame(rows, ddl), 4, 1).orderBy("n").collect()
    assert [row.violations for row in found] == [codes for _, codes in cases]
    assert [row.compatible for row in found] == [not codes for _, codes in cases]
