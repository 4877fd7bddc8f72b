"""Round 8: larger tables."""

import os
import random
import re
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F

from tickloom import schema, session
from tickloom.operators import depth, quality
from tickloom.session import new_folder, stage
from tickloom.sources import audit_log
from tickloom.streaming import replay

# Files of 64 KB a task, and a join whose small side only turns out small while it runs.
_LATE_BROADCAST = {
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "1",
    "spark.sql.autoBroadcastJoinThreshold": "20000",
    "spark.sql.shuffle.partitions": "8",
}


def test_a_file_has_one_writer_after_a_late_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in _LATE_BROADCAST}
    for key, value in _LATE_BROADCAST.items():
        spark.conf.set(key, value)
    try:
        n = F.col("id")
        lines = stage(
            spark.range(0, 40_000, 1, 4).select(
                n.alias("n"), (n % 40).alias("file_no"), F.sha2(n.cast("string"), 256).alias("value")
            ),
            "late-broadcast",
        )
        ends = lines.groupBy("file_no").agg(F.max("n").alias("_z"))
        path = f"{new_folder(spark, 'late-broadcast-log')}/audit.jsonl"
        cut = lines.join(ends, "file_no").filter("n <> _z")
        audit_log.write_files(cut.select("file_no", "n", "value"), path)
        files = audit_log.rotated_paths(path)
        assert len(files) == 40
        assert all(len(open(file).read().splitlines()) == 999 for file in files)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


class _Memory:
    """Value or map state that counts the messages it gets."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def _count(self, value):
        self.calls += 1
        return value

    def get(self):
        return self._count(self.value)

    def update(self, value):
        self.value = self._count(value)

    def iterator(self):
        return iter(self._count(list(self.held.items())))

    def getValue(self, key):
        return self._count(self.held.get(key))

    def updateValue(self, key, value):
        self.held[key] = self._count(value)

    def removeKey(self, key):
        self._count(self.held.pop(key, None))

    def clear(self):
        self.held, self.value = self._count({}), None


def _streamed(kind, batches):
    """Output rows of a symbol, state messages of each micro-batch, and the order state."""
    states = {"cursor": _Memory(), "order_state": _Memory(), "level_state": _Memory()}
    out, calls = [], []
    for batch in batches:
        processor = kind()
        for name, state in states.items():
            setattr(processor, name, state)
        frame = pd.DataFrame(batch, columns=schema.INDEXED_EVENT.fieldNames())
        before = sum(s.calls for s in states.values())
        for rows in processor.handleInputRows((1,), iter([frame]), None):
            out += rows.itertuples(index=False, name=None)
        calls.append(sum(s.calls for s in states.values()) - before)
    return out, calls, states["order_state"].held


def _busy_symbol(events: int):
    """A clean log: orders are added, some cut, replaced or cancelled, and one snapshot begins."""
    pick, live, rows = random.Random(8), {}, []
    for n in range(1, events + 1):
        known = pick.choice(sorted(live)) if live and pick.random() < 0.4 else None
        if n == events * 2 // 3:
            live.clear()
            rows.append((n, n, 1, "Snapshot", "None", 0, 0, 0, 0, 1, n))
        elif known is None:
            side = pick.choice(("Buy", "Sell"))
            price = 100 - pick.randint(1, 40) if side == "Buy" else 100 + pick.randint(1, 40)
            live[n * 7 - 3] = side, price
            rows.append((n, n, 1, "Add", side, price, 9, n * 7 - 3, 0, 0, n))
        else:
            kind = pick.choice(("Cancel", "Replace", "Execute"))
            side, price = live[known]
            rows.append((n, n, 1, kind, side, price, 9 if kind == "Replace" else 1, known, 0, 0, n))
            if kind != "Replace":
                rows[-1] = (*rows[-1][:3], "Cancel", *rows[-1][4:6], 0, *rows[-1][7:])
                del live[known]
    return rows


def test_packed_replay_equals_the_one_with_an_entry_per_order(monkeypatch):
    """Orders over many buckets, read all together and one by one, then a halt."""
    rows = _busy_symbol(900)
    rows.append((901, 901, 1, "Execute", "Buy", 0, 1, 10**9, 0, 0, 901))
    cuts = [0, 400, 420, 600, 602, 880, 903]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [rows[-1:]]
    expected = _streamed(replay.ReplayProcessor, batches)
    monkeypatch.setattr(replay, "_BUCKET", 8)
    got = _streamed(replay.PackedReplayProcessor, batches)
    assert got[0] == expected[0] and len(got[0]) == 902
    assert expected[0][900][4] == "unknown execute order id" and got[2] == {}


def test_packed_replay_sends_no_message_per_order():
    """Reading and writing the cursor and one bucket; an order and a level took a message each."""
    out, calls, held = _streamed(
        replay.PackedReplayProcessor, [_busy_symbol(200)[:100], _busy_symbol(200)[100:130]]
    )
    assert [r[3] for r in out] == ["applied"] * 130
    assert calls == [3, 4] and len(held) == 1


def _names(spark):
    folder = session._run_dir(spark)
    return {x.rsplit("-", 1)[0] for x in os.listdir(folder.removeprefix("file:"))}


def test_steps_of_a_table_go_when_it_is_there(spark):
    """What was staged on the way stayed beside the table, and so did all shuffle files."""
    def inner():
        return stage(spark.range(5).toDF("n"), "inner-step").filter("n > 1")

    def outer():
        kept = session.staged_once(spark, "steps", "inner-table", inner)
        return stage(kept.groupBy("n").count(), "outer-step")

    got = session.staged_once(spark, "steps", "outer-table", outer)
    assert sorted(r.n for r in got.collect()) == [2, 3, 4]
    assert got is session.staged_once(spark, "steps", "outer-table", outer)
    names = _names(spark)
    assert {"inner-table", "outer-table"} <= names
    assert not {"inner-step", "outer-step"} & names
    assert session.staged_once(spark, "steps", "inner-table", inner).count() == 3
    assert spark.conf.get(session._CLEANUP) == "false"


def test_judging_events_deals_them_twice(spark, make_events):
    """Order states were joined back to their events: two more deals of all of them."""
    events = make_events([
        (1, 1, 1, "Add", "Buy", 10, 5, 7), (2, 2, 1, "Trade", "None", 10, 5, 0),
        (3, 3, 1, "Cancel", "Buy", 10, 6, 7), (1, 1, 2, "Heartbeat", "None", 0, 0, 0),
        (2, 2, 2, "Execute", "Buy", 10, 6, 9), (3, 3, 2, "Add", "Buy", 0, 6, 9),
    ])
    judged = quality.annotate(events, quality.ReplayOptions(snapshots=False))
    got = {(r.symbol_id, r.event_index): r.reason for r in judged.collect()}
    assert got == {
        (1, 1): None, (1, 2): None,
        (1, 3): "invalid quantity exceeds resting order quantity",
        (2, 1): None, (2, 2): "unknown execute order id", (2, 3): "invalid price",
    }
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # the carried values of each branch


def test_plain_numbers_scale_like_all_others(spark):
    """Plain digits took the decimal arithmetic too; they give the same ticks without it."""
    texts = [
        "0", "7", "007.5", "1.25", "999999999.99999999", "1234567890.5", "1.123456785", "0.1234567850",
        "1.000000005", "-3.5", "+2", "1e3", " 4.5 ", "5.", ".5", "1.2.3", "", "abc", "12a", None,
    ]
    df = spark.createDataFrame([(x,) for x in texts], "s STRING")

    def expected(text, scale):
        try:
            value = Decimal(text.strip())
        except (AttributeError, InvalidOperation):
            return None
        return int((value * scale).to_integral_value(ROUND_HALF_EVEN))

    for scale in (100_000_000, 100, 1, 25):
        ticks = df.select("s", depth.to_ticks(F.col("s"), scale).alias("t"))
        assert [r.t for r in ticks.collect()] == [expected(x, scale) for x in texts]
    plan = df.select(depth.to_ticks(F.col("s"), 100))._jdf.queryExecution().optimizedPlan()
    assert "RLIKE" in plan.toString()


def test_the_envelope_is_parsed_of_wrapped_messages_only(spark):
    lines = [
        (1, '{"e":"depthUpdate","E":5,"s":"X","U":1,"u":2,"b":[["1","2"]],"a":[]}'),
        (2, '{"_captured_at_ns":9,"symbol":"Y","data":{"lastUpdateId":3,"bids":[],"asks":[]}}'),
        (3, '{"_captured_at_ns":8,"symbol":"Y","lastUpdateId":3,"bids":[],"asks":[]}'),
    ]
    parsed = depth.parse_lines(spark.createDataFrame(lines, "raw_index BIGINT, line STRING"))
    got = {r.raw_index: (r.kind, r.symbol, r.known_ns, r.final_id) for r in parsed.collect()}
    assert got == {
        1: ("diff", "X", 5_000_000, 2), 2: ("snapshot", "Y", 9, 3), 3: ("missing", None, None, 3),
    }
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"StructField\(_captured_at_ns,LongType,true\), CASE WHEN _wrapped", plan)
