"""Round 6: work that was done again for every name, row or message."""

import pandas as pd

from tickloom import schema
from tickloom.plans import views as V
from tickloom.sources import event_log
from tickloom.streaming import replay


def test_csv_fields_are_parsed_once(spark, tmp_path):
    """A filter on the error used to repeat the parsing of every field beneath it."""
    path = tmp_path / "log.csv"
    path.write_text("1,1,1,A,B,10,5,1,0,0\n2,2,1,A,B,1x,5,2,0,0\n")
    bad = event_log.parse_csv(spark, [str(path)]).filter("error IS NOT NULL")
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 13  # three signed fields, five unsigned ones that name it twice
    assert [r.error for r in bad.collect()] == [
        "failed to parse CSV numeric field price_ticks"]
    good = event_log.read_csv(spark, [str(path)], strict=False).collect()
    assert [(r.event_type, r.side, r.price_ticks) for r in good] == [("Add", "Buy", 10)]


class _State:
    """Map, list and value state in memory that counts its calls."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def _count(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._count(self.value)

    def exists(self):
        return self._count(self.value is not None)

    def update(self, value):
        self.value = self._count(value)

    put = update

    def iterator(self):
        return self._count(iter(list(self.held.items())))

    def getValue(self, key):
        return self._count(self.held.get(key))

    def containsKey(self, key):
        return self._count(key in self.held)

    def updateValue(self, key, value):
        self.held[key] = self._count(value)

    def removeKey(self, key):
        self._count(self.held.pop(key))

    def clear(self):
        self.held, self.value = self._count({}), None


def _replayed(batches):
    """Output rows and state calls of a symbol, a micro-batch at a time."""
    cursor, orders, levels = _State(), _State(), _State()
    out, calls = [], []
    for batch in batches:
        processor = replay.ReplayProcessor()
        processor.cursor, processor.order_state, processor.level_state = cursor, orders, levels
        frame = pd.DataFrame(batch, columns=schema.INDEXED_EVENT.fieldNames())
        before = cursor.calls + orders.calls + levels.calls
        for rows in processor.handleInputRows((1,), iter([frame]), None):
            out += rows.itertuples(index=False, name=None)
        calls.append(cursor.calls + orders.calls + levels.calls - before)
    return out, calls, orders.held


def test_replay_asks_its_state_little():
    """An order was looked up, and a level looked for, in a message each; halted symbols too."""
    def add(n):
        return n, n, 1, "Add", "Buy", 10 + n, 5, n, 0, 0, n

    def cancel(n, order):
        return n, n, 1, "Cancel", "Buy", 10 + order, 0, order, 0, 0, n

    first = [add(n) for n in range(1, 21)]
    second = [cancel(20 + n, n) for n in range(1, 20)]
    third = [add(41), cancel(42, 41), add(43)]
    out, calls, held = _replayed([first, second, third[1:], third])
    assert [r[3] for r in out] == ["applied"] * 39 + ["halted"] + ["skipped"] * 4
    assert out[38][5:] == (1, 30, None) and held == {}
    # A cursor read and written, 20 orders and 20 levels written; then orders and levels read, 19 of
    # each removed. A halted symbol reads its cursor.
    assert calls[0] == 42 and calls[1] == 42 and calls[3] == 1


def test_replay_looks_up_few_of_many_orders():
    def add(n):
        return n, n, 1, "Add", "Buy", 10 + n, 5, n, 0, 0, n

    first = [add(n) for n in range(1, 101)]
    second = [(101, 101, 1, "Execute", "Buy", 0, 2, 7, 0, 0, 101)]
    out, calls, held = _replayed([first, second])
    assert out[-1][3:] == ("applied", None, 100, 110, None)
    assert held[(7,)] == ("Buy", 17, 3) and len(held) == 100
    assert calls[1] <= 6


def test_flow_is_compiled(spark, tmp_path, monkeypatch):
    """An array filter in the flow ran uncompiled, line by line; every event is still there."""
    spark.createDataFrame(
        [(1, 10, 3, 1, 4.0, 1.0, 0.0, 0.0, "A", "F"), (1, 11, 3, 2, 5.0, 1.0, 0.0, 0.0, "R", "F"),
         (2, 12, 3, 1, 6.0, 1.0, 0.0, 0.0, "N", "F"), (2, 13, 3, 3, 7.0, 1.0, 0.0, 0.0, "N", "O")],
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING",
    ).selectExpr("*", "TIMESTAMP_NTZ '1996-01-01 00:00:00' AS l_shipdate").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    plans = []
    keep = V.number_rows

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, *args)

    monkeypatch.setattr(V, "number_rows", watched)
    rows = V.order_flow(spark, str(tmp_path)).orderBy("event_index").collect()
    assert "lambda" not in plans[-1]
    assert [(r.order_id, r.event_type, r.quantity) for r in rows] == [
        (1, "Add", 4), (2, "Add", 5), (3, "Add", 6), (4, "Add", 7),
        (1, "Execute", 2), (3, "Replace", 7), (2, "Cancel", 0)]
