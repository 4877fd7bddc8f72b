import random

from naive import random_flow
from tickloom.operators import book, lifecycle, quality
from tickloom.streaming import replay, windows


def test_stream_equals_batch_over_many_micro_batches(spark, make_events, tmp_path):
    rows = random_flow(random.Random(9), symbols=2, events=120)
    rows[150] = (*rows[150][:1], 999, *rows[150][2:])
    events = make_events(rows)
    batches = [events.filter(f"event_index > {n} AND event_index <= {n + 40}") for n in (0, 40, 80)]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    windows.use_state_store(spark)
    stream = windows.file_stream(
        spark, str(tmp_path / "in"), events.schema, maxFilesPerTrigger="1"
    )
    got = windows.run_to_table(replay.replay_stream(stream), "parity").collect()
    found = quality.diagnostics(events)
    halts = {r.symbol_id: (r.log_index, r.reason) for r in found.collect()}
    stopped = {r.symbol_id: (r.event_index, r.reason) for r in got if r.status == "halted"}
    assert stopped == halts and len(halts) == 1
    quotes = {
        (r.symbol_id, r.event_index): (r.bid_price, r.ask_price)
        for r in book.quote_timeline(quality.valid_prefix(events, found), block_rows=50).collect()
    }
    applied = {
        (r.symbol_id, r.event_index): (r.bid_price, r.ask_price)
        for r in got if r.status == "applied"
    }
    assert applied == quotes


def test_lifecycle_history(spark):
    rows = [
        (1, 1, "order_accepted"), (1, 2, "cancel_requested"), (1, 3, "cancel_rejected"),
        (1, 4, "order_filled"), (1, 5, "cancel_requested"),
        (2, 1, "cancel_requested"), (2, 2, "order_accepted"), (2, 3, "order_accepted"),
        (0, 1, "order_accepted"),
    ]
    events = spark.createDataFrame(rows, "order_id BIGINT, event_index BIGINT, event_type STRING")
    history = lifecycle.state_history(events, block_rows=2)
    got = {(r.order_id, r.event_index): (r.valid, r.state_after) for r in history.collect()}
    assert got == {
        (1, 1): (True, "accepted"), (1, 2): (True, "pending_cancel"), (1, 3): (True, "accepted"),
        (1, 4): (True, "filled"), (1, 5): (False, "filled"),
        (2, 1): (False, "none"), (2, 2): (True, "accepted"), (2, 3): (False, "accepted"),
        (0, 1): (False, "none"),
    }
    sessions = spark.createDataFrame(
        [(1, "connect"), (2, "connect"), (3, "disconnect"), (4, "reconnect")],
        "event_index BIGINT, event_type STRING",
    )
    total = lifecycle.summary(history, sessions).first()
    assert (total.live_order_count, total.filled_order_count, total.cancel_reject_count) == (1, 1, 1)
    assert (total.connect_count, total.disconnect_count, total.reconnect_count) == (1, 1, 1)
    assert [r.order_id for r in lifecycle.disconnect_requests(history, 3).collect()] == [1, 2]
