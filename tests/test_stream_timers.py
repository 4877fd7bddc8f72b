"""State expiry and alerts by event-time timers, and replay over restarts."""

import random

from naive import random_flow
from pyspark.sql import functions as F

from tickloom.operators import book, quality
from tickloom.streaming import gates, replay, windows

SECOND = 1_000_000_000


def _run(spark, rows, schema, transform, slots, base):
    """Rows carry their slot last; one micro-batch each, restarted from the checkpoint."""
    table = spark.createDataFrame(rows, f"{schema}, slot INT")
    windows.use_state_store(spark)
    for n in range(slots):
        part = table.filter(F.col("slot") == n).drop("slot").coalesce(1)
        part.write.mode("append").parquet(f"{base}/in")
        feed = windows.file_stream(spark, f"{base}/in", part.schema)
        found = windows.run_to_table(transform(feed), "timers", base=base)
    return found.collect()


def _state(spark, base, name):
    return (
        spark.read.format("statestore").option("stateVarName", name)
        .load(f"{base}/checkpoint").collect()
    )


def test_rate_state_ends_with_its_window(spark, tmp_path):
    # Client 1 falls silent, client 2 goes on; the second message of client 1 is older than the first.
    rows = [
        (1, 1, 10 * SECOND, 0), (1, 2, 8 * SECOND, 0), (2, 3, 10 * SECOND, 0),
        (1, 4, 12 * SECOND, 1), (2, 5, 13 * SECOND, 1),
        (2, 6, 60 * SECOND, 2), (2, 7, 61 * SECOND, 2),
    ]
    base = str(tmp_path)
    got = _run(
        spark, rows, "client_id BIGINT, arrival BIGINT, timestamp_ns BIGINT",
        lambda feed: gates.rate_stream(feed, 2, 4 * SECOND, watermark="5 seconds"), 3, base,
    )
    assert {(r.client_id, r.arrival, r.observed_rate, r.allowed) for r in got} == {
        (1, 1, 1, True), (1, 2, 2, True), (1, 4, 2, True), (2, 3, 1, True), (2, 5, 2, True),
        (2, 6, 1, True), (2, 7, 2, True),
    }
    assert {r.key.client_id for r in _state(spark, base, "times")} == {2}


def test_fixed_rate_state_ends_with_its_window(spark, tmp_path):
    rows = [
        (1, 1, 10 * SECOND, 0), (1, 2, 11 * SECOND, 0), (1, 3, 13 * SECOND, 1),
        (1, 4, 14 * SECOND, 1), (2, 5, 60 * SECOND, 1),
    ]
    base = str(tmp_path)
    got = _run(
        spark, rows, "client_id BIGINT, arrival BIGINT, timestamp_ns BIGINT",
        lambda feed: gates.rate_stream(feed, 2, 4 * SECOND, False, "5 seconds"), 2, base,
    )
    assert {(r.arrival, r.observed_rate, r.allowed) for r in got} == {
        (1, 1, True), (2, 2, True), (3, 3, False), (4, 1, True), (5, 1, True),
    }
    assert {r.key.client_id for r in _state(spark, base, "span")} == {2}


def test_stale_price_raises_a_row_without_a_message(spark, tmp_path):
    # Symbol 1 never sends again; symbol 2 renews in time once, then too late inside one batch.
    rows = [
        (1, 10 * SECOND, None, 100, 0), (1, 11 * SECOND, 7, None, 0),
        (2, 10 * SECOND, None, 200, 0), (2, 14 * SECOND, None, 201, 1),
        (2, 30 * SECOND, None, 202, 1), (2, 31 * SECOND, 8, None, 1), (3, 12 * SECOND, 9, None, 0),
    ]
    got = _run(
        spark, rows,
        "symbol_id BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, reference_price_ticks BIGINT",
        lambda feed: gates.stale_stream(feed, 5 * SECOND, "1 second"), 2, str(tmp_path),
    )
    late = 5 * SECOND + gates.MILLI
    raised = [r for r in got if r.client_order_id is None]
    assert {(r.symbol_id, r.reference_price_ticks, r.timestamp_ns, r.age_ns) for r in raised} == {
        (1, 100, 10 * SECOND + late, late), (2, 201, 14 * SECOND + late, late),
    }
    assert len(raised) == 2 and all(r.stale for r in raised)
    judged = {(r.client_order_id, r.reference_price_ticks, r.age_ns, r.stale)
              for r in got if r.client_order_id is not None}
    assert judged == {(7, 100, SECOND, False), (8, 202, SECOND, False), (9, None, None, True)}


def test_replay_keeps_books_over_restarts_and_drops_halted_ones(spark, make_events, tmp_path):
    rows = random_flow(random.Random(4), symbols=2, events=100)
    rows[150] = (*rows[150][:1], 999, *rows[150][2:])
    events = make_events(rows)
    base = str(tmp_path)
    windows.use_state_store(spark)
    for n in range(5):
        part = events.filter(f"event_index > {20 * n} AND event_index <= {20 * (n + 1)}")
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        feed = windows.file_stream(spark, f"{base}/in", events.schema)
        got = windows.run_to_table(replay.replay_stream(feed), "restarts", base=base)
    found = quality.diagnostics(events)
    halted = {r.symbol_id for r in found.collect()}
    valid = quality.valid_prefix(events, found)
    quotes = {
        (r.symbol_id, r.event_index): (r.bid_price, r.ask_price)
        for r in book.quote_timeline(valid, block_rows=50).collect()
    }
    assert quotes == {
        (r.symbol_id, r.event_index): (r.bid_price, r.ask_price)
        for r in got.filter("status = 'applied'").collect()
    }
    held = {
        (r.key.symbol_id, r.user_map_key.order_id): tuple(r.user_map_value)
        for r in _state(spark, base, "orders")
    }
    live = {
        (r.symbol_id, r.order_id): (r.side, r.price_ticks, r.quantity)
        for r in book.live_orders(valid).collect() if r.symbol_id not in halted
    }
    assert len(halted) == 1 and held == live and live
    levels: dict[tuple, int] = {}
    for (symbol, _), (side, price, _) in live.items():
        levels[symbol, side, price] = levels.get((symbol, side, price), 0) + 1
    assert levels == {
        (r.key.symbol_id, *r.user_map_key): r.user_map_value.orders
        for r in _state(spark, base, "levels")
    }
