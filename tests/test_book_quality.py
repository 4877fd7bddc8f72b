import random

import pytest

from naive import Book, random_flow
from tickloom.operators import book, quality

HOT_PATH = [
    (1000000000, 1, 1, "Add", "Buy", 999, 300, 1001),
    (1000000001, 2, 1, "Add", "Sell", 1001, 100, 1002),
    (1000000002, 3, 1, "Add", "Sell", 1002, 500, 1003),
    (1000000003, 4, 1, "Execute", "Buy", 999, 50, 1001, 9101, 0),
    (1000000004, 5, 1, "Replace", "Sell", 1003, 450, 1003),
    (1000000005, 6, 1, "Execute", "Sell", 1001, 20, 1002, 9102, 0),
    (1000000006, 7, 1, "Add", "Buy", 998, 400, 1004),
    (1000000007, 8, 1, "Cancel", "Sell", 1001, 0, 1002),
    (1000000008, 9, 1, "Add", "Sell", 1004, 250, 1005),
    (1000000009, 10, 1, "Execute", "Buy", 998, 75, 1004, 9103, 0),
    (1000000010, 11, 1, "Replace", "Buy", 997, 225, 1001),
    (1000000011, 12, 1, "Heartbeat", "None", 0, 0, 0),
]


def test_final_ladder_of_golden_log(make_events):
    levels = book.l2_levels(book.live_orders(make_events(HOT_PATH)))
    got = {(r.side, r.price_ticks): r.quantity for r in levels.collect()}
    assert got == {("Buy", 998): 325, ("Buy", 997): 225, ("Sell", 1003): 450, ("Sell", 1004): 250}


def test_snapshot_begin_clears_the_book(make_events):
    rows = [
        (1, 1, 1, "Add", "Buy", 999, 100, 1),
        (2, 2, 1, "Add", "Sell", 1001, 50, 2),
        (3, 3, 1, "Snapshot", "Buy", 990, 200, 10, 0, 1),
        (4, 4, 1, "Snapshot", "Sell", 1010, 150, 11, 0, 0),
        (5, 5, 1, "Snapshot", "None", 0, 0, 0, 0, 2),
    ]
    orders = book.live_orders(make_events(rows))
    assert {(r.side, r.price_ticks, r.quantity) for r in orders.collect()} == {
        ("Buy", 990, 200), ("Sell", 1010, 150),
    }


def test_replace_loses_priority_and_keeps_side(make_events):
    rows = [
        (1, 1, 1, "Add", "Buy", 100, 5, 1),
        (2, 2, 1, "Add", "Buy", 100, 6, 2),
        (3, 3, 1, "Replace", "Sell", 100, 7, 1),
    ]
    queue = book.fifo_queue(book.live_orders(make_events(rows)), block_rows=2)
    assert [(r.order_id, r.side) for r in sorted(queue.collect(), key=lambda r: r.fifo_rank)] == [
        (2, "Buy"), (1, "Buy"),
    ]
    assert book.best_orders(queue).first().order_id == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_flow_matches_sequential_book(make_events, seed):
    rows = random_flow(random.Random(seed))
    events = make_events(rows)
    # Small blocks: every symbol is split many times.
    quotes = {
        (r.symbol_id, r.event_index): (r.bid_price, r.bid_quantity, r.ask_price, r.ask_quantity)
        for r in book.quote_timeline(events, block_rows=37).collect()
    }
    levels = {
        (r.symbol_id, r.side, r.price_ticks): r.quantity
        for r in book.l2_levels(book.live_orders(events)).collect()
    }
    names = (
        "timestamp_ns", "sequence_number", "symbol_id", "event_type", "side", "price_ticks",
        "quantity", "order_id", "trade_id", "flags",
    )
    books, place, final = {}, {}, {}
    for row in rows:
        e = dict(zip(names, row, strict=True))
        symbol = e["symbol_id"]
        books.setdefault(symbol, Book()).apply(e)
        place[symbol] = place.get(symbol, 0) + 1
        assert quotes[(symbol, place[symbol])] == books[symbol].top()
    for symbol, b in books.items():
        final |= {(symbol, *k): q for k, q in b.levels().items()}
    assert levels == final


BAD = [
    ([(1, 1, 1, "Add", "Buy", 100, 0, 1)], "invalid quantity"),
    ([(1, 1, 1, "Add", "Buy", 100, -5, 1)], "invalid quantity"),
    ([(1, 1, 1, "Add", "Buy", -1, 5, 1)], "invalid price"),
    ([(1, 1, 1, "Add", "None", 100, 5, 1)], "invalid side"),
    ([(1, 1, 1, "Add", "Buy", 100, 5, 0)], "invalid order id"),
    ([(1, 1, 0, "Heartbeat", "None", 0, 0, 0)], "invalid symbol id"),
    ([(1, 1, 1, "Heartbeat", "None", -1, 0, 0)], "invalid negative price"),
    ([(1, 1, 1, "Heartbeat", "None", 0, -1, 0)], "invalid negative quantity"),
    ([(1, 1, 1, "Add", "Buy", 100, 5, 1), (1, 3, 1, "Add", "Buy", 100, 5, 2)],
     "sequence gap: expected 2, received 3"),
    ([(2, 1, 1, "Add", "Buy", 100, 5, 1), (1, 2, 1, "Add", "Buy", 100, 5, 2)],
     "timestamp reversal: previous 2, received 1"),
    ([(1, 1, 1, "Snapshot", "None", 100, 5, 7, 0, 1)], "invalid snapshot side"),
    ([(1, 1, 1, "Snapshot", "Buy", 0, 5, 7, 0, 1)], "invalid snapshot price"),
    ([(1, 1, 1, "Snapshot", "Buy", 9, 0, 7, 0, 1)], "invalid snapshot quantity"),
    ([(1, 1, 1, "Add", "Buy", 100, 10, 1), (1, 2, 1, "Execute", "Buy", 100, 11, 1)],
     "invalid quantity exceeds resting order quantity"),
    ([(1, 1, 1, "Cancel", "Buy", 100, 0, 1)], "unknown cancel order id"),
    ([(1, 1, 1, "Replace", "Buy", 100, 3, 1)], "unknown replace order id"),
    ([(1, 1, 1, "Execute", "Buy", 100, 3, 1)], "unknown execute order id"),
    ([(1, 1, 1, "Add", "Buy", 100, 10, 1), (1, 2, 1, "Add", "Buy", 100, 11, 1)],
     "duplicate order id"),
    ([(1, 1, 1, "Add", "Buy", 100, 10, 1), (1, 2, 1, "Snapshot", "Buy", 100, 11, 1, 0, 0)],
     "failed to apply Snapshot event"),
    ([(1, 1, 1, "Add", "Buy", 100, 10, 1), (1, 2, 1, "Add", "Sell", 100, 11, 2)],
     "crossed book state: best bid 100 >= best ask 100"),
]


def test_bad_input_matrix(make_events):
    """Every case is one symbol of a shared log, followed by a good row that must not count."""
    rows, expected = [], {}
    for n, (case, reason) in enumerate(BAD, start=1):
        symbol = 0 if case[0][2] == 0 else n
        rows += [(*r[:2], symbol, *r[3:]) for r in case]
        expected[symbol] = (len(case) - 1, reason)
    found = quality.diagnostics(make_events(rows))
    got = {r.symbol_id: (r.event_index, r.reason) for r in found.collect()}
    assert got == expected


def test_other_symbols_continue_after_a_halt(make_events):
    rows = [
        (1, 1, 1, "Add", "Buy", 100, 5, 1),
        (1, 3, 1, "Add", "Buy", 100, 5, 2),
        (1, 4, 1, "Add", "Buy", 100, 5, 3),
        (1, 1, 2, "Add", "Buy", 100, 5, 1),
        (1, 2, 2, "Add", "Buy", 100, 5, 2),
    ]
    events = make_events(rows)
    found = quality.diagnostics(events)
    summary = {r.symbol_id: r for r in quality.symbol_summary(events, found).collect()}
    assert (summary[1].event_count, summary[1].events_processed, summary[1].last_sequence) == (3, 1, 4)
    assert summary[2].sequence_valid and summary[2].events_processed == 2
    assert quality.valid_prefix(events, found).count() == 3


def test_crossing_event_stays_in_the_book(make_events):
    rows = [(1, 1, 1, "Add", "Buy", 100, 10, 1), (1, 2, 1, "Add", "Sell", 99, 11, 2)]
    events = make_events(rows)
    found = quality.diagnostics(events)
    assert quality.valid_prefix(events, found).count() == 1
    assert book.live_orders(quality.applied_events(events, found)).count() == 2


def test_reconciliation_finds_each_violation(make_events):
    orders = book.live_orders(make_events(HOT_PATH))
    levels = book.l2_levels(orders)
    assert book.reconcile_levels(orders, levels).count() == 0
    broken = levels.filter("price_ticks <> 998").unionByName(
        levels.limit(1).selectExpr(
            "symbol_id", "side", "7L as price_ticks", "quantity", "order_count"
        )
    )
    got = {r.violation for r in book.reconcile_levels(orders.unionByName(orders.limit(1)), broken).collect()}
    assert "level missing for resting orders" in got
    assert "empty price level was retained" in got
    assert "duplicate order id in price queues" in got
