"""Ladder sweeps and quotes at probes against a book kept in plain dictionaries."""

import random

import pytest

from tickloom.operators import book


def _plain_sweep(levels, sign, limit, wanted):
    filled = cost = 0
    for price in sorted(levels, key=lambda p: sign * p):
        if limit is not None and sign * (price - limit) > 0:
            break
        take = min(levels[price], wanted - filled)
        filled, cost = filled + take, cost + take * price
    return filled, cost


def _best(levels, sign):
    if not levels:
        return None, None
    price = min(levels, key=lambda p: sign * p)
    return price, levels[price]


@pytest.mark.parametrize("block_rows", [25, 1_000])
def test_sweeps_match_a_plain_book(spark, block_rows):
    rng = random.Random(block_rows)
    deltas, probes, expected = [], [], {}
    for symbol in (1, 2):
        books = {"Buy": {}, "Sell": {}}
        for index in range(1, 301):
            side = rng.choice(["Buy", "Sell"])
            levels = books[side]
            if index % 3:
                price = rng.randrange(90, 111)
                held = levels.get(price, 0)
                delta = -held if held and rng.random() < 0.4 else rng.randrange(1, 9)
                levels[price] = held + delta
                if not levels[price]:
                    del levels[price]
                deltas.append((symbol, 0, index, side, price, delta))
                continue
            limit = None if rng.random() < 0.2 else rng.randrange(85, 116)
            wanted, probe = rng.choice([0, 1, 7, 30, 500]), symbol * 1000 + index
            probes.append((symbol, index, probe, side, limit, wanted))
            other, sign = ("Sell", 1) if side == "Buy" else ("Buy", -1)
            expected[probe] = (
                *_best(books["Buy"], -1), *_best(books["Sell"], 1),
                *_plain_sweep(books[other], sign, limit, wanted),
                [(p, books["Buy"][p]) for p in sorted(books["Buy"], reverse=True)[:2]],
            )
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(small, "7")
    try:
        found = book.walk_books(
            spark.createDataFrame(
                deltas, "symbol_id BIGINT, epoch BIGINT, event_index BIGINT, side STRING, "
                "price_ticks BIGINT, delta BIGINT"),
            spark.createDataFrame(
                probes, "symbol_id BIGINT, event_index BIGINT, probe_id BIGINT, side STRING, "
                "price_ticks BIGINT, quantity BIGINT"),
            depth=2, sweep=True, block_rows=block_rows,
        ).collect()
    finally:
        spark.conf.unset(small)
    got = {
        r.probe_id: (r.bid_price, r.bid_quantity, r.ask_price, r.ask_quantity, r.fill_quantity,
                     r.fill_cost, [tuple(level) for level in r.bids])
        for r in found
    }
    assert got == expected
