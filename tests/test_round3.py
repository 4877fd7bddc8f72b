"""Folds that compose, and the operators that replaced sequential rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import limits, portfolio

FILLS = "symbol_id BIGINT, fill_index BIGINT, side STRING, quantity BIGINT, price_ticks BIGINT"


def plain_fold(rows, start=None):
    held, out = dict(start or {}), []
    for symbol, n, side, size, price in rows:
        q, c = held.get(symbol, (0, 0))
        s = {"Buy": size, "Sell": -size}.get(side, 0) if size > 0 else 0
        gain = 0
        if s and q * s >= 0:
            paid = c * abs(q) + price * abs(s)
            q, c = q + s, int(paid / abs(q + s)) if abs(paid) < 2**50 else (
                abs(paid) // abs(q + s) * (1 if paid >= 0 else -1))
        elif s:
            gain = (price - c) * min(abs(s), abs(q)) * (1 if q > 0 else -1)
            after = q + s
            c = 0 if after == 0 else price if after * q < 0 else c
            q = after
        held[symbol] = (q, c)
        out.append((symbol, n, q, c, gain))
    return sorted(out)


def random_fills(seed, n, sizes, prices, buys):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        side = "Buy" if rng.random() < buys else "Sell"
        if rng.random() < 0.05:
            side = rng.choice(["None", "Buy"])
        size = rng.choice(sizes) if rng.random() > 0.05 else rng.choice([0, -5])
        out.append((1 if rng.random() < 0.8 else rng.randint(2, 4), k, side, size,
                    rng.choice(prices)))
    return out


@pytest.mark.parametrize("case", [
    (1, 400, range(1, 50), range(900, 1100), 0.5),        # turns and closes
    (2, 400, range(1, 5), range(1, 100_000), 0.95),       # a position that only grows
    (3, 400, range(1, 9), range(-50, 50), 0.7),           # prices of both signs
    (4, 120, [1, 10**9], range(10**6, 10**6 + 30), 0.9),  # slopes close to one
])
def test_average_cost_over_many_blocks(spark, case):
    rows = random_fills(*case)
    start = {1: (7, 950), 3: (-5, 3), 9: (2, 5)}
    begun = spark.createDataFrame([(k, q, c) for k, (q, c) in start.items()],
                                  "symbol_id BIGINT, quantity BIGINT, average_cost_ticks BIGINT")
    df = spark.createDataFrame(rows, FILLS)
    for block in (5, 10**6):
        got = portfolio.fold_fills(df, block_rows=block).collect()
        assert sorted(map(tuple, got)) == plain_fold(rows)
    got = portfolio.fold_fills(df, begun, block_rows=11).collect()
    assert sorted(map(tuple, got)) == plain_fold(rows, start)


def test_cost_curve_is_the_fold():
    """The curve gives, for every start, what folding from that start gives."""
    rng = random.Random(8)
    for _ in range(300):
        low = rng.randint(-40, 40)
        high, held = low + rng.randint(0, 60), rng.choice([-30, -3, 2, 9, 400])
        fills = [(rng.choice([-4, -1, 0, 1, 2, 7]), rng.randint(low, high))
                 for _ in range(rng.randint(0, 12))]
        first, starts = portfolio.cost_curve(held, fills, low, high)
        for cost in range(low, high + 1):
            q, c = held, cost
            for signed, price in fills:
                if signed:
                    q, c, _ = portfolio._apply(q, c, signed, price)
            want = cost if first is None else first + sum(s <= cost for s in starts)
            assert c == want
        assert starts == sorted(starts)


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_average_cost_takes_as_many_jobs_for_any_number_of_blocks(spark):
    rows = random_fills(5, 500, range(1, 5), range(900, 1100), 0.9)
    df = spark.createDataFrame(rows, FILLS)
    few = jobs_of(spark, "few", lambda: portfolio.fold_fills(df, block_rows=100).collect())
    many = jobs_of(spark, "many", lambda: portfolio.fold_fills(df, block_rows=10).collect())
    assert many == few


def plain_rates(rows, window):
    open_at, out = {}, {}
    for client, n, ts in sorted(rows, key=lambda r: r[1]):
        start, count = open_at.get(client, (None, 0))
        if start is None or ts - start >= window:
            start, count = ts, 0
        open_at[client] = (start, count + 1)
        out[client, n] = count + 1
    return out


def test_fixed_windows_by_doubling(spark):
    """Times that stand still or go back, a busy client, one message, windows of one message."""
    rng = random.Random(6)
    now, rows = 0, []
    for n in range(1, 700):
        now += rng.choice([0, 0, 1, 3, 40, -2, -15])
        rows.append((rng.choice([1, 1, 1, 2]), n, now))
    rows += [(3, 700, 5), (4, 800, 5), (4, 801, 0), (4, 802, 25), (4, 803, 15), (4, 804, 26)]
    rows += [(5, 1000 + k, 100 * k) for k in range(70)]
    df = spark.createDataFrame(rows, "client_id BIGINT, arrival BIGINT, timestamp_ns BIGINT")
    for block in (9, 10**6):
        got = {(r.client_id, r.arrival): r.observed_rate
               for r in limits.fixed_rate(df, 20, block).collect()}
        assert got == plain_rates(rows, 20)


def test_fixed_window_rounds_grow_with_the_logarithm(spark):
    def jobs(windows):
        rows = [(1, k, 100 * k) for k in range(windows)]
        df = spark.createDataFrame(rows, "client_id BIGINT, arrival BIGINT, timestamp_ns BIGINT")
        return jobs_of(spark, f"w{windows}", lambda: limits.fixed_rate(df, 100, 50).collect())

    one, two, three = jobs(8), jobs(32), jobs(128)
    assert three - two <= two - one + 2


def test_windows_close_by_the_watermark(spark, tmp_path):
    """Append mode: closed windows are written once, rows that come later do not count."""
    from tickloom.streaming import windows

    day = "2024-01-01 "
    batches = [
        [("00:10:00", 1), ("00:50:00", 2), ("01:20:00", 4)],
        [("02:30:00", 8), ("01:40:00", 16)],   # closes nothing yet: the watermark follows
        [("02:40:00", 256)],                   # closes the first window
        [("00:20:00", 32), ("01:50:00", 64)],  # the first is late, the second is in time
        [("05:00:00", 128)],
    ]
    for rows in batches:
        spark.createDataFrame([(day + t, v) for t, v in rows], "t STRING, v BIGINT").select(
            F.to_timestamp("t").alias("ts"), F.lit("k").alias("k"), "v"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.file_stream(
        spark, str(tmp_path / "in"), "ts TIMESTAMP, k STRING, v BIGINT", maxFilesPerTrigger="1")
    counted = windows.windowed_counters(stream, ["k"], "v", "1 hour")
    got = windows.run_to_table(counted, "append")
    rows = sorted((r.start.hour, r.event_count, r.total) for r in got.collect())
    assert rows == [(0, 2, 3), (1, 3, 84), (2, 2, 264)]
