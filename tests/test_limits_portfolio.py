import random

from pyspark.sql import functions as F

from tickloom.operators import features, latency, limits, portfolio


def _requests(spark, rows, market=1000, market_ns=0):
    """rows: (arrival, ts, client order, client, symbol, side, price, qty)."""
    df = spark.createDataFrame(
        rows,
        "arrival BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, client_id BIGINT, "
        "symbol_id BIGINT, side STRING, price_ticks BIGINT, quantity BIGINT",
    )
    return df.withColumns(
        {
            "scope": F.lit(1).cast("bigint"),
            "order_type": F.lit("Limit"),
            "reference_price_ticks": F.lit(market).cast("bigint"),
            "reference_ns": F.lit(market_ns).cast("bigint"),
            "position": F.lit(0).cast("bigint"),
            "exposure_base": F.lit(0).cast("bigint"),
        }
    )


def _decide(requests, lim, reports=None, replaces=None, controls=None, block_rows=2):
    messages = limits.message_stream(requests, reports, replaces, controls)
    rows = limits.decide_orders(messages, lim, block_rows=block_rows).collect()
    return sorted(rows, key=lambda r: (r.arrival, r.client_order_id))


def test_open_quantity_and_release(spark):
    orders = _requests(
        spark,
        [(1, 101, 1, 7, 1, "Buy", 1000, 100), (2, 102, 2, 7, 1, "Buy", 1000, 100),
         (4, 103, 3, 7, 1, "Buy", 1000, 100)],
    )
    reports = spark.createDataFrame(
        [(1, 3, 102, 1, 10001, "Canceled", "Canceled", 0, 0)],
        "scope BIGINT, arrival BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, "
        "exchange_order_id BIGINT, order_status STRING, exec_type STRING, "
        "remaining_quantity BIGINT, resting_price_ticks BIGINT",
    )
    got = _decide(orders, limits.RiskLimits(max_open_order_quantity=150), reports)
    assert [(r.check_name, r.limit_value, r.observed_value) for r in got] == [
        ("accepted", 1_000_000, 100_000),
        ("max_open_order_quantity", 150, 200),
        ("accepted", 1_000_000, 100_000),
    ]


def test_rate_windows(spark):
    fixed = limits.RiskLimits(max_messages_per_window=2, rate_window_ns=100)
    orders = _requests(
        spark,
        [(n, ts, n, client, 1, "Buy", 1000, 10)
         for n, (ts, client) in enumerate([(10, 7), (20, 7), (30, 7), (30, 8), (200, 7)], 1)],
    )
    got = _decide(orders, fixed)
    assert [r.accepted for r in got] == [True, True, False, True, True]
    assert (got[2].check_name, got[2].limit_value, got[2].observed_value) == (
        "message_rate_limit", 2, 3,
    )
    sliding = limits.RiskLimits(
        max_messages_per_window=2, rate_window_ns=100, rate_limit_mode="sliding-window"
    )
    orders = _requests(
        spark,
        [(n, ts, n, 7, 1, "Buy", 1000, 10) for n, ts in enumerate([0, 90, 99, 200], 1)],
    )
    got = _decide(orders, sliding)
    assert [r.accepted for r in got] == [True, True, False, True]
    assert (got[2].check_name, got[2].observed_value) == ("message_rate_limit_sliding", 3)


def test_rate_operators_match_brute_force(spark):
    rng = random.Random(5)
    now, rows = 0, []
    for n in range(1, 200):
        now += rng.choice([0, 1, 20, 150])
        rows.append((1 if rng.random() < 0.8 else 2, n, now))
    df = spark.createDataFrame(rows, "client_id BIGINT, arrival BIGINT, timestamp_ns BIGINT")
    slide = {r.arrival: r.observed_rate for r in limits.sliding_rate(df, 100).collect()}
    fixed = {r.arrival: r.observed_rate for r in limits.fixed_rate(df, 100, 16).collect()}
    seen, windows = {}, {}
    for client, n, ts in rows:
        kept = [t for t in seen.get(client, []) if ts - t < 100] + [ts]
        seen[client] = kept
        assert slide[n] == len(kept)
        start, count = windows.get(client, (None, 0))
        if start is None or ts - start >= 100:
            start, count = ts, 0
        windows[client] = (start, count + 1)
        assert fixed[n] == count + 1


def test_self_trade_duplicate_and_replace(spark):
    lim = limits.RiskLimits(
        max_open_order_quantity=150, max_order_quantity=200, enable_self_trade_prevention=True,
        cancel_on_disconnect=True,
    )
    orders = _requests(
        spark,
        [(1, 10, 1, 7, 1, "Buy", 1000, 100), (2, 10, 1, 7, 1, "Buy", 1000, 10),
         (3, 10, 3, 7, 1, "Sell", 999, 10), (9, 40, 9, 7, 1, "Buy", 1000, 10)],
    )
    reports = spark.createDataFrame(
        [(1, 4, 10, 1, 10001, "New", "New", 100, 1000)],
        "scope BIGINT, arrival BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, "
        "exchange_order_id BIGINT, order_status STRING, exec_type STRING, "
        "remaining_quantity BIGINT, resting_price_ticks BIGINT",
    )
    replaces = _requests(
        spark,
        [(5, 20, 20, 0, 1, "None", 1001, 120), (6, 21, 21, 0, 1, "None", 1001, 151)],
    ).withColumnsRenamed({"price_ticks": "new_price_ticks", "quantity": "new_quantity"}).withColumn(
        "exchange_order_id", F.lit(10001).cast("bigint")
    )
    controls = spark.createDataFrame(
        [(1, 8, 30, "disconnect")],
        "scope BIGINT, arrival BIGINT, timestamp_ns BIGINT, control STRING",
    )
    got = _decide(orders, lim, reports, replaces, controls)
    assert [(r.arrival, r.check_name, r.observed_value) for r in got] == [
        (1, "accepted", 100_000),
        (2, "duplicate_client_order_id", 1),
        (3, "self_trade_prevention", 1000),
        (5, "replace_accepted", 120_120),
        (6, "replace_max_open_order_quantity", 151),
        (8, "disconnect_cancel", 120),
        (9, "disconnected", 0),
    ]


def test_exact_decisions_do_not_depend_on_block_size(spark):
    rng = random.Random(11)
    rows = [
        (n, n, rng.choice([n, max(n - 3, 1)]), rng.randint(1, 3), 1, rng.choice(["Buy", "Sell"]),
         rng.randint(990, 1010), rng.randint(1, 40))
        for n in range(1, 150)
    ]
    lim = limits.RiskLimits(
        max_open_order_quantity=400, enable_self_trade_prevention=True, stale_after_ns=0,
        max_messages_per_window=4, rate_window_ns=9,
    )
    orders = _requests(spark, rows)
    one = [tuple(r) for r in _decide(orders, lim, block_rows=10**6)]
    many = [tuple(r) for r in _decide(orders, lim, block_rows=13)]
    assert one == many and len({r[8] for r in one}) >= 4


def _fills(spark, rows):
    return spark.createDataFrame(
        [(s, n, side, q, p) for n, (s, side, q, p) in enumerate(rows, 1)],
        "symbol_id BIGINT, fill_index BIGINT, side STRING, quantity BIGINT, price_ticks BIGINT",
    )


def _marks(spark, pairs):
    return spark.createDataFrame(pairs, "symbol_id BIGINT, mark_ticks BIGINT")


def test_pnl_and_flip(spark):
    folded = portfolio.fold_fills(
        _fills(spark, [(1, "Buy", 100, 1000), (1, "Sell", 40, 1010), (2, "Buy", 50, 1000),
                       (2, "Sell", 80, 1010)]),
        block_rows=1,
    )
    marks = _marks(spark, [(1, 1010), (2, 1000)])
    rows = {r.symbol_id: r for r in portfolio.final_positions(folded, marks=marks).collect()}
    assert (rows[1].quantity, rows[1].realised_ticks) == (60, 400)
    assert (rows[2].quantity, rows[2].realised_ticks, rows[2].average_cost_ticks) == (-30, 500, 1010)
    taken = portfolio.snapshot(portfolio.final_positions(folded, marks=marks)).first()
    assert taken.unrealised_pnl_ticks == 600 + 300


def _positions(spark, rows):
    return spark.createDataFrame(
        rows,
        "symbol_id BIGINT, quantity BIGINT, average_cost_ticks BIGINT, realised_ticks BIGINT, "
        "mark_ticks BIGINT",
    )


def _order(spark, symbol, side, quantity, price):
    return spark.createDataFrame(
        [(symbol, side, quantity, price)],
        "symbol_id BIGINT, side STRING, quantity BIGINT, price_ticks BIGINT",
    )


def test_portfolio_limits(spark):
    held = _positions(spark, [(1, 50, 1000, 0, 1000), (2, 80, 500, 0, 500)])
    marks = held.select("symbol_id", "mark_ticks")
    gross = portfolio.PortfolioLimits(max_gross_exposure_ticks=100_000)
    assert portfolio.check_state(portfolio.snapshot(held), gross).first().accepted
    got = portfolio.check_orders(_order(spark, 1, "Buy", 20, 1000), held, gross, marks).first()
    assert (got.check_name, got.observed_value) == ("portfolio_gross_exposure", 110_000)

    held = _positions(spark, [(1, 50, 1000, 0, 1000), (2, -45, 1000, 0, 1000)])
    net = portfolio.PortfolioLimits(max_net_exposure_ticks=10_000)
    got = portfolio.check_orders(_order(spark, 1, "Buy", 10, 1000), held, net, marks).first()
    assert (got.check_name, got.observed_value) == ("portfolio_net_exposure", 15_000)

    held = _positions(spark, [(1, 70, 1000, 0, 1000), (2, 30, 1000, 0, 1000)])
    most = portfolio.PortfolioLimits(max_symbol_concentration_bps=6_000)
    got = portfolio.check_state(portfolio.snapshot(held), most).first()
    assert (got.breach, got.breach_symbol, got.observed_value) == ("concentration", 1, 7_000)

    held = _positions(spark, [(1, 100, 1000, 0, 940)])
    loss = portfolio.PortfolioLimits(max_loss_ticks=5_000)
    got = portfolio.check_state(portfolio.snapshot(held), loss).first()
    assert (got.breach, got.observed_value) == ("loss", 6_000)


def test_latency_summary_and_budget(spark):
    samples = spark.createDataFrame(
        [("risk", v) for v in (10, 30, 20, 40)], "stage STRING, duration_ns BIGINT"
    )
    got = latency.percentiles(samples, ["stage"], bucket=16).first()
    assert (got.sample_count, got.min_ns, got.max_ns) == (4, 10, 40)
    assert (got.p50_ns, got.p90_ns, got.p99_ns, got.p999_ns) == (20, 40, 40, 40)
    over = spark.createDataFrame([("risk", 250)], "stage STRING, duration_ns BIGINT")
    reports = latency.stage_reports(over, {"risk": 100})
    assert reports.filter("stage = 'risk'").first().worst_utilization_ppm == 2_500_000
    assert latency.budget_summary(reports).first().worst_offender == "risk"


def test_features_and_scores(spark):
    quotes = spark.createDataFrame(
        [(999, 300, 1001, 100), (999, 300, None, None)],
        "bid_price BIGINT, bid_quantity BIGINT, ask_price BIGINT, ask_quantity BIGINT",
    )
    rows = features.l2_features(quotes).collect()
    names = ["spread_ticks", "mid_price_ticks", "top_level_imbalance", "top_level_quantity"]
    assert sorted([rows[0][n] for n in names] for _ in (0,)) == [[2.0, 1000.0, 0.5, 400.0]]
    assert [rows[1][n] for n in names] == [0.0] * 4
    score = features.linear_score(names, [0.5, 0.0, 2.0, 0.001], 1.0)
    assert abs(features.l2_features(quotes).select(score.alias("s")).first().s - 3.4) < 1e-12
