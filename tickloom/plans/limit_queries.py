"""Queries over order messages: as-of prices, rates, limits, controls."""

from pyspark.sql import functions as F

from tickloom.operators import asof, book, limits
from tickloom.plans import views as V
from tickloom.plans.event_queries import _CLEAN, _TIMELINE
from tickloom.plans.registry import query

DAY = V.DAY_NS
MONTH = 30 * DAY
# Time slices for as-of scans; the derived tables have one time per day.
SLICE = 64 * DAY

LIMITS = limits.RiskLimits(
    max_order_quantity=190,
    max_notional_ticks=185_000,
    max_position_per_symbol=330,
    max_gross_exposure_ticks=1_000_000,
    price_band_ticks=55,
    stale_after_ns=DAY // 2,
    max_messages_per_window=5,
    rate_window_ns=MONTH,
    rate_limit_mode="sliding-window",
)

_ORDERS = V.ORDERS_SQL
_ASOF = f"""{_ORDERS}, {V.MARKET_SQL},
priced AS (
  SELECT o.*, m.reference_price_ticks, m.timestamp_ns AS reference_ns
  FROM order_requests o ASOF LEFT JOIN market_ref m
    ON m.symbol_id = o.symbol_id AND o.timestamp_ns >= m.timestamp_ns)"""


@query(
    "asof_reference_price",
    f"""WITH {_ASOF} SELECT client_order_id, symbol_id, timestamp_ns, reference_price_ticks,
    reference_ns, coalesce(timestamp_ns - reference_ns > {DAY // 2}, false) AS stale FROM priced""",
)
def asof_reference_price(spark, sf_dir):
    found = asof.as_of(
        V.order_requests(spark, sf_dir),
        V.market_ref(spark, sf_dir),
        ["symbol_id"],
        "timestamp_ns",
        ["reference_price_ticks"],
        slice_ns=SLICE,
    )
    return found.select(
        "client_order_id",
        "symbol_id",
        "timestamp_ns",
        "reference_price_ticks",
        F.col("asof_timestamp_ns").alias("reference_ns"),
        F.coalesce(
            asof.age_exceeds(F.col("timestamp_ns"), F.col("asof_timestamp_ns"), DAY // 2),
            F.lit(False),
        ).alias("stale"),
    )


_RATE = f"""
rated AS (
  SELECT *, count(*) OVER (PARTITION BY client_id ORDER BY timestamp_ns
      RANGE BETWEEN {MONTH - 1} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY client_id, timestamp_ns ORDER BY arrival
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS observed_rate
  FROM order_requests)"""


@query(
    "rate_sliding",
    f"""WITH {_ORDERS}, {_RATE} SELECT client_id, arrival, observed_rate,
    observed_rate <= 5 AS allowed FROM rated""",
)
def rate_sliding(spark, sf_dir):
    rated = limits.sliding_rate(V.order_requests(spark, sf_dir), MONTH)
    return rated.select(
        "client_id", "arrival", "observed_rate", (F.col("observed_rate") <= 5).alias("allowed")
    )


@query(
    "rate_fixed",
    f"""WITH RECURSIVE {_ORDERS},
    lined AS (SELECT client_id, arrival, timestamp_ns, row_number() OVER (
      PARTITION BY client_id ORDER BY arrival) AS n FROM order_requests),
    walk AS (
      SELECT client_id, arrival, n, timestamp_ns AS start, CAST(1 AS BIGINT) AS observed_rate
      FROM lined WHERE n = 1
      UNION ALL
      SELECT l.client_id, l.arrival, l.n,
        CASE WHEN l.timestamp_ns - w.start >= {MONTH} THEN l.timestamp_ns ELSE w.start END,
        CASE WHEN l.timestamp_ns - w.start >= {MONTH} THEN 1 ELSE w.observed_rate + 1 END
      FROM walk w JOIN lined l ON l.client_id = w.client_id AND l.n = w.n + 1)
    SELECT client_id, arrival, observed_rate, observed_rate <= 5 AS allowed FROM walk""",
)
def rate_fixed(spark, sf_dir):
    rated = limits.fixed_rate(V.order_requests(spark, sf_dir), MONTH, block_rows=1_000)
    return rated.select(
        "client_id", "arrival", "observed_rate", (F.col("observed_rate") <= 5).alias("allowed")
    )


@query(
    "duplicate_ids",
    f"""WITH {_ORDERS} SELECT client_order_id % 9973 AS client_order_id, count(*) AS uses
    FROM order_requests GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf_dir):
    reused = V.order_requests(spark, sf_dir).withColumn(
        "client_order_id", F.col("client_order_id") % 9973
    )
    return limits.duplicate_ids(reused)


_GATED = f"""{V.CONTROLS_SQL},
linked AS (
  SELECT o.client_order_id, c.control FROM order_requests o ASOF LEFT JOIN
    (SELECT * FROM controls WHERE control <> 'kill') c ON o.timestamp_ns >= c.timestamp_ns),
gated AS (
  SELECT o.*, l.control IS NULL OR l.control = 'reconnect' AS connected,
    o.timestamp_ns >= (SELECT timestamp_ns FROM controls WHERE control = 'kill') AS killed
  FROM order_requests o JOIN linked l USING (client_order_id))"""


def _gated(spark, sf_dir):
    orders = V.order_requests(spark, sf_dir).withColumn("scope", F.lit(1).cast("bigint"))
    return asof.control_state(
        orders, V.controls(spark, sf_dir), ["scope"], "timestamp_ns", slice_ns=SLICE
    )


@query(
    "control_intervals",
    f"WITH {_ORDERS}, {_GATED} SELECT client_order_id, killed, connected FROM gated",
)
def control_intervals(spark, sf_dir):
    return _gated(spark, sf_dir).select("client_order_id", "killed", "connected")


_SCREEN = f"""{_ASOF}, {_RATE}, {_GATED},
steps AS (
  SELECT m.timestamp_ns, (m.reference_price_ticks - lag(m.reference_price_ticks, 1, 0) OVER (
    PARTITION BY m.symbol_id ORDER BY m.timestamp_ns)) * abs(p.quantity) AS change
  FROM market_ref m JOIN positions p USING (symbol_id)),
base AS (
  SELECT timestamp_ns, sum(sum(change)) OVER (ORDER BY timestamp_ns) AS exposure_base
  FROM steps GROUP BY timestamp_ns),
based AS (
  SELECT o.arrival, b.exposure_base FROM order_requests o
  ASOF LEFT JOIN base b ON o.timestamp_ns >= b.timestamp_ns),
full_orders AS (
  SELECT p.*, r.observed_rate, g.killed, g.connected, coalesce(s.quantity, 0) AS position,
    coalesce(b.exposure_base, 0) AS exposure_base, p.price_ticks * p.quantity AS notional
  FROM priced p JOIN rated r USING (arrival) JOIN gated g USING (arrival)
  JOIN based b USING (arrival) LEFT JOIN positions s ON s.symbol_id = p.symbol_id),
named AS (
  SELECT *, abs(position + CASE WHEN side = 'Buy' THEN quantity ELSE -quantity END) AS held,
    CASE WHEN killed THEN 'kill_switch' WHEN NOT connected THEN 'disconnected'
      WHEN observed_rate > 5 THEN 'message_rate_limit_sliding'
      WHEN quantity > 190 THEN 'max_order_quantity'
      WHEN reference_price_ticks IS NULL OR timestamp_ns - reference_ns > {DAY // 2}
        THEN 'stale_market_data'
      WHEN abs(price_ticks - reference_price_ticks) > 55 THEN 'price_band'
      WHEN notional > 185000 THEN 'max_notional' WHEN held > 330 THEN 'max_position'
      WHEN notional + exposure_base > 1000000 THEN 'max_gross_exposure'
      ELSE 'accepted' END AS check_name
  FROM full_orders)"""

_SCREENED = """
    SELECT client_order_id, symbol_id, side, timestamp_ns, check_name = 'accepted' AS accepted,
      check_name,
      CASE check_name WHEN 'kill_switch' THEN 'KillSwitch' WHEN 'disconnected' THEN 'Disconnected'
        WHEN 'message_rate_limit_sliding' THEN 'MessageRateLimit'
        WHEN 'max_order_quantity' THEN 'MaxOrderQuantity'
        WHEN 'stale_market_data' THEN 'StaleMarketData' WHEN 'price_band' THEN 'PriceBand'
        WHEN 'max_notional' THEN 'MaxNotional' WHEN 'max_position' THEN 'MaxPosition'
        WHEN 'max_gross_exposure' THEN 'MaxGrossExposure' ELSE 'None' END AS reject_reason,
      CAST(CASE check_name WHEN 'kill_switch' THEN 0 WHEN 'disconnected' THEN 0
        WHEN 'message_rate_limit_sliding' THEN 5 WHEN 'max_order_quantity' THEN 190
        WHEN 'stale_market_data' THEN 43200000000000 WHEN 'price_band' THEN 55
        WHEN 'max_position' THEN 330 WHEN 'max_gross_exposure' THEN 1000000
        ELSE 185000 END AS BIGINT) AS limit_value,
      CAST(CASE check_name WHEN 'kill_switch' THEN 0 WHEN 'disconnected' THEN 0
        WHEN 'message_rate_limit_sliding' THEN observed_rate
        WHEN 'max_order_quantity' THEN quantity
        WHEN 'stale_market_data' THEN coalesce(timestamp_ns - reference_ns, 0)
        WHEN 'price_band' THEN abs(price_ticks - reference_price_ticks)
        WHEN 'max_position' THEN held WHEN 'max_gross_exposure' THEN notional + exposure_base
        ELSE notional END AS BIGINT) AS observed_value
    FROM named"""


def _enriched(spark, sf_dir, orders):
    return limits.enrich_requests(
        orders, V.market_ref(spark, sf_dir), V.positions(spark, sf_dir), SLICE
    )


@query("limit_decisions_t1", f"WITH {_SCREEN} {_SCREENED}")
def limit_decisions_t1(spark, sf_dir):
    orders = limits.sliding_rate(_gated(spark, sf_dir), MONTH)
    return limits.screen_orders(_enriched(spark, sf_dir, orders), LIMITS)


_BAND = limits.RiskLimits(
    max_order_quantity=10**6,
    max_notional_ticks=10**12,
    max_position_per_symbol=10**9,
    max_gross_exposure_ticks=10**15,
    price_band_ticks=55,
    stale_after_ns=DAY // 2,
)


@query(
    "price_band_stale_checks",
    f"""WITH {_ASOF},
    j AS (SELECT *, CASE WHEN reference_price_ticks IS NULL
        OR timestamp_ns - reference_ns > {DAY // 2} THEN 'stale_market_data'
      WHEN abs(price_ticks - reference_price_ticks) > 55 THEN 'price_band'
      ELSE 'accepted' END AS check_name FROM priced)
    SELECT symbol_id, check_name, count(*) AS order_count FROM j GROUP BY ALL""",
)
def price_band_stale_checks(spark, sf_dir):
    judged = limits.screen_orders(
        _enriched(spark, sf_dir, V.order_requests(spark, sf_dir)), _BAND
    )
    return judged.groupBy("symbol_id", "check_name").agg(F.count(F.lit(1)).alias("order_count"))


def _working(spark, sf_dir):
    return V.order_requests(spark, sf_dir).withColumns(
        {
            "from_index": F.col("arrival") * 2,
            "until_index": (F.col("arrival") + 1 + F.col("quantity") * 7) * 2 + 1,
        }
    )


@query(
    "self_trade_pairs",
    f"""WITH {_ORDERS},
    w AS (SELECT *, arrival * 2 AS f, (arrival + 1 + quantity * 7) * 2 + 1 AS u FROM order_requests)
    SELECT a.client_order_id, a.client_id, a.symbol_id, a.side, a.price_ticks,
      CASE WHEN any_value(a.side) = 'Buy' THEN min(b.price_ticks) ELSE max(b.price_ticks) END
        AS opposing_price_ticks
    FROM w a JOIN w b ON b.client_id = a.client_id AND b.symbol_id = a.symbol_id
      AND b.side <> a.side AND b.f < a.f AND b.u > a.f
      AND CASE WHEN a.side = 'Buy' THEN a.price_ticks >= b.price_ticks
        ELSE a.price_ticks <= b.price_ticks END
    GROUP BY a.client_order_id, a.client_id, a.symbol_id, a.side, a.price_ticks""",
)
def self_trade_pairs(spark, sf_dir):
    return limits.self_trades(_working(spark, sf_dir))


@query(
    "sweep_fillability",
    f"""WITH {_CLEAN}{_TIMELINE.format(log='clean')}, {_ORDERS},
    placed AS (
      SELECT o.*, e.event_index FROM order_requests o ASOF JOIN
        (SELECT symbol_id, timestamp_ns, max(event_index) AS event_index FROM clean GROUP BY ALL) e
        ON e.symbol_id = o.symbol_id AND o.timestamp_ns >= e.timestamp_ns),
    lad AS (
      SELECT p.client_order_id, p.symbol_id, p.quantity, s.held, s.price_ticks, p.side,
        CAST(sum(s.held) OVER (PARTITION BY p.client_order_id ORDER BY
          CASE WHEN p.side = 'Buy' THEN s.price_ticks ELSE -s.price_ticks END) AS BIGINT) AS upto
      FROM placed p JOIN grid s ON s.symbol_id = p.symbol_id AND s.event_index = p.event_index
        AND s.side <> p.side
        AND CASE WHEN p.side = 'Buy' THEN s.price_ticks <= p.price_ticks + 20
          ELSE s.price_ticks >= p.price_ticks - 20 END),
    taken AS (
      SELECT client_order_id, sum(least(held, greatest(quantity * 20 - (upto - held), 0))) AS q,
        sum(least(held, greatest(quantity * 20 - (upto - held), 0)) * price_ticks) AS c
      FROM lad GROUP BY ALL)
    SELECT p.client_order_id, p.symbol_id, coalesce(q, 0) > 0 AS crosses,
      coalesce(q, 0) >= p.quantity * 20 AS fillable, CAST(coalesce(q, 0) AS BIGINT) AS fill_quantity,
      CAST(coalesce(c, 0) AS BIGINT) AS fill_cost
    FROM placed p LEFT JOIN taken t USING (client_order_id)""",
)
def sweep_fillability(spark, sf_dir):
    events = V.order_flow(spark, sf_dir)
    placed = asof.as_of(
        V.order_requests(spark, sf_dir),
        events.select("symbol_id", "timestamp_ns", "event_index"),
        ["symbol_id"],
        "timestamp_ns",
        ["event_index"],
        slice_ns=SLICE,
        tie="event_index",
    ).filter("event_index IS NOT NULL")
    nudge = F.when(F.col("side") == "Buy", 20).otherwise(-20)
    larger = placed.withColumns(
        {"quantity": F.col("quantity") * 20, "price_ticks": F.col("price_ticks") + nudge}
    )
    states = book.order_states(events.withColumn("epoch", F.lit(0).cast("bigint")))
    return limits.sweep_orders(larger, book.level_deltas(states))


_CHANGES = f"""{_ORDERS},
changes AS (
  SELECT symbol_id, arrival * 2 AS event_index, quantity AS delta FROM order_requests
  UNION ALL
  SELECT symbol_id, (arrival + quantity * 7) * 2 + 1, -quantity FROM order_requests
  WHERE client_order_id % 3 = 0)"""


@query(
    "working_quantity",
    f"""WITH {_CHANGES}, net AS (
      SELECT symbol_id, event_index, CAST(sum(delta) AS BIGINT) AS delta FROM changes GROUP BY ALL)
    SELECT symbol_id, event_index, delta, CAST(sum(delta) OVER (PARTITION BY symbol_id
      ORDER BY event_index) AS BIGINT) AS working_quantity FROM net""",
)
def working_quantity(spark, sf_dir):
    orders = V.order_requests(spark, sf_dir)
    added = orders.select(
        "symbol_id", (F.col("arrival") * 2).alias("event_index"), F.col("quantity").alias("delta")
    )
    gone = orders.filter("client_order_id % 3 = 0").select(
        "symbol_id",
        ((F.col("arrival") + F.col("quantity") * 7) * 2 + 1).alias("event_index"),
        (-F.col("quantity")).alias("delta"),
    )
    net = added.unionByName(gone).groupBy("symbol_id", "event_index").agg(
        F.sum("delta").alias("delta")
    )
    return limits.running_working_quantity(net)


def _reports(orders):
    """One report per order: a third filled, a third partly filled, the rest acknowledged.

    Partial fills come without a client id (ignored) or under an id that is not working.
    """
    third = F.col("client_order_id") % 3
    left = F.when(third == 0, 0).when(third == 1, F.expr("quantity div 2")).otherwise(
        F.col("quantity")
    )
    return orders.select(
        F.when(third != 1, F.col("client_order_id"))
        .when(F.col("client_order_id") % 2 == 0, 0)
        .otherwise(F.col("client_order_id") + 8_000_000_000)
        .cast("bigint")
        .alias("client_order_id"),
        (F.col("client_order_id") + 7_000_000_000).alias("exchange_order_id"),
        F.when(third == 0, "Filled").when(third == 1, "PartiallyFilled").otherwise("New").alias(
            "order_status"
        ),
        F.when(third == 2, "New").otherwise("Trade").alias("exec_type"),
        left.cast("bigint").alias("remaining_quantity"),
        F.when(left > 0, F.col("price_ticks")).otherwise(0).cast("bigint").alias(
            "resting_price_ticks"
        ),
        (F.col("timestamp_ns") + 2).alias("timestamp_ns"),
    )


@query(
    "exposure_snapshot",
    f"""WITH {_ORDERS}, {V.MARKET_SQL},
    open AS (SELECT symbol_id, CAST(sum(CASE WHEN client_order_id % 6 = 1 AND quantity // 2 > 0
        THEN quantity // 2 ELSE quantity END) AS BIGINT) AS working_quantity,
        count(*) AS working_order_count
      FROM order_requests WHERE client_order_id % 3 <> 0 GROUP BY ALL)
    SELECT symbol_id, coalesce(p.quantity, 0) AS position,
      coalesce(working_quantity, 0) AS working_quantity,
      coalesce(working_order_count, 0) AS working_order_count
    FROM positions p FULL JOIN open USING (symbol_id)""",
)
def exposure_snapshot(spark, sf_dir):
    orders = V.order_requests(spark, sf_dir)
    # The acknowledgement binds the exchange id, by which partial fills find their order.
    acks = orders.select(
        "client_order_id",
        (F.col("client_order_id") + 7_000_000_000).alias("exchange_order_id"),
        F.lit("New").alias("order_status"),
        F.lit("New").alias("exec_type"),
        F.col("quantity").alias("remaining_quantity"),
        F.col("price_ticks").alias("resting_price_ticks"),
        (F.col("timestamp_ns") + 1).alias("timestamp_ns"),
    )
    working = limits.working_orders(orders, acks.unionByName(_reports(orders)))
    return limits.exposure_snapshot(working, V.positions(spark, sf_dir))


@query(
    "mass_cancels",
    f"""WITH {_ORDERS}, {V.CONTROLS_SQL},
    live AS (SELECT *, timestamp_ns + (1 + quantity % 40) * {DAY} AS until_ns FROM order_requests),
    hit AS (
      SELECT l.*, c.timestamp_ns AS at_ns, c.control FROM live l ASOF JOIN
        (SELECT * FROM controls WHERE control <> 'reconnect') c ON l.timestamp_ns <= c.timestamp_ns)
    SELECT at_ns AS timestamp_ns, client_order_id, symbol_id, side, false AS accepted,
      CASE control WHEN 'kill' THEN 'KillSwitch' ELSE 'Disconnected' END AS reject_reason,
      CASE control WHEN 'kill' THEN 'kill_switch_cancel' ELSE 'disconnect_cancel' END AS check_name,
      CAST(0 AS BIGINT) AS limit_value, quantity AS observed_value
    FROM hit WHERE at_ns < until_ns""",
)
def mass_cancels(spark, sf_dir):
    live = V.order_requests(spark, sf_dir).withColumns(
        {
            "scope": F.lit(1).cast("bigint"),
            "from_ns": F.col("timestamp_ns"),
            "until_ns": F.col("timestamp_ns") + (1 + F.col("quantity") % 40) * DAY,
        }
    )
    return asof.mass_cancels(live, V.controls(spark, sf_dir), True)


EXACT = limits.RiskLimits(
    max_order_quantity=190,
    max_notional_ticks=185_000,
    max_position_per_symbol=330,
    max_gross_exposure_ticks=1_000_000,
    price_band_ticks=55,
    stale_after_ns=DAY // 2,
    max_open_order_quantity=5_000,
    enable_self_trade_prevention=True,
    cancel_on_disconnect=True,
)


def decision_messages(spark, sf_dir):
    """Orders, reports, replaces and a yearly disconnect; one scope per symbol."""
    orders = V.order_requests(spark, sf_dir).withColumns(
        {"scope": F.col("symbol_id"), "arrival": F.col("arrival") * 100}
    )
    enriched = _enriched(spark, sf_dir, orders)
    reports = _reports(orders.withColumn("_arrival", F.col("arrival"))).select("*")
    keyed = orders.select(
        (F.col("client_order_id") + 7_000_000_000).alias("exchange_order_id"), "scope", "arrival"
    )
    acks = orders.filter("client_order_id % 3 = 1").select(
        "scope",
        (F.col("arrival") + 1).alias("arrival"),
        (F.col("timestamp_ns") + 1).alias("timestamp_ns"),
        "client_order_id",
        (F.col("client_order_id") + 7_000_000_000).alias("exchange_order_id"),
        F.lit("New").alias("order_status"),
        F.lit("New").alias("exec_type"),
        F.col("quantity").alias("remaining_quantity"),
        F.col("price_ticks").alias("resting_price_ticks"),
    )
    later = reports.join(keyed, "exchange_order_id").withColumn(
        "arrival", F.col("arrival") + 40_002
    )
    replaces = (
        enriched.filter("client_order_id % 3 = 1 AND client_order_id % 7 < 3")
        .withColumns(
            {
                "exchange_order_id": F.col("client_order_id") + 7_000_000_000,
                "client_order_id": F.when(
                    F.col("client_order_id") % 5 == 0, F.col("client_order_id")
                ).otherwise(F.col("client_order_id") + 9_000_000_000),
                "new_price_ticks": F.col("price_ticks") + 1,
                "new_quantity": F.col("quantity") + 3,
                "arrival": F.col("arrival") + 20_003,
            }
        )
        .drop("price_ticks", "quantity")
    )
    year = F.year(F.timestamp_micros(F.expr("timestamp_ns div 1000")))
    first = orders.groupBy("scope", year.alias("_year")).agg(
        F.min("arrival").alias("_first"), F.min("timestamp_ns").alias("_from")
    )

    def stop(control: str, days: int, messages: int):
        return F.struct(
            F.lit(control).alias("control"),
            (F.col("_from") + days * DAY).alias("timestamp_ns"),
            (F.col("_first") + messages * 100 + 50).alias("arrival"),
        )

    stops = first.select(
        "scope", F.explode(F.array(stop("disconnect", 10, 60), stop("reconnect", 20, 120))).alias("c")
    ).select("scope", "c.*")
    return limits.message_stream(
        enriched, acks.unionByName(later.select(*acks.columns)), replaces, stops
    )


@query("limit_decisions_exact")
def limit_decisions_exact(spark, sf_dir):
    return limits.decide_orders(decision_messages(spark, sf_dir), EXACT, block_rows=200_000)
