"""Queries over event logs: books, data quality, depth captures."""

from pyspark.sql import functions as F

from tickloom.operators import book, depth, quality
from tickloom.plans import views as V
from tickloom.plans.registry import query
from tickloom.session import staged_once

_CLEAN = V.ORDER_FLOW_SQL + """,
clean AS (SELECT *, 0 AS epoch FROM order_flow),""" + V.states_sql("clean")
_SNAP = V.SNAPSHOT_FLOW_SQL + """,
snap AS (SELECT *, sum(CASE WHEN event_type = 'Snapshot' AND flags & 1 <> 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY symbol_id ORDER BY event_index) AS epoch FROM snapshot_flow),""" + V.states_sql("snap")


@query(
    "final_l2_levels",
    f"""WITH {_CLEAN}
    SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS quantity,
      count(*) AS order_count FROM live GROUP BY ALL""",
)
def final_l2_levels(spark, sf_dir):
    return book.l2_levels(book.live_orders(V.order_flow(spark, sf_dir), snapshots=False))


@query(
    "l2_top5",
    f"""WITH {_CLEAN},
    lv AS (SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS quantity
      FROM live GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY symbol_id, side ORDER BY
      CASE WHEN side = 'Buy' THEN -price_ticks ELSE price_ticks END) AS INTEGER) AS level
    FROM lv QUALIFY level <= 5""",
)
def l2_top5(spark, sf_dir):
    orders = book.live_orders(V.order_flow(spark, sf_dir), snapshots=False)
    return book.top_levels(book.l2_levels(orders), 5).drop("order_count")


@query(
    "l3_fifo_book",
    f"""WITH {_CLEAN}
    SELECT symbol_id, side, price_ticks, order_id, quantity, set_ts AS timestamp_ns,
      set_seq AS sequence_number, row_number() OVER (
        PARTITION BY symbol_id, side, price_ticks ORDER BY head_index) AS fifo_rank
    FROM live""",
)
def l3_fifo_book(spark, sf_dir):
    orders = book.live_orders(V.order_flow(spark, sf_dir), snapshots=False)
    return book.fifo_queue(orders).drop("priority_index")


@query(
    "final_bbo",
    f"""WITH {_CLEAN},
    lv AS (SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS quantity
      FROM live GROUP BY ALL)
    SELECT symbol_id,
      max(price_ticks) FILTER (side = 'Buy') AS bid_price,
      arg_max(quantity, price_ticks) FILTER (side = 'Buy') AS bid_quantity,
      min(price_ticks) FILTER (side = 'Sell') AS ask_price,
      arg_min(quantity, price_ticks) FILTER (side = 'Sell') AS ask_quantity
    FROM lv GROUP BY symbol_id""",
)
def final_bbo(spark, sf_dir):
    orders = book.live_orders(V.order_flow(spark, sf_dir), snapshots=False)
    return book.best_quotes(book.l2_levels(orders))


# Quantity of every level after each of its changes, then the best level after each event.
_TIMELINE = """,
touched AS (
  SELECT *, lag(rest_quantity, 1, 0) OVER o AS prev_quantity, lag(rest_price) OVER o AS prev_price,
    lag(rest_side) OVER o AS prev_side
  FROM states WINDOW o AS (PARTITION BY symbol_id, epoch, order_id ORDER BY event_index)),
moves AS (
  SELECT symbol_id, epoch, event_index, prev_side AS side, prev_price AS price_ticks,
    -prev_quantity AS delta FROM touched WHERE prev_quantity > 0
  UNION ALL
  SELECT symbol_id, epoch, event_index, rest_side, rest_price, rest_quantity
  FROM touched WHERE rest_quantity > 0),
netted AS (SELECT symbol_id, epoch, event_index, side, price_ticks, sum(delta) AS delta
  FROM moves GROUP BY ALL),
level_steps AS (
  SELECT symbol_id, epoch, side, price_ticks, event_index, sum(delta) OVER (
    PARTITION BY symbol_id, epoch, side, price_ticks ORDER BY event_index) AS held
  FROM netted),
places AS (SELECT DISTINCT symbol_id, epoch, side, price_ticks FROM netted),
cells AS (
  SELECT e.symbol_id, e.epoch, e.event_index, p.side, p.price_ticks
  FROM {log} e JOIN places p ON p.symbol_id = e.symbol_id AND p.epoch = e.epoch),
grid AS (
  SELECT c.symbol_id, c.event_index, c.side, c.price_ticks, CAST(s.held AS BIGINT) AS held
  FROM cells c ASOF JOIN level_steps s ON s.symbol_id = c.symbol_id AND s.epoch = c.epoch
    AND s.side = c.side AND s.price_ticks = c.price_ticks AND c.event_index >= s.event_index
  WHERE s.held > 0),
quotes AS (
  SELECT e.symbol_id, e.event_index,
    max(g.price_ticks) FILTER (g.side = 'Buy') AS bid_price,
    arg_max(g.held, g.price_ticks) FILTER (g.side = 'Buy') AS bid_quantity,
    min(g.price_ticks) FILTER (g.side = 'Sell') AS ask_price,
    arg_min(g.held, g.price_ticks) FILTER (g.side = 'Sell') AS ask_quantity
  FROM {log} e LEFT JOIN grid g ON g.symbol_id = e.symbol_id AND g.event_index = e.event_index
  GROUP BY e.symbol_id, e.event_index)"""


@query("bbo_timeline", f"WITH {_CLEAN}{_TIMELINE.format(log='clean')} SELECT * FROM quotes")
def bbo_timeline(spark, sf_dir):
    return book.quote_timeline(V.order_flow(spark, sf_dir), snapshots=False)


@query(
    "snapshot_epoch_book",
    f"""WITH {_SNAP}
    SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS quantity,
      count(*) AS order_count FROM live GROUP BY ALL""",
)
def snapshot_epoch_book(spark, sf_dir):
    return book.l2_levels(book.live_orders(V.snapshot_flow(spark, sf_dir)))


@query("snapshot_bbo_timeline", f"WITH {_SNAP}{_TIMELINE.format(log='snap')} SELECT * FROM quotes")
def snapshot_bbo_timeline(spark, sf_dir):
    return book.quote_timeline(V.snapshot_flow(spark, sf_dir))


# --- data quality -----------------------------------------------------------------------

_DIRTY = V.DIRTY_FLOW_SQL + """,
dirty AS (SELECT *, 0 AS epoch FROM dirty_flow),""" + V.states_sql("dirty") + """,
before AS (
  SELECT symbol_id, event_index, lag(rest_quantity, 1, 0) OVER (
    PARTITION BY symbol_id, order_id ORDER BY event_index) AS resting FROM states),
judged AS (
  SELECT d.*, row_number() OVER w - 1 AS ordinal,
    CASE
      WHEN sequence_number <> lag(sequence_number) OVER w + 1 THEN
        'sequence gap: expected ' || (lag(sequence_number) OVER w + 1) || ', received ' || sequence_number
      WHEN timestamp_ns < lag(timestamp_ns) OVER w THEN
        'timestamp reversal: previous ' || lag(timestamp_ns) OVER w || ', received ' || timestamp_ns
      WHEN event_type IN ('Add','Cancel','Replace','Execute') AND order_id = 0 THEN 'invalid order id'
      WHEN event_type IN ('Add','Replace') AND side = 'None' THEN 'invalid side'
      WHEN event_type IN ('Add','Replace','Trade') AND price_ticks <= 0 THEN 'invalid price'
      WHEN price_ticks < 0 THEN 'invalid negative price'
      WHEN event_type IN ('Add','Replace','Execute','Trade') AND quantity <= 0 THEN 'invalid quantity'
      WHEN quantity < 0 THEN 'invalid negative quantity'
      WHEN event_type = 'Add' AND resting > 0 THEN 'duplicate order id'
      WHEN event_type IN ('Cancel','Replace','Execute') AND coalesce(resting, 0) = 0 THEN
        'unknown ' || lower(event_type) || ' order id'
      WHEN event_type IN ('Cancel','Execute') AND quantity > resting THEN
        'invalid quantity exceeds resting order quantity'
    END AS reason
  FROM dirty d LEFT JOIN before USING (symbol_id, event_index)
  WINDOW w AS (PARTITION BY symbol_id ORDER BY d.event_index)),
diag AS (
  SELECT symbol_id, arg_min(ordinal, event_index) AS event_index, min(event_index) AS log_index,
    arg_min(sequence_number, event_index) AS sequence_number, 'error' AS severity,
    arg_min(reason, event_index) AS reason
  FROM judged WHERE reason IS NOT NULL GROUP BY symbol_id)"""

_RULES_ONLY = quality.ReplayOptions(snapshots=False, book=False)


def _dirty_diagnostics(spark, sf_dir):
    return staged_once(
        spark,
        sf_dir,
        "dirty_diagnostics",
        lambda: quality.diagnostics(V.dirty_flow(spark, sf_dir), _RULES_ONLY),
    )


@query("dirty_diagnostics", f"WITH {_DIRTY} SELECT * FROM diag")
def dirty_diagnostics(spark, sf_dir):
    return quality.diagnostics(V.dirty_flow(spark, sf_dir), _RULES_ONLY)


@query(
    "diagnostics_by_reason",
    f"""WITH {_DIRTY} SELECT split_part(reason, ':', 1) AS reason, count(*) AS diagnostic_count
    FROM diag GROUP BY ALL""",
)
def diagnostics_by_reason(spark, sf_dir):
    return quality.diagnostics_by(_dirty_diagnostics(spark, sf_dir), "reason")


@query(
    "diagnostics_by_severity",
    f"WITH {_DIRTY} SELECT severity, count(*) AS diagnostic_count FROM diag GROUP BY ALL",
)
def diagnostics_by_severity(spark, sf_dir):
    return quality.diagnostics_by(_dirty_diagnostics(spark, sf_dir), "severity")


@query(
    "valid_prefix",
    f"""WITH {_DIRTY}
    SELECT d.symbol_id, count(*) AS event_count, CAST(sum(d.quantity) AS BIGINT) AS quantity
    FROM dirty d LEFT JOIN diag g ON g.symbol_id = d.symbol_id
    WHERE g.log_index IS NULL OR d.event_index < g.log_index GROUP BY d.symbol_id""",
)
def valid_prefix(spark, sf_dir):
    clean = quality.valid_prefix(
        V.dirty_flow(spark, sf_dir), _dirty_diagnostics(spark, sf_dir)
    )
    return clean.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("quantity").alias("quantity")
    )


_SUMMARY = _DIRTY + """,
summary AS (
  SELECT d.symbol_id, count(*) AS event_count,
    arg_min(d.sequence_number, d.event_index) AS first_sequence,
    arg_max(d.sequence_number, d.event_index) AS last_sequence,
    arg_min(d.timestamp_ns, d.event_index) AS first_timestamp_ns,
    arg_max(d.timestamp_ns, d.event_index) AS last_timestamp_ns,
    coalesce(any_value(g.event_index), count(*)) AS events_processed,
    any_value(g.reason) IS NULL AS sequence_valid,
    CAST(CASE WHEN any_value(g.reason) IS NULL THEN 0 ELSE 1 END AS BIGINT) AS diagnostic_error_count,
    CAST(0 AS BIGINT) AS diagnostic_warning_count,
    coalesce(any_value(g.reason), '') AS error
  FROM dirty d LEFT JOIN diag g ON g.symbol_id = d.symbol_id GROUP BY d.symbol_id)"""


@query("symbol_replay_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def symbol_replay_summary(spark, sf_dir):
    events = V.dirty_flow(spark, sf_dir)
    return quality.symbol_summary(events, _dirty_diagnostics(spark, sf_dir))


@query(
    "log_summary",
    f"""WITH {_SUMMARY} SELECT CAST(sum(event_count) AS BIGINT) AS total_events,
    count(*) AS symbol_count, count(*) FILTER (sequence_valid) AS valid_symbols,
    CAST(sum(diagnostic_error_count) AS BIGINT) AS diagnostic_error_count FROM summary""",
)
def log_summary(spark, sf_dir):
    return quality.log_summary(symbol_replay_summary(spark, sf_dir))


@query(
    "event_type_counts",
    f"WITH {V.ORDER_FLOW_SQL} SELECT event_type, count(*) AS event_count FROM order_flow GROUP BY ALL",
)
def event_type_counts(spark, sf_dir):
    return quality.event_type_counts(V.order_flow(spark, sf_dir))


@query(
    "activity_rows",
    f"""WITH {V.ORDER_FLOW_SQL} SELECT symbol_id, sequence_number, price_ticks, quantity,
    trade_id FROM order_flow WHERE event_type IN ('Execute', 'Trade')""",
)
def activity_rows(spark, sf_dir):
    return book.activity(V.order_flow(spark, sf_dir)).select(
        "symbol_id", "sequence_number", "price_ticks", "quantity", "trade_id"
    )


# 2000-01-01.
_AS_OF_NS = 946_684_800 * 1_000_000_000


@query(
    "order_state_asof",
    f"""WITH {V.ORDER_FLOW_SQL},
    clean AS (SELECT *, 0 AS epoch FROM order_flow WHERE timestamp_ns <= {_AS_OF_NS}),
    {V.states_sql("clean")}
    SELECT symbol_id, side, price_ticks, order_id, quantity FROM live""",
)
def order_state_asof(spark, sf_dir):
    orders = book.order_as_of(
        V.order_flow(spark, sf_dir), _AS_OF_NS, "timestamp_ns", snapshots=False
    )
    return orders.select("symbol_id", "side", "price_ticks", "order_id", "quantity")


@query(
    "book_reconciliation",
    f"""WITH {_CLEAN},
    lv AS (SELECT symbol_id, side, price_ticks, sum(quantity) AS quantity FROM live GROUP BY ALL)
    SELECT symbol_id, side, price_ticks, CAST(NULL AS BIGINT) AS order_id,
      CASE WHEN price_ticks % 10 = 3 THEN 'price-level total does not match child order sum'
        ELSE 'level missing for resting orders' END AS violation
    FROM lv WHERE price_ticks % 10 IN (3, 7)""",
)
def book_reconciliation(spark, sf_dir):
    """Ladder with one lost and one wrong level in ten, against the orders."""
    orders = book.live_orders(V.order_flow(spark, sf_dir), snapshots=False)
    levels = book.l2_levels(orders).filter("price_ticks % 10 <> 7").withColumn(
        "quantity",
        F.col("quantity") + F.when(F.col("price_ticks") % 10 == 3, 1).otherwise(0),
    )
    return book.reconcile_levels(orders, levels)


_PERIOD_NS = 91 * V.DAY_NS


@query(
    "period_end_ladder",
    f"""WITH {_CLEAN}{_TIMELINE.format(log='clean')},
    ends AS (SELECT symbol_id, timestamp_ns // {_PERIOD_NS} AS period,
      max(event_index) AS event_index FROM clean GROUP BY ALL)
    SELECT g.symbol_id, e.period, g.side, g.price_ticks, g.held AS quantity
    FROM ends e JOIN grid g USING (symbol_id, event_index)""",
)
def period_end_ladder(spark, sf_dir):
    return book.period_ladders(V.order_flow(spark, sf_dir), _PERIOD_NS)


# --- public depth captures --------------------------------------------------------------


@query("depth_to_l3", f"WITH {V.DEPTH_SQL} SELECT * FROM l3")
def depth_to_l3(spark, sf_dir):
    return depth.normalise(V.depth_lines(spark, sf_dir)).events.drop("event_index")


@query("depth_diagnostics", f"WITH {V.DEPTH_SQL} SELECT * FROM problems")
def depth_diagnostics(spark, sf_dir):
    return depth.normalise(V.depth_lines(spark, sf_dir)).diagnostics


@query("symbol_dictionary", f"WITH {V.DEPTH_SQL} SELECT * FROM sym")
def symbol_dictionary(spark, sf_dir):
    return depth.symbol_dictionary(depth.parse_lines(V.depth_lines(spark, sf_dir)))


@query(
    "depth_report",
    f"""WITH {V.DEPTH_SQL}
    SELECT (SELECT count(*) FROM msg WHERE kind <> 'banner') AS raw_line_count,
      (SELECT count(*) FROM msg WHERE kind NOT IN ('banner', 'malformed')) AS raw_message_count,
      (SELECT count(*) FROM msg WHERE kind = 'banner') AS metadata_line_count,
      (SELECT min(u2) FROM msg WHERE kind IN ('diff', 'snapshot', 'missing')) AS min_update_id,
      (SELECT max(u2) FROM msg WHERE kind IN ('diff', 'snapshot', 'missing')) AS max_update_id,
      CAST(3 AS INTEGER) AS min_levels, CAST(3 AS INTEGER) AS max_levels,
      count(*) AS normalised_event_count,
      count(*) FILTER (event_type = 'Add') AS add_count,
      count(*) FILTER (event_type = 'Cancel') AS cancel_count,
      count(*) FILTER (event_type = 'Replace') AS replace_count,
      count(*) FILTER (event_type = 'Snapshot') AS snapshot_count,
      arg_min(timestamp_ns, sequence_number) AS first_timestamp_ns,
      arg_max(timestamp_ns, sequence_number) AS last_timestamp_ns,
      min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence,
      (SELECT count(*) FROM problems) AS diagnostics_count,
      (SELECT count(*) FROM sym) AS symbol_count
    FROM l3""",
)
def depth_report(spark, sf_dir):
    return depth.report(depth.normalise(V.depth_lines(spark, sf_dir)))
