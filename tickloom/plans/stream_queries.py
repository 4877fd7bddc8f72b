"""Queries that run as Structured Streaming over all available input."""

import uuid

from pyspark.sql import functions as F

from tickloom.operators import compare, quality
from tickloom.operators.scan import whole_div
from tickloom.plans import views as V
from tickloom.plans.analytics_queries import _POLICY, _SIGNALS, _signal_columns
from tickloom.plans.event_queries import _DIRTY, _dirty_diagnostics
from tickloom.plans.limit_queries import _ASOF, _ORDERS, _RATE, MONTH
from tickloom.plans.registry import query
from tickloom.session import shared_dir, stage, staged_once
from tickloom.streaming import gates, replay, windows


def _slots(rows, position, slots):
    """Rows, the even stretch of ``position`` each belongs to, and the number of stretches."""
    lo, hi = rows.agg(F.min(position), F.max(position)).first()
    width = ((hi or 0) - (lo or 0)) // slots + 1
    return rows, whole_div(F.col(position) - F.lit(lo or 0), width), slots


def _event_stream(spark, sf_dir):
    schema = V.table(spark, sf_dir, "events").schema
    return windows.file_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def _replayed(spark, sf_dir):
    def build():
        windows.use_state_store(spark)
        rows = windows.run_in_slots(
            *_slots(V.supplier_flow(spark, sf_dir), "event_index", 5),
            lambda feed: replay.replay_stream(V.damaged(feed), packed=True), "replay")
        return rows.groupBy("symbol_id").agg(
            F.count_if(F.col("status") == "applied").alias("events_processed"),
            F.count_if(F.col("status") == "skipped").alias("events_skipped"),
            F.coalesce(F.max("reason"), F.lit("")).alias("error"),
            F.max_by("live_orders", "event_index").alias("live_orders"),
        )

    return staged_once(spark, sf_dir, "stream_replay", build)


_BATCH = _DIRTY + """,
stream_summary AS (
  SELECT d.symbol_id, coalesce(any_value(g.event_index), count(*)) AS events_processed,
    CASE WHEN any_value(g.event_index) IS NULL THEN 0
      ELSE count(*) - any_value(g.event_index) - 1 END AS events_skipped,
    coalesce(any_value(g.reason), '') AS error
  FROM dirty d LEFT JOIN diag g ON g.symbol_id = d.symbol_id GROUP BY d.symbol_id)"""


@query("stream_replay_summary", f"WITH {_BATCH} SELECT * FROM stream_summary")
def stream_replay_summary(spark, sf_dir):
    return _replayed(spark, sf_dir).drop("live_orders")


@query(
    "stream_batch_parity",
    f"""WITH {_BATCH} SELECT symbol_id, true AS present_left, true AS present_right,
      true AS events_processed_match, true AS error_match, true AS matched,
      events_processed, error, (SELECT count(*) FROM dirty d WHERE d.symbol_id = s.symbol_id)
        AS event_count
    FROM stream_summary s""",
)
def stream_batch_parity(spark, sf_dir):
    """Streamed against batch summaries, with the streamed outcome and the batch event count."""
    streamed = _replayed(spark, sf_dir)
    batch = quality.symbol_summary(V.dirty_flow(spark, sf_dir), _dirty_diagnostics(spark, sf_dir))
    return (
        compare.compare_runs(streamed, batch, "symbol_id", ["events_processed", "error"])
        .join(streamed.select("symbol_id", "events_processed", "error"), "symbol_id", "left")
        .join(batch.select("symbol_id", "event_count"), "symbol_id", "left")
    )


@query(
    "stream_rate_sliding",
    f"""WITH {_ORDERS}, {_RATE} SELECT client_id, arrival, observed_rate,
    observed_rate <= 5 AS allowed FROM rated""",
)
def stream_rate_sliding(spark, sf_dir):
    windows.use_state_store(spark)
    return windows.run_in_slots(
        *_slots(V.order_requests(spark, sf_dir), "arrival", 3),
        lambda messages: gates.rate_stream(messages, 5, MONTH), "rate")


@query(
    "stream_late_gate",
    f"""WITH {_SIGNALS}, isl AS (
      SELECT *, sum(CASE WHEN late_signal THEN 0 ELSE 1 END) OVER (
        PARTITION BY user_id ORDER BY event_id) AS island FROM decided),
    streaks AS (
      SELECT *, CAST(sum(CASE WHEN late_signal THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS late_streak FROM isl),
    latched AS (SELECT *, max(late_streak) OVER (PARTITION BY user_id ORDER BY event_id) >= 4
      AS model_disabled FROM streaks)
    SELECT user_id, event_id, late_streak, model_disabled, accepted AND NOT model_disabled AS accepted
    FROM latched""",
)
def stream_late_gate(spark, sf_dir):
    windows.use_state_store(spark)
    signals = _event_stream(spark, sf_dir).select(*_signal_columns())
    return windows.run_to_table(gates.gate_stream(signals, _POLICY), "gate")


def _staleness(spark, sf_dir):
    """Judged orders and alerts of old prices, from a feed cut by time into slots."""
    def build():
        windows.use_state_store(spark)
        market = V.market_ref(spark, sf_dir).withColumn(
            "client_order_id", F.lit(None).cast("bigint")
        )
        orders = V.order_requests(spark, sf_dir).select(
            "symbol_id", "timestamp_ns", "client_order_id",
            F.lit(None).cast("bigint").alias("reference_price_ticks"),
        )
        messages = stage(orders.unionByName(market), "stale-messages")
        return windows.run_in_slots(
            *_slots(messages, "timestamp_ns", 3),
            lambda feed: gates.stale_stream(feed, V.DAY_NS // 2, "1 hour"), "stale")

    return staged_once(spark, sf_dir, "stream_stale", build)


@query(
    "stream_stale_orders",
    f"""WITH {_ASOF} SELECT symbol_id, client_order_id, reference_price_ticks,
      timestamp_ns - reference_ns AS age_ns,
      coalesce(timestamp_ns - reference_ns > {V.DAY_NS // 2}, true) AS stale FROM priced""",
)
def stream_stale_orders(spark, sf_dir):
    return _staleness(spark, sf_dir).filter("client_order_id IS NOT NULL").drop("timestamp_ns")


@query(
    "stream_stale_alerts",
    f"""WITH {_ORDERS}, {V.MARKET_SQL},
    stands AS (SELECT *, lead(timestamp_ns) OVER (
      PARTITION BY symbol_id ORDER BY timestamp_ns) AS until_ns FROM market_ref),
    ends AS (SELECT max(timestamp_ns) - {V.DAY_NS // 24} AS passed_ns FROM (
      SELECT timestamp_ns FROM market_ref UNION ALL SELECT timestamp_ns FROM order_requests))
    SELECT symbol_id, reference_price_ticks, timestamp_ns + {V.DAY_NS // 2} + 1000000 AS raised_ns
    FROM stands, ends
    WHERE coalesce(until_ns, passed_ns) - timestamp_ns > {V.DAY_NS // 2}""",
)
def stream_stale_alerts(spark, sf_dir):
    """One row for every price that grew too old, also the last of a symbol that fell silent."""
    return _staleness(spark, sf_dir).filter("client_order_id IS NULL").select(
        "symbol_id", "reference_price_ticks", F.col("timestamp_ns").alias("raised_ns"))


# Arrival of the events: five even stretches of time, then every 97th event, long after its time.
_SLOTS, _LATE, _FILES = 5, 97, 4


def _arriving(spark, sf_dir):
    """Folder of files in arrival order, ``_FILES`` for each slot."""
    folder = f"{shared_dir(spark)}/tickloom/late-events-{uuid.uuid4().hex}"
    rows = V.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id",
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_ns"),
    )
    span = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    slot = whole_div(F.unix_micros("ts") - span[0], (span[1] - span[0]) // _SLOTS + 1)
    rows = rows.withColumn(
        "slot", F.when(F.col("event_id") % _LATE == 0, _SLOTS).otherwise(slot))
    for n in range(_SLOTS + 1):
        rows.filter(F.col("slot") == n).repartition(_FILES).write.mode("append").parquet(folder)
    return windows.file_stream(spark, folder, rows.schema, maxFilesPerTrigger=str(_FILES))


@query(
    "stream_windowed_counters",
    f"""WITH span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
    e AS (
      SELECT ts, event_type, CAST(floor(value * 1000) AS BIGINT) AS v, event_id % {_LATE} = 0 AS late,
        (epoch_us(ts) - lo) // ((hi - lo) // {_SLOTS} + 1) AS slot,
        time_bucket(INTERVAL '1 hour', ts) AS start FROM events, span),
    passed AS (SELECT
      max(ts) FILTER (NOT late AND slot < {_SLOTS - 1}) - INTERVAL '1 hour' AS before_late,
      max(ts) - INTERVAL '1 hour' AS until FROM e)
    SELECT start, start + INTERVAL '1 hour' AS "end", event_type, count(*) AS event_count,
      CAST(sum(v) AS BIGINT) AS total, max(v) AS worst
    FROM e, passed WHERE start + INTERVAL '1 hour' <= until
      AND (NOT late OR start + INTERVAL '1 hour' > before_late) GROUP BY ALL""",
)
def stream_windowed_counters(spark, sf_dir):
    """Windows that the watermark has passed, over six micro-batches. Rows are late by the watermark
    that the batch before them ran with, which lags the rows by one batch more."""
    counted = windows.windowed_counters(
        _arriving(spark, sf_dir), ["event_type"], "duration_ns", "1 hour")
    return windows.run_to_table(counted, "counters").select(
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("end").cast("timestamp_ntz").alias("end"),
        "event_type", "event_count", "total", "worst",
    )
