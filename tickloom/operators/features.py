"""Ladder features, scores, signals, policies and model frames."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.operators.scan import block_scan, whole_div


def l2_features(quotes: DataFrame) -> DataFrame:
    """Spread, mid, imbalance and quantity of the top level; zeros if a side is empty."""
    bid, ask = F.col("bid_price").cast("double"), F.col("ask_price").cast("double")
    bid_q, ask_q = F.col("bid_quantity").cast("double"), F.col("ask_quantity").cast("double")
    both = F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull()
    total = bid_q + ask_q
    shown = lambda value: F.when(both, value).otherwise(F.lit(0.0))
    return quotes.withColumns(
        {
            "spread_ticks": shown(ask - bid),
            "mid_price_ticks": shown((ask + bid) / 2.0),
            "top_level_imbalance": shown(
                F.when(total == 0, F.lit(0.0)).otherwise((bid_q - ask_q) / total)
            ),
            "top_level_quantity": shown(total),
        }
    )


def linear_score(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """bias + sum of weight x feature over the shorter of the two lists, left to right."""
    score = F.lit(float(bias))
    for name, weight in zip(features, weights, strict=False):
        score = score + F.lit(float(weight)) * F.col(name)
    return score


def linear_score_array(features: Column, weights: Sequence[float], bias: float) -> Column:
    """The same for an array column."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    pairs = F.zip_with(features, fixed, lambda x, w: x * w)
    known = F.filter(pairs, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(float(bias)), lambda acc, x: acc + x)


def reference_score(features: Column, weights: Sequence[float], bias: float) -> Column:
    """Score that insists on the exact feature count."""
    checked = F.when(F.size(features) == len(weights), features).otherwise(
        F.raise_error(F.lit("reference fixture feature count mismatch"))
    )
    return linear_score_array(checked, weights, bias)


@dataclass(frozen=True)
class SignalPolicy:
    """When a signal is too slow or too old, and when a model is switched off."""

    timeout_ns: int = 0
    max_signal_age_ns: int = 0
    drop_timed_out: bool = True
    drop_late_signals: bool = True
    disable_on_repeated_late_signals: bool = False
    max_consecutive_late_signals: int = 0


def judge_signals(signals: DataFrame, policy: SignalPolicy) -> DataFrame:
    """Add timed_out, late_signal, accepted and decision.

    signals: latency_ns, signal_timestamp_ns, now_ns.
    """
    slow = F.lit(policy.timeout_ns > 0) & (F.col("latency_ns") > policy.timeout_ns)
    late = (
        F.lit(policy.max_signal_age_ns > 0)
        & (F.col("signal_timestamp_ns") > 0)
        & (F.col("now_ns") >= F.col("signal_timestamp_ns"))
        & (F.col("now_ns") - F.col("signal_timestamp_ns") > policy.max_signal_age_ns)
    )
    judged = signals.withColumns({"timed_out": slow, "late_signal": late})
    slow, late = F.col("timed_out"), F.col("late_signal")
    return judged.withColumns(
        {
            "accepted": ~(slow & F.lit(policy.drop_timed_out))
            & ~(late & F.lit(policy.drop_late_signals)),
            "decision": F.when(slow & late, "timeout_and_late_signal")
            .when(slow, "timeout")
            .when(late, "late_signal")
            .otherwise("accept"),
        }
    )


def late_streaks(
    signals: DataFrame,
    policy: SignalPolicy,
    keys: Sequence[str],
    position: str,
    block: Column,
) -> DataFrame:
    """Add late_streak and model_disabled: the length of the current run of late signals and
    the latch it trips. Both follow from running sums, so a busy model is scanned in blocks.
    """
    keys = list(keys)
    judged = judge_signals(signals, policy)
    late = F.col("late_signal")
    counted = block_scan(
        judged.withColumn("_slice", block),
        keys,
        [position],
        "_slice",
        totals={"_late": F.when(late, 1).otherwise(0).cast("bigint")},
    )
    # The late count at the last good signal, subtracted from the count so far.
    based = block_scan(
        counted,
        keys,
        [position],
        "_slice",
        latest={"_base": F.when(~late, F.col("_late"))},
    ).withColumn("late_streak", F.col("_late") - F.coalesce("_base", F.lit(0)))
    trips = F.lit(
        policy.disable_on_repeated_late_signals and policy.max_consecutive_late_signals > 0
    ) & (F.col("late_streak") >= max(policy.max_consecutive_late_signals, 1))
    # A latch needs only the first trip per key: an aggregation, not a scan.
    first = (
        based.filter(trips).groupBy(*keys).agg(F.min(position).alias("_tripped"))
    )
    off = F.coalesce(F.col(position) >= F.col("_tripped"), F.lit(False))
    return (
        based.join(first, keys, "left")
        .withColumns({"model_disabled": off, "accepted": F.col("accepted") & ~off})
        .drop("_late", "_base", "_tripped", "_slice")
    )


def imbalance_signals(quotes: DataFrame, threshold: float, quantity: int) -> DataFrame:
    """Buy at the bid when its share of top quantity reaches the threshold, else sell at the
    ask when the other side's does."""
    share = F.col("bid_quantity").cast("double") / (
        F.col("bid_quantity") + F.col("ask_quantity")
    ).cast("double")
    usable = (
        F.col("bid_price").isNotNull()
        & F.col("ask_price").isNotNull()
        & (F.col("bid_quantity") + F.col("ask_quantity") > 0)
        & F.lit(quantity > 0)
    )
    side = F.when(share >= threshold, "Buy").when(1.0 - share >= threshold, "Sell")
    return (
        quotes.filter(usable)
        .withColumn("side", side)
        .filter("side IS NOT NULL")
        .withColumns(
            {
                "order_type": F.lit("Limit"),
                "price_ticks": F.when(F.col("side") == "Buy", F.col("bid_price")).otherwise(
                    F.col("ask_price")
                ),
                "quantity": F.lit(quantity).cast("bigint"),
            }
        )
    )


def quote_signals(quotes: DataFrame, quantity: int) -> DataFrame:
    """Quote one tick inside both sides when the spread leaves room."""
    room = (F.col("ask_price") > F.col("bid_price") + 1) & F.lit(quantity > 0)
    leg = lambda side, price: F.struct(
        F.lit(side).alias("side"), price.alias("price_ticks")
    )
    return (
        quotes.filter(room)
        .withColumn(
            "_legs",
            F.explode(
                F.array(leg("Buy", F.col("bid_price") + 1), leg("Sell", F.col("ask_price") - 1))
            ),
        )
        .select(
            *quotes.columns,
            "_legs.*",
            F.lit("Limit").alias("order_type"),
            F.lit(quantity).cast("bigint").alias("quantity"),
        )
    )


def reference_price(event_price: Column) -> Column:
    """Mid (whole ticks), else bid, else ask, else the event's price, else 1000."""
    mid = F.expr("(bid_price + ask_price) div 2")
    return F.coalesce(mid, F.col("bid_price"), F.col("ask_price"),
                      F.when(event_price > 0, event_price), F.lit(1000))


# --- model contracts and windows --------------------------------------------------------

# Artefact types the model contract knows.
ARTEFACT_TYPES = (
    "trained_synthetic_smoke",
    "trained_recorded_public_l2",
)


def shape_values(shape: str) -> str:
    """SQL for the number of elements of a shape column: null for a null or empty shape, a
    dimension that is not positive, and a product beyond 2^63 - 1."""
    return f"""CASE WHEN size({shape}) > 0 THEN aggregate({shape}, 1L, (n, x) ->
        CASE WHEN x > 0 AND n <= 9223372036854775807 div x THEN n * x END) END"""


def contract_rules() -> dict[str, str]:
    """Code of each rule of a model contract, and the SQL condition that a sound model meets. A
    condition that cannot be told counts as violated."""
    recorded = "coalesce(artefact_type = 'trained_recorded_public_l2', false)"
    kinds = ", ".join(f"'{kind}'" for kind in ("", *ARTEFACT_TYPES))
    return {
        "name": "model_name <> ''",
        "feature_count": "feature_count > 0",
        "window_length": "window_length > 0",
        "feature_version": "feature_version > 0",
        "input_shape": f"{shape_values('input_shape')} > 0",
        "output_shape": f"{shape_values('output_shape')} > 0",
        "frame_size": f"{shape_values('input_shape')} = try_multiply(feature_count, window_length)",
        "sample_input": f"size(expected_test_input) = {shape_values('input_shape')}",
        "sample_output": f"size(expected_test_output) = {shape_values('output_shape')}",
        "recorded_input": f"NOT {recorded} OR input_shape = array(1L, window_length, feature_count)",
        "recorded_output": f"NOT {recorded} OR (size(output_shape) = 2 AND get(output_shape, 0) = 1)",
        "weights": "reference_weights IS NULL OR size(reference_weights) IN (0, feature_count)",
        "kind": f"coalesce(artefact_type, '') IN ({kinds})",
        "kind_untrained": "NOT startswith(coalesce(artefact_type, ''), 'trained_') OR trained_model",
    }


def contract_violations(
    models: DataFrame,
    feature_count: int = len(schema.FEATURE_NAMES),
    feature_version: int = schema.FEATURE_VERSION,
) -> DataFrame:
    """Codes of all violated rules per model row (``violations``), and whether the model is sound
    and fits the engine's features (``compatible``). Counts, versions and dimensions are bigint."""
    broken = [
        F.when(~F.coalesce(F.expr(f"({rule})"), F.lit(False)), code)
        for code, rule in contract_rules().items()
    ]
    fits = (F.col("feature_count") == feature_count) & (F.col("feature_version") == feature_version)
    return models.withColumn("violations", F.array_compact(F.array(*broken))).withColumn(
        "compatible", (F.size("violations") == 0) & F.coalesce(fits, F.lit(False))
    )


def neighbourhood(
    rows: DataFrame, keys: Sequence[str], position: str, back: int, ahead: int, block_rows: int
) -> tuple[DataFrame, Window]:
    """Rows plus the copies needed to see ``back`` rows before and ``ahead`` rows after each,
    and a window over them. ``position`` must be dense. Only rows near block ends are copied,
    so fixed-length frames over a busy key need no per-key task. Keep rows with ``_own``.
    """
    block = whole_div(position, block_rows)
    place = F.col(position) - block * block_rows
    copy = lambda shift, own: F.struct(
        (block + shift).alias("_block"), F.lit(own).alias("_own")
    )
    copies = F.array_compact(
        F.array(
            copy(0, True),
            F.when(place >= block_rows - back, copy(1, False)),
            F.when(place < ahead, copy(-1, False)),
        )
    )
    spread = rows.withColumn("_c", F.explode(copies)).select("*", "_c._block", "_c._own").drop("_c")
    return spread, Window.partitionBy(*keys, "_block").orderBy(position)


def model_frames(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    features: Sequence[str],
    *,
    window_length: int = 16,
    horizon: int = 5,
    threshold: float = 0.0,
    mean: Sequence[float] | None = None,
    std: Sequence[float] | None = None,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Frames of the last ``window_length`` z-scored feature rows with a direction label.

    The label is the sign of the mid move ``horizon`` rows ahead beyond ``threshold``: -1, 0
    or 1. Rows without a full frame or horizon are left out.
    """
    mean = list(mean or [0.0] * len(features))
    std = list(std or [1.0] * len(features))
    spread, order = neighbourhood(rows, keys, position, window_length - 1, horizon, block_rows)
    scaled = F.array(
        *[
            (F.col(name).cast("double") - F.lit(m)) / F.lit(s)
            for name, m, s in zip(features, mean, std, strict=True)
        ]
    )
    frame = order.rowsBetween(-(window_length - 1), 0)
    move = F.lead("mid_price_ticks", horizon).over(order) - F.col("mid_price_ticks")
    return (
        spread.withColumn("_row", scaled)
        .withColumns(
            {
                "frame": F.flatten(F.collect_list("_row").over(frame)),
                "_rows": F.count(F.lit(1)).over(frame),
                "_move": move,
            }
        )
        .filter(F.col("_own") & (F.col("_rows") == window_length) & F.col("_move").isNotNull())
        .select(
            *keys,
            position,
            "frame",
            F.when(F.col("_move") > threshold, 1)
            .when(F.col("_move") < -threshold, -1)
            .otherwise(0)
            .alias("label"),
        )
    )


def ladder_feature_columns(depth: int = 10) -> list[str]:
    """Names of the mid-relative ladder features, bids then asks, prices then quantities."""
    return [
        f"{side}_{what}_{i}"
        for side in ("bid", "ask")
        for what in ("price_rel", "qty")
        for i in range(depth)
    ]


def ladder_features(ladders: DataFrame, depth: int = 10) -> DataFrame:
    """Mid and mid-relative prices and quantities of ``depth`` levels per side, from a quote
    timeline with ladders; missing levels give 0."""
    mid = (F.col("bid_price") + F.col("ask_price")) / 2.0
    columns = {}
    for side, levels in (("bid", "bids"), ("ask", "asks")):
        for i in range(depth):
            level = F.get(F.col(levels), i)
            columns[f"{side}_price_rel_{i}"] = F.coalesce(level.price_ticks - mid, F.lit(0.0))
            columns[f"{side}_qty_{i}"] = F.coalesce(
                level.quantity.cast("double"), F.lit(0.0)
            )
    return ladders.withColumns({"mid_price_ticks": mid} | columns)


def score_batches(
    rows: DataFrame,
    features: Sequence[str],
    score: Callable[[pd.DataFrame], pd.Series],
    *,
    contract_error: str = "",
    fallback_weights: Sequence[float] = (),
    fallback_bias: float = 0.0,
) -> DataFrame:
    """Score rows with a user model in Arrow batches; fall back to the linear score when the
    model's contract does not hold. Adds score, backend and latency_ns (batch mean)."""
    if contract_error:
        return rows.withColumns(
            {
                "score": linear_score(features, fallback_weights, fallback_bias),
                "backend": F.lit("linear"),
                "latency_ns": F.lit(0).cast("bigint"),
            }
        )
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from time import perf_counter_ns

        for batch in batches:
            started = perf_counter_ns()
            values = score(batch[names])
            spent = (perf_counter_ns() - started) // max(len(batch), 1)
            yield batch.assign(score=values, backend="user", latency_ns=spent)

    out = T.StructType(
        rows.schema.fields
        + [
            T.StructField("score", T.DoubleType()),
            T.StructField("backend", T.StringType()),
            T.StructField("latency_ns", T.LongType()),
        ]
    )
    return rows.mapInPandas(run, schema=out)


DECISION_FIELDS = "side STRING, order_type STRING, price_ticks BIGINT, quantity BIGINT"


def apply_strategy(
    quotes: DataFrame, strategy: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """User strategy over batches of quote rows; it returns the input columns of each decision
    plus side, order_type, price_ticks and quantity."""
    out = T.StructType(
        quotes.schema.fields + T.StructType.fromDDL(DECISION_FIELDS).fields
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield strategy(batch)[out.fieldNames()]

    return quotes.mapInPandas(run, schema=out)
