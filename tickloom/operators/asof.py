"""As-of lookups and control intervals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import block_scan, whole_div

HOUR_NS = 3_600 * 1_000_000_000


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    *,
    slice_ns: int = 24 * HOUR_NS,
    tie: str | None = None,
) -> DataFrame:
    """Add the latest ``right`` values at or before each left row's ``time``, per key.

    Also adds ``asof_{time}``, the time of the matched row. Both sides are first cut to one
    row per (key, time), so repeated times cost nothing, and the scan works in time slices of
    each key; the result goes back to the left rows by equi-join, where AQE splits skew.
    ``tie`` names the right column deciding between rows of equal time (largest wins).
    """
    keys = list(keys)
    point = tie or time
    known = right.groupBy(*keys, time).agg(
        *[F.max_by(c, point).alias(c) for c in values]
    ).withColumn("_asked", F.lit(0))
    asked = left.select(*keys, time).distinct()
    for c in values:
        asked = asked.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    asked = asked.withColumn("_asked", F.lit(1))
    is_known = F.col("_asked") == 0
    found = block_scan(
        known.unionByName(asked),
        keys,
        [time, "_asked"],
        whole_div(time, slice_ns),
        latest={
            "_hit": F.when(is_known, F.struct(F.col(time).alias("_t"), *[F.col(c) for c in values]))
        },
    ).filter(F.col("_asked") == 1)
    lookup = found.select(
        *keys,
        time,
        F.col("_hit._t").alias(f"asof_{time}"),
        *[F.col(f"_hit.{c}").alias(c) for c in values],
    )
    return left.join(lookup, [*keys, time], "left")


def running_sum_as_of(
    left: DataFrame, changes: DataFrame, time: str, amount: str, name: str, slice_ns: int
) -> DataFrame:
    """Add the sum of all ``changes`` at or before each left row's time (no key)."""
    stepped = changes.groupBy(time).agg(F.sum(amount).alias("_step"))
    asked = left.select(time).distinct().withColumn("_step", F.lit(0).cast("bigint"))
    both = stepped.unionByName(asked).groupBy(time).agg(F.sum("_step").alias("_step"))
    total = block_scan(
        both,
        [],
        [time],
        whole_div(time, slice_ns),
        totals={name: F.col("_step")},
    )
    return left.join(total.select(time, name), time, "left")


def control_state(
    rows: DataFrame, controls: DataFrame, keys: Sequence[str], time: str, **options
) -> DataFrame:
    """Add ``killed`` and ``connected`` as of each row's time.

    controls: keys, time, ``control`` in kill, disconnect, reconnect. A kill never ends.
    """
    steps = controls.withColumns(
        {
            "killed": (F.col("control") == "kill"),
            "connected": F.when(F.col("control") != "kill", F.col("control") == "reconnect"),
        }
    )
    kills = steps.filter("killed").groupBy(*keys).agg(F.min(time).alias("_killed_from"))
    links = steps.filter("connected IS NOT NULL")
    joined = as_of(rows, links, keys, time, ["connected"], **options).drop(f"asof_{time}")
    return joined.join(kills, list(keys), "left").select(
        *rows.columns,
        F.coalesce(F.col(time) >= F.col("_killed_from"), F.lit(False)).alias("killed"),
        F.coalesce("connected", F.lit(True)).alias("connected"),
    )


def mass_cancels(live: DataFrame, controls: DataFrame, limits_cancel_on_disconnect: bool) -> DataFrame:
    """Orders cancelled by the first kill or disconnect inside their working interval.

    live: scope, client_order_id, symbol_id, side, quantity, from_ns, until_ns (exclusive)
    controls: scope, timestamp_ns, control. Each order meets at most its first control.
    """
    kinds = ["kill", "disconnect"] if limits_cancel_on_disconnect else ["kill"]
    stops = controls.filter(F.col("control").isin(*kinds)).select(
        "scope", (-F.col("timestamp_ns")).alias("_back"), "control"
    )
    # The first stop at or after the start is an as-of lookup on mirrored time.
    asked = live.withColumn("_back", -F.col("from_ns"))
    met = as_of(asked, stops, ["scope"], "_back", ["control"])
    stop_ns = -F.col("asof__back")
    kill = F.col("control") == "kill"
    return met.filter(stop_ns < F.col("until_ns")).select(
        stop_ns.alias("timestamp_ns"),
        "client_order_id",
        "symbol_id",
        "side",
        F.lit(False).alias("accepted"),
        F.when(kill, "KillSwitch").otherwise("Disconnected").alias("reject_reason"),
        F.when(kill, "kill_switch_cancel").otherwise("disconnect_cancel").alias("check_name"),
        F.lit(0).cast("bigint").alias("limit_value"),
        F.col("quantity").alias("observed_value"),
    )


def age_exceeds(now: Column, since: Column, limit_ns: int) -> Column:
    """Staleness test; a limit of 0 or less never trips."""
    return F.lit(limit_ns > 0) & (now - since > F.lit(limit_ns))
