"""Run-to-run comparison: benchmarks, replay parity, first differences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("iterations", "total_ns", "avg_ns")


def pct_change(before: Column, after: Column) -> Column:
    """Percent change; 0 when both are 0, null when only the base is 0."""
    return F.when(before == 0, F.when(after == 0, F.lit(0.0))).otherwise(
        (after - before) / before * 100.0
    )


def compare_benchmarks(
    baseline: DataFrame, current: DataFrame, threshold_pct: float = 10.0, metric: str = "avg_ns"
) -> DataFrame:
    """All names of both runs with status shared, new or missing, change and verdict."""
    if threshold_pct < 0:
        raise ValueError("threshold_pct must be non-negative")
    if metric not in METRICS:
        raise ValueError(f"unknown benchmark metric: {metric}")
    old = baseline.select("name", F.col(metric).alias("baseline_value"))
    new = current.select("name", F.col(metric).alias("current_value"))
    before, after = F.col("baseline_value"), F.col("current_value")
    shared = before.isNotNull() & after.isNotNull()
    pct = F.col("pct_change")
    worse = F.when(pct.isNull(), after > before).otherwise(pct > threshold_pct)
    better = F.when(pct.isNull(), after < before).otherwise(pct < -threshold_pct)
    return (
        old.join(new, "name", "full_outer")
        .withColumn("pct_change", F.when(shared, pct_change(before, after)))
        .select(
            "name",
            F.when(before.isNull(), "new").when(after.isNull(), "missing").otherwise("shared")
            .alias("status"),
            before,
            after,
            (after - before).alias("delta"),
            "pct_change",
            (shared & worse).alias("regressed"),
            (shared & better).alias("improved"),
        )
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if("regressed").alias("regressions"),
        F.count_if("improved").alias("improvements"),
        F.count_if(F.col("status") == "new").alias("new_benchmarks"),
        F.count_if(F.col("status") == "missing").alias("missing_benchmarks"),
        F.coalesce(F.bool_or("regressed"), F.lit(False)).alias("has_regressions"),
    )


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names present on the left only."""
    return left.select("name").distinct().join(right.select("name"), "name", "left_anti")


def shared_names(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("name").intersect(right.select("name"))


def compare_runs(
    left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Presence and per-field match flags for every key of two summary tables."""
    l_side = left.select(key, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in fields])
    r_side = right.select(
        key, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in fields]
    )
    joined = l_side.join(r_side, key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    same = {f"{c}_match": both & F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in fields}
    matched = both
    for flag in same.values():
        matched = matched & flag
    return joined.select(
        key,
        F.col("_l").isNotNull().alias("present_left"),
        F.col("_r").isNotNull().alias("present_right"),
        *[flag.alias(name) for name, flag in same.items()],
        matched.alias("matched"),
    )


def parity_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if("present_left").alias("symbol_count_left"),
        F.count_if("present_right").alias("symbol_count_right"),
        F.count_if(~F.col("matched")).alias("mismatch_count"),
        F.coalesce(F.bool_and("matched"), F.lit(True)).alias("matched"),
    )


def field_differences(
    left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Differing fields of keys present in both tables, one row each, values as text."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(f"_l_{c}").cast("string").alias("left_value"),
                F.col(f"_r_{c}").cast("string").alias("right_value"),
            )
            for c in fields
        ]
    )
    l_side = left.select(key, *[F.col(c).alias(f"_l_{c}") for c in fields])
    r_side = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in fields])
    differing = F.filter(pairs, lambda x: ~x.left_value.eqNullSafe(x.right_value))
    return l_side.join(r_side, key).select(key, F.explode(differing).alias("d")).select(key, "d.*")


def first_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, fields: Sequence[str]
) -> DataFrame:
    """First position per key at which two ordered streams differ or one ends."""
    keys = list(keys)
    row = F.struct(*fields)
    joined = left.select(*keys, position, row.alias("_l")).join(
        right.select(*keys, position, row.alias("_r")), [*keys, position], "full_outer"
    )
    kind = F.when(F.col("_l").isNull(), "right_only").when(
        F.col("_r").isNull(), "left_only"
    ).otherwise("changed")
    return (
        joined.filter(~F.col("_l").eqNullSafe(F.col("_r")))
        .groupBy(*keys)
        .agg(
            F.min(position).alias("first_position"),
            F.min_by(kind, position).alias("kind"),
            F.count(F.lit(1)).alias("difference_count"),
        )
    )


def expected_top_levels(compared: DataFrame, top: DataFrame) -> DataFrame:
    """Expected ladder rows of the symbols whose runs disagree."""
    return top.join(compared.filter(~F.col("matched")).select("symbol_id"), "symbol_id", "left_semi")


def compare_variants(
    rows: DataFrame, key: str, variant: str, base: str, other: str, metrics: Sequence[str]
) -> DataFrame:
    """Two variants side by side per key: values, deltas (other - base) and ratios."""
    picked = {
        f"{name}_{metric}": F.max(F.when(F.col(variant) == name, F.col(metric)))
        for name in (base, other)
        for metric in metrics
    }
    wide = rows.filter(F.col(variant).isin(base, other)).groupBy(key).agg(
        *[col.alias(name) for name, col in picked.items()]
    )
    extra = []
    for metric in metrics:
        b, o = F.col(f"{base}_{metric}"), F.col(f"{other}_{metric}")
        extra.append((o - b).alias(f"delta_{metric}"))
        extra.append(F.when(b != 0, o / b).alias(f"ratio_{metric}"))
    return wide.select(key, *picked, *extra)
