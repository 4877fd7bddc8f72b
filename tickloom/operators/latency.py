"""Latency distributions, stage budgets, counters and throughput."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators.scan import block_scan

SUMMARY_QUANTILES = {"p50_ns": 0.50, "p90_ns": 0.90, "p99_ns": 0.99, "p999_ns": 0.999}
BENCH_QUANTILES = {"p50_ns": 0.50, "p95_ns": 0.95, "p99_ns": 0.99, "p999_ns": 0.999}


def percentiles(
    samples: DataFrame,
    keys: Sequence[str],
    value: str = "duration_ns",
    quantiles: dict[str, float] = SUMMARY_QUANTILES,
    bucket: int = 65_536,
) -> DataFrame:
    """Exact nearest-rank percentiles per key, with count, minimum and maximum.

    Samples are counted per distinct value before any shuffle of note; ranks are running
    counts over value buckets, so one stage with most samples is not one task.
    """
    keys = list(keys)
    counted = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = block_scan(
        counted,
        keys,
        [value],
        F.floor(F.col(value) / F.lit(bucket)).cast("bigint"),
        totals={"_upto": F.col("_n")},
    )
    sizes = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min(value).alias("min_ns"),
        F.max(value).alias("max_ns"),
    )
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("sample_count")), F.lit(1))
    return (
        ranked.join(sizes, keys)
        .groupBy(*keys, "sample_count", "min_ns", "max_ns")
        .agg(
            *[
                F.min(F.when(F.col("_upto") >= rank(p), F.col(value))).alias(name)
                for name, p in quantiles.items()
            ]
        )
    )


def stage_reports(samples: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """One row per known stage, also without samples; budget 0 means none."""
    spark = samples.sparkSession
    unknown = set(budgets) - set(schema.LATENCY_STAGES)
    if unknown:
        raise ValueError(f"unknown latency stages: {sorted(unknown)}")
    stages = spark.createDataFrame(
        [(name, code, budgets.get(name, 0)) for name, code in schema.LATENCY_STAGES.items()],
        "stage STRING, stage_no BIGINT, budget_ns BIGINT",
    )
    seen = samples.groupBy("stage").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max("duration_ns").alias("worst_observed_ns"),
        F.sum("duration_ns").alias("total_observed_ns"),
    )
    zero = F.lit(0).cast("bigint")
    rows = stages.join(seen, "stage", "left").withColumns(
        {c: F.coalesce(c, zero) for c in seen.columns if c != "stage"}
    )
    return rows.select(
        "stage",
        "stage_no",
        (F.col("budget_ns") > 0).alias("has_budget"),
        "budget_ns",
        "sample_count",
        "worst_observed_ns",
        "total_observed_ns",
        F.coalesce(F.expr("worst_observed_ns * 1000000 div nullif(budget_ns, 0)"), zero).alias(
            "worst_utilization_ppm"
        ),
        (
            (F.col("budget_ns") > 0)
            & (F.col("sample_count") > 0)
            & (F.col("worst_observed_ns") > F.col("budget_ns"))
        ).alias("exceeded"),
    )


def budget_summary(reports: DataFrame) -> DataFrame:
    """Exceeded stages and the worst offender (first stage on equal utilisation)."""
    counts = F.col("has_budget") & (F.col("sample_count") > 0)
    return reports.agg(
        F.count_if("exceeded").alias("exceeded_count"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("exceeded"), F.struct("stage_no", "stage")))
                ),
                lambda x: x.stage,
            ),
            ",",
        ).alias("exceeded_stages"),
        F.max_by(
            "stage",
            F.when(counts, F.struct("worst_utilization_ppm", -F.col("stage_no"))),
        ).alias("worst_offender"),
    )


def counters(increments: DataFrame) -> DataFrame:
    """Named counters: sum of ``delta`` per ``name``."""
    return increments.groupBy("name").agg(F.sum("delta").alias("value"))


def throughput(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events per second over the time between a key's first and last event."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        (F.max("timestamp_ns") - F.min("timestamp_ns")).alias("elapsed_ns"),
    ).withColumn(
        "events_per_second",
        F.when(F.col("elapsed_ns") > 0, F.col("event_count") * 1e9 / F.col("elapsed_ns")),
    )


def budget_document(reports: DataFrame) -> DataFrame:
    """Budget report as one JSON line per stage."""
    return reports.select(F.to_json(F.struct(*reports.drop("stage_no").columns)).alias("value"))
