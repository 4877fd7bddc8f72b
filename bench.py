"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores. Every query
is timed once over its full result (``noop`` sink) in one warm session; intermediate tables it
stages count. The shared inputs (event log, order messages) are staged first and reported as
their own entry, ``stage_inputs``. BENCH_ONLY names queries to run.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tickloom.plans import catalog, views
from tickloom.session import configure

HEADLINES = [
    "final_l2_levels",
    "l3_fifo_book",
    "bbo_timeline",
    "snapshot_epoch_book",
    "dirty_diagnostics",
    "symbol_replay_summary",
    "period_end_ladder",
    "depth_to_l3",
    "asof_reference_price",
    "rate_sliding",
    "limit_decisions_t1",
    "self_trade_pairs",
    "sweep_fillability",
    "portfolio_positions",
    "latency_percentiles",
    "benchmark_compare",
    "l2_features",
    "model_frames",
    "event_log_checksums",
    "audit_chain_verify",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        started = time.perf_counter()
        action()
        return round(time.perf_counter() - started, 3)

    def stage_inputs() -> None:
        for build in (views.order_flow, views.supplier_flow, views.order_requests):
            build(spark, sf_dir)

    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINES
    times = {"stage_inputs": timed(stage_inputs)}
    for name in names:
        run = lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode(  # noqa: E731, B023
            "overwrite"
        ).save()
        times[name] = timed(run)
        print(name, times[name], file=sys.stderr, flush=True)
    events = views.order_flow(spark, sf_dir).count()
    report = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "events": events,
        "bbo_events_per_second": round(events / times["bbo_timeline"])
        if "bbo_timeline" in times else None,
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
