"""Event-time counters over streams, and running a stream to its end."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import new_folder

STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def event_time(nanos: str = "timestamp_ns"):
    """Timestamp column (microseconds) of an integer nanosecond time."""
    return F.timestamp_micros(F.expr(f"{nanos} div 1000"))


def windowed_counters(
    events: DataFrame,
    keys: list[str],
    value: str,
    width: str,
    slide: str | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """Count, sum and maximum per key and time window; needs a ``ts`` timestamp column.

    In append mode a window is written once, when the watermark has passed its end, and its state
    goes; rows that come after that are not counted. Complete mode keeps every window in state.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(window.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum(value).alias("total"),
            F.max(value).alias("worst"),
        )
        .select("w.start", "w.end", *keys, "event_count", "total", "worst")
    )


def run_to_table(
    stream: DataFrame, label: str, mode: str = "append", base: str | None = None
) -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    Append output goes to Parquet in the shared folder with a checkpoint beside it, so a run
    survives lost executors and restarts: with the ``base`` folder of an earlier run it goes on
    from that run's checkpoint and returns the rows of both. Complete and update modes overwrite
    one folder per batch through ``foreachBatch``.
    """
    spark = stream.sparkSession
    base = base or new_folder(spark, f"stream-{label}")
    writer = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(mode)
    )
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/data").start()
    else:
        query = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/data")
        ).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_in_slots(
    rows: DataFrame,
    slot: Column,
    slots: int,
    transform: Callable[[DataFrame], DataFrame],
    label: str,
) -> DataFrame:
    """What ``transform`` gives for a folder that grows by one slot of ``rows`` at a time.

    The stream ends after each slot and starts anew from its checkpoint for the next one, so every
    slot is a micro-batch of its own and all state passes through the checkpoint.
    """
    spark = rows.sparkSession
    base = new_folder(spark, f"stream-{label}")
    numbered = rows.withColumn("_slot", slot)
    for n in range(slots):
        numbered.filter(F.col("_slot") == n).drop("_slot").write.mode("append").parquet(f"{base}/in")
        written = run_to_table(
            transform(file_stream(spark, f"{base}/in", rows.schema)), label, base=base
        )
    return written


def file_stream(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """Stream Parquet files of a folder or glob."""
    reader = spark.readStream.schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(folder)


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
