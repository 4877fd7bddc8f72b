"""JSON and CSV documents: benchmarks, latency budgets, models, risk and portfolio inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema


def _document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def _rows(document: DataFrame, array: str, fields: T.StructType | None = None) -> DataFrame:
    return document.select(F.explode(array).alias("r")).select("r.*")


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows; a name that occurs twice in a document is an error."""
    row = "STRUCT<name: STRING, iterations: BIGINT, total_ns: BIGINT, avg_ns: BIGINT>"
    rows = _rows(_document(spark, path, f"benchmarks ARRAY<{row}>"), "benchmarks")
    twice = rows.groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate benchmark name: {twice[0].name}")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "name", *[F.coalesce(c, zero).alias(c) for c in ("iterations", "total_ns", "avg_ns")]
    )


def benchmark_summary(spark: SparkSession, path: str) -> DataFrame:
    ddl = "schema_version BIGINT, environment MAP<STRING, STRING>, benchmarks ARRAY<STRUCT<name: STRING>>"
    return _document(spark, path, ddl).select(
        F.coalesce("schema_version", F.lit(0)).alias("schema_version"),
        "environment",
        F.coalesce(F.size("benchmarks"), F.lit(0)).alias("benchmark_count"),
    )


def read_latency_budget(spark: SparkSession, path: str) -> DataFrame:
    """Stage rows of a latency-budget report."""
    row = (
        "STRUCT<stage: STRING, has_budget: BOOLEAN, budget_ns: BIGINT, sample_count: BIGINT, "
        "worst_observed_ns: BIGINT, total_observed_ns: BIGINT, worst_utilization_ppm: BIGINT, "
        "exceeded: BOOLEAN>"
    )
    return _rows(_document(spark, path, f"stages ARRAY<{row}>"), "stages")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Model metadata, one row per document; window_length defaults to 1."""
    numbers = "ARRAY<DOUBLE>"
    ddl = (
        "model_name STRING, model_class STRING, artefact_type STRING, input_shape ARRAY<BIGINT>, "
        "output_shape ARRAY<BIGINT>, feature_count BIGINT, window_length BIGINT, "
        "feature_version BIGINT, onnx_sha256 STRING, source_data_sha256 STRING, "
        f"expected_test_input {numbers}, expected_test_output {numbers}, "
        f"reference_weights {numbers}, reference_bias DOUBLE, trained_model BOOLEAN, "
        "deterministic_fixture BOOLEAN"
    )
    return (
        _document(spark, path, ddl)
        .withColumn("window_length", F.coalesce("window_length", F.lit(1)))
        .withColumn("reference_bias", F.coalesce("reference_bias", F.lit(0.0)))
    )


_ARRAYS = {
    "market_data": schema.MARKET_DATA,
    "positions": schema.POSITION,
    "orders": schema.ORDER_REQUEST,
    "execution_reports": schema.EXECUTION_REPORT,
    "replaces": schema.REPLACE_REQUEST,
    "marks": schema.MARK,
    "fills": schema.FILL,
}
_TIMES = ("disconnect_timestamp_ns", "reconnect_timestamp_ns", "kill_switch_timestamp_ns")


def read_risk_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a risk-flow or portfolio document; each keeps its array position as
    ``position_no``. ``limits`` is a name/value table, ``controls`` holds control times."""
    fields = [T.StructField(name, T.ArrayType(row)) for name, row in _ARRAYS.items()]
    fields += [T.StructField(name, T.LongType()) for name in _TIMES]
    fields.append(T.StructField("limits", T.MapType(T.StringType(), T.StringType())))
    document = spark.read.schema(T.StructType(fields)).option("multiLine", True).json(path)
    tables = {
        name: document.select(F.posexplode(name).alias("position_no", "r")).select(
            "position_no", "r.*"
        )
        for name in _ARRAYS
    }
    tables["limits"] = document.select(F.explode("limits").alias("name", "value"))
    tables["controls"] = document.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c.split("_")[0]).alias("control"), F.col(c).alias("timestamp_ns"))
                    for c in _TIMES
                ]
            )
        ).alias("c")
    ).select("c.*").filter("timestamp_ns IS NOT NULL")
    return tables


def read_results(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Published-result CSV with a header and an explicit schema."""
    return spark.read.schema(ddl).option("header", True).csv(path)
