"""Feed data-quality rules: diagnostics, halting and validated prefixes per symbol."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import book
from tickloom.operators.scan import DEFAULT_BLOCK_ROWS, block_of, block_scan
from tickloom.session import stage


@dataclass(frozen=True)
class ReplayOptions:
    """Which rules run. ``mode`` "full" checks the book after every event, "light" only its
    top and once at the end; both halt a symbol at its first error."""

    sequence: bool = True
    timestamps: bool = True
    book: bool = True
    snapshots: bool = True
    mode: str = "full"
    block_rows: int = DEFAULT_BLOCK_ROWS

    def __post_init__(self):
        if self.mode not in ("full", "light"):
            raise ValueError(f"unsupported replay validation mode: {self.mode}")


def _type_in(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def is_valid_side(side: str = "side") -> Column:
    return F.col(side).isin("Buy", "Sell")


def is_valid_resting_order() -> Column:
    """An order that may rest in a book."""
    return (
        (F.col("order_id") != 0)
        & (F.col("symbol_id") != 0)
        & is_valid_side()
        & (F.col("price_ticks") > 0)
        & (F.col("quantity") > 0)
    )


def field_rule() -> Column:
    """First violated rule that needs only the row itself, else null."""
    named = _type_in("Add", "Cancel", "Replace", "Execute")
    priced = _type_in("Add", "Replace", "Trade")
    sized = _type_in("Add", "Replace", "Execute", "Trade")
    payload = _type_in("Snapshot") & (F.col("order_id") != 0)
    price, quantity = F.col("price_ticks"), F.col("quantity")
    return (
        F.when(F.col("symbol_id") == 0, "invalid symbol id")
        .when(named & (F.col("order_id") == 0), "invalid order id")
        .when(_type_in("Add", "Replace") & ~is_valid_side(), "invalid side")
        .when(priced & (price <= 0), "invalid price")
        .when(~priced & (price < 0), "invalid negative price")
        .when(sized & (quantity <= 0), "invalid quantity")
        .when(~sized & (quantity < 0), "invalid negative quantity")
        .when(payload & ~is_valid_side(), "invalid snapshot side")
        .when(payload & (price <= 0), "invalid snapshot price")
        .when(payload & (quantity <= 0), "invalid snapshot quantity")
    )


def state_rule() -> Column:
    """First violated rule that compares the event with the resting order, else null."""
    live = F.col("prev_quantity") > 0
    return (
        F.when(_type_in("Add") & live, "duplicate order id")
        .when(_type_in("Cancel") & ~live, "unknown cancel order id")
        .when(_type_in("Replace") & ~live, "unknown replace order id")
        .when(_type_in("Execute") & ~live, "unknown execute order id")
        .when(
            _type_in("Cancel", "Execute") & (F.col("quantity") > F.col("prev_quantity")),
            "invalid quantity exceeds resting order quantity",
        )
        .when(_type_in("Snapshot") & live, "failed to apply Snapshot event")
    )


def annotate(events: DataFrame, options: ReplayOptions = ReplayOptions()) -> DataFrame:
    """Events with ``event_ordinal`` (0-based place in the symbol's log), ``epoch`` and
    ``reason``: the first violated rule of the row, judged as if all earlier rows were clean.

    That makes reasons exact up to and including the first bad row of a symbol, which is all
    that halting keeps. One scan yields predecessor values, ordinals and epochs together.
    """
    totals = {"event_ordinal": F.lit(1).cast("bigint")}
    if options.snapshots:
        totals["epoch"] = F.when(book.is_begin(), 1).otherwise(0).cast("bigint")
    scanned = block_scan(
        events,
        ["symbol_id"],
        ["event_index"],
        block_of("event_index", options.block_rows),
        previous={
            "_prev_sequence": F.col("sequence_number"),
            "_prev_timestamp": F.col("timestamp_ns"),
        },
        totals=totals,
    ).withColumn("event_ordinal", F.col("event_ordinal") - 1)
    if not options.snapshots:
        scanned = scanned.withColumn("epoch", F.lit(0).cast("bigint"))

    # The states keep the columns of their events; the events that touch no order join them as they
    # are. A row without a symbol or place has no state to be judged by.
    placed = F.col("symbol_id").isNotNull() & F.col("event_index").isNotNull()
    none = F.lit(None).cast("bigint")
    touched = book.order_states(scanned).select(
        *scanned.columns, F.when(placed, F.col("prev_quantity").cast("bigint")).alias("prev_quantity")
    )
    joined = touched.unionByName(
        scanned.filter(~F.coalesce(book.touches_order(), F.lit(False))).withColumn(
            "prev_quantity", none
        )
    )
    reasons = [field_rule(), state_rule()]
    if options.timestamps:
        back = F.col("timestamp_ns") < F.col("_prev_timestamp")
        reasons.insert(
            0,
            F.when(
                back,
                F.format_string(
                    "timestamp reversal: previous %d, received %d",
                    "_prev_timestamp",
                    "timestamp_ns",
                ),
            ),
        )
    if options.sequence:
        gap = F.col("sequence_number") != F.col("_prev_sequence") + 1
        reasons.insert(
            0,
            F.when(
                gap,
                F.format_string(
                    "sequence gap: expected %d, received %d",
                    F.col("_prev_sequence") + 1,
                    F.col("sequence_number"),
                ),
            ),
        )
    return joined.withColumn("reason", F.coalesce(*reasons)).drop(
        "_prev_sequence", "_prev_timestamp", "prev_quantity"
    )


def first_errors(annotated: DataFrame) -> DataFrame:
    """The first bad row per symbol. Plain aggregation: combined map-side, no symbol task."""
    return (
        annotated.filter(F.col("reason").isNotNull())
        .groupBy("symbol_id")
        .agg(
            *[
                F.min_by(c, "event_index").alias(c)
                for c in ("event_ordinal", "sequence_number", "reason")
            ],
            F.min("event_index").alias("event_index"),
        )
    )


def crossed_rows(quotes: DataFrame) -> DataFrame:
    """Rows of a quote timeline where the book is crossed or locked, with the reason."""
    return quotes.filter(F.col("bid_price") >= F.col("ask_price")).withColumn(
        "reason",
        F.format_string(
            "crossed book state: best bid %d >= best ask %d", "bid_price", "ask_price"
        ),
    )


def diagnostics(events: DataFrame, options: ReplayOptions = ReplayOptions()) -> DataFrame:
    """One row per halted symbol: where and why replay stopped.

    With ``options.book`` the book is walked up to the first rule violation and a crossed top
    found before it wins.
    """
    annotated = annotate(events, options)
    if options.book:
        annotated = stage(annotated, "annotated")
    errors = first_errors(annotated)
    if options.book:
        clean = _before(annotated, errors, inclusive=False)
        quotes = book.quote_timeline(
            clean.select(*events.columns),
            snapshots=options.snapshots,
            block_rows=min(options.block_rows, book.DEFAULT_WALK_ROWS),
        )
        crossed = crossed_rows(quotes).join(
            annotated.select("symbol_id", "event_index", "event_ordinal", "sequence_number"),
            ["symbol_id", "event_index"],
        )
        # A crossing event has changed the book already, so it only precedes rule violations.
        errors = first_errors(
            errors.select("symbol_id", "event_index", "event_ordinal", "sequence_number", "reason")
            .unionByName(
                crossed.select(
                    "symbol_id", "event_index", "event_ordinal", "sequence_number", "reason"
                )
            )
        )
    return errors.select(
        "symbol_id",
        F.col("event_ordinal").alias("event_index"),
        F.col("event_index").alias("log_index"),
        "sequence_number",
        F.lit("error").alias("severity"),
        "reason",
    )


def _before(rows: DataFrame, errors: DataFrame, inclusive: bool) -> DataFrame:
    halts = errors.select("symbol_id", F.col("event_index").alias("_halt"))
    joined = rows.join(halts, "symbol_id", "left")
    place = F.col("event_index") <= F.col("_halt") if inclusive else (
        F.col("event_index") < F.col("_halt")
    )
    return joined.filter(F.col("_halt").isNull() | place).drop("_halt")


def valid_prefix(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events before the first error of their symbol; other symbols go on."""
    halts = found.select("symbol_id", F.col("log_index").alias("event_index"))
    return _before(events, halts, inclusive=False)


def applied_events(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events that changed the book: the valid prefix, plus a halting event that crossed it."""
    halts = found.select(
        "symbol_id",
        (
            F.col("log_index")
            + F.when(F.col("reason").startswith("crossed book"), 1).otherwise(0)
        ).alias("event_index"),
    )
    return _before(events, halts, inclusive=False)


def diagnostics_by(found: DataFrame, column: str) -> DataFrame:
    """Diagnostic counts by ``reason`` or ``severity``; numbers in a reason are dropped."""
    label = F.regexp_extract(column, r"^[^:]*", 0)
    return found.groupBy(label.alias(column)).agg(F.count(F.lit(1)).alias("diagnostic_count"))


def symbol_summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """Per-symbol replay summary over all rows, also those after a halt."""
    counts = events.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("sequence_number", "event_index").alias("first_sequence"),
        F.max_by("sequence_number", "event_index").alias("last_sequence"),
        F.min_by("timestamp_ns", "event_index").alias("first_timestamp_ns"),
        F.max_by("timestamp_ns", "event_index").alias("last_timestamp_ns"),
    )
    halts = found.select(
        "symbol_id",
        F.col("event_index").alias("_processed"),
        F.col("reason").alias("error"),
    )
    return counts.join(halts, "symbol_id", "left").select(
        *counts.columns,
        F.coalesce("_processed", "event_count").alias("events_processed"),
        F.col("error").isNull().alias("sequence_valid"),
        F.when(F.col("error").isNull(), 0).otherwise(1).cast("bigint").alias(
            "diagnostic_error_count"
        ),
        F.lit(0).cast("bigint").alias("diagnostic_warning_count"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def log_summary(symbols: DataFrame) -> DataFrame:
    """Whole-log rollup of ``symbol_summary``."""
    return symbols.agg(
        F.sum("event_count").alias("total_events"),
        F.count(F.lit(1)).alias("symbol_count"),
        F.count_if("sequence_valid").alias("valid_symbols"),
        F.sum("diagnostic_error_count").alias("diagnostic_error_count"),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))
