"""Fingerprints and exact chained checksums, per key and in parallel."""

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import codec, fnv
from tickloom.operators import quality
from tickloom.operators.book import live_orders
from tickloom.operators.scan import DEFAULT_BLOCK_ROWS, block_of, block_scan
from tickloom.session import stage


def fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free table fingerprint: row count, xor and sum of row hashes. One aggregation."""
    keys = list(keys)
    row_hash = F.xxhash64(*df.columns)
    hashed = df.select(*keys, row_hash.alias("_h"))
    aggs = [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(20,0)")).alias("hash_sum"),
    ]
    return hashed.groupBy(*keys).agg(*aggs) if keys else hashed.agg(*aggs)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows in any order, by fingerprint."""
    columns = left.columns
    return fingerprint(left).first() == fingerprint(right.select(*columns)).first()


Layout = dict[str, tuple[Column, str]]


def _stream(rows: pa.Table, order: Sequence[str], widths: dict[str, str]) -> np.ndarray:
    """Payloads of a block in order, as one byte array."""
    ordered = rows.sort_by([(c, "ascending") for c in order])
    if widths:
        records = np.empty(ordered.num_rows, dtype=list(widths.items()))
        for name in widths:
            records[name] = ordered.column(name).to_numpy()
        return records.view(np.uint8)
    parts = [p for p in ordered.column("_payload").to_pylist() if p]
    return np.frombuffer(b"".join(parts), dtype=np.uint8)


class _Chain:
    """Block decomposition of one chained table; see ``chained_checksum``."""

    def __init__(self, rows, keys, order, payload, block, kept=(), seed=fnv.OFFSET):
        self.keys, self.order, self.seed = list(keys), list(order), seed
        fields = payload if isinstance(payload, dict) else {}
        self.widths = {f"_f_{name}": width for name, (_, width) in fields.items()}
        data = [col.cast("bigint").alias(f"_f_{name}") for name, (col, _) in fields.items()]
        self.rows = stage(
            rows.select(
                *self.keys, *self.order, *kept,
                *(data or [payload.alias("_payload")]), block.alias("_block"),
            ),
            "chain",
        )
        self.group = [*self.keys, "_block"]
        self.short, self.long = None, self.rows
        if self.keys:
            block = F.col("_block")
            several = F.coalesce(F.min(block) < F.max(block), F.lit(False))
            # A null block is one of its own.
            several = several | ((F.count(block) > 0) & (F.count_if(block.isNull()) > 0))
            spans = stage(
                self.rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in self.keys]).agg(
                    several.alias("_cut")
                ),
                "chain-spans",
            )
            same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in self.keys]
            cut = lambda kind: self.rows.join(spans.filter(kind), same, "left_semi")
            kinds = {r[0] for r in spans.select("_cut").distinct().collect()}
            self.short = cut("NOT _cut") if False in kinds else None
            self.long = cut("_cut") if True in kinds else None
        ddl = ", ".join(
            f"`{k}` {self.rows.schema[k].dataType.simpleString()}" for k in self.keys
        )
        self.prefix = f"{ddl}, " if ddl else ""

    def by_key(self, df: DataFrame):
        return df.groupBy(*self.keys)

    def block_parts(self) -> DataFrame:
        """Bytes and affine part of every block.

        A key of one block starts at the seed, so its block needs no map of low bytes.
        """
        group, order, widths, seed = self.group, self.order, self.widths, self.seed
        found = f"{self.prefix}_block BIGINT, _bytes BIGINT, _part BINARY"

        def low_map(table: pa.Table) -> pa.Table:
            data = _stream(table, order, widths)
            mapped = pa.array([fnv.low_byte_map(data).tobytes()], pa.binary())
            return table.slice(0, 1).select(group).append_column("_map", mapped)

        def chain_maps(table: pa.Table) -> pa.Table:
            ordered = table.sort_by("_block")
            low = seed & 0xFF
            lows = []
            for mapped in ordered.column("_map").to_pylist():
                lows.append(low)
                low = mapped[low]
            return ordered.select(group).append_column("_low", pa.array(lows, pa.int64()))

        def part_of(table: pa.Table, low: int) -> pa.Table:
            data = _stream(table, order, widths)
            part = fnv.affine_part(data, low)
            return (
                table.slice(0, 1)
                .select(group)
                .append_column("_bytes", pa.array([int(data.size)], pa.int64()))
                .append_column("_part", pa.array([part.to_bytes(8, "little")], pa.binary()))
            )

        def affine(left: pa.Table, right: pa.Table) -> pa.Table:
            return part_of(left, right.column("_low")[0].as_py())

        def alone(table: pa.Table) -> pa.Table:
            return part_of(table, seed & 0xFF)

        short = None
        if self.short is not None:
            short = self.short.groupBy(*group).applyInArrow(alone, schema=found)
            if self.long is None:
                return short
        rows = self.rows if self.long is None else self.long
        maps = rows.groupBy(*group).applyInArrow(
            low_map, schema=f"{self.prefix}_block BIGINT, _map BINARY"
        )
        starts = stage(
            self.by_key(maps).applyInArrow(
                chain_maps, schema=f"{self.prefix}_block BIGINT, _low BIGINT"
            ),
            "chain-starts",
        )
        parts = rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(
            affine, schema=found
        )
        return parts if short is None else short.unionByName(parts)


def _chained(table: pa.Table, seed: int = fnv.OFFSET) -> tuple[pa.Table, list[int], int]:
    """Blocks of one key in order, their start states and the final state."""
    ordered = table.sort_by("_block")
    state, starts = seed, []
    pairs = zip(
        ordered.column("_bytes").to_pylist(), ordered.column("_part").to_pylist(), strict=True
    )
    for length, part in pairs:
        starts.append(state)
        state = fnv.advance(state, length, int.from_bytes(part, "little"))
    return ordered, starts, state


def chained_checksum(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Column | Layout,
    block: Column,
    name: str = "checksum",
) -> DataFrame:
    """Exact FNV-1a over the payloads of each key in ``order``, as DECIMAL(20,0).

    A payload is a binary column, or a layout of fixed-width fields packed in the task.

    The chain is split into blocks: pass one maps start low byte to end low byte, the maps of
    a key (256 bytes per block) are chained, pass two adds each block's affine part for its
    now known start. No task sees more than one block of rows.
    """
    chain = _Chain(rows, keys, order, payload, block)

    def finish(table: pa.Table) -> pa.Table:
        ordered, _, state = _chained(table)
        value = pa.array([Decimal(state)], pa.decimal128(20, 0))
        return ordered.slice(0, 1).select(chain_keys).append_column(name, value)

    chain_keys = chain.keys
    return chain.by_key(chain.block_parts()).applyInArrow(
        finish, schema=f"{chain.prefix}`{name}` DECIMAL(20,0)"
    )


def running_checksum(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Column,
    block: Column,
    name: str = "checksum",
    seed: int = fnv.OFFSET,
) -> DataFrame:
    """Every row with the exact chained checksum up to and including it, starting at ``seed``."""
    kept = [c for c in rows.columns if c not in {*keys, *order}]
    chain = _Chain(rows, keys, order, payload, block, kept, seed)
    columns = rows.columns
    sort_keys = [(c, "ascending") for c in chain.order]
    group = chain.group

    def start_states(table: pa.Table) -> pa.Table:
        ordered, starts, _ = _chained(table, seed)
        states = pa.array([s.to_bytes(8, "little") for s in starts], pa.binary())
        return ordered.select(group).append_column("_start", states)

    starts = stage(
        chain.by_key(chain.block_parts()).applyInArrow(
            start_states, schema=f"{chain.prefix}_block BIGINT, _start BINARY"
        ),
        "chain-states",
    )

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = left.sort_by(sort_keys)
        parts = [p or b"" for p in ordered.column("_payload").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        start = int.from_bytes(right.column("_start")[0].as_py(), "little")
        states = [Decimal(int(s)) for s in fnv.running(data, ends, start)]
        return ordered.select(columns).append_column(
            name, pa.array(states, pa.decimal128(20, 0))
        )

    out = rows.schema.add(name, "decimal(20,0)")
    return (
        chain.rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(emit, schema=out)
    )


def event_checksums(events: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact event-log checksum per symbol."""
    return chained_checksum(
        events,
        ["symbol_id"],
        ["event_index"],
        codec.event_layout(),
        block_of("event_index", block_rows),
        "event_log_checksum",
    )


def activity_checksums(events: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact checksum of the Execute and Trade rows; symbols without any keep the offset."""
    active = events.filter(F.col("event_type").isin("Execute", "Trade"))
    found = chained_checksum(
        active,
        ["symbol_id"],
        ["event_index"],
        codec.event_layout(),
        block_of("event_index", block_rows),
        "activity_checksum",
    )
    return _with_empty(events.select("symbol_id").distinct(), found, "activity_checksum")


def diagnostic_checksums(
    symbols: DataFrame, found: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Exact checksum of the diagnostics per symbol of ``symbols``."""
    sums = chained_checksum(
        found,
        ["symbol_id"],
        ["event_index"],
        codec.diagnostic_payload(),
        block_of("event_index", block_rows),
        "diagnostics_checksum",
    )
    return _with_empty(symbols, sums, "diagnostics_checksum")


def _with_empty(symbols: DataFrame, sums: DataFrame, name: str) -> DataFrame:
    offset = F.lit(str(fnv.OFFSET)).cast("decimal(20,0)")
    return symbols.join(sums, "symbol_id", "left").select(
        "symbol_id", F.coalesce(name, offset).alias(name)
    )


def book_checksums(
    orders: DataFrame, symbols: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Exact book checksum per symbol from live orders (``book.live_orders``).

    The byte stream is: symbol; then per side its code, level count and, best level first,
    price, total and order count followed by the orders in queue order. Header rows sort
    before their orders, so the stream is one more chained table.
    """
    # Both are read several times, so they are computed once.
    orders, symbols = stage(orders, "book-orders"), stage(symbols, "book-symbols")
    levels = orders.groupBy("symbol_id", "side", "price_ticks").agg(
        F.sum("quantity").alias("total"), F.count(F.lit(1)).alias("size")
    )
    rank = F.when(F.col("side") == "Buy", -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    side_no = F.when(F.col("side") == "Buy", 1).otherwise(2)
    sides = symbols.select(
        "symbol_id", F.explode(F.array(F.lit("Buy"), F.lit("Sell"))).alias("side")
    ).join(
        levels.groupBy("symbol_id", "side").agg(F.count(F.lit(1)).alias("n")),
        ["symbol_id", "side"],
        "left",
    )
    low = F.lit(-(2**62)).cast("bigint")

    def row(df, place_side, place_level, place_order, *parts):
        return df.select(
            "symbol_id",
            place_side.cast("int").alias("p1"),
            place_level.cast("bigint").alias("p2"),
            place_order.cast("bigint").alias("p3"),
            codec.payload(*parts).alias("bytes"),
        )

    width8 = lambda c: codec.le_hex(c, 8)
    stream = (
        row(symbols, F.lit(0), low, low, codec.le_hex(F.col("symbol_id"), 4))
        .unionByName(
            row(
                sides, side_no, low, low,
                codec.le_hex(codec.code_of(F.col("side"), schema.SIDES), 1),
                width8(F.coalesce("n", F.lit(0))),
            )
        )
        .unionByName(
            row(
                levels, side_no, rank, low,
                width8(F.col("price_ticks")), width8(F.col("total")), width8(F.col("size")),
            )
        )
        .unionByName(
            row(
                orders, side_no, rank, F.col("priority_index"),
                width8(F.col("order_id")), width8(F.lit(0)), codec.le_hex(F.col("symbol_id"), 4),
                width8(F.col("quantity")), width8(F.col("timestamp_ns")),
                width8(F.col("sequence_number")),
            )
        )
    )
    # Blocks follow the stream order and gather small levels; one big level is sliced.
    sliced = stage(
        stream.withColumn(
            "slice", F.when(F.col("p3") > low, block_of("p3", block_rows)).otherwise(F.lit(-1))
        ),
        "book-stream",
    )
    place = ["p1", "p2", "slice"]
    sizes = sliced.groupBy("symbol_id", *place).agg(F.count(F.lit(1)).alias("_n"))
    placed = block_scan(
        sizes, ["symbol_id"], place, F.col("p1").cast("bigint"), totals={"_upto": F.col("_n")}
    ).withColumn("_b", block_of("_upto", block_rows))
    numbered = sliced.join(placed.drop("_n", "_upto"), ["symbol_id", *place])
    return chained_checksum(
        numbered,
        ["symbol_id"],
        ["p1", "p2", "p3"],
        F.col("bytes"),
        F.col("_b"),
        "final_book_checksum",
    )


def combined_book_checksum(summaries: DataFrame) -> DataFrame:
    """Checksum over all symbols' book checksums, in symbol order."""
    rows = summaries.select(
        "symbol_id",
        codec.payload(
            codec.le_hex(F.col("symbol_id"), 4),
            codec.le_hex_unsigned(F.col("final_book_checksum")),
        ).alias("bytes"),
    )
    count = rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).cast("bigint").alias("symbol_id"),
        codec.payload(codec.le_hex(F.col("n"), 8)).alias("bytes"),
    )
    return chained_checksum(
        rows.unionByName(count),
        [],
        ["symbol_id"],
        F.col("bytes"),
        block_of("symbol_id", DEFAULT_BLOCK_ROWS),
        "combined_book_checksum",
    )


SUMMARY_CHECKSUMS = (
    "event_log_checksum", "final_book_checksum", "activity_checksum", "diagnostics_checksum"
)


def replay_summary(
    events: DataFrame, found: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS,
    snapshots: bool = False,
) -> DataFrame:
    """``symbol_summary`` with its four checksums.

    The log checksum covers all rows of a symbol; book and activity only the rows applied
    before its halt. A symbol that halts on its first row has an empty book.
    """
    # Events and diagnostics are read by every part, so they are computed once.
    events, found = stage(events, "summary-events"), stage(found, "summary-found")
    symbols = stage(events.select("symbol_id").distinct(), "summary-symbols")
    applied = stage(quality.applied_events(events, found), "summary-applied")
    orders = live_orders(applied, snapshots)
    parts = (
        event_checksums(events, block_rows),
        book_checksums(orders, symbols, block_rows),
        _with_empty(symbols, activity_checksums(applied, block_rows), "activity_checksum"),
        diagnostic_checksums(symbols, found, block_rows),
    )
    summary = quality.symbol_summary(events, found)
    for part in parts:
        summary = summary.join(part, "symbol_id")
    return summary


def replay_aggregate(summaries: DataFrame) -> DataFrame:
    """One row over the symbols of ``replay_summary``: totals and both checksums."""
    one = F.lit(0).alias("_one")
    combined = combined_book_checksum(summaries)
    totals = summaries.agg(
        F.sum("event_count").alias("total_events"), F.count(F.lit(1)).alias("symbol_count")
    )
    return (
        totals.select("*", one)
        .join(combined.select("*", one), "_one")
        .join(aggregate_checksum(summaries, combined).select("*", one), "_one")
        .drop("_one")
    )


def aggregate_checksum(summaries: DataFrame, combined: DataFrame) -> DataFrame:
    """Checksum over the whole set of symbol summaries (columns as in ``symbol_summary`` plus
    the four per-symbol checksums)."""
    wide = lambda c: codec.le_hex(F.col(c), 8)
    big = lambda c: codec.le_hex_unsigned(F.col(c))
    rows = summaries.select(
        "symbol_id",
        codec.payload(
            codec.le_hex(F.col("symbol_id"), 4),
            wide("event_count"),
            wide("first_sequence"),
            wide("last_sequence"),
            wide("first_timestamp_ns"),
            wide("last_timestamp_ns"),
            codec.le_hex(F.col("sequence_valid").cast("int"), 1),
            big("event_log_checksum"),
            big("final_book_checksum"),
            big("activity_checksum"),
            big("diagnostics_checksum"),
            codec.le_hex(
                F.col("diagnostic_error_count") + F.col("diagnostic_warning_count"), 8
            ),
            wide("diagnostic_error_count"),
            wide("diagnostic_warning_count"),
            codec.text_hex(F.col("error")),
        ).alias("bytes"),
    )
    head = (
        summaries.agg(F.sum("event_count").alias("total"), F.count(F.lit(1)).alias("n"))
        .withColumn("_one", F.lit(0))
        .join(combined.withColumn("_one", F.lit(0)), "_one")
        .select(
            F.lit(-1).cast("bigint").alias("symbol_id"),
            codec.payload(wide("total"), wide("n"), big("combined_book_checksum")).alias("bytes"),
        )
    )
    tail = head.select(
        F.lit(2**62).cast("bigint").alias("symbol_id"),
        codec.payload(codec.text_hex(F.lit(""))).alias("bytes"),
    )
    return chained_checksum(
        rows.unionByName(head).unionByName(tail),
        [],
        ["symbol_id"],
        F.col("bytes"),
        block_of("symbol_id", DEFAULT_BLOCK_ROWS),
        "aggregate_checksum",
    )


def budget_checksum(budgets: dict[str, int]) -> int:
    """Checksum of a latency-budget configuration (seven stages; driver side)."""
    data = b"".join(
        code.to_bytes(1, "little") + budgets.get(stage_name, 0).to_bytes(8, "little")
        for stage_name, code in schema.LATENCY_STAGES.items()
    )
    return fnv.fnv1a(data)


def portfolio_checksum(positions: DataFrame, limits, marked: DataFrame) -> DataFrame:
    """Checksum of a portfolio snapshot: limits, realised PnL and every position."""
    known = marked.select("symbol_id", F.lit(1).alias("_has"))
    rows = positions.join(known, "symbol_id", "left").select(
        "symbol_id",
        codec.payload(
            codec.le_hex(F.col("symbol_id"), 4),
            codec.le_hex(F.col("quantity"), 8),
            codec.le_hex(F.col("average_cost_ticks"), 8),
            codec.le_hex(F.when(F.col("_has") == 1, F.col("mark_ticks")).otherwise(0), 8),
            codec.le_hex(F.coalesce("_has", F.lit(0)), 1),
        ).alias("bytes"),
    )
    fixed = [
        limits.max_gross_exposure_ticks,
        limits.max_net_exposure_ticks,
        limits.max_symbol_concentration_bps,
        limits.max_loss_ticks,
    ]
    head = positions.agg(
        F.coalesce(F.sum("realised_ticks"), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("n")
    ).select(
        F.lit(-1).cast("bigint").alias("symbol_id"),
        codec.payload(
            *[codec.le_hex(F.lit(v), 8) for v in fixed],
            codec.le_hex(F.col("r"), 8),
            codec.le_hex(F.col("n"), 8),
        ).alias("bytes"),
    )
    return chained_checksum(
        rows.unionByName(head),
        [],
        ["symbol_id"],
        F.col("bytes"),
        block_of("symbol_id", DEFAULT_BLOCK_ROWS),
        "checksum",
    )
