"""Order books from event streams: order states, ladders, queues, best quotes, probes.

Everything works on indexed events (``schema.INDEXED_EVENT``). Books are kept per
``symbol_id`` and per epoch; an epoch starts at every Snapshot begin row, which clears the
book. Within an epoch, a *life* of an order starts at each Add, Replace or Snapshot payload
row, and executions and partial cancels reduce it.
"""

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.operators.scan import (
    DEFAULT_BLOCK_ROWS,
    block_of,
    block_scan,
    group_starts,
    whole_div,
    whole_groups,
)
from tickloom.session import stage

BOOK_EVENTS = ("Add", "Cancel", "Replace", "Execute", "Snapshot")


def is_begin() -> Column:
    """Snapshot rows that clear the book."""
    begins = F.col("flags").bitwiseAND(schema.FLAG_SNAPSHOT_BEGIN) != 0
    return (F.col("event_type") == "Snapshot") & begins


def touches_order() -> Column:
    """Rows that add, change or remove an order."""
    return F.col("event_type").isin(*BOOK_EVENTS) & (F.col("order_id") != 0)


def with_epoch(
    events: DataFrame, snapshots: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Add ``epoch``: the number of snapshot begin rows so far in the symbol's log.

    Pass ``snapshots=False`` for logs known to hold no Snapshot rows; no scan is needed then.
    """
    if not snapshots:
        return events.withColumn("epoch", F.lit(0).cast("bigint"))
    return block_scan(
        events,
        ["symbol_id"],
        ["event_index"],
        block_of("event_index", block_rows),
        totals={"epoch": F.when(is_begin(), 1).otherwise(0).cast("bigint")},
    )


def order_states(events: DataFrame) -> DataFrame:
    """State of the touched order before and after each book event.

    Adds ``prev_quantity``/``prev_price`` (0/null when the order was not live),
    ``rest_quantity``/``rest_price``/``rest_side`` after the event, ``priority_index`` (event
    that gave the order its queue place) and the set time of that place. Input needs
    ``epoch``. Rows without an order (markers, trades, heartbeats) are left out, so id 0 never
    forms a group. The windows are keyed by order, so a busy symbol spreads over all tasks.
    """
    touching = events.filter(touches_order())
    order = Window.partitionBy("symbol_id", "epoch", "order_id").orderBy("event_index")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, quantity = F.col("event_type"), F.col("quantity")
    sets = kind.isin("Add", "Replace", "Snapshot")
    opens = kind.isin("Add", "Snapshot")
    cut = F.when((kind == "Execute") | ((kind == "Cancel") & (quantity > 0)), quantity).otherwise(0)
    kill = (kind == "Cancel") & (quantity <= 0)
    latest = lambda condition, value: F.last(
        F.when(condition, value), ignorenulls=True
    ).over(upto)
    # One sort serves everything: reductions since the head of the life are a difference of
    # running sums, and a full cancel counts when it came after the head.
    cuts = touching.withColumn("_cut", F.sum(cut).over(upto))
    heads = cuts.withColumns(
        {
            "rest_side": latest(opens, F.col("side")),
            "rest_price": latest(sets, F.col("price_ticks")),
            "priority_index": latest(sets, F.col("event_index")),
            "set_timestamp_ns": latest(sets, F.col("timestamp_ns")),
            "set_sequence": latest(sets, F.col("sequence_number")),
            "_head": latest(sets, quantity + F.col("_cut")),
            "_killed": latest(kill, F.col("event_index")),
        }
    )
    gone = F.col("_head").isNull() | F.coalesce(
        F.col("_killed") > F.col("priority_index"), F.lit(False)
    )
    states = heads.withColumn(
        "rest_quantity",
        F.when(gone, 0).otherwise(F.greatest(F.col("_head") - F.col("_cut"), F.lit(0)))
        .cast("bigint"),
    )
    return states.withColumns(
        {
            "prev_quantity": F.coalesce(F.lag("rest_quantity").over(order), F.lit(0)),
            "prev_price": F.lag("rest_price").over(order),
            "prev_side": F.lag("rest_side").over(order),
        }
    ).drop("_cut", "_head", "_killed")


def live_orders(events: DataFrame, snapshots: bool = True) -> DataFrame:
    """Orders resting at the end of the log: one row per live order with its queue key.

    ``events`` is the raw log; with snapshots only the last epoch of a symbol counts.
    """
    log = with_epoch(events, snapshots)
    states = order_states(log)
    # The last row of an order comes from the sort the states already have.
    order = Window.partitionBy("symbol_id", "epoch", "order_id").orderBy("event_index")
    last = states.withColumn("_next", F.lead("event_index").over(order)).filter("_next IS NULL")
    if snapshots:
        current = log.groupBy("symbol_id").agg(F.max("epoch").alias("epoch"))
        last = last.join(current, ["symbol_id", "epoch"], "left_semi")
    return last.filter(F.col("rest_quantity") > 0).select(
        "symbol_id",
        F.col("rest_side").alias("side"),
        F.col("rest_price").alias("price_ticks"),
        "order_id",
        F.col("rest_quantity").alias("quantity"),
        F.col("set_timestamp_ns").alias("timestamp_ns"),
        F.col("set_sequence").alias("sequence_number"),
        "priority_index",
    )


def l2_levels(orders: DataFrame) -> DataFrame:
    """Aggregate live orders to price levels."""
    return orders.groupBy("symbol_id", "side", "price_ticks").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_count")
    )


def top_levels(levels: DataFrame, depth: int, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Best ``depth`` levels per side, numbered from 1; bids descend, asks ascend.

    The rank filter lets Spark keep only ``depth`` rows per group before the shuffle.
    """
    best_first = F.when(F.col("side") == "Buy", -F.col("price_ticks")).otherwise(
        F.col("price_ticks")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("_key"))
    return (
        levels.withColumn("_key", best_first)
        .withColumn("level", rank)
        .filter(F.col("level") <= depth)
        .drop("_key")
    )


def ladder_arrays(levels: DataFrame, depth: int, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Top levels as two arrays of (price_ticks, quantity), best first."""
    def side(name: str):
        level = F.struct("level", "price_ticks", "quantity")
        picked = F.collect_list(F.when(F.col("side") == name, level))
        return F.transform(
            F.array_sort(picked), lambda x: F.struct(x.price_ticks, x.quantity)
        )

    return top_levels(levels, depth, keys).groupBy(*keys).agg(
        side("Buy").alias("bids"), side("Sell").alias("asks")
    )


def best_quotes(levels: DataFrame, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Best bid and ask with their quantities per key at the end of the log."""
    bid = F.when(F.col("side") == "Buy", F.col("price_ticks"))
    ask = F.when(F.col("side") == "Sell", F.col("price_ticks"))
    return levels.groupBy(*keys).agg(
        F.max(bid).alias("bid_price"),
        F.max_by(F.when(F.col("side") == "Buy", F.col("quantity")), bid).alias("bid_quantity"),
        F.min(ask).alias("ask_price"),
        F.min_by(F.when(F.col("side") == "Sell", F.col("quantity")), ask).alias("ask_quantity"),
    )


def fifo_queue(orders: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Queue rank of every live order within its price level (1 = first to trade)."""
    return block_scan(
        orders,
        ["symbol_id", "side", "price_ticks"],
        ["priority_index"],
        block_of("priority_index", block_rows),
        totals={"fifo_rank": F.lit(1).cast("bigint")},
    )


def best_orders(queue: DataFrame) -> DataFrame:
    """First order in the queue of the best level per symbol and side."""
    closeness = F.when(F.col("side") == "Buy", F.col("price_ticks")).otherwise(
        -F.col("price_ticks")
    )
    return (
        queue.filter(F.col("fifo_rank") == 1)
        .groupBy("symbol_id", "side")
        .agg(
            F.max_by("order_id", closeness).alias("order_id"),
            F.max_by("price_ticks", closeness).alias("price_ticks"),
            F.max_by("quantity", closeness).alias("quantity"),
        )
    )


def order_as_of(
    events: DataFrame, at: int, column: str = "event_index", snapshots: bool = True
) -> DataFrame:
    """Orders resting right after position (or, by ``column``, time) ``at`` of each symbol."""
    return live_orders(events.filter(F.col(column) <= at), snapshots)


def level_deltas(states: DataFrame) -> DataFrame:
    """At most two level changes per event: quantity leaving the old level, entering the new.

    One row per event that changes a level, as (side, old price, -quantity, new price,
    +quantity); unchanged price gives one net change.
    """
    same = (F.col("prev_price") == F.col("rest_price")) & (
        F.col("prev_side") == F.col("rest_side")
    )
    was_live = F.col("prev_quantity") > 0
    return states.select(
        "symbol_id",
        "epoch",
        "event_index",
        F.explode(
            F.filter(
                F.array(
                    F.struct(
                        F.when(was_live & ~same, F.col("prev_side")).alias("side"),
                        F.col("prev_price").alias("price_ticks"),
                        (-F.col("prev_quantity")).alias("delta"),
                    ),
                    F.struct(
                        F.col("rest_side").alias("side"),
                        F.col("rest_price").alias("price_ticks"),
                        F.when(was_live & same, F.col("rest_quantity") - F.col("prev_quantity"))
                        .otherwise(F.col("rest_quantity"))
                        .alias("delta"),
                    ),
                ),
                lambda x: x.side.isNotNull() & (x.delta != 0),
            )
        ).alias("d"),
    ).select("symbol_id", "epoch", "event_index", "d.*")


# --- block-parallel book walk -----------------------------------------------------------

# Row kinds inside a block, in the order they apply at equal positions. Buy rows are even.
_CLEAR, _BUY, _SELL, _PROBE_BUY, _PROBE_SELL = 0, 2, 3, 4, 5

DEFAULT_WALK_ROWS = 50_000


class _Side:
    """Quantities per price with the best price on a lazily cleaned heap."""

    __slots__ = ("heap", "quantity", "sign")

    def __init__(self, sign: int):
        self.sign = sign
        self.clear()

    def clear(self) -> None:
        self.quantity: dict[int, int] = {}
        self.heap: list[int] = []

    def change(self, price: int, delta: int) -> None:
        held = self.quantity.get(price)
        if held is None:
            self.quantity[price] = delta
            heapq.heappush(self.heap, self.sign * price)
        elif held + delta == 0:
            del self.quantity[price]
        else:
            self.quantity[price] = held + delta

    def best(self) -> tuple[int | None, int | None]:
        heap, quantity = self.heap, self.quantity
        while heap:
            price = self.sign * heap[0]
            held = quantity.get(price)
            if held is not None:
                return price, held
            heapq.heappop(heap)
        return None, None

    def ladder(self, depth: int | None = None) -> list[tuple[int, int]]:
        if depth is None:
            prices = sorted(self.quantity, reverse=self.sign < 0)
        elif self.sign < 0:
            prices = heapq.nlargest(depth, self.quantity)
        else:
            prices = heapq.nsmallest(depth, self.quantity)
        return [(p, self.quantity[p]) for p in prices]


class _Ranked:
    """One side of a block's book as Fenwick trees of quantity and cost over its price ranks.

    The prices of a block are known before it is walked and ranked from the best one. A sweep is a
    descent for the quantity and a bisection for the limit, however many levels it crosses. Levels
    that stand before the first probe are built in one pass.
    """

    __slots__ = ("built", "cost", "held", "keys", "quantity", "rank", "sign", "top")

    def __init__(self, sign: int, prices: np.ndarray):
        self.sign = sign
        self.keys = np.unique(sign * prices).tolist()
        self.rank = {sign * key: n for n, key in enumerate(self.keys, 1)}
        self.top = (1 << len(self.keys).bit_length()) >> 1
        self.clear()

    def clear(self) -> None:
        self.held = [0] * (len(self.keys) + 1)
        self.built = False

    def change(self, price: int, delta: int) -> None:
        n = self.rank[price]
        self.held[n] += delta
        if self.built:
            worth, quantity, cost = delta * price, self.quantity, self.cost
            while n < len(quantity):
                quantity[n] += delta
                cost[n] += worth
                n += n & -n

    def _build(self) -> None:
        self.quantity = quantity = self.held.copy()
        self.cost = cost = [0, *[
            held * key * self.sign for held, key in zip(self.held[1:], self.keys, strict=True)
        ]]
        for n in range(1, len(quantity)):
            above = n + (n & -n)
            if above < len(quantity):
                quantity[above] += quantity[n]
                cost[above] += cost[n]
        self.built = True

    def _within(self, wanted: int) -> tuple[int, int, int]:
        """Last rank up to which all levels together hold at most ``wanted``; their sums."""
        if not self.built:
            self._build()
        at = filled = worth = 0
        quantity, step = self.quantity, self.top
        while step:
            ahead = at + step
            if ahead < len(quantity) and filled + quantity[ahead] <= wanted:
                at = ahead
                filled += quantity[ahead]
                worth += self.cost[ahead]
            step >>= 1
        return at, filled, worth

    def best(self) -> tuple[int | None, int | None]:
        at, _, _ = self._within(0)
        if at == len(self.keys):
            return None, None
        return self.sign * self.keys[at], self.held[at + 1]

    def ladder(self, depth: int) -> list[tuple[int, int]]:
        levels = zip(self.keys, self.held[1:], strict=True)
        return list(islice(((self.sign * k, held) for k, held in levels if held), depth))

    def sweep(self, limit: int | None, wanted: int) -> tuple[int, int]:
        """Quantity and cost available within ``limit`` for ``wanted``, best prices first."""
        wanted = max(wanted, 0)
        at, filled, worth = self._within(wanted)
        reach = len(self.keys) if limit is None else bisect_right(self.keys, self.sign * limit)
        if at < reach:
            rest = wanted - filled
            return wanted, worth + rest * self.sign * self.keys[at]
        filled = worth = 0
        while reach:
            filled += self.quantity[reach]
            worth += self.cost[reach]
            reach -= reach & -reach
        return filled, worth


PROBE_RESULT = (
    "probe_id BIGINT, event_index BIGINT, bid_price BIGINT, bid_quantity BIGINT, "
    "ask_price BIGINT, ask_quantity BIGINT"
)


def walk_books(
    deltas: DataFrame,
    probes: DataFrame,
    *,
    keys: Sequence[str] = ("symbol_id",),
    clears: DataFrame | None = None,
    depth: int = 0,
    sweep: bool = False,
    block_rows: int = DEFAULT_WALK_ROWS,
) -> DataFrame:
    """Read the book at every probe position, in parallel blocks of each key's log.

    deltas: keys, epoch, event_index, side, price_ticks, delta
    probes: keys, event_index, probe_id [, side, price_ticks, quantity when ``sweep``];
            a probe sees all deltas at or before its position
    clears: keys, event_index of rows that empty the book (snapshot begin)

    The quantity of each level at the start of each block comes from per-block sums (combined
    before the shuffle), so every block is independent and one busy key is as parallel as
    many. Carried rows are live levels x blocks with a probe, however far apart those are: keep
    blocks longer than the book. Output: keys, probe_id, event_index and the best quotes;
    ``depth`` adds ladders, ``sweep`` adds fill_quantity and fill_cost of a limit (or, with a null price, market)
    order against the opposite side.
    """
    keys = list(keys)
    schema_of = {f.name: f.dataType for f in deltas.schema.fields}
    block = block_of("event_index", block_rows)
    by_block = deltas.groupBy(*keys, "epoch", "side", "price_ticks", block.alias("_block")).agg(
        F.sum("delta").alias("_sum"), F.max("event_index").alias("_seen")
    )
    walked = probes.select(*keys, block.alias("_block")).distinct()
    # Probed blocks are numbered per key, so that gaps between positions cost nothing.
    numbered = (
        walked.withColumn("_probed", F.lit(1))
        .unionByName(
            deltas.select(*keys, block.alias("_block")).distinct().withColumn("_probed", F.lit(0))
        )
        .groupBy(*keys, "_block")
        .agg(F.max("_probed").alias("_probed"))
        .withColumn("_no", F.sum("_probed").over(Window.partitionBy(*keys).orderBy("_block")))
    )
    level = Window.partitionBy(*keys, "epoch", "side", "price_ticks").orderBy("_block")
    held = by_block.join(numbered.drop("_probed"), [*keys, "_block"]).select(
        *keys,
        "epoch",
        "side",
        "price_ticks",
        F.sum("_sum")
        .over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("_held"),
        (F.col("_no") + 1).alias("_from"),
        F.lead("_no").over(level).alias("_until"),
    ).filter(F.col("_held") != 0)
    span = numbered.groupBy(*keys).agg(F.max("_no").alias("_last"))
    # A level is carried into every later probed block until its next change, within its epoch.
    carry = held.join(span, keys).select(
        *keys,
        "epoch",
        "side",
        "price_ticks",
        "_held",
        F.explode(
            F.when(
                F.coalesce("_until", "_last") >= F.col("_from"),
                F.sequence(F.col("_from"), F.coalesce("_until", "_last")),
            )
        ).alias("_no"),
    ).join(numbered.filter("_probed = 1").drop("_probed"), [*keys, "_no"]).drop("_no")
    if clears is not None:
        started = (
            clears.groupBy(*keys, block.alias("_block"))
            .agg(F.max("epoch").alias("_epoch"))
        )
        starts = block_scan(
            walked.join(started, [*keys, "_block"], "full_outer"),
            keys,
            ["_block"],
            F.floor(F.col("_block") / 4096).alias("_blocks"),
            peaks={"_now": F.col("_epoch")},
        ).select(*keys, "_block", F.coalesce("_now", F.lit(0)).alias("epoch"))
        carry = carry.join(starts, [*keys, "_block", "epoch"], "left_semi")

    def shaped(df: DataFrame, kind, position, price, amount, probe):
        return df.select(
            *keys,
            (F.col("_block") if "_block" in df.columns else block).alias("_block"),
            position.alias("event_index"),
            kind.cast("tinyint").alias("_kind"),
            price.alias("price_ticks"),
            amount.alias("_amount"),
            probe.alias("probe_id"),
        )

    zero = F.lit(0).cast("bigint")
    change = F.when(F.col("side") == "Buy", _BUY).otherwise(_SELL)
    asked = (
        F.when(F.col("side") == "Sell", _PROBE_SELL).otherwise(_PROBE_BUY)
        if sweep
        else F.lit(_PROBE_BUY)
    )
    parts = [
        shaped(
            carry, change, F.lit(-1).cast("bigint"), F.col("price_ticks"), F.col("_held"), zero
        ),
        shaped(
            deltas, change, F.col("event_index"), F.col("price_ticks"), F.col("delta"), zero
        ),
        shaped(
            probes,
            asked,
            F.col("event_index"),
            F.col("price_ticks") if sweep else zero,
            F.col("quantity") if sweep else zero,
            F.col("probe_id"),
        ),
    ]
    if clears is not None:
        parts.append(shaped(clears, F.lit(_CLEAR), F.col("event_index"), zero, zero, zero))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.repartition(*keys, "_block").sortWithinPartitions(
        *keys, "_block", "event_index", "_kind"
    )

    fields = [T.StructField(k, schema_of[k]) for k in keys]
    fields += T.StructType.fromDDL(PROBE_RESULT).fields
    if depth:
        level_type = "ARRAY<STRUCT<price_ticks: BIGINT, quantity: BIGINT>>"
        fields += T.StructType.fromDDL(f"bids {level_type}, asks {level_type}").fields
    if sweep:
        fields += T.StructType.fromDDL("fill_quantity BIGINT, fill_cost BIGINT").fields
    result = T.StructType(fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(result)
        bids, asks = _Side(-1), _Side(1)
        last = None
        # Sweeps rank the prices of a block, so they take it whole.
        for batch in whole_groups(batches, [*keys, "_block"]) if sweep else batches:
            place = [batch.column(c) for c in [*keys, "_block"]]
            kind = batch.column("_kind").to_numpy()
            prices = batch.column("price_ticks")
            no_limit = prices.is_null().to_pylist() if sweep and prices.null_count else None
            rows_of = zip(
                kind.tolist(),
                prices.fill_null(0).to_numpy().tolist(),
                batch.column("_amount").to_numpy().tolist(),
                strict=True,
            )
            fresh = group_starts(place, last)
            last = [c[-1].as_py() for c in place]
            if sweep:
                known = prices.fill_null(0).to_numpy()
                bids, asks = _Ranked(-1, known[kind == _BUY]), _Ranked(1, known[kind == _SELL])
            best: tuple[list, list, list, list] = ([], [], [], [])
            extra: list[list] = [[] for _ in range(2 * bool(depth) + 2 * sweep)]
            for i, (what, price, amount) in enumerate(rows_of):
                if i in fresh:
                    bids.clear()
                    asks.clear()
                if what == _BUY:
                    bids.change(price, amount)
                elif what == _SELL:
                    asks.change(price, amount)
                elif what == _CLEAR:
                    bids.clear()
                    asks.clear()
                else:
                    bid, ask = bids.best(), asks.best()
                    best[0].append(bid[0])
                    best[1].append(bid[1])
                    best[2].append(ask[0])
                    best[3].append(ask[1])
                    if depth:
                        for column, side in zip(extra, (bids, asks), strict=False):
                            column.append(
                                [
                                    {"price_ticks": p, "quantity": q}
                                    for p, q in side.ladder(depth)
                                ]
                            )
                    if sweep:
                        opposite = asks if what == _PROBE_BUY else bids
                        limit = None if no_limit and no_limit[i] else price
                        filled, cost = opposite.sweep(limit, amount)
                        extra[-2].append(filled)
                        extra[-1].append(cost)
            asked_rows = pa.array(np.flatnonzero(kind >= _PROBE_BUY))
            if len(asked_rows):
                kept = [
                    batch.column(c).take(asked_rows) for c in [*keys, "probe_id", "event_index"]
                ]
                made = [
                    pa.array(values, type=out_schema.field(len(kept) + n).type)
                    for n, values in enumerate([*best, *extra])
                ]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=out_schema)

    return rows.mapInArrow(walk, schema=result)


def quote_timeline(
    events: DataFrame,
    *,
    snapshots: bool = True,
    depth: int = 0,
    block_rows: int = DEFAULT_WALK_ROWS,
) -> DataFrame:
    """Best bid and ask right after every event of the log."""
    log = with_epoch(events, snapshots)
    # Read twice (level sums and block rows), so computed once.
    deltas = stage(level_deltas(order_states(log)), "deltas")
    probes = events.select(
        "symbol_id", "event_index", F.col("event_index").alias("probe_id")
    )
    clears = (
        log.filter(is_begin()).select("symbol_id", "event_index", "epoch") if snapshots else None
    )
    return walk_books(
        deltas, probes, clears=clears, depth=depth, block_rows=block_rows
    ).drop("probe_id")


def period_ladders(events: DataFrame, period_ns: int) -> DataFrame:
    """Level quantities at the end of every period in which the symbol traded at all.

    Built-ins only: per-period net change of each level, summed up and carried forward to the
    periods of the symbol. Input must hold no snapshots. Rows are levels x periods.
    """
    period = whole_div("timestamp_ns", period_ns)
    log = events.withColumn("period", period)
    states = order_states(log.withColumn("epoch", F.lit(0).cast("bigint")))
    deltas = level_deltas(states).join(
        log.select("symbol_id", "event_index", "period"), ["symbol_id", "event_index"]
    )
    changes = deltas.groupBy("symbol_id", "side", "price_ticks", "period").agg(
        F.sum("delta").alias("_sum")
    )
    level = Window.partitionBy("symbol_id", "side", "price_ticks").orderBy("period")
    spans = changes.select(
        "symbol_id",
        "side",
        "price_ticks",
        F.sum("_sum")
        .over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("quantity"),
        F.col("period").alias("_from"),
        F.lead("period").over(level).alias("_until"),
    ).filter(F.col("quantity") != 0)
    periods = log.select("symbol_id", "period").distinct()
    return (
        spans.join(periods, "symbol_id")
        .filter(
            (F.col("period") >= F.col("_from"))
            & (F.col("_until").isNull() | (F.col("period") < F.col("_until")))
        )
        .select("symbol_id", "period", "side", "price_ticks", "quantity")
    )


def activity(events: DataFrame) -> DataFrame:
    """Trading activity: Execute and Trade rows."""
    return events.filter(F.col("event_type").isin("Execute", "Trade"))


def reconcile_levels(orders: DataFrame, levels: DataFrame) -> DataFrame:
    """Book invariants as a table: every disagreement between live orders and a ladder.

    Returns no rows for a consistent book.
    """
    key = ["symbol_id", "side", "price_ticks"]
    child = orders.groupBy(*key).agg(
        F.sum("quantity").alias("child_quantity"),
        F.min("quantity").alias("least_quantity"),
        F.count(F.lit(1)).alias("child_count"),
    )
    stored = levels.select(*key, F.col("quantity").alias("level_quantity"))
    issue = (
        F.when(F.col("level_quantity").isNull(), "level missing for resting orders")
        .when(F.col("child_count").isNull(), "empty price level was retained")
        .when(F.col("least_quantity") <= 0, "resting order has non-positive quantity")
        .when(
            F.col("child_quantity") != F.col("level_quantity"),
            "price-level total does not match child order sum",
        )
    )
    level_issues = (
        child.join(stored, key, "full_outer")
        .withColumn("violation", issue)
        .filter("violation IS NOT NULL")
        .select(*key, F.lit(None).cast("bigint").alias("order_id"), "violation")
    )
    duplicates = (
        orders.groupBy("symbol_id", "order_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("side").alias("side"),
            F.min("price_ticks").alias("price_ticks"),
        )
        .filter("_n > 1")
        .select(*key, "order_id", F.lit("duplicate order id in price queues").alias("violation"))
    )
    return level_issues.unionByName(duplicates)
