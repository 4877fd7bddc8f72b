"""Positions from fills, PnL, exposure and portfolio limit checks."""

from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.scan import block_of
from tickloom.session import stage


@dataclass(frozen=True)
class PortfolioLimits:
    """Portfolio limits in ticks and basis points; 0 switches a limit off."""

    max_gross_exposure_ticks: int = 0
    max_net_exposure_ticks: int = 0
    max_symbol_concentration_bps: int = 0
    max_loss_ticks: int = 0

    @property
    def active(self) -> bool:
        return any(
            limit > 0
            for limit in (
                self.max_gross_exposure_ticks,
                self.max_net_exposure_ticks,
                self.max_symbol_concentration_bps,
                self.max_loss_ticks,
            )
        )


def _apply(quantity: int, cost: int, signed: int, price: int) -> tuple[int, int, int]:
    """Position, average cost and realised PnL after one signed fill."""
    after = quantity + signed
    if quantity * signed >= 0:
        paid = cost * abs(quantity) + price * abs(signed)
        # Division towards zero.
        share = abs(paid) // abs(after)
        return after, share if paid >= 0 else -share, 0
    closed = min(abs(signed), abs(quantity))
    gain = (price - cost) * closed if quantity > 0 else (cost - price) * closed
    if after == 0:
        return 0, 0, gain
    return after, price if (after > 0) != (quantity > 0) else cost, gain


_FILL_OUT = (
    "symbol_id BIGINT, fill_index BIGINT, quantity BIGINT, average_cost_ticks BIGINT, "
    "realised_ticks BIGINT"
)
_CURVE = "symbol_id BIGINT, block BIGINT, first_cost BIGINT, starts ARRAY<BIGINT>"


def _signed_fills(rows: pa.Table) -> list[tuple[int, int]]:
    """Signed quantity (0 where a fill does not count) and price of each row."""
    return [
        (size if side == "Buy" else -size if side == "Sell" else 0, price)
        if size and size > 0 else (0, price)
        for side, size, price in zip(
            rows.column("side").to_pylist(), rows.column("quantity").to_pylist(),
            rows.column("price_ticks").to_pylist(), strict=True,
        )
    ]


def cost_curve(quantity: int, fills: list[tuple[int, int]], low: int, high: int):
    """Average cost after ``fills`` as a function of the cost before them, low <= cost <= high.

    Returns the value at ``low`` and, for each step up by one, the smallest start that reaches
    it, or (None, []) if the fills leave the cost as it was. An extension maps c to (c * held + paid) / total, cut to a whole number: it never falls
    and shrinks differences, and a closed or turned position forgets c, so few steps are left.
    The steps are found backwards: each output's smallest input, fill by fill.
    """
    a, b, q, same = low, high, quantity, True
    maps: list[tuple[int, int, int]] = []
    for signed, price in fills:
        if signed == 0:
            continue
        same = same and q * signed < 0 and (q + signed) * q > 0
        if q * signed > 0:
            if a != b:
                maps.append((abs(q), price * abs(signed), abs(q + signed)))
            a, b = _apply(q, a, signed, price)[1], _apply(q, b, signed, price)[1]
        elif q == 0 or (q + signed) * q < 0:
            a = b = price
        elif q + signed == 0:
            a = b = 0
        if a == b:
            maps = []
        q += signed
    if same:
        return None, []
    largest = max([1, *(total for _, _, total in maps)]) * (max(abs(low), abs(high)) + 2)
    values = np.arange(a + 1, b + 1, dtype=np.int64 if largest < 1 << 61 else object)
    for held, paid, total in reversed(maps):
        # The smallest c with (c * held + paid) / total, cut towards zero, at least the value.
        least = np.where(values > 0, total * values, total * (values - 1) + 1)
        values = -((paid - least) // held)
    return a, [max(int(v), low) for v in values]


def fold_fills(
    fills: DataFrame, start: DataFrame | None = None, block_rows: int = 200_000
) -> DataFrame:
    """Position, truncated average cost and realised PnL after every fill.

    fills: symbol_id, fill_index (order), side, quantity, price_ticks. The position is a running
    sum. The average truncates at every extension, so it cannot be summed; but over a block it is
    a step function of the average before it (``cost_curve``). Blocks make their curves in
    parallel, one pass per symbol runs through one curve per block, and the blocks then write
    their rows from a known start: the same few jobs for any number of blocks.
    """
    rows = stage(fills.withColumn("block", block_of("fill_index", block_rows)), "fills-rows")
    key = ["symbol_id", "block"]
    signed = F.when(F.col("quantity") > 0, F.when(F.col("side") == "Buy", F.col("quantity"))
                    .when(F.col("side") == "Sell", -F.col("quantity")))
    sums = rows.groupBy(*key).agg(
        F.coalesce(F.sum(signed), F.lit(0)).alias("moved"),
        F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"),
    )
    if start is None:
        begun = sums.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("q0", "c0")])
    else:
        begun = sums.join(
            start.select("symbol_id", F.col("quantity").alias("q0"),
                         F.col("average_cost_ticks").alias("c0")), "symbol_id", "left",
        ).na.fill(0, ["q0", "c0"])
    before = Window.partitionBy("symbol_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    entries = stage(begun.select(
        *key, "c0", (F.col("q0") + F.coalesce(F.sum("moved").over(before), F.lit(0))).alias("held"),
        F.least("c0", F.min("low").over(before)).alias("low"),
        F.greatest("c0", F.max("high").over(before)).alias("high"),
    ), "fills-entries")

    def make_curve(left: pa.Table, right: pa.Table) -> pa.Table:
        one = right.to_pylist()[0]
        first, starts = cost_curve(
            one["held"], _signed_fills(left.sort_by("fill_index")), one["low"], one["high"])
        return pa.table({
            "symbol_id": pa.array([one["symbol_id"]], pa.int64()),
            "block": pa.array([one["block"]], pa.int64()),
            "first_cost": pa.array([first], pa.int64()),
            "starts": pa.array([starts], pa.list_(pa.int64())),
        })

    curves = rows.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(make_curve, _CURVE)

    def chain(_, batches):
        """Entry cost of every block; curves come in block order, one batch at a time."""
        cost = None
        for batch in batches:
            costs = []
            for r in batch.to_pylist():
                cost = r["c0"] if cost is None else cost
                costs.append(cost)
                if r["first_cost"] is not None:
                    cost = r["first_cost"] + bisect_right(r["starts"], cost)
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbol_id"), batch.column("block"), batch.column("held"),
                 pa.array(costs, pa.int64())], ["symbol_id", "block", "held", "cost"])

    ordered = curves.join(
        entries.select(*key, "c0", "held"), key).repartition("symbol_id").sortWithinPartitions(*key)
    begins = stage(ordered.mapInArrow(
        _per_symbol(chain), "symbol_id BIGINT, block BIGINT, held BIGINT, cost BIGINT"), "fills-starts")

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_in, one = left.sort_by("fill_index"), right.to_pylist()[0]
        quantity, cost = one["held"], one["cost"]
        out: tuple[list, list, list] = ([], [], [])
        for signed_size, price in _signed_fills(rows_in):
            gain = 0
            if signed_size:
                quantity, cost, gain = _apply(quantity, cost, signed_size, price)
            for column, value in zip(out, (quantity, cost, gain), strict=True):
                column.append(value)
        return pa.table(
            [rows_in.column("symbol_id"), rows_in.column("fill_index"),
             *[pa.array(x, pa.int64()) for x in out]],
            names=[f.split()[0] for f in _FILL_OUT.split(", ")])

    return rows.groupBy(*key).cogroup(begins.groupBy(*key)).applyInArrow(write, _FILL_OUT)


def _per_symbol(chain):
    """Runs ``chain`` over the batches of each symbol; rows come sorted by symbol."""

    def pieces(batches):
        for batch in batches:
            ids = batch.column("symbol_id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    yield int(ids[lo]), batch.slice(lo, hi - lo)

    def run(batches):
        for symbol, group in groupby(pieces(batches), key=lambda p: p[0]):
            yield from chain(symbol, (batch for _, batch in group))

    return run


def final_positions(
    folded: DataFrame, start: DataFrame | None = None, marks: DataFrame | None = None
) -> DataFrame:
    """Last position per symbol with its mark (average cost where no mark is known)."""
    last = folded.groupBy("symbol_id").agg(
        F.max_by("quantity", "fill_index").alias("quantity"),
        F.max_by("average_cost_ticks", "fill_index").alias("average_cost_ticks"),
        F.sum("realised_ticks").alias("realised_ticks"),
    )
    if start is not None:
        untouched = start.join(last, "symbol_id", "left_anti").select(
            "symbol_id", "quantity", "average_cost_ticks",
            F.lit(0).cast("bigint").alias("realised_ticks"),
        )
        last = last.unionByName(untouched)
    if marks is None:
        return last.withColumn("mark_ticks", F.col("average_cost_ticks"))
    joined = last.join(marks.select("symbol_id", "mark_ticks"), "symbol_id", "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "symbol_id",
        F.coalesce("quantity", zero).alias("quantity"),
        F.coalesce("average_cost_ticks", zero).alias("average_cost_ticks"),
        F.coalesce("realised_ticks", zero).alias("realised_ticks"),
        F.coalesce("mark_ticks", "average_cost_ticks", zero).alias("mark_ticks"),
    )


def _exposures():
    size = F.abs("quantity") * F.col("mark_ticks")
    return [
        F.coalesce(F.sum(size), F.lit(0)).alias("gross_exposure_ticks"),
        F.coalesce(F.abs(F.sum(F.col("quantity") * F.col("mark_ticks"))), F.lit(0)).alias(
            "net_exposure_ticks"
        ),
        F.coalesce(F.sum("realised_ticks"), F.lit(0)).alias("realised_pnl_ticks"),
        F.coalesce(
            F.sum((F.col("mark_ticks") - F.col("average_cost_ticks")) * F.col("quantity")),
            F.lit(0),
        ).alias("unrealised_pnl_ticks"),
        F.count(F.lit(1)).alias("symbol_count"),
    ]


def snapshot(positions: DataFrame) -> DataFrame:
    """One row: exposures, PnL and the most concentrated symbol (lowest id on ties)."""
    totals = positions.agg(*_exposures())
    size = F.abs("quantity") * F.col("mark_ticks")
    per_symbol = positions.select("symbol_id", size.alias("_size"), F.lit(0).alias("_one"))
    whole = totals.select(F.col("gross_exposure_ticks").alias("_gross"), F.lit(0).alias("_one"))
    bps = F.expr("_size * 10000 div _gross")
    worst = (
        per_symbol.join(F.broadcast(whole), "_one")  # exactly one row
        .filter("_gross > 0")
        .withColumn("_bps", bps)
        .filter("_bps > 0")
        .agg(
            F.max("_bps").alias("max_concentration_bps"),
            F.max_by("symbol_id", F.struct("_bps", -F.col("symbol_id"))).alias(
                "max_concentration_symbol"
            ),
        )
        .withColumn("_one", F.lit(0))
    )
    return (
        totals.withColumn("_one", F.lit(0))
        .join(worst, "_one")
        .select(
            *[c for c in totals.columns if c != "symbol_count"],
            (F.col("realised_pnl_ticks") + F.col("unrealised_pnl_ticks")).alias("total_pnl_ticks"),
            F.coalesce("max_concentration_symbol", F.lit(0)).alias("max_concentration_symbol"),
            F.coalesce("max_concentration_bps", F.lit(0)).alias("max_concentration_bps"),
            "symbol_count",
        )
    )


def _judge(limits: PortfolioLimits, gross, net, bps, symbol, pnl):
    """Ordered limit cascade as a struct (accepted, breach, symbol, limit, observed)."""

    def result(breach: str, where, limit: int, seen):
        return F.struct(
            F.lit(breach == "none").alias("accepted"),
            F.lit(breach).alias("breach"),
            where.cast("bigint").alias("breach_symbol"),
            F.lit(limit).cast("bigint").alias("limit_value"),
            seen.cast("bigint").alias("observed_value"),
        )

    none = F.lit(0)
    rules = []
    if limits.max_gross_exposure_ticks > 0:
        top = limits.max_gross_exposure_ticks
        rules.append((gross > top, result("gross_exposure", none, top, gross)))
    if limits.max_net_exposure_ticks > 0:
        top = limits.max_net_exposure_ticks
        rules.append((net > top, result("net_exposure", none, top, net)))
    if limits.max_symbol_concentration_bps > 0:
        top = limits.max_symbol_concentration_bps
        rules.append(((gross > 0) & (bps > top), result("concentration", symbol, top, bps)))
    if limits.max_loss_ticks > 0:
        top = limits.max_loss_ticks
        rules.append((pnl <= -top, result("loss", none, top, -pnl)))
    verdict = result("none", none, 0, none)
    for condition, value in reversed(rules):
        verdict = F.when(condition, value).otherwise(verdict)
    return verdict


def check_state(taken: DataFrame, limits: PortfolioLimits) -> DataFrame:
    """Judge a portfolio ``snapshot``."""
    verdict = _judge(
        limits,
        F.col("gross_exposure_ticks"),
        F.col("net_exposure_ticks"),
        F.col("max_concentration_bps"),
        F.col("max_concentration_symbol"),
        F.col("total_pnl_ticks"),
    )
    return taken.select(verdict.alias("v")).select("v.*")


# Breach names as they appear in audit rows.
_CHECKS = {
    "none": ("portfolio_accepted", "None"),
    "gross_exposure": ("portfolio_gross_exposure", "MaxPortfolioGrossExposure"),
    "net_exposure": ("portfolio_net_exposure", "MaxPortfolioNetExposure"),
    "concentration": ("portfolio_concentration", "MaxSymbolConcentration"),
    "loss": ("portfolio_loss", "MaxPortfolioLoss"),
}


def check_orders(
    orders: DataFrame, positions: DataFrame, limits: PortfolioLimits, marks: DataFrame
) -> DataFrame:
    """What-if check of every order on a hypothetical fill, as audit rows.

    Only the order's own symbol changes, so its new contribution replaces the old one in the
    totals; orders are never paired with other symbols. The largest other symbol comes from
    the two largest of the portfolio. On equal concentration after rounding, the larger
    exposure names the symbol.
    """
    size = F.abs("quantity") * F.col("mark_ticks")
    contribution = positions.select(
        F.col("symbol_id"),
        F.col("quantity").alias("_q"),
        F.col("average_cost_ticks").alias("_c"),
        F.col("mark_ticks").alias("_m"),
        size.alias("_size"),
    )
    first = F.max(F.struct("_size", -F.col("symbol_id")))
    total = contribution.agg(
        F.coalesce(F.sum("_size"), F.lit(0)).alias("_gross"),
        F.coalesce(F.sum(F.col("_q") * F.col("_m")), F.lit(0)).alias("_net"),
        F.coalesce(F.sum((F.col("_m") - F.col("_c")) * F.col("_q")), F.lit(0)).alias("_open"),
        first.alias("_top"),
    )
    realised = positions.agg(F.coalesce(F.sum("realised_ticks"), F.lit(0)).alias("_realised"))
    top = total.select((-F.col("_top.col2")).alias("symbol_id"))
    second = contribution.join(top, "symbol_id", "left_anti").agg(first.alias("_second"))
    one = lambda df: df.withColumn("_one", F.lit(0))
    whole = one(total).join(one(realised), "_one").join(one(second), "_one")

    known = marks.select("symbol_id", F.lit(True).alias("_marked"))
    rows = (
        one(orders)
        .join(contribution, "symbol_id", "left")
        .join(known, "symbol_id", "left")
        .join(F.broadcast(whole), "_one")  # exactly one row
    )
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("_q", "_c", "_m", "_size")})
    fills = (F.col("quantity") > 0) & F.col("side").isin("Buy", "Sell")
    signed = F.when(
        fills, F.when(F.col("side") == "Buy", F.col("quantity")).otherwise(-F.col("quantity"))
    ).otherwise(0)
    rows = rows.withColumn("_signed", signed).withColumn("_after", F.col("_q") + F.col("_signed"))
    extends = F.col("_q") * F.col("_signed") >= 0
    closed = F.least(F.abs("_signed"), F.abs("_q"))
    gain = F.when(extends, 0).otherwise(
        F.when(F.col("_q") > 0, F.col("price_ticks") - F.col("_c")).otherwise(
            F.col("_c") - F.col("price_ticks")
        )
        * closed
    )
    cost = (
        F.when(F.col("_signed") == 0, F.col("_c"))
        .when(F.col("_after") == 0, 0)
        .when(
            extends,
            F.expr(
                "(_c * abs(_q) + price_ticks * abs(_signed)) div nullif(abs(_after), 0)"
            ),
        )
        .when(F.signum("_after") != F.signum("_q"), F.col("price_ticks"))
        .otherwise(F.col("_c"))
    )
    rows = rows.withColumns({"_gain": gain, "_cost": cost})
    mark = F.when(F.coalesce("_marked", F.lit(False)), F.col("_m")).otherwise(F.col("_cost"))
    rows = rows.withColumn("_mark", mark)
    own = F.abs("_after") * F.col("_mark")
    rows = rows.withColumns(
        {
            "_own": own,
            "_g": F.col("_gross") - F.col("_size") + own,
            "_n": F.abs(
                F.col("_net") - F.col("_q") * F.col("_m") + F.col("_after") * F.col("_mark")
            ),
            "_pnl": F.col("_realised") + F.col("_gain") + F.col("_open")
            - (F.col("_m") - F.col("_c")) * F.col("_q")
            + (F.col("_mark") - F.col("_cost")) * F.col("_after"),
        }
    )
    other = F.when(F.col("_top.col2") == -F.col("symbol_id"), F.col("_second")).otherwise(
        F.col("_top")
    )
    mine = F.struct(F.col("_own").alias("_size"), (-F.col("symbol_id")).alias("col2"))
    rows = rows.withColumn("_worst", F.greatest(F.coalesce(other, mine), mine))
    rows = rows.withColumn("_bps", F.expr("_worst._size * 10000 div nullif(_g, 0)"))
    verdict = _judge(
        limits, F.col("_g"), F.col("_n"), F.coalesce("_bps", zero), -F.col("_worst.col2"),
        F.col("_pnl"),
    )
    names = F.create_map(*[F.lit(x) for k, v in _CHECKS.items() for x in (k, v[0])])
    reasons = F.create_map(*[F.lit(x) for k, v in _CHECKS.items() for x in (k, v[1])])
    return rows.withColumn("v", verdict).select(
        *[c for c in orders.columns if c in ("client_order_id", "timestamp_ns")],
        "symbol_id",
        "side",
        "v.accepted",
        reasons[F.col("v.breach")].alias("reject_reason"),
        names[F.col("v.breach")].alias("check_name"),
        "v.limit_value",
        "v.observed_value",
    )


def order_vwap(executions: DataFrame) -> DataFrame:
    """Filled quantity and truncated average price per order."""
    return executions.groupBy("order_id").agg(
        F.sum("quantity").alias("filled_quantity"),
        F.sum(F.col("quantity") * F.col("price_ticks")).alias("_value"),
    ).select(
        "order_id",
        "filled_quantity",
        F.expr("CASE WHEN filled_quantity > 0 THEN _value div filled_quantity ELSE 0 END").alias(
            "average_price_ticks"
        ),
    )


def last_marks(fills: DataFrame) -> DataFrame:
    """Mark every symbol at the price of its last fill."""
    return fills.groupBy("symbol_id").agg(F.max_by("price_ticks", "fill_index").alias("mark_ticks"))
