"""Order limit surveillance.

Two ways to decide a stream of order messages:

* ``screen_orders`` judges every rule that needs no earlier decision (control state, rate,
  field, size, staleness, band, notional, position and exposure rules) with built-ins.
* ``decide_orders`` is exact for the whole cascade, including the rules that depend on what
  was accepted before (duplicate ids, self-trade, open quantity, replaces). Reference prices,
  exposures and positions still come from Spark joins; only the feedback runs in a block fold.
"""

import json
from bisect import bisect_right
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators.asof import HOUR_NS, age_exceeds, as_of, running_sum_as_of
from tickloom.operators.book import DEFAULT_WALK_ROWS, walk_books
from tickloom.operators.scan import block_fold, block_of, block_scan, follow, whole_div
from tickloom.session import stage


@dataclass(frozen=True)
class RiskLimits:
    """Limit configuration; 0 switches the optional controls off."""

    max_order_quantity: int = 1_000
    max_notional_ticks: int = 1_000_000
    max_position_per_symbol: int = 10_000
    max_gross_exposure_ticks: int = 10_000_000
    price_band_ticks: int = 100
    stale_after_ns: int = 1_000_000_000
    max_open_order_quantity: int = 0
    max_messages_per_window: int = 0
    rate_window_ns: int = 0
    enable_self_trade_prevention: bool = False
    rate_limit_mode: str = "fixed-window"
    cancel_on_disconnect: bool = False
    disconnect_order_policy: str = "reject-new-orders"

    def __post_init__(self):
        if self.rate_limit_mode not in schema.RATE_LIMIT_MODES:
            raise ValueError(f"unknown rate-limit mode: {self.rate_limit_mode}")
        if self.disconnect_order_policy not in schema.DISCONNECT_POLICIES:
            raise ValueError(f"unknown disconnect policy: {self.disconnect_order_policy}")

    @property
    def rate_limited(self) -> bool:
        return self.max_messages_per_window > 0 and self.rate_window_ns > 0

    @property
    def rate_check_name(self) -> str:
        sliding = self.rate_limit_mode == "sliding-window"
        return "message_rate_limit_sliding" if sliding else "message_rate_limit"


def sliding_rate(messages: DataFrame, window_ns: int) -> DataFrame:
    """``observed_rate``: messages of the client within the last ``window_ns``, this one
    included. Needs client_id, timestamp_ns and a unique ``arrival`` in time order.

    Every message is put into its window-sized time bucket and, as context, into the next one,
    so a busy client is split by time.
    """
    bucket = whole_div("timestamp_ns", window_ns)
    copies = messages.withColumn(
        "_in",
        F.explode(
            F.array(
                F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
                F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")),
            )
        ),
    ).select("*", "_in.bucket", "_in.own")
    seen = Window.partitionBy("client_id", "bucket").orderBy("timestamp_ns", "arrival")
    expired = (
        Window.partitionBy("client_id", "bucket")
        .orderBy("timestamp_ns")
        .rangeBetween(Window.unboundedPreceding, -window_ns)
    )
    return (
        copies.withColumn(
            "observed_rate",
            (F.row_number().over(seen) - F.count(F.lit(1)).over(expired)).cast("bigint"),
        )
        .filter("own")
        .drop("_in", "bucket", "own")
    )


def fixed_rate(messages: DataFrame, window_ns: int, block_rows: int = 100_000) -> DataFrame:
    """``observed_rate`` under fixed windows anchored at a client's first message; a message
    at or past the window's end opens the next window.

    Anchors chain, but each message's next anchor is known without the chain: the first later
    message at or past its window's end. An anchor is always later than all messages before it,
    so only those can be one, and the lookup is an as-of join on mirrored time. From these
    pointers the anchors are found by doubling: with the anchors up to the 2^k-th and pointers
    over 2^k anchors, one join gives as many again and one the pointers over twice as many.
    Rounds grow with the logarithm of the windows of the busiest client; no key is ever walked.
    """
    rows = messages.select("client_id", "arrival", "timestamp_ns").withColumn(
        "_blk", block_of("arrival", block_rows)
    )
    seen = stage(
        block_scan(
            rows, ["client_id"], ["arrival"], "_blk",
            totals={"n": F.lit(1)}, peaks={"peak": F.col("timestamp_ns")},
        ),
        "rate-rows",
    )
    latest = seen.filter("peak IS NULL OR timestamp_ns > peak")
    opens = latest.select("client_id", (-F.col("timestamp_ns")).alias("_back"), "n")
    asks = latest.select(
        "client_id", F.col("n").alias("at"), (-F.col("timestamp_ns") - window_ns).alias("_back")
    )
    pointers = as_of(asks, opens, ["client_id"], "_back", ["n"], slice_ns=64 * window_ns)
    jumps = stage(
        pointers.filter("n IS NOT NULL").select("client_id", "at", F.col("n").alias("to")),
        "rate-jumps",
    )
    anchors = follow(
        seen.filter("n = 1").select("client_id", F.col("n").alias("at")), jumps, ["client_id"]
    ).withColumnRenamed("at", "n")
    opened = seen.join(
        anchors.withColumn("_open", F.lit(True)), ["client_id", "n"], "left"
    ).select("client_id", "arrival", "n", "_blk", "_open")
    counted = block_scan(
        opened, ["client_id"], ["arrival"], "_blk",
        latest={"_from": F.when(F.col("_open"), F.col("n"))},
    ).select("client_id", "arrival", (F.col("n") - F.col("_from") + 1).alias("observed_rate"))
    return messages.join(counted, ["client_id", "arrival"])


def duplicate_ids(requests: DataFrame) -> DataFrame:
    """Client order ids seen more than once, with the number of uses (candidates: the exact
    rule counts accepted uses only, see ``decide_orders``)."""
    return (
        requests.groupBy("client_order_id")
        .agg(F.count(F.lit(1)).alias("uses"))
        .filter("uses > 1")
    )


def notional(limit_price, reference_price):
    price = F.when(F.col("order_type") == "Market", F.coalesce(reference_price, F.lit(0))).otherwise(
        limit_price
    )
    return F.abs(price * F.col("quantity"))


def exposure_base(
    requests: DataFrame, market: DataFrame, positions: DataFrame, slice_ns: int
) -> DataFrame:
    """Add ``exposure_base``: sum of |position| x reference price of all symbols as of the
    order's time. Each market update changes the sum by a known step, so one running sum
    serves all orders; symbols and orders are never paired up."""
    held = market.join(positions.select("symbol_id", F.abs("quantity").alias("_size")), "symbol_id")
    per_time = held.groupBy("symbol_id", "timestamp_ns").agg(
        F.max("reference_price_ticks").alias("_price"), F.first("_size").alias("_size")
    )
    stepped = block_scan(
        per_time,
        ["symbol_id"],
        ["timestamp_ns"],
        whole_div("timestamp_ns", slice_ns),
        previous={"_before": F.col("_price")},
    ).select(
        "timestamp_ns",
        ((F.col("_price") - F.coalesce("_before", F.lit(0))) * F.col("_size")).alias("_change"),
    )
    return running_sum_as_of(
        requests, stepped, "timestamp_ns", "_change", "exposure_base", slice_ns
    )


def enrich_requests(
    requests: DataFrame,
    market: DataFrame,
    positions: DataFrame,
    slice_ns: int = 24 * HOUR_NS,
) -> DataFrame:
    """Add the market reference, its age, the symbol's position and the exposure base."""
    with_market = as_of(
        requests,
        market,
        ["symbol_id"],
        "timestamp_ns",
        ["reference_price_ticks"],
        slice_ns=slice_ns,
    ).withColumnRenamed("asof_timestamp_ns", "reference_ns")
    with_position = with_market.join(
        positions.select("symbol_id", F.col("quantity").alias("position")), "symbol_id", "left"
    ).withColumn("position", F.coalesce("position", F.lit(0)))
    return exposure_base(with_position, market, positions, slice_ns)


_DECISION = ("check_name", "reject_reason", "limit_value", "observed_value")


def screen_orders(enriched: DataFrame, limits: RiskLimits) -> DataFrame:
    """First failing rule among those without feedback, in cascade order, else accepted.

    Optional columns: ``killed``/``connected`` (see ``control_state``), ``observed_rate``.
    """
    has = set(enriched.columns)
    quantity, price = F.col("quantity"), F.col("price_ticks")
    reference = F.col("reference_price_ticks")
    limit_order = F.col("order_type") == "Limit"
    now = F.col("timestamp_ns")
    size = notional(price, reference)
    projected = F.abs(
        F.col("position") + F.when(F.col("side") == "Buy", quantity).otherwise(-quantity)
    )
    gross = size + F.coalesce("exposure_base", F.lit(0))
    zero = F.lit(0).cast("bigint")
    rules = []
    if "killed" in has:
        rules.append((F.col("killed"), "kill_switch", "KillSwitch", zero, zero))
        if limits.disconnect_order_policy == "reject-new-orders":
            rules.append((~F.col("connected"), "disconnected", "Disconnected", zero, zero))
    if "observed_rate" in has and limits.rate_limited:
        rules.append(
            (
                F.col("observed_rate") > limits.max_messages_per_window,
                limits.rate_check_name,
                "MessageRateLimit",
                F.lit(limits.max_messages_per_window),
                F.col("observed_rate"),
            )
        )
    rules += [
        (quantity <= 0, "invalid_quantity", "InvalidQuantity", zero, quantity),
        (limit_order & (price <= 0), "invalid_price", "InvalidPrice", zero, price),
        (
            quantity > limits.max_order_quantity,
            "max_order_quantity",
            "MaxOrderQuantity",
            F.lit(limits.max_order_quantity),
            quantity,
        ),
        (
            reference.isNull(),
            "stale_market_data",
            "StaleMarketData",
            F.lit(limits.stale_after_ns),
            zero,
        ),
        (
            age_exceeds(now, F.col("reference_ns"), limits.stale_after_ns),
            "stale_market_data",
            "StaleMarketData",
            F.lit(limits.stale_after_ns),
            now - F.col("reference_ns"),
        ),
        (
            limit_order & (F.abs(price - reference) > limits.price_band_ticks),
            "price_band",
            "PriceBand",
            F.lit(limits.price_band_ticks),
            F.abs(price - reference),
        ),
        (
            size > limits.max_notional_ticks,
            "max_notional",
            "MaxNotional",
            F.lit(limits.max_notional_ticks),
            size,
        ),
        (
            projected > limits.max_position_per_symbol,
            "max_position",
            "MaxPosition",
            F.lit(limits.max_position_per_symbol),
            projected,
        ),
        (
            gross > limits.max_gross_exposure_ticks,
            "max_gross_exposure",
            "MaxGrossExposure",
            F.lit(limits.max_gross_exposure_ticks),
            gross,
        ),
    ]

    def outcome(name, reason, limit, observed):
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(reason).alias("reject_reason"),
            limit.cast("bigint").alias("limit_value"),
            observed.cast("bigint").alias("observed_value"),
        )

    verdict = None
    for condition, *rest in rules:
        result = outcome(*rest)
        verdict = F.when(condition, result) if verdict is None else verdict.when(condition, result)
    verdict = verdict.otherwise(
        outcome("accepted", "None", F.lit(limits.max_notional_ticks), size)
    )
    return (
        enriched.withColumn("_v", verdict)
        .select(
            "client_order_id",
            "symbol_id",
            "side",
            "timestamp_ns",
            (F.col("_v.check_name") == "accepted").alias("accepted"),
            *[F.col(f"_v.{c}").alias(c) for c in _DECISION],
        )
    )


def self_trades(working: DataFrame, block_rows: int = DEFAULT_WALK_ROWS) -> DataFrame:
    """Orders that would trade against the same client's resting orders.

    working: client_id, symbol_id, client_order_id, side, order_type, price_ticks, quantity,
    from_index, until_index (position at which the order stops resting). Client 0 is exempt.
    The best opposing price comes from walking one small book per (client, symbol), so no
    pairs of orders are formed.
    """
    own = working.filter(F.col("client_id") != 0)
    resting = own.filter(F.col("order_type") == "Limit")
    epoch = F.lit(0).cast("bigint").alias("epoch")
    key = ["client_id", "symbol_id"]
    deltas = resting.select(
        *key,
        epoch,
        "side",
        "price_ticks",
        F.explode(
            F.array(
                F.struct(
                    F.col("from_index").alias("event_index"), F.col("quantity").alias("delta")
                ),
                F.struct(
                    F.col("until_index").alias("event_index"), (-F.col("quantity")).alias("delta")
                ),
            )
        ).alias("d"),
    ).select(*key, "epoch", "d.event_index", "side", "price_ticks", "d.delta")
    probes = own.select(
        *key,
        F.col("from_index").alias("event_index"),
        F.col("client_order_id").alias("probe_id"),
    )
    tops = walk_books(deltas, probes, keys=key, block_rows=block_rows)
    opposing = F.when(F.col("side") == "Buy", F.col("ask_price")).otherwise(F.col("bid_price"))
    crosses = F.when(F.col("side") == "Buy", F.col("price_ticks") >= opposing).otherwise(
        F.col("price_ticks") <= opposing
    )
    return (
        own.join(
            tops.select(F.col("probe_id").alias("client_order_id"), "bid_price", "ask_price"),
            "client_order_id",
        )
        .withColumn("opposing_price_ticks", opposing)
        .filter(
            F.col("opposing_price_ticks").isNotNull()
            & ((F.col("order_type") == "Market") | crosses)
        )
        .select(
            "client_order_id", "client_id", "symbol_id", "side", "price_ticks",
            "opposing_price_ticks",
        )
    )


def sweep_orders(
    orders: DataFrame, deltas: DataFrame, block_rows: int = DEFAULT_WALK_ROWS
) -> DataFrame:
    """Would the order cross the ladder, can it fill completely, at what cost.

    orders: symbol_id, client_order_id, side, order_type, price_ticks, quantity, event_index
    (book position to read). Ladders are read in place; orders x levels is never built.
    """
    # The walk reads both several times, so they are computed once.
    orders, deltas = stage(orders, "sweep-orders"), stage(deltas, "sweep-deltas")
    probes = orders.select(
        "symbol_id",
        "event_index",
        F.col("client_order_id").alias("probe_id"),
        "side",
        F.when(F.col("order_type") != "Market", F.col("price_ticks")).alias("price_ticks"),
        "quantity",
    )
    walked = walk_books(deltas, probes, sweep=True, block_rows=block_rows)
    return orders.join(
        walked.select(F.col("probe_id").alias("client_order_id"), "fill_quantity", "fill_cost"),
        "client_order_id",
    ).select(
        "client_order_id",
        "symbol_id",
        (F.col("fill_quantity") > 0).alias("crosses"),
        (F.col("fill_quantity") >= F.col("quantity")).alias("fillable"),
        "fill_quantity",
        "fill_cost",
    )


def working_orders(
    accepted: DataFrame, reports: DataFrame, order: str = "timestamp_ns"
) -> DataFrame:
    """Accepted resting orders after their execution reports, taken in ``order``.

    A report without a client id is ignored. One whose id is a working order's changes that
    order, or releases it when terminal or empty. Any other id is looked up by the exchange id
    that a working order holds at that time; such a report changes the order but never releases
    it. The last price above zero and the last remaining quantity count. Ties in ``order`` fall
    back on the report's own values.
    """
    at = F.struct(order, "client_order_id", "exchange_order_id", "remaining_quantity",
                  "resting_price_ticks", "order_status", "exec_type")
    terminal = (
        (F.col("exec_type") == "Rejected")
        | F.col("order_status").isin("Rejected", "Canceled", "Filled")
        | (F.col("remaining_quantity") <= 0)
    )
    named = reports.filter("client_order_id <> 0").select(
        "client_order_id",
        F.coalesce("exchange_order_id", F.lit(0)).alias("_exchange"),
        F.col("remaining_quantity").alias("_left"),
        F.when(F.col("resting_price_ticks") > 0, F.col("resting_price_ticks")).alias("_price"),
        F.coalesce(terminal, F.lit(False)).alias("_ends"),
        at.alias("_at"),
    )
    known = accepted.select("client_order_id", F.lit(True).alias("_known"))
    named = named.join(known, "client_order_id", "left")
    by_order = Window.partitionBy("client_order_id").orderBy("_at")
    so_far = by_order.rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn(
        "_direct",
        F.coalesce("_known", F.lit(False))
        & ~F.coalesce(F.max("_ends").over(so_far), F.lit(False)),
    ).withColumn(
        "_held",
        F.last(F.when(F.col("_direct") & (F.col("_exchange") != 0), F.col("_exchange")),
               ignorenulls=True).over(so_far),
    )
    direct = named.filter("_direct")
    # Binding events of an exchange id: taken by an order, or given up by it.
    taken = direct.filter("NOT _ends AND _exchange <> 0").select(
        "_exchange", "_at", F.struct(F.col("client_order_id").alias("id")).alias("_owner")
    )
    given_up = direct.filter(
        "_held IS NOT NULL AND (_ends OR (_exchange <> 0 AND _exchange <> _held))"
    ).select(
        F.col("_held").alias("_exchange"),
        "_at",
        F.struct(F.lit(None).cast(accepted.schema["client_order_id"].dataType).alias("id")).alias(
            "_owner"
        ),
    )
    others = named.filter("NOT _direct AND NOT _ends AND _exchange <> 0").select(
        "_exchange", "_at", "_left", "_price"
    )
    by_exchange = Window.partitionBy("_exchange").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    mapped = (
        taken.unionByName(given_up)
        .unionByName(others, allowMissingColumns=True)
        .withColumn("_bound", F.last("_owner", ignorenulls=True).over(by_exchange))
        .filter("_owner IS NULL AND _bound.id IS NOT NULL")
        .select(F.col("_bound.id").alias("client_order_id"), "_at", "_left", "_price")
    )
    changes = direct.select("client_order_id", "_at", "_left", "_price", "_ends").unionByName(
        mapped.withColumn("_ends", F.lit(False))
    )
    last = changes.groupBy("client_order_id").agg(
        F.max_by("_left", "_at").alias("_left"),
        F.max_by("_price", F.when(F.col("_price").isNotNull(), F.col("_at"))).alias("_price"),
        F.bool_or("_ends").alias("_gone"),
    )
    return (
        accepted.join(last, "client_order_id", "left")
        .filter(~F.coalesce("_gone", F.lit(False)))
        .select(
            "client_order_id",
            "client_id",
            "symbol_id",
            "side",
            F.coalesce("_price", "price_ticks").alias("price_ticks"),
            F.coalesce("_left", "quantity").alias("quantity"),
        )
    )


def working_quantity(working: DataFrame) -> DataFrame:
    """Open quantity and order count per symbol."""
    return working.groupBy("symbol_id").agg(
        F.sum("quantity").alias("working_quantity"),
        F.count(F.lit(1)).alias("working_order_count"),
    )


def exposure_snapshot(working: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions and open quantities side by side per symbol."""
    return (
        positions.select("symbol_id", F.col("quantity").alias("position"))
        .join(working_quantity(working), "symbol_id", "full_outer")
        .select(
            "symbol_id",
            F.coalesce("position", F.lit(0)).alias("position"),
            F.coalesce("working_quantity", F.lit(0)).alias("working_quantity"),
            F.coalesce("working_order_count", F.lit(0)).alias("working_order_count"),
        )
    )


def running_working_quantity(changes: DataFrame, block_rows: int = 1_000_000) -> DataFrame:
    """Open quantity of the symbol after every change (symbol_id, event_index, delta)."""
    return block_scan(
        changes,
        ["symbol_id"],
        ["event_index"],
        block_of("event_index", block_rows),
        totals={"working_quantity": F.col("delta")},
    )


# --- exact cascade with feedback --------------------------------------------------------

_AUDIT_OUT = (
    "scope BIGINT, arrival BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, "
    "symbol_id BIGINT, side STRING, accepted BOOLEAN, reject_reason STRING, check_name STRING, "
    "limit_value BIGINT, observed_value BIGINT"
)


class _Gate:
    """Feedback state of one scope while a block of messages passes."""

    def __init__(self, limits: RiskLimits, state: bytes):
        data = json.loads(state) if state else {}
        self.limits = limits
        self.working = {int(k): v for k, v in data.get("working", {}).items()}
        self.bound = {int(k): v for k, v in data.get("bound", {}).items()}
        self.used = set(data.get("used", []))
        self.rates = {int(k): v for k, v in data.get("rates", {}).items()}
        self.killed = data.get("killed", False)
        self.connected = data.get("connected", True)
        self.open: dict[int, int] = {}
        self.prices: dict[tuple[int, int, str], dict[int, int]] = {}
        for order in self.working.values():
            self._count(order, 1)

    def _count(self, order: dict, sign: int) -> None:
        """Add or remove an order in the per-symbol and per-price totals."""
        change = sign * order["quantity"]
        self.open[order["symbol"]] = self.open.get(order["symbol"], 0) + change
        book = self.prices.setdefault((order["client"], order["symbol"], order["side"]), {})
        left = book.get(order["price"], 0) + change
        if left:
            book[order["price"]] = left
        else:
            book.pop(order["price"], None)

    def dump(self) -> bytes:
        data = {
            "working": self.working,
            "bound": self.bound,
            "used": sorted(self.used),
            "rates": self.rates,
            "killed": self.killed,
            "connected": self.connected,
        }
        return json.dumps(data, sort_keys=True).encode()

    def opposing(self, client: int, symbol: int, side: str) -> int | None:
        other = "Sell" if side == "Buy" else "Buy"
        prices = self.prices.get((client, symbol, other))
        if not prices:
            return None
        return min(prices) if side == "Buy" else max(prices)

    def rate(self, client: int, now: int) -> int:
        window = self.limits.rate_window_ns
        if self.limits.rate_limit_mode == "sliding-window":
            kept = self.rates.get(client, [])
            kept = kept[bisect_right(kept, now - window):] + [now]
            self.rates[client] = kept
            return len(kept)
        start, count = self.rates.get(client, (None, 0))
        if start is None or now - start >= window:
            start, count = now, 0
        self.rates[client] = [start, count + 1]
        return count + 1

    def release(self, client_order: int) -> None:
        order = self.working.pop(client_order, None)
        if order:
            self._count(order, -1)
            self.bound.pop(order["exchange"], None)

    def report(self, m: dict) -> None:
        target = m["client_order_id"]
        if not target:
            return
        known = target
        if known not in self.working:
            known = self.bound.get(m["exchange_order_id"])
            if known not in self.working:
                return
        if m["terminal"] or m["quantity"] <= 0:
            self.release(target)
            return
        order = self.working[known]
        exchange = m["exchange_order_id"]
        if exchange and exchange != order["exchange"]:
            self.bound.pop(order["exchange"], None)
            order["exchange"] = exchange
            self.bound[exchange] = known
        self.change(order, m["price_ticks"] or order["price"], m["quantity"])

    def change(self, order: dict, price: int, quantity: int) -> None:
        self._count(order, -1)
        order["price"], order["quantity"] = price, quantity
        self._count(order, 1)

    def control(self, kind: str) -> list[tuple[int, dict, str, str]]:
        """Apply a control message; returns the working orders it cancels."""
        if kind == "reconnect":
            self.connected = True
            return []
        if kind == "disconnect":
            if not self.connected:
                return []
            self.connected = False
            if not self.limits.cancel_on_disconnect:
                return []
            reason, name = "Disconnected", "disconnect_cancel"
        else:
            self.killed = True
            reason, name = "KillSwitch", "kill_switch_cancel"
        gone = [(k, o, reason, name) for k, o in sorted(self.working.items())]
        self.working, self.bound, self.open, self.prices = {}, {}, {}, {}
        return gone

    def sized(self, m: dict, symbol: int, side: str, client: int, limit: bool, existing: int):
        """Rules shared by new orders and replaces, from the size rule on."""
        lim, qty, price = self.limits, m["quantity"], m["price_ticks"]
        if qty > lim.max_order_quantity:
            return "max_order_quantity", "MaxOrderQuantity", lim.max_order_quantity, qty
        reference = m["reference_price_ticks"]
        stale = lim.stale_after_ns
        if reference is None:
            return "stale_market_data", "StaleMarketData", stale, 0
        age = m["timestamp_ns"] - m["reference_ns"]
        if stale > 0 and age > stale:
            return "stale_market_data", "StaleMarketData", stale, age
        away = abs(price - reference)
        if limit and away > lim.price_band_ticks:
            return "price_band", "PriceBand", lim.price_band_ticks, away
        value = abs((price if limit else reference) * qty)
        if value > lim.max_notional_ticks:
            return "max_notional", "MaxNotional", lim.max_notional_ticks, value
        if lim.enable_self_trade_prevention and not m["post_only"]:
            best = self.opposing(client, symbol, side)
            if best is not None and (
                not limit or (price >= best if side == "Buy" else price <= best)
            ):
                return "self_trade_prevention", "SelfTradePrevention", price, best
        if lim.max_open_order_quantity > 0 and limit and m["rests"]:
            ahead = self.open.get(symbol, 0) - existing + qty
            if ahead > lim.max_open_order_quantity:
                return (
                    "max_open_order_quantity",
                    "MaxOpenOrderQuantity",
                    lim.max_open_order_quantity,
                    ahead,
                )
        held = abs(m["position"] + (qty if side == "Buy" else -qty))
        if held > lim.max_position_per_symbol:
            return "max_position", "MaxPosition", lim.max_position_per_symbol, held
        gross = value + m["exposure_base"]
        if gross > lim.max_gross_exposure_ticks:
            return "max_gross_exposure", "MaxGrossExposure", lim.max_gross_exposure_ticks, gross
        return "accepted", "None", lim.max_notional_ticks, value

    def gated(self):
        if self.killed:
            return "kill_switch", "KillSwitch", 0, 0
        if not self.connected and self.limits.disconnect_order_policy == "reject-new-orders":
            return "disconnected", "Disconnected", 0, 0
        return None

    def throttled(self, client: int, now: int):
        if self.limits.rate_limited:
            seen = self.rate(client, now)
            allowed = self.limits.max_messages_per_window
            if seen > allowed:
                return self.limits.rate_check_name, "MessageRateLimit", allowed, seen
        return None

    def new_order(self, m: dict):
        limit = m["order_type"] == "Limit"
        verdict = self.gated() or self.throttled(m["client_id"], m["timestamp_ns"])
        if verdict is None and m["quantity"] <= 0:
            verdict = "invalid_quantity", "InvalidQuantity", 0, m["quantity"]
        if verdict is None and limit and m["price_ticks"] <= 0:
            verdict = "invalid_price", "InvalidPrice", 0, m["price_ticks"]
        if verdict is None and m["client_order_id"] in self.used:
            verdict = (
                "duplicate_client_order_id", "DuplicateClientOrderId", 0, m["client_order_id"],
            )
        if verdict is None:
            verdict = self.sized(m, m["symbol_id"], m["side"], m["client_id"], limit, 0)
        if verdict[1] == "None":
            self.accept(m)
            tracks = (
                self.limits.max_open_order_quantity > 0
                or self.limits.enable_self_trade_prevention
            )
            if limit and m["rests"] and tracks:
                order = {
                    "client": m["client_id"],
                    "symbol": m["symbol_id"],
                    "side": m["side"],
                    "price": m["price_ticks"],
                    "quantity": m["quantity"],
                    "exchange": 0,
                }
                self.working[m["client_order_id"]] = order
                self._count(order, 1)
        return m["symbol_id"], m["side"], verdict

    def replace_order(self, m: dict):
        verdict = self.gated()
        if verdict is None and m["quantity"] <= 0:
            verdict = "replace_invalid_quantity", "InvalidQuantity", 0, m["quantity"]
        if verdict is None and m["price_ticks"] <= 0:
            verdict = "replace_invalid_price", "InvalidPrice", 0, m["price_ticks"]
        if verdict is None and m["client_order_id"] in self.used:
            verdict = (
                "replace_duplicate_client_order_id",
                "DuplicateClientOrderId",
                0,
                m["client_order_id"],
            )
        order = self.working.get(self.bound.get(m["exchange_order_id"]))
        if verdict is None and order is None:
            verdict = "unknown_replace_order_id", "UnknownOrder", 0, m["exchange_order_id"]
        if verdict is not None:
            return 0, "None", verdict
        verdict = self.throttled(order["client"], m["timestamp_ns"]) or self.sized(
            m, order["symbol"], order["side"], order["client"], True, order["quantity"]
        )
        if verdict[1] == "None":
            self.change(order, m["price_ticks"], m["quantity"])
            self.accept(m)
        return order["symbol"], order["side"], ("replace_" + verdict[0], *verdict[1:])

    def accept(self, m: dict) -> None:
        if m["id_repeats"]:
            self.used.add(m["client_order_id"])


MESSAGE_COLUMNS = (
    "scope", "arrival", "kind", "timestamp_ns", "client_order_id", "exchange_order_id",
    "client_id", "symbol_id", "side", "order_type", "price_ticks", "quantity", "terminal",
    "post_only", "rests", "id_repeats", "reference_price_ticks", "reference_ns",
    "position", "exposure_base",
)


def message_stream(
    requests: DataFrame,
    reports: DataFrame | None = None,
    replaces: DataFrame | None = None,
    controls: DataFrame | None = None,
) -> DataFrame:
    """One table of messages in ``arrival`` order per ``scope`` (an account or gateway).

    Each input carries scope and arrival; requests and replaces are enriched (reference,
    position, exposure).
    """
    def shaped(df: DataFrame, kind, given: dict | None = None) -> DataFrame:
        types = {
            "kind": "string", "side": "string", "order_type": "string", "terminal": "boolean",
            "post_only": "boolean", "rests": "boolean",
            "id_repeats": "boolean",
        }
        defaults = {
            "kind": kind, "post_only": F.lit(False), "rests": F.lit(True),
            "terminal": F.lit(False), "id_repeats": F.lit(False),
        } | (given or {})
        return df.select(
            *[
                (defaults[c] if c in defaults and c not in df.columns else
                 F.col(c) if c in df.columns else F.lit(None))
                .cast(types.get(c, "bigint")).alias(c)
                for c in MESSAGE_COLUMNS
            ]
        )

    ids = requests.select("scope", "client_order_id")
    if replaces is not None:
        ids = ids.unionByName(replaces.select("scope", "client_order_id"))
    repeated = (
        ids.groupBy("scope", "client_order_id")
        .agg((F.count(F.lit(1)) > 1).alias("id_repeats"))
        .filter("id_repeats")
    )
    flag = lambda df: df.join(repeated, ["scope", "client_order_id"], "left").withColumn(
        "id_repeats", F.coalesce("id_repeats", F.lit(False))
    )
    parts = [shaped(flag(requests), F.lit("new"))]
    if reports is not None:
        terminal = (F.col("exec_type") == "Rejected") | F.col("order_status").isin(
            "Rejected", "Canceled", "Filled"
        )
        parts.append(
            shaped(
                reports.select(
                    "scope", "arrival", "timestamp_ns", "client_order_id", "exchange_order_id",
                    terminal.alias("terminal"),
                    F.col("remaining_quantity").alias("quantity"),
                    F.col("resting_price_ticks").alias("price_ticks"),
                ),
                F.lit("report"),
            )
        )
    if replaces is not None:
        renamed = flag(replaces).withColumnsRenamed(
            {"new_price_ticks": "price_ticks", "new_quantity": "quantity"}
        )
        parts.append(shaped(renamed, F.lit("replace")))
    if controls is not None:
        parts.append(shaped(controls.withColumnRenamed("control", "kind"), F.col("kind")))
    stream = parts[0]
    for part in parts[1:]:
        stream = stream.unionByName(part)
    return stream


def decide_orders(
    messages: DataFrame, limits: RiskLimits, block_rows: int = 100_000
) -> DataFrame:
    """Exact decisions, one audit row per new order, replace and mass-cancelled order.

    The scope is the reach of duplicate ids and rates: group by account or gateway. Blocks of
    one scope run in parallel and are re-run only where their entry state changed.
    """
    settings = asdict(limits)

    def fold(state: bytes, rows: pa.Table):
        gate = _Gate(RiskLimits(**settings), state)
        out: dict[str, list] = {name.split()[0]: [] for name in _AUDIT_OUT.split(", ")}

        def write(m, client_order, symbol, side, verdict):
            name, reason, limit, observed = verdict
            values = (
                m["scope"], m["arrival"], m["timestamp_ns"], client_order, symbol, side,
                reason == "None", reason, name, limit, observed,
            )
            for column, value in zip(out, values, strict=True):
                out[column].append(value)

        for m in rows.to_pylist():
            kind = m["kind"]
            if kind == "new":
                write(m, m["client_order_id"], *gate.new_order(m))
            elif kind == "replace":
                write(m, m["client_order_id"], *gate.replace_order(m))
            elif kind == "report":
                gate.report(m)
            else:
                for client_order, order, reason, name in gate.control(kind):
                    write(
                        m, client_order, order["symbol"], order["side"],
                        (name, reason, 0, order["quantity"]),
                    )
        return out, gate.dump()

    return block_fold(
        messages,
        ["scope"],
        ["arrival"],
        block_of("arrival", block_rows),
        fold,
        _AUDIT_OUT,
        label="decisions",
    )


