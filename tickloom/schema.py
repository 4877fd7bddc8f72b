"""Table schemas and vocabularies.

All vocabularies below are fixed values: their spelling and codes are part of the
event-log, audit-log and report formats.
"""

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DECIMAL(20,0)": T.DecimalType(20, 0),
}


def _struct(spec: str) -> T.StructType:
    """Flat schema from ``name TYPE, ...``; usable before a session exists."""
    pairs = (column.split() for column in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENT = _struct(
    "timestamp_ns BIGINT, sequence_number BIGINT, symbol_id BIGINT, event_type STRING, "
    "side STRING, price_ticks BIGINT, quantity BIGINT, order_id BIGINT, trade_id BIGINT, "
    "flags BIGINT"
)
EVENT_COLUMNS = EVENT.fieldNames()

# An event with its position in the log. `event_index` is unique per symbol and gives the
# processing order; Spark keeps no file order, so every order-dependent operator sorts by it.
INDEXED_EVENT = T.StructType(EVENT.fields + [T.StructField("event_index", T.LongType())])

AUDIT = _struct(
    "timestamp_ns BIGINT, client_order_id BIGINT, symbol_id BIGINT, side STRING, "
    "accepted BOOLEAN, reject_reason STRING, check_name STRING, limit_value BIGINT, "
    "observed_value BIGINT, checksum DECIMAL(20,0)"
)

ORDER_REQUEST = _struct(
    "client_order_id BIGINT, client_id BIGINT, symbol_id BIGINT, side STRING, "
    "order_type STRING, price_ticks BIGINT, quantity BIGINT, timestamp_ns BIGINT"
)
REPLACE_REQUEST = _struct(
    "client_order_id BIGINT, exchange_order_id BIGINT, new_price_ticks BIGINT, "
    "new_quantity BIGINT, timestamp_ns BIGINT"
)
EXECUTION_REPORT = _struct(
    "client_order_id BIGINT, exchange_order_id BIGINT, symbol_id BIGINT, side STRING, "
    "order_status STRING, exec_type STRING, filled_quantity BIGINT, remaining_quantity BIGINT, "
    "last_fill_quantity BIGINT, last_fill_price_ticks BIGINT, average_price_ticks BIGINT, "
    "resting_price_ticks BIGINT, timestamp_ns BIGINT"
)
MARKET_DATA = _struct("symbol_id BIGINT, reference_price_ticks BIGINT, timestamp_ns BIGINT")
POSITION = _struct("symbol_id BIGINT, quantity BIGINT, average_cost_ticks BIGINT")
MARK = _struct("symbol_id BIGINT, mark_ticks BIGINT")
FILL = _struct("symbol_id BIGINT, side STRING, quantity BIGINT, price_ticks BIGINT")

# --- fixed values -----------------------------------------------------------------------
EVENT_TYPES = {
    "Add": 1,
    "Cancel": 2,
    "Replace": 3,
    "Execute": 4,
    "Trade": 5,
    "Snapshot": 6,
    "Heartbeat": 7,
}
SIDES = {"None": 0, "Buy": 1, "Sell": 2}
ORDER_TYPES = {"Limit": 1, "Market": 2}
TIME_IN_FORCE = {"Gtc": 1, "Ioc": 2, "Fok": 3}
ORDER_STATUS = {
    "New": 1,
    "PartiallyFilled": 2,
    "Filled": 3,
    "Canceled": 4,
    "Replaced": 5,
    "Rejected": 6,
}
EXEC_TYPES = {"New": 1, "Trade": 2, "Canceled": 3, "Replaced": 4, "Rejected": 5}
REJECT_REASONS = {
    "None": 0,
    "InvalidQuantity": 1,
    "InvalidPrice": 2,
    "DuplicateClientOrderId": 3,
    "UnknownOrder": 4,
    "KillSwitch": 5,
    "MaxOrderQuantity": 6,
    "MaxNotional": 7,
    "MaxPosition": 8,
    "MaxGrossExposure": 9,
    "PriceBand": 10,
    "StaleMarketData": 11,
    "Unsupported": 12,
    "InternalError": 13,
    "MaxOpenOrderQuantity": 14,
    "MessageRateLimit": 15,
    "SelfTradePrevention": 16,
    "Disconnected": 17,
    "MaxPortfolioGrossExposure": 18,
    "MaxPortfolioNetExposure": 19,
    "MaxSymbolConcentration": 20,
    "MaxPortfolioLoss": 21,
    "PostOnlyWouldCross": 22,
    "FokNotFillable": 23,
}
# Audit lines never carry the last two reasons, so reading them back rejects those.
AUDIT_REJECT_REASONS = {k: v for k, v in REJECT_REASONS.items() if v <= 21}
SEVERITIES = {"info": 1, "warning": 2, "error": 3}
LATENCY_STAGES = {
    "replay": 1,
    "book_update": 2,
    "matching": 3,
    "risk": 4,
    "strategy": 5,
    "inference": 6,
    "total": 7,
}
LIFECYCLE_EVENTS = {
    "connect": 1,
    "disconnect": 2,
    "reconnect": 3,
    "order_accepted": 4,
    "cancel_requested": 5,
    "cancel_acknowledged": 6,
    "cancel_rejected": 7,
    "order_filled": 8,
}
ORDER_STATES = {"accepted": 1, "pending_cancel": 2, "canceled": 3, "filled": 4}
RATE_LIMIT_MODES = {"fixed-window": 1, "sliding-window": 2}
RATE_LIMIT_MODE_ALIASES = {
    "fixed": "fixed-window",
    "fixed-window": "fixed-window",
    "sliding": "sliding-window",
    "sliding-window": "sliding-window",
}
DISCONNECT_POLICIES = {"reject-new-orders": 1, "allow-new-orders": 2}
FLAG_SNAPSHOT_BEGIN = 1
FLAG_SNAPSHOT_END = 2
FEATURE_NAMES = (
    "spread_ticks",
    "mid_price_ticks",
    "top_level_imbalance",
    "top_level_quantity",
)
FEATURE_VERSION = 1
