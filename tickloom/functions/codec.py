"""Column codecs: vocabularies, strict numbers, byte layouts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom import schema

# One-letter aliases accepted in CSV logs.
EVENT_ALIASES = {
    "A": "Add",
    "C": "Cancel",
    "R": "Replace",
    "E": "Execute",
    "T": "Trade",
    "S": "Snapshot",
    "H": "Heartbeat",
}
SIDE_ALIASES = {"B": "Buy", "S": "Sell", "N": "None", "": "None"}

WHITESPACE = " \t\r\n"


def lookup(column: Column, mapping: dict) -> Column:
    """Value of a small vocabulary, null when unknown; evaluated in the JVM."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.create_map(*pairs)[column]


def decode_event_type(text: Column) -> Column:
    names = {name: name for name in schema.EVENT_TYPES}
    return lookup(F.trim(text, F.lit(WHITESPACE)), names | EVENT_ALIASES)


def decode_side(text: Column) -> Column:
    names = {name: name for name in schema.SIDES}
    return lookup(F.trim(text, F.lit(WHITESPACE)), names | SIDE_ALIASES)


def code_of(column: Column, vocabulary: dict[str, int]) -> Column:
    """Numeric code of a vocabulary word."""
    return lookup(column, vocabulary)


def word_of(column: Column, vocabulary: dict[str, int]) -> Column:
    """Vocabulary word of a numeric code."""
    return lookup(column.cast("int"), {code: word for word, code in vocabulary.items()})


def opposite_side(side: Column) -> Column:
    return F.when(side == "Buy", "Sell").when(side == "Sell", "Buy").otherwise("None")


def strict_integer(text: Column, kind: str = "bigint") -> Column:
    """Whole-string integer, else null: no blanks, no plus sign, no fraction."""
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast(kind))


def big(value: int) -> Column:
    """Literal beyond the signed 64-bit range."""
    return F.lit(str(value)).cast("decimal(38,0)")


def strict_unsigned(text: Column, limit: int) -> Column:
    """Whole-string non-negative integer of at most ``limit``, else null."""
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= big(limit), value)


def rate_limit_mode(text: Column) -> Column:
    """Canonical rate-limit mode of an alias, null when unknown."""
    token = F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit("-"))
    return lookup(token, schema.RATE_LIMIT_MODE_ALIASES)


def flag_set(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def remaining_quantity(original: Column, filled: Column) -> Column:
    return F.greatest(original - filled, F.lit(0))


# --- little-endian payloads for checksums ----------------------------------------------


def le_hex(column: Column, width: int) -> Column:
    """Little-endian hex text of an integer in ``width`` bytes (two's complement)."""
    digits = F.lpad(F.hex(column.cast("bigint")), 16, "0")
    last = 15
    return F.concat(*[F.substring(digits, last - 2 * i, 2) for i in range(width)])


def le_hex_unsigned(column: Column) -> Column:
    """Little-endian hex text of an unsigned 64-bit value held as DECIMAL(20,0)."""
    wrapped = F.when(column >= big(2**63), column - big(2**64)).otherwise(column)
    return le_hex(wrapped.cast("bigint"), 8)


def text_hex(column: Column) -> Column:
    """Length-prefixed UTF-8 text as hex."""
    raw = F.encode(column, "UTF-8")
    return F.concat(le_hex(F.octet_length(raw), 8), F.hex(raw))


def payload(*parts: Column) -> Column:
    """Binary payload from hex parts."""
    return F.unhex(F.concat(*parts))


def event_layout() -> dict[str, tuple[Column, str]]:
    """The 58 checksum bytes of an event row as fixed-width little-endian fields."""
    return {
        "timestamp_ns": (F.col("timestamp_ns"), "<i8"),
        "sequence_number": (F.col("sequence_number"), "<i8"),
        "symbol_id": (F.col("symbol_id"), "<u4"),
        "event_type": (code_of(F.col("event_type"), schema.EVENT_TYPES), "u1"),
        "side": (code_of(F.col("side"), schema.SIDES), "u1"),
        "price_ticks": (F.col("price_ticks"), "<i8"),
        "quantity": (F.col("quantity"), "<i8"),
        "order_id": (F.col("order_id"), "<i8"),
        "trade_id": (F.col("trade_id"), "<i8"),
        "flags": (F.col("flags"), "<u4"),
    }


def audit_payload() -> Column:
    """Checksum bytes of an audit row; null when a word is unknown."""
    return payload(
        le_hex(F.col("timestamp_ns"), 8),
        le_hex(F.col("client_order_id"), 8),
        le_hex(F.col("symbol_id"), 4),
        le_hex(code_of(F.col("side"), schema.SIDES), 1),
        le_hex(F.col("accepted").cast("int"), 1),
        le_hex(code_of(F.col("reject_reason"), schema.REJECT_REASONS), 1),
        text_hex(F.col("check_name")),
        le_hex(F.col("limit_value"), 8),
        le_hex(F.col("observed_value"), 8),
    )


def diagnostic_payload() -> Column:
    """Checksum bytes of a replay diagnostic (severity info 1, warning 2, error 3)."""
    return payload(
        le_hex(F.col("event_index"), 8),
        le_hex(F.col("sequence_number"), 8),
        le_hex(F.col("symbol_id"), 4),
        le_hex(code_of(F.col("severity"), schema.SEVERITIES), 1),
        text_hex(F.col("reason")),
    )


def report_payload() -> Column:
    """Checksum bytes of an execution report; needs ``reject_reason``."""
    return payload(
        le_hex(F.col("client_order_id"), 8),
        le_hex(F.col("exchange_order_id"), 8),
        le_hex(F.col("symbol_id"), 4),
        le_hex(code_of(F.col("side"), schema.SIDES), 1),
        le_hex(code_of(F.col("order_status"), schema.ORDER_STATUS), 1),
        le_hex(code_of(F.col("exec_type"), schema.EXEC_TYPES), 1),
        *[
            le_hex(F.col(c), 8)
            for c in (
                "filled_quantity",
                "remaining_quantity",
                "last_fill_quantity",
                "last_fill_price_ticks",
                "average_price_ticks",
                "resting_price_ticks",
                "timestamp_ns",
            )
        ],
        le_hex(code_of(F.col("reject_reason"), schema.REJECT_REASONS), 1),
    )


def lifecycle_payload() -> Column:
    """Checksum bytes of an order-lifecycle event."""
    return payload(
        le_hex(F.col("timestamp_ns"), 8),
        le_hex(code_of(F.col("event_type"), schema.LIFECYCLE_EVENTS), 1),
        le_hex(F.col("order_id"), 8),
        le_hex(F.col("client_order_id"), 8),
        le_hex(F.col("symbol_id"), 4),
        le_hex(code_of(F.col("side"), schema.SIDES), 1),
        le_hex(F.col("quantity"), 8),
    )
