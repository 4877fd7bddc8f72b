"""DuckDB expressions for byte streams and their FNV-1a chain, for the twins of checksums.

The chain is folded byte by byte, with none of the block decomposition of the Spark side.
"""

from tickloom import schema
from tickloom.functions import fnv

STEP = f"(xor(h, x) * {fnv.PRIME}::HUGEINT) % {2**64}::HUGEINT"


def little(value: str, width: int) -> str:
    """Little-endian bytes of a whole number."""
    return "[" + ", ".join(f"(({value}) >> {8 * i}) & 255" for i in range(width)) + "]"


def code(value: str, vocabulary: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{word}' THEN {number}" for word, number in vocabulary.items())
    return f"[CASE {value} {cases} END]"


def text(value: str) -> str:
    """Length-prefixed ASCII text."""
    letters = f"list_transform(range(strlen({value})), lambda i: ord(({value})[i + 1]))"
    return f"list_concat({little(f'strlen({value})', 8)}, {letters})"


def joined(*parts: str) -> str:
    return "flatten([" + ", ".join(f"CAST({p} AS HUGEINT[])" for p in parts) + "])"


def chain(data: str, seed: str = str(fnv.OFFSET)) -> str:
    """FNV-1a state after the bytes of a list."""
    return f"list_reduce({data}, lambda h, x: {STEP}, CAST({seed} AS HUGEINT))"


def ordered_chain(data: str, order: str, where: str = "") -> str:
    """Aggregate: the chain over the byte lists of a group in order, as text."""
    kept = f" FILTER ({where})" if where else ""
    stream = f"flatten(coalesce(list({data} ORDER BY {order}){kept}, []))"
    return f"CAST({chain(stream)} AS VARCHAR)"


EVENT = joined(
    little("timestamp_ns", 8), little("sequence_number", 8), little("symbol_id", 4),
    code("event_type", schema.EVENT_TYPES), code("side", schema.SIDES),
    little("price_ticks", 8), little("quantity", 8), little("order_id", 8),
    little("trade_id", 8), little("flags", 4),
)

AUDIT = joined(
    little("timestamp_ns", 8), little("client_order_id", 8), little("symbol_id", 4),
    code("side", schema.SIDES), "[CASE WHEN accepted THEN 1 ELSE 0 END]",
    code("reject_reason", schema.REJECT_REASONS), text("check_name"),
    little("limit_value", 8), little("observed_value", 8),
)

DIAGNOSTIC = joined(
    little("event_index", 8), little("sequence_number", 8), little("symbol_id", 4),
    code("severity", schema.SEVERITIES), text("reason"),
)


def books(symbols: str, live: str) -> str:
    """CTE body: symbol_id and the checksum of its book; ``live`` holds the resting orders."""
    rank = "CASE WHEN side = 'Buy' THEN -price_ticks ELSE price_ticks END"
    return f"""
  WITH lv AS (SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS total,
      count(*) AS size FROM {live} GROUP BY ALL),
  sides AS (SELECT y.symbol_id, s.side, s.code,
      (SELECT count(*) FROM lv WHERE lv.symbol_id = y.symbol_id AND lv.side = s.side) AS n
    FROM {symbols} y, (VALUES ('Buy', 1), ('Sell', 2)) s(side, code)),
  stream AS (
    SELECT symbol_id, 0 AS p1, 0 AS p2, 0 AS p3, 0 AS p4,
      {joined(little("symbol_id", 4))} AS bytes FROM {symbols}
    UNION ALL
    SELECT symbol_id, code, 0, 0, 0, {joined("[code]", little("n", 8))} FROM sides
    UNION ALL
    SELECT symbol_id, CASE WHEN side = 'Buy' THEN 1 ELSE 2 END, 1, {rank}, -1,
      {joined(little("price_ticks", 8), little("total", 8), little("size", 8))} FROM lv
    UNION ALL
    SELECT symbol_id, CASE WHEN side = 'Buy' THEN 1 ELSE 2 END, 1, {rank}, head_index,
      {joined(little("order_id", 8), little("0", 8), little("symbol_id", 4),
              little("quantity", 8), little("set_ts", 8), little("set_seq", 8))} FROM {live})
  SELECT symbol_id, {ordered_chain("bytes", "p1, p2, p3, p4")} AS final_book_checksum
  FROM stream GROUP BY symbol_id"""


def combined(books_table: str) -> str:
    """Scalar: the checksum over all books of a table, in symbol order."""
    one = joined(little("symbol_id", 4), little("final_book_checksum::HUGEINT", 8))
    head = joined(little("count(*)", 8))
    return f"""(SELECT {chain(f"list_concat({head}, flatten(list({one} ORDER BY symbol_id)))")}
      FROM {books_table})"""
