"""Market-event tables derived from the driver's TPC-H-like tables.

Each view exists twice: as a Spark DataFrame and as DuckDB SQL for the comparison. The two
are written separately on purpose, so agreement means something.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators.scan import number_rows
from tickloom.session import staged_once

DAY_NS = 86_400 * 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_stream(staged: DataFrame) -> DataFrame:
    """The same staged table as a file stream."""
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    return staged.sparkSession.readStream.schema(staged.schema).parquet(folder)


def nanos(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


_LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a dense ``order_id``; (orderkey, linenumber) repeats in the data."""
    return staged_once(
        spark,
        sf_dir,
        "lines",
        lambda: number_rows(
            table(spark, sf_dir, "lineitem").select(*_LINE_ORDER), [], _LINE_ORDER, "order_id"
        ),
    )


def _flow(spark: SparkSession, sf_dir: str, symbols: int) -> DataFrame:
    buy = F.col("l_linenumber") % 2 == 1
    away = lambda shift: 1 + (F.col("l_partkey") + shift) % 50
    price = lambda d: F.when(buy, 1000 - d).otherwise(1000 + d).cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    t = nanos("l_shipdate")
    flag = F.col("l_returnflag")

    def row(when, kind: str, step: int, days: int, px, quantity, trade_id):
        event = F.struct(
            (t + days * DAY_NS).alias("timestamp_ns"),
            F.lit(kind).alias("event_type"),
            F.lit(step).alias("step"),
            px.alias("price_ticks"),
            quantity.cast("bigint").alias("quantity"),
            trade_id.cast("bigint").alias("trade_id"),
        )
        return F.when(when, event)

    none = F.lit(0)
    events = lines(spark, sf_dir).select(
        (1 + F.col("l_suppkey") % symbols).alias("symbol_id"),
        "order_id",
        F.when(buy, "Buy").otherwise("Sell").alias("side"),
        # Filtered after the generator: an array filter would run uncompiled, line by line.
        F.explode(
            F.array(
                row(F.lit(True), "Add", 0, 0, price(away(0)), q, none),
                row(
                    flag == "A", "Execute", 1, 5, price(away(0)),
                    F.expr("(cast(l_quantity as bigint) + 1) div 2"), F.col("order_id"),
                ),
                row(flag == "R", "Cancel", 2, 10, price(away(0)), none, none),
                row(
                    (flag == "N") & (F.col("l_linestatus") == "F"), "Replace", 2, 7,
                    price(away(7)), q + 1, none,
                ),
            )
        ).alias("e"),
    ).filter("e IS NOT NULL")
    numbered = number_rows(
        events.select("symbol_id", "order_id", "side", "e.*"),
        ["symbol_id"],
        ["timestamp_ns", "order_id", "step"],
        "sequence_number",
    )
    return numbered.select(
        *[c for c in schema.EVENT_COLUMNS if c != "flags"],
        F.lit(0).cast("bigint").alias("flags"),
        F.col("sequence_number").alias("event_index"),
        "step",
    )


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean event log of eight busy symbols."""
    return staged_once(spark, sf_dir, "order_flow", lambda: _flow(spark, sf_dir, 8))


def supplier_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, one symbol per supplier (many small logs)."""
    return staged_once(
        spark, sf_dir, "supplier_flow", lambda: _flow(spark, sf_dir, 1_000_000_007)
    )


def _picked(kind: int):
    return (F.col("order_id") % 211 == 7) & (F.expr("order_id div 211") % 10 == kind)


def dirty_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(supplier_flow(spark, sf_dir))


def damaged(flow: DataFrame) -> DataFrame:
    """A flow (batch or stream) with one of ten kinds of damage on some orders."""
    add, cut, cancel = F.col("step") == 0, F.col("step") == 1, F.col("event_type") == "Cancel"
    broken = flow.filter(~(_picked(0) & add)).withColumns(
        {
            "quantity": F.when(_picked(1) & add, 0)
            .when(_picked(7) & cut, F.col("quantity") * 10)
            .otherwise(F.col("quantity")).cast("bigint"),
            "price_ticks": F.when(_picked(2) & add, -1)
            .when(_picked(9) & add, -5)
            .otherwise(F.col("price_ticks")).cast("bigint"),
            "side": F.when(_picked(3) & add, "None").otherwise(F.col("side")),
            "_id": F.when(_picked(4) & add, 0)
            .when(_picked(6) & cancel, F.col("order_id") + 1_000_000_000)
            .otherwise(F.col("order_id")).cast("bigint"),
            "_type": F.when(_picked(5) & cancel, "Add")
            .when(_picked(9) & add, "Heartbeat")
            .otherwise(F.col("event_type")),
            "_quantity": F.when(_picked(5) & cancel, 1),
            "timestamp_ns": F.when(
                _picked(8) & add, F.col("timestamp_ns") - 400 * DAY_NS
            ).otherwise(F.col("timestamp_ns")),
        }
    )
    return broken.withColumns(
        {
            "order_id": F.col("_id"),
            "event_type": F.col("_type"),
            "quantity": F.coalesce("_quantity", "quantity").cast("bigint"),
        }
    ).select(*schema.INDEXED_EVENT.fieldNames())


def snapshot_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_flow with a two-order snapshot block after every 4,999th event of a symbol.

    Positions are widened tenfold to make room for the inserted rows.
    """
    flow = order_flow(spark, sf_dir).withColumn("event_index", F.col("event_index") * 10)
    at = flow.filter(F.col("sequence_number") % 4999 == 0)

    def inserted(offset: int, side: str, price: int, quantity: int, order, flags: int):
        return F.struct(
            F.lit(offset).alias("offset"),
            F.lit(side).alias("side"),
            F.lit(price).cast("bigint").alias("price_ticks"),
            F.lit(quantity).cast("bigint").alias("quantity"),
            order.cast("bigint").alias("order_id"),
            F.lit(flags).cast("bigint").alias("flags"),
        )

    base = F.col("sequence_number") * 10 + 5_000_000_000
    block = at.select(
        "timestamp_ns",
        "sequence_number",
        "symbol_id",
        "event_index",
        F.explode(
            F.array(
                inserted(1, "None", 0, 0, F.lit(0), 1),
                inserted(2, "Buy", 990, 200, base, 0),
                inserted(3, "Sell", 1010, 150, base + 1, 0),
                inserted(4, "None", 0, 0, F.lit(0), 2),
            )
        ).alias("s"),
    ).select(
        "timestamp_ns",
        "sequence_number",
        "symbol_id",
        F.lit("Snapshot").alias("event_type"),
        "s.side",
        "s.price_ticks",
        "s.quantity",
        "s.order_id",
        F.lit(0).cast("bigint").alias("trade_id"),
        "s.flags",
        (F.col("event_index") + F.col("s.offset")).alias("event_index"),
    )
    return flow.select(*schema.INDEXED_EVENT.fieldNames()).unionByName(block)


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-order messages with a dense arrival number over (timestamp, id)."""

    def build() -> DataFrame:
        orders = table(spark, sf_dir, "orders").select(
            (F.col("o_orderkey") + 1).alias("client_order_id"),
            (1 + F.col("o_custkey") % 50).alias("client_id"),
            (1 + F.col("o_orderkey") % 8).alias("symbol_id"),
            F.when(F.expr("(o_orderkey div 8) % 2") == 0, "Buy").otherwise("Sell").alias("side"),
            F.lit("Limit").alias("order_type"),
            (950 + (F.col("o_orderkey") * 37) % 101).alias("price_ticks"),
            (1 + F.col("o_custkey") % 200).alias("quantity"),
            nanos("o_orderdate").alias("timestamp_ns"),
        )
        return number_rows(orders, [], ["timestamp_ns", "client_order_id"], "arrival")

    return staged_once(spark, sf_dir, "order_requests", build)


def market_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference price per symbol and ship day."""
    return (
        lines(spark, sf_dir)
        .groupBy((1 + F.col("l_suppkey") % 8).alias("symbol_id"), nanos("l_shipdate").alias("timestamp_ns"))
        .agg((980 + F.sum("l_partkey") % 41).alias("reference_price_ticks"))
        .select("symbol_id", "reference_price_ticks", "timestamp_ns")
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills per symbol in order of ``fill_index``; symbols are suppliers modulo 64."""
    return lines(spark, sf_dir).select(
        (1 + F.col("l_suppkey") % 64).alias("symbol_id"),
        F.when(F.col("l_partkey") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.lit(900) + F.col("l_partkey") % 200).cast("bigint").alias("price_ticks"),
        F.col("order_id").alias("fill_index"),
    )


def depth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw depth capture: one JSON line per lineitem row, with every kind of bad input."""
    n = F.col("order_id")
    name = F.concat(F.lit("SYM"), (F.col("l_suppkey") % 4).cast("string"))
    pair = lambda price, size: F.concat(F.lit('["'), price, F.lit('","'), size, F.lit('"]'))
    text = lambda c: c.cast("string")
    size = F.when(F.col("l_returnflag") == "R", "0").otherwise(
        F.concat(text(F.col("l_quantity").cast("bigint")), F.lit(".25"))
    )
    bid1 = F.when(n % 613 == 0, "abc").otherwise(
        F.concat(text(1000 - F.col("l_partkey") % 50), F.lit(".5"))
    )
    bid2 = F.concat(text(900 - F.col("l_partkey") % 7), F.lit(".125"))
    ask = F.concat(
        text(F.when(n % 499 == 0, 980).otherwise(1001) + (F.col("l_partkey") + 7) % 50), F.lit(".5")
    )
    ask_size = F.when(n % 617 == 0, "-1").otherwise(size)
    stamp = text(1_600_000_000_000 + n * 10 - F.when(n % 97 == 0, 5000).otherwise(0))
    diff = F.concat(
        F.lit('{"e":"depthUpdate","E":'), stamp, F.lit(',"s":"'),
        F.when(n % 983 == 2, "").otherwise(name), F.lit('","U":'),
        text(n - F.col("l_partkey") % 12), F.lit(',"u":'),
        text(n - F.when(F.col("l_partkey") % 31 == 0, 50).otherwise(0)), F.lit(',"b":['),
        pair(bid2, size), F.lit(","), pair(bid1, size), F.lit('],"a":['),
        pair(ask, ask_size), F.lit("]}"),
    )
    snapshot = F.concat(
        F.lit('{"_captured_at_ns":'), text((F.lit(1_600_000_000_000) + n * 10) * 1_000_000),
        F.lit(',"symbol":"'), name, F.lit('","data":{"lastUpdateId":'), text(n),
        F.lit(',"bids":[["990.5","2.0"],["991.5","1.0"]],"asks":[["1040.5","3.0"]]}}'),
    )
    line = (
        F.when(n == 1, '{"_meta":"capture"}')
        .when(n % 997 == 5, "{bad")
        .when(n % 991 == 3, '{"e":"trade"}')
        .when(n % 500 == 1, snapshot)
        .otherwise(diff)
    )
    return lines(spark, sf_dir).select(n.alias("raw_index"), line.alias("line"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed start position per symbol."""
    return (
        lines(spark, sf_dir)
        .groupBy((1 + F.col("l_suppkey") % 8).alias("symbol_id"))
        .agg((F.sum("l_partkey") % 401 - 200).alias("quantity"))
        .withColumn("average_cost_ticks", F.lit(1000).cast("bigint"))
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly ten-day disconnect and a kill thirty days before the last order."""
    orders = order_requests(spark, sf_dir)
    year = F.year(F.timestamp_micros(F.expr("timestamp_ns div 1000")))
    starts = orders.groupBy(year.alias("year")).agg(F.min("timestamp_ns").alias("start"))
    links = starts.select(
        F.explode(
            F.array(
                F.struct(
                    (F.col("start") + 10 * DAY_NS).alias("timestamp_ns"),
                    F.lit("disconnect").alias("control"),
                ),
                F.struct(
                    (F.col("start") + 20 * DAY_NS).alias("timestamp_ns"),
                    F.lit("reconnect").alias("control"),
                ),
            )
        ).alias("c")
    ).select("c.*")
    kill = orders.agg((F.max("timestamp_ns") - 30 * DAY_NS).alias("timestamp_ns")).withColumn(
        "control", F.lit("kill")
    )
    return links.unionByName(kill).withColumn("scope", F.lit(1).cast("bigint"))


# --- DuckDB twins -----------------------------------------------------------------------

LINES_SQL = """
lines AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus
  ) AS order_id
  FROM lineitem)"""


def flow_sql(name: str, symbols: int) -> str:
    return f"""
{name}_legs AS (
  SELECT 1 + l_suppkey % {symbols} AS symbol_id, order_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'Buy' ELSE 'Sell' END AS side,
    CASE WHEN l_linenumber % 2 = 1 THEN -1 ELSE 1 END AS away,
    1 + l_partkey % 50 AS d1, 1 + (l_partkey + 7) % 50 AS d2,
    CAST(l_quantity AS BIGINT) AS q, epoch_us(l_shipdate) * 1000 AS t,
    l_returnflag, l_linestatus
  FROM lines),
{name}_raw AS (
  SELECT symbol_id, order_id, side, t AS timestamp_ns, 'Add' AS event_type, 0 AS step,
    1000 + away * d1 AS price_ticks, q AS quantity, 0 AS trade_id FROM {name}_legs
  UNION ALL
  SELECT symbol_id, order_id, side, t + 5 * {DAY_NS}, 'Execute', 1,
    1000 + away * d1, (q + 1) // 2, order_id FROM {name}_legs WHERE l_returnflag = 'A'
  UNION ALL
  SELECT symbol_id, order_id, side, t + 10 * {DAY_NS}, 'Cancel', 2,
    1000 + away * d1, 0, 0 FROM {name}_legs WHERE l_returnflag = 'R'
  UNION ALL
  SELECT symbol_id, order_id, side, t + 7 * {DAY_NS}, 'Replace', 2,
    1000 + away * d2, q + 1, 0 FROM {name}_legs
  WHERE l_returnflag = 'N' AND l_linestatus = 'F'),
{name} AS (
  SELECT timestamp_ns,
    row_number() OVER (PARTITION BY symbol_id ORDER BY timestamp_ns, order_id, step)
      AS sequence_number,
    symbol_id, event_type, side, CAST(price_ticks AS BIGINT) AS price_ticks, quantity,
    order_id, CAST(trade_id AS BIGINT) AS trade_id, CAST(0 AS BIGINT) AS flags, step,
    row_number() OVER (PARTITION BY symbol_id ORDER BY timestamp_ns, order_id, step)
      AS event_index
  FROM {name}_raw)"""


ORDER_FLOW_SQL = LINES_SQL + "," + flow_sql("order_flow", 8)
SUPPLIER_FLOW_SQL = LINES_SQL + "," + flow_sql("supplier_flow", 1_000_000_007)

DIRTY_FLOW_SQL = (
    SUPPLIER_FLOW_SQL
    + f""",
dirty_marked AS (
  SELECT *, CASE WHEN order_id % 211 = 7 THEN (order_id // 211) % 10 ELSE -1 END AS dmg
  FROM supplier_flow),
dirty_flow AS (
  SELECT
    CASE WHEN dmg = 8 AND step = 0 THEN timestamp_ns - 400 * {DAY_NS} ELSE timestamp_ns END
      AS timestamp_ns,
    sequence_number, symbol_id,
    CASE WHEN dmg = 5 AND event_type = 'Cancel' THEN 'Add'
         WHEN dmg = 9 AND step = 0 THEN 'Heartbeat' ELSE event_type END AS event_type,
    CASE WHEN dmg = 3 AND step = 0 THEN 'None' ELSE side END AS side,
    CASE WHEN dmg = 2 AND step = 0 THEN -1 WHEN dmg = 9 AND step = 0 THEN -5
         ELSE price_ticks END AS price_ticks,
    CASE WHEN dmg = 1 AND step = 0 THEN 0 WHEN dmg = 7 AND step = 1 THEN quantity * 10
         WHEN dmg = 5 AND event_type = 'Cancel' THEN 1 ELSE quantity END AS quantity,
    CASE WHEN dmg = 4 AND step = 0 THEN 0
         WHEN dmg = 6 AND event_type = 'Cancel' THEN order_id + 1000000000
         ELSE order_id END AS order_id,
    trade_id, flags, event_index
  FROM dirty_marked WHERE NOT (dmg = 0 AND step = 0))"""
)

SNAPSHOT_FLOW_SQL = (
    ORDER_FLOW_SQL
    + """,
snap_rows AS (
  SELECT * FROM (VALUES (1, 'None', 0, 0, -1, 1), (2, 'Buy', 990, 200, 0, 0),
    (3, 'Sell', 1010, 150, 1, 0), (4, 'None', 0, 0, -1, 2)) v(off, sd, px, qy, oid, fl)),
snapshot_flow AS (
  SELECT timestamp_ns, sequence_number, symbol_id, event_type, side, price_ticks, quantity,
    order_id, trade_id, flags, event_index * 10 AS event_index FROM order_flow
  UNION ALL
  SELECT timestamp_ns, sequence_number, symbol_id, 'Snapshot', sd, px, qy,
    CASE WHEN oid < 0 THEN 0 ELSE sequence_number * 10 + 5000000000 + oid END, 0, fl,
    event_index * 10 + off
  FROM order_flow, snap_rows WHERE sequence_number % 4999 = 0)"""
)

# Order states per event; `log` must name a CTE with an `epoch` column.
def states_sql(log: str) -> str:
    return f"""
lived AS (
  SELECT *, sum(CASE WHEN event_type IN ('Add','Replace','Snapshot') THEN 1 ELSE 0 END)
    OVER (PARTITION BY symbol_id, epoch, order_id ORDER BY event_index) AS life
  FROM {log} WHERE order_id <> 0
    AND event_type IN ('Add','Cancel','Replace','Execute','Snapshot')),
headed AS (
  SELECT symbol_id, epoch, order_id, life, event_index AS head_index,
    price_ticks AS rest_price, quantity AS head_quantity, timestamp_ns AS set_ts,
    sequence_number AS set_seq,
    last_value(CASE WHEN event_type <> 'Replace' THEN side END IGNORE NULLS) OVER (
      PARTITION BY symbol_id, epoch, order_id ORDER BY event_index) AS rest_side
  FROM lived WHERE event_type IN ('Add','Replace','Snapshot')),
states AS (
  SELECT l.*, h.rest_price, h.rest_side, h.head_index, h.set_ts, h.set_seq,
    CASE WHEN h.life IS NULL OR
        max(CASE WHEN l.event_type = 'Cancel' AND l.quantity <= 0 THEN 1 ELSE 0 END) OVER w = 1
      THEN 0
      ELSE greatest(h.head_quantity - sum(CASE
        WHEN l.event_type = 'Execute' OR (l.event_type = 'Cancel' AND l.quantity > 0)
        THEN l.quantity ELSE 0 END) OVER w, 0) END AS rest_quantity
  FROM lived l LEFT JOIN headed h USING (symbol_id, epoch, order_id, life)
  WINDOW w AS (PARTITION BY l.symbol_id, l.epoch, l.order_id, l.life ORDER BY l.event_index)),
last_epoch AS (SELECT symbol_id, max(epoch) AS epoch FROM {log} GROUP BY symbol_id),
final_states AS (
  SELECT * FROM states JOIN last_epoch USING (symbol_id, epoch)
  QUALIFY row_number() OVER (PARTITION BY symbol_id, order_id ORDER BY event_index DESC) = 1),
live AS (
  SELECT symbol_id, rest_side AS side, rest_price AS price_ticks, order_id,
    CAST(rest_quantity AS BIGINT) AS quantity, set_ts, set_seq, head_index
  FROM final_states WHERE rest_quantity > 0)"""


DEPTH_SQL = (
    LINES_SQL
    + """,
msg AS (
  SELECT order_id AS i, 'SYM' || (l_suppkey % 4) AS symbol,
    CASE WHEN order_id = 1 THEN 'banner' WHEN order_id % 997 = 5 THEN 'malformed'
      WHEN order_id % 991 = 3 THEN 'unsupported' WHEN order_id % 500 = 1 THEN 'snapshot'
      WHEN order_id % 983 = 2 THEN 'missing' ELSE 'diff' END AS kind,
    (1600000000000 + order_id * 10
      - CASE WHEN order_id % 97 = 0 AND order_id % 500 <> 1 THEN 5000 ELSE 0 END) * 1000000 AS ts,
    order_id - l_partkey % 12 AS u1,
    CASE WHEN order_id % 500 = 1 THEN order_id
      ELSE order_id - CASE WHEN l_partkey % 31 = 0 THEN 50 ELSE 0 END END AS u2,
    l_partkey AS pk, CASE WHEN l_returnflag = 'R' THEN 0
      ELSE CAST(l_quantity AS BIGINT) * 100000000 + 25000000 END AS sz
  FROM lineitem_numbered),
good AS (SELECT * FROM msg WHERE kind IN ('diff', 'snapshot')),
sym AS (SELECT symbol, min(i) AS first_index, row_number() OVER (ORDER BY min(i)) AS symbol_id
  FROM good GROUP BY symbol),
st AS (
  SELECT g.*, symbol_id, lag(ts) OVER w AS prev_ts,
    sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER w AS epoch,
    sum(CASE WHEN kind = 'diff' THEN 1 ELSE 0 END) OVER w AS diffs
  FROM good g JOIN sym USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY i)),
ids AS (
  SELECT *, max(u2) OVER (PARTITION BY symbol, diffs ORDER BY i) AS known FROM st),
lastid AS (SELECT *, lag(known) OVER (PARTITION BY symbol ORDER BY i) AS last_id FROM ids),
leg AS (
  SELECT i, symbol_id, kind, epoch, ts, 1 AS leg, 'Buy' AS side,
    CASE WHEN i % 613 = 0 THEN (900 - pk % 7) * 100000000 + 12500000
      ELSE (1000 - pk % 50) * 100000000 + 50000000 END AS px,
    sz FROM st WHERE kind = 'diff'
  UNION ALL
  SELECT i, symbol_id, kind, epoch, ts, 2, 'Buy',
    CASE WHEN i % 613 = 0 THEN NULL ELSE (900 - pk % 7) * 100000000 + 12500000 END, sz
  FROM st WHERE kind = 'diff'
  UNION ALL
  SELECT i, symbol_id, kind, epoch, ts, 3, 'Sell',
    (CASE WHEN i % 499 = 0 THEN 980 ELSE 1001 END + (pk + 7) % 50) * 100000000 + 50000000,
    CASE WHEN i % 617 = 0 THEN -1 ELSE sz END FROM st WHERE kind = 'diff'
  UNION ALL
  SELECT i, symbol_id, kind, epoch, ts, v.leg, v.side, v.px, v.sz
  FROM st, (VALUES (1, 'Buy', 99150000000, 100000000), (2, 'Buy', 99050000000, 200000000),
    (3, 'Sell', 104050000000, 300000000)) v(leg, side, px, sz) WHERE kind = 'snapshot'),
ok_leg AS (
  SELECT *, lag(sz, 1, 0) OVER (PARTITION BY symbol_id, epoch, side, px ORDER BY i, leg) AS held
  FROM leg WHERE px IS NOT NULL AND sz >= 0),
typed AS (
  SELECT *, CASE WHEN kind = 'snapshot' THEN 'Snapshot' WHEN sz = 0 AND held > 0 THEN 'Cancel'
    WHEN sz = 0 THEN NULL WHEN held > 0 THEN 'Replace' ELSE 'Add' END AS event_type FROM ok_leg),
marks AS (
  SELECT i, symbol_id, kind, epoch, ts, m.leg, 'None' AS side, 0 AS px, 0 AS sz, 0 AS held,
    'Snapshot' AS event_type FROM st, (VALUES (0), (99)) m(leg) WHERE kind = 'snapshot'),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY i, leg) AS sequence_number,
    sum(CASE WHEN side <> 'None' AND event_type IN ('Add', 'Snapshot') THEN 1 ELSE 0 END)
      OVER (ORDER BY i, leg) AS ids
  FROM (SELECT * FROM typed WHERE event_type IS NOT NULL UNION ALL SELECT * FROM marks)),
l3 AS (
  SELECT ts AS timestamp_ns, sequence_number, symbol_id, event_type, side,
    CAST(px AS BIGINT) AS price_ticks, CAST(sz AS BIGINT) AS quantity,
    CAST(CASE WHEN side = 'None' THEN 0 ELSE last_value(CASE WHEN event_type IN ('Add', 'Snapshot')
      THEN ids END IGNORE NULLS) OVER (PARTITION BY symbol_id, epoch, side, px
      ORDER BY i, leg) END AS BIGINT) AS order_id,
    CAST(0 AS BIGINT) AS trade_id,
    CAST(CASE WHEN side <> 'None' THEN 0 WHEN leg = 0 THEN 1 ELSE 2 END AS BIGINT) AS flags
  FROM numbered),
lvl AS (
  SELECT symbol_id, epoch, side, px, i, arg_max(sz, leg) AS held FROM typed GROUP BY ALL),
cell AS (
  SELECT s.i, s.symbol_id, s.epoch, p.side, p.px FROM st s
  JOIN (SELECT DISTINCT symbol_id, epoch, side, px FROM typed) p
    ON p.symbol_id = s.symbol_id AND p.epoch = s.epoch),
top AS (
  SELECT c.i, max(c.px) FILTER (c.side = 'Buy') AS bid, min(c.px) FILTER (c.side = 'Sell') AS ask
  FROM cell c ASOF JOIN lvl l ON l.symbol_id = c.symbol_id AND l.epoch = c.epoch
    AND l.side = c.side AND l.px = c.px AND c.i >= l.i
  WHERE l.held > 0 GROUP BY c.i),
problems AS (
  SELECT i AS raw_index, 'error' AS severity, 'malformed_message' AS reason FROM msg WHERE kind = 'malformed'
  UNION ALL SELECT i, 'error', 'missing_fields' FROM msg WHERE kind = 'missing'
  UNION ALL SELECT i, 'warning', 'unsupported_message_type' FROM msg WHERE kind = 'unsupported'
  UNION ALL SELECT i, 'warning', 'non_monotonic_event_time' FROM st WHERE kind = 'diff' AND ts < prev_ts
  UNION ALL SELECT i, 'warning', 'stale_update' FROM lastid
    WHERE (kind = 'diff' AND u2 <= last_id) OR (kind = 'snapshot' AND u2 < last_id)
  UNION ALL SELECT i, 'warning', 'update_gap' FROM lastid
    WHERE kind = 'diff' AND u2 > last_id AND u1 > last_id + 1
  UNION ALL SELECT i, 'error', 'invalid_price' FROM leg WHERE px IS NULL
  UNION ALL SELECT i, 'error', 'invalid_quantity' FROM leg WHERE px IS NOT NULL AND sz < 0
  UNION ALL SELECT i, 'info', 'level_remove_absent' FROM typed WHERE event_type IS NULL
  UNION ALL SELECT i, 'warning', 'crossed_book' FROM top WHERE bid >= ask)"""
).replace("lineitem_numbered", "lines")


ORDERS_SQL = """
order_requests AS (
  SELECT o_orderkey + 1 AS client_order_id, 1 + o_custkey % 50 AS client_id,
    1 + o_orderkey % 8 AS symbol_id,
    CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side,
    950 + (o_orderkey * 37) % 101 AS price_ticks, 1 + o_custkey % 200 AS quantity,
    epoch_us(o_orderdate) * 1000 AS timestamp_ns,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS arrival FROM orders)"""

MARKET_SQL = """
market_ref AS (
  SELECT 1 + l_suppkey % 8 AS symbol_id, epoch_us(l_shipdate) * 1000 AS timestamp_ns,
    CAST(980 + sum(l_partkey) % 41 AS BIGINT) AS reference_price_ticks
  FROM lineitem GROUP BY ALL),
positions AS (
  SELECT 1 + l_suppkey % 8 AS symbol_id, CAST(sum(l_partkey) % 401 - 200 AS BIGINT) AS quantity
  FROM lineitem GROUP BY ALL)"""

CONTROLS_SQL = f"""
year_start AS (SELECT min(timestamp_ns) AS start FROM order_requests
  GROUP BY year(make_timestamp(timestamp_ns // 1000))),
controls AS (
  SELECT start + 10 * {DAY_NS} AS timestamp_ns, 'disconnect' AS control FROM year_start
  UNION ALL SELECT start + 20 * {DAY_NS}, 'reconnect' FROM year_start
  UNION ALL SELECT max(timestamp_ns) - 30 * {DAY_NS}, 'kill' FROM order_requests)"""
