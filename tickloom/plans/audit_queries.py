"""Queries over fingerprints, checksums and audit trails."""

from pyspark.sql import functions as F

from tickloom.functions import fnv
from tickloom.operators import audit, book, checksum
from tickloom.plans import byte_sql as B
from tickloom.plans import views as V
from tickloom.plans.event_queries import _CLEAN, _SUMMARY, dirty_diagnostics
from tickloom.plans.limit_queries import _SCREEN, _SCREENED, limit_decisions_t1
from tickloom.plans.registry import query
from tickloom.session import staged_once
from tickloom.sources import audit_log


def _trail(spark, sf_dir):
    """Screened decisions as an audit trail of one chain per symbol."""

    def build():
        arrivals = V.order_requests(spark, sf_dir).select("client_order_id", "arrival")
        rows = limit_decisions_t1(spark, sf_dir).join(arrivals, "client_order_id")
        return audit_log.with_chain(rows, "arrival", ["symbol_id"], block_rows=50_000)

    return staged_once(spark, sf_dir, "audit_trail", build)


@query(
    "audit_trail",
    f"""WITH RECURSIVE {_SCREEN}, d AS ({_SCREENED}),
    placed AS (SELECT d.*, o.arrival, {B.AUDIT} AS bytes, row_number() OVER (
        PARTITION BY d.symbol_id ORDER BY o.arrival) AS n
      FROM d JOIN (SELECT client_order_id, arrival FROM order_requests) o USING (client_order_id)),
    chained AS (
      SELECT symbol_id, n, {B.chain("bytes")} AS state FROM placed WHERE n = 1
      UNION ALL
      SELECT p.symbol_id, p.n, {B.chain("p.bytes", "c.state")} FROM chained c
      JOIN placed p ON p.symbol_id = c.symbol_id AND p.n = c.n + 1)
    SELECT p.* EXCLUDE (bytes, n), CAST(c.state AS VARCHAR) AS checksum
    FROM placed p JOIN chained c USING (symbol_id, n)""",
)
def audit_trail(spark, sf_dir):
    return _trail(spark, sf_dir).withColumn("checksum", F.col("checksum").cast("string"))


@query(
    "audit_summary",
    f"""WITH {_SCREEN}, d AS ({_SCREENED})
    SELECT count(*) AS entry_count, count(*) FILTER (accepted) AS accepted_count,
      count(*) FILTER (NOT accepted) AS rejected_count FROM d""",
)
def audit_summary(spark, sf_dir):
    return audit.summary(_trail(spark, sf_dir), ["arrival"]).drop("last_checksum")


@query(
    "audit_check_counts",
    f"""WITH {_SCREEN}, d AS ({_SCREENED})
    SELECT check_name, count(*) AS entry_count FROM d GROUP BY check_name""",
)
def audit_check_counts(spark, sf_dir):
    return audit.check_counts(_trail(spark, sf_dir))


@query(
    "audit_chain_verify",
    f"""WITH {V.ORDERS_SQL}
    SELECT symbol_id, count(*) AS entry_count,
      CAST(count(*) FILTER (client_order_id % 1000 = 17) AS BIGINT) AS invalid_count,
      min(arrival) FILTER (client_order_id % 1000 = 17) AS first_invalid
    FROM order_requests GROUP BY symbol_id""",
)
def audit_chain_verify(spark, sf_dir):
    """Every row verified against its predecessor, after tampering with some rows.

    Only the tampered rows fail: their own logged checksum still matches the genuine entry
    that later rows build on.
    """
    tampered = _trail(spark, sf_dir).withColumn(
        "observed_value",
        F.col("observed_value") + F.when(F.col("client_order_id") % 1000 == 17, 1).otherwise(0),
    )
    judged = audit.verify_rows(
        tampered,
        ["arrival"],
        ["symbol_id"],
        F.floor(F.col("arrival") / 1_000_000).cast("bigint"),
    )
    bad = ~F.col("valid")
    return judged.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(bad).alias("invalid_count"),
        F.min(F.when(bad, F.col("arrival"))).alias("first_invalid"),
    )


@query("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    return checksum.fingerprint(V.order_flow(spark, sf_dir), ["symbol_id"])


def _as_text(df, name):
    return df.withColumn(name, F.col(name).cast("string"))


@query(
    "event_log_checksums",
    f"""WITH {V.ORDER_FLOW_SQL}
    SELECT symbol_id, {B.ordered_chain(B.EVENT, "event_index")} AS event_log_checksum
    FROM order_flow GROUP BY symbol_id""",
)
def event_log_checksums(spark, sf_dir):
    found = checksum.event_checksums(V.order_flow(spark, sf_dir), block_rows=50_000)
    return _as_text(found, "event_log_checksum")


_ACTIVE = "event_type IN ('Execute', 'Trade')"


@query(
    "activity_checksums",
    f"""WITH {V.ORDER_FLOW_SQL}
    SELECT symbol_id, {B.ordered_chain(B.EVENT, "event_index", _ACTIVE)} AS activity_checksum
    FROM order_flow GROUP BY symbol_id""",
)
def activity_checksums(spark, sf_dir):
    found = checksum.activity_checksums(V.order_flow(spark, sf_dir), block_rows=50_000)
    return _as_text(found, "activity_checksum")


def _books(spark, sf_dir):
    events = V.order_flow(spark, sf_dir)
    orders = book.live_orders(events, snapshots=False)
    return checksum.book_checksums(orders, events.select("symbol_id").distinct(), 50_000)


_BOOKS = f"""{_CLEAN},
syms AS (SELECT DISTINCT symbol_id FROM order_flow),
books AS ({B.books("syms", "live")})"""


@query("book_checksums", f"WITH {_BOOKS} SELECT * FROM books")
def book_checksums(spark, sf_dir):
    return _as_text(_books(spark, sf_dir), "final_book_checksum")


@query(
    "combined_book_checksum",
    f"WITH {_BOOKS} SELECT CAST({B.combined('books')} AS VARCHAR) AS combined_book_checksum",
)
def combined_book_checksum(spark, sf_dir):
    return _as_text(
        checksum.combined_book_checksum(_books(spark, sf_dir)), "combined_book_checksum"
    )


# --- replay summary with its checksums --------------------------------------------------

_REPLAYED = f"""{_SUMMARY},
applied AS (
  SELECT d.* FROM dirty d LEFT JOIN diag g ON g.symbol_id = d.symbol_id
  WHERE g.log_index IS NULL OR d.event_index < g.log_index),
syms AS (SELECT DISTINCT symbol_id FROM dirty),
resting AS (WITH {V.states_sql("applied")} SELECT * FROM live),
books AS ({B.books("syms", "resting")}),
logs AS (SELECT symbol_id, {B.ordered_chain(B.EVENT, "event_index")} AS event_log_checksum
  FROM dirty GROUP BY symbol_id),
active AS (SELECT symbol_id, {B.ordered_chain(B.EVENT, "event_index", _ACTIVE)}
    AS activity_checksum FROM applied GROUP BY symbol_id),
noted AS (SELECT symbol_id, {B.ordered_chain(B.DIAGNOSTIC, "event_index")}
    AS diagnostics_checksum FROM diag GROUP BY symbol_id),
replayed AS (
  SELECT s.*, l.event_log_checksum, b.final_book_checksum,
    coalesce(a.activity_checksum, '{fnv.OFFSET}') AS activity_checksum,
    coalesce(n.diagnostics_checksum, '{fnv.OFFSET}') AS diagnostics_checksum
  FROM summary s JOIN logs l USING (symbol_id) JOIN books b USING (symbol_id)
  LEFT JOIN active a USING (symbol_id) LEFT JOIN noted n USING (symbol_id))"""

_SUMMARY_BYTES = B.joined(
    B.little("symbol_id", 4), B.little("event_count", 8), B.little("first_sequence", 8),
    B.little("last_sequence", 8), B.little("first_timestamp_ns", 8),
    B.little("last_timestamp_ns", 8), "[CASE WHEN sequence_valid THEN 1 ELSE 0 END]",
    *[B.little(f"{c}::HUGEINT", 8) for c in checksum.SUMMARY_CHECKSUMS],
    B.little("diagnostic_error_count + diagnostic_warning_count", 8),
    B.little("diagnostic_error_count", 8), B.little("diagnostic_warning_count", 8),
    B.text("error"),
)


def _replayed(spark, sf_dir):
    def build():
        events = V.dirty_flow(spark, sf_dir)
        found = dirty_diagnostics(spark, sf_dir)
        return checksum.replay_summary(events, found, block_rows=50_000)

    return staged_once(spark, sf_dir, "replay_summary", build)


@query("replay_summary_checksums", f"WITH {_REPLAYED} SELECT * FROM replayed")
def replay_summary_checksums(spark, sf_dir):
    """Replay of damaged logs per symbol: counts, halt and all four checksums."""
    found = _replayed(spark, sf_dir)
    for name in checksum.SUMMARY_CHECKSUMS:
        found = _as_text(found, name)
    return found


@query(
    "replay_aggregate",
    f"""WITH {_REPLAYED},
    whole AS (SELECT CAST(sum(event_count) AS BIGINT) AS total_events, count(*) AS symbol_count,
        {B.combined("replayed")} AS combined,
        flatten(list({_SUMMARY_BYTES} ORDER BY symbol_id)) AS bytes FROM replayed)
    SELECT total_events, symbol_count, CAST(combined AS VARCHAR) AS combined_book_checksum,
      CAST({B.chain("list_concat(" + B.joined(
          B.little("total_events", 8), B.little("symbol_count", 8), B.little("combined", 8))
          + ", bytes, " + B.joined(B.little("0", 8)) + ")")} AS VARCHAR) AS aggregate_checksum
    FROM whole""",
)
def replay_aggregate(spark, sf_dir):
    """One row over all symbols: totals, checksum of all books, checksum of all summaries."""
    found = checksum.replay_aggregate(_replayed(spark, sf_dir))
    return _as_text(_as_text(found, "combined_book_checksum"), "aggregate_checksum")
