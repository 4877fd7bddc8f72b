"""Queries over files: event logs and audit logs derived from the tables are written to the
shared folder, read back and judged; the twins never see a file."""

from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators import audit
from tickloom.operators.scan import block_scan, whole_div
from tickloom.plans import byte_sql as B
from tickloom.plans import views as V
from tickloom.plans.limit_queries import _SCREEN, _SCREENED, limit_decisions_t1
from tickloom.plans.registry import query
from tickloom.session import new_folder, staged_once
from tickloom.sources import audit_log, event_log

# 1997-01-01 and 1999-01-01.
_CUTS = (852_076_800 * 1_000_000_000, 915_148_800 * 1_000_000_000)
_COLUMNS = ", ".join(schema.EVENT_COLUMNS)


def _mixed_log(spark, sf_dir):
    """order_flow as a folder of two binary appends and a CSV log, read back as one log."""

    def build():
        folder = new_folder(spark, "mixed-log")
        flow = V.order_flow(spark, sf_dir)
        time = F.col("timestamp_ns")
        event_log.write_events(flow.filter(time < _CUTS[0]), f"{folder}/a.bin")
        event_log.write_events(
            flow.filter((time >= _CUTS[0]) & (time < _CUTS[1])), f"{folder}/a.bin"
        )
        event_log.write_events(flow.filter(time >= _CUTS[1]), f"{folder}/b", "csv")
        return event_log.read_events(spark, folder)

    return staged_once(spark, sf_dir, "mixed_log", build)


@query(
    "event_log_round_trip",
    f"""WITH {V.ORDER_FLOW_SQL} SELECT {_COLUMNS}, event_index AS position FROM order_flow""",
)
def event_log_round_trip(spark, sf_dir):
    """Every event with its place in its symbol, in the order that the files hold."""
    return block_scan(
        _mixed_log(spark, sf_dir),
        ["symbol_id"],
        ["event_index"],
        whole_div("event_index", 1 << 18),
        totals={"position": F.lit(1).cast("bigint")},
    ).select(*schema.EVENT_COLUMNS, "position")


@query(
    "csv_log_quarantine",
    f"""WITH {V.ORDER_FLOW_SQL},
    broken AS (
      SELECT *, CASE order_id % 101 WHEN 1 THEN 'failed to parse CSV numeric field price_ticks'
          WHEN 2 THEN 'failed to parse CSV event_type spelling field event_type'
          WHEN 3 THEN 'failed to parse CSV side spelling field side'
          WHEN 4 THEN 'CSV column drift: expected 10 fields in v1 order, got 9'
          WHEN 5 THEN 'failed to parse CSV numeric field order_id'
          WHEN 6 THEN 'failed to parse CSV numeric field flags'
          WHEN 7 THEN 'unsupported CSV numeric field trade_id: above 2^63-1' END AS error
      FROM order_flow)
    SELECT error, symbol_id, count(*) AS line_count, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM broken WHERE error IS NULL OR order_id % 101 <= 7 GROUP BY ALL""",
)
def csv_log_quarantine(spark, sf_dir):
    """Hand-written CSV lines: short names, blanks, comments and seven kinds of broken fields;
    good events and reported errors per symbol."""

    def build():
        kind = F.col("order_id") % 101
        damaged = lambda k, bad, name: F.when(kind == k, bad).otherwise(
            F.col(name).cast("string")
        )
        short = F.substring("event_type", 1, 1)
        fields = [
            F.concat(F.lit(" "), F.col("timestamp_ns").cast("string")),
            F.col("sequence_number").cast("string"),
            F.concat(F.col("symbol_id").cast("string"), F.lit("\t")),
            # Every other order spells its events by their first letter.
            F.when(kind == 2, "Amend").when(F.col("order_id") % 2 == 0, short).otherwise(
                F.col("event_type")
            ),
            F.when(kind == 3, "Both").when(
                F.col("order_id") % 3 == 0, F.substring("side", 1, 1)
            ).otherwise(F.col("side")),
            damaged(1, "12x", "price_ticks"),
            F.col("quantity").cast("string"),
            damaged(5, "+7", "order_id"),
            damaged(7, "9223372036854775808", "trade_id"),
            damaged(6, "4294967296", "flags"),
        ]
        line = F.concat_ws(",", *fields)
        nine = F.concat_ws(",", *fields[:9])
        text = F.when(kind == 4, nine).when(
            kind == 8, F.concat(line, F.lit("\n# a comment\n\n"))
        ).otherwise(line)
        folder = new_folder(spark, "csv-lines")
        V.order_flow(spark, sf_dir).select(text.alias("value")).write.text(folder)
        return event_log.parse_csv(spark, [folder])

    parsed = staged_once(spark, sf_dir, "csv_lines", build)
    part = F.split("text", ",")
    number = lambda i: F.trim(part[i], F.lit(" \t")).cast("bigint")
    return parsed.groupBy("error", number(2).alias("symbol_id")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(number(6)).alias("quantity")
    )


# --- rotated audit logs -----------------------------------------------------------------

_FILE_BYTES = 50_000


def _chained(spark, sf_dir):
    def build():
        arrivals = V.order_requests(spark, sf_dir).select("client_order_id", "arrival")
        rows = limit_decisions_t1(spark, sf_dir).join(arrivals, "client_order_id")
        return audit_log.with_chain(rows, "arrival", block_rows=50_000)

    return staged_once(spark, sf_dir, "audit_chain", build)


def _rotated(spark, sf_dir):
    """Lines of the audit log cut into files of at most 50,000 bytes."""

    def build():
        rows = _chained(spark, sf_dir)
        lines = rows.select("arrival", audit_log.audit_lines(rows).alias("value"))
        return audit_log.rotate(lines, "arrival", max_bytes=_FILE_BYTES)

    return staged_once(spark, sf_dir, "audit_rotated", build)


def _written(spark, sf_dir):
    """Manifest rows of the rotated log, read back from its files."""

    def build():
        path = f"{new_folder(spark, 'audit-log')}/audit.jsonl"
        audit_log.write_files(_rotated(spark, sf_dir), path)
        return audit.describe_files(spark, audit_log.rotated_paths(path))

    return staged_once(spark, sf_dir, "audit_manifest", build)


_LINE = """'{"timestamp_ns":' || timestamp_ns || ',"client_order_id":' || client_order_id
      || ',"symbol_id":' || symbol_id || ',"side":"' || side || '","accepted":' || accepted
      || ',"reject_reason":"' || reject_reason || '","check_name":"' || check_name
      || '","limit_value":' || limit_value || ',"observed_value":' || observed_value
      || ',"checksum":' || state || '}'"""

# One row after the other: the chain, the line and the file that the line falls into.
_ROTATION = f"""RECURSIVE {_SCREEN}, d AS ({_SCREENED}),
placed AS (SELECT d.*, o.arrival AS n, {B.AUDIT} AS bytes
  FROM d JOIN (SELECT client_order_id, arrival FROM order_requests) o USING (client_order_id)),
cut AS (
  SELECT n, state, strlen(line) + 1 AS used, 0 AS file_no, line
  FROM (SELECT *, {_LINE} AS line FROM (
    SELECT *, {B.chain("bytes")} AS state FROM placed WHERE n = 1))
  UNION ALL
  SELECT n, state, CASE WHEN over THEN size ELSE used + size END,
    CASE WHEN over THEN file_no + 1 ELSE file_no END, line
  FROM (SELECT *, strlen(line) + 1 AS size, used + strlen(line) + 1 > {_FILE_BYTES} AS over
    FROM (SELECT *, {_LINE} AS line FROM (
      SELECT p.*, c.used, c.file_no, {B.chain("p.bytes", "c.state")} AS state
      FROM cut c JOIN placed p ON p.n = c.n + 1)))),
letters AS (SELECT *, list_transform(range(strlen(line)), lambda i: ord(line[i + 1])) || [10]
  AS codes FROM cut)"""

_NAME = "CASE WHEN file_no = 0 THEN 'audit.jsonl' ELSE 'audit.' || file_no || '.jsonl' END"


def _files_sql(lines: str) -> str:
    stream = "flatten(list(CAST(codes AS HUGEINT[]) ORDER BY n))"
    return f"""SELECT CAST(file_no AS INTEGER) AS file_no, {_NAME} AS file_name,
      count(*) AS record_count, CAST(sum(strlen(line) + 1) AS BIGINT) AS byte_size,
      CAST({B.chain(stream)} AS VARCHAR) AS content_checksum,
      CAST(arg_max(state, n) AS VARCHAR) AS audit_chain_checksum
    FROM {lines} GROUP BY file_no"""


@query("audit_rotation_manifest", f"WITH {_ROTATION} {_files_sql('letters')}")
def audit_rotation_manifest(spark, sf_dir):
    """Manifest of an audit log that was written as rotated files."""
    found = _written(spark, sf_dir)
    return found.withColumns(
        {c: F.col(c).cast("string") for c in ("content_checksum", "audit_chain_checksum")}
    )


_HURT = f"""hurt AS (
  SELECT * REPLACE (CASE WHEN file_no % 3 = 2 AND opens THEN replace(line, '"side"', '"sidE"')
    ELSE line END AS line)
  FROM (SELECT *, n = min(n) OVER (PARTITION BY file_no) AS opens,
    n = max(n) OVER (PARTITION BY file_no) AS closes FROM cut)
  WHERE file_no % 5 <> 1 AND NOT (file_no % 4 = 3 AND closes)),
hurt_letters AS (SELECT *, list_transform(range(strlen(line)), lambda i: ord(line[i + 1]))
  || [10] AS codes FROM hurt),
told AS ({_files_sql("letters")}),
seen AS ({_files_sql("hurt_letters")}),
matched AS (SELECT t.*, s.byte_size AS size, s.record_count AS records,
  s.content_checksum AS content FROM told t LEFT JOIN seen s USING (file_name))"""


@query(
    "manifest_check",
    f"""WITH {_ROTATION}, {_HURT}
    SELECT 'missing_file' AS kind, file_name, 'file not found' AS detail FROM matched
    WHERE size IS NULL
    UNION ALL SELECT 'size_mismatch', file_name,
      'byte size mismatch: expected ' || byte_size || ', found ' || size
    FROM matched WHERE size <> byte_size
    UNION ALL SELECT 'content_checksum_mismatch', file_name, 'content checksum mismatch'
    FROM matched WHERE content <> content_checksum
    UNION ALL SELECT 'record_count_mismatch', file_name,
      'record count mismatch: expected ' || record_count || ', found ' || records
    FROM matched WHERE records <> record_count""",
)
def manifest_check(spark, sf_dir):
    """The manifest against a log in which files are gone, changed and cut short."""

    def build():
        path = f"{new_folder(spark, 'audit-hurt')}/audit.jsonl"
        lines = _rotated(spark, sf_dir)
        ends = lines.groupBy("file_no").agg(F.min("n").alias("_a"), F.max("n").alias("_z"))
        number = F.col("file_no")
        hurt = (
            lines.join(ends, "file_no")
            .filter((number % 5 != 1) & ~((number % 4 == 3) & (F.col("n") == F.col("_z"))))
            .withColumn(
                "value",
                F.when(
                    (number % 3 == 2) & (F.col("n") == F.col("_a")),
                    F.replace("value", F.lit('"side"'), F.lit('"sidE"')),
                ).otherwise(F.col("value")),
            )
        )
        audit_log.write_files(hurt.select("file_no", "n", "value"), path)
        found = audit.files_now(spark, audit_log.rotated_paths(path))
        return audit.file_issues(_written(spark, sf_dir), found)

    return staged_once(spark, sf_dir, "manifest_issues", build)


@query(
    "audit_files_verify",
    f"""WITH {_ROTATION}
    SELECT true AS valid, CAST(max(file_no) + 1 AS INTEGER) AS files_checked,
      count(*) AS entries_checked, CAST(arg_max(state, n) AS VARCHAR) AS final_checksum,
      '' AS error FROM cut""",
)
def audit_files_verify(spark, sf_dir):
    """The chain over all files of the rotated log, verified from the files alone."""

    def build():
        path = f"{new_folder(spark, 'audit-verify')}/audit.jsonl"
        audit_log.write_files(_rotated(spark, sf_dir), path)
        return audit.verify_chain(spark, audit_log.rotated_paths(path))

    found = staged_once(spark, sf_dir, "audit_files_verify", build)
    return found.withColumn("final_checksum", F.col("final_checksum").cast("string"))
