"""Event logs as CSV and binary files, read and written in parallel."""

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tickloom import schema
from tickloom.functions import codec
from tickloom.operators.scan import block_scan
from tickloom.session import stage
from tickloom.sources.files import (
    SPLIT_BYTES,
    FileRange,
    list_files,
    numbered_files,
    open_path,
    ordered_lines,
    read_head,
)

# Fixed values of log format version 1.
MAGIC = b"ASTITCH1"
VERSION, HEADER_SIZE, RECORD_SIZE = 1, 16, 58
BINARY_SUFFIXES = (".bin", ".itch", ".ablog")
FORMAT_NAMES = {"auto": "auto", "csv": "csv", "binary": "binary", "bin": "binary", "itch": "binary"}

HEADER = np.dtype(
    [("magic", "S8"), ("version", "<u2"), ("header", "<u2"), ("record", "<u2"), ("zero", "<u2")]
)
RECORD = np.dtype(
    [
        ("timestamp_ns", "<i8"),
        ("sequence_number", "<i8"),
        ("symbol_id", "<u4"),
        ("event_type", "u1"),
        ("side", "u1"),
        ("flags", "<u4"),
        ("price_ticks", "<i8"),
        ("quantity", "<i8"),
        ("order_id", "<i8"),
        ("trade_id", "<i8"),
    ]
)
_TYPE_NAMES = np.array([None, *schema.EVENT_TYPES], dtype=object)
_SIDE_NAMES = np.array(list(schema.SIDES), dtype=object)
_BATCH = 65_536


class EventLogError(ValueError):
    """A log that does not follow format version 1."""


def parse_format(name: str) -> str:
    try:
        return FORMAT_NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown event-log format: {name}") from None


def format_for_path(path: str) -> str:
    return "binary" if path.lower().endswith(BINARY_SUFFIXES) else "csv"


def detect_format(path: str) -> str:
    """Format of one existing file by its first bytes."""
    return "binary" if read_head(path, len(MAGIC)) == MAGIC else "csv"


def header_bytes() -> bytes:
    return np.array([(MAGIC, VERSION, HEADER_SIZE, RECORD_SIZE, 0)], dtype=HEADER).tobytes()


def check_header(raw: bytes) -> None:
    if len(raw) < HEADER_SIZE:
        raise EventLogError("malformed binary event log: truncated binary event-log header")
    head = np.frombuffer(raw[:HEADER_SIZE], dtype=HEADER)[0]
    if head["magic"] != MAGIC:
        raise EventLogError("binary header drift: invalid binary event-log magic")
    if head["version"] != VERSION:
        raise EventLogError(
            f"binary schema version drift: unsupported binary event-log version {head['version']}"
        )
    if head["header"] != HEADER_SIZE:
        raise EventLogError(
            f"binary layout drift: unsupported binary event-log header size {head['header']}"
        )
    if head["record"] != RECORD_SIZE:
        raise EventLogError(
            f"binary layout drift: unsupported binary event record size {head['record']}"
        )
    if head["zero"] != 0:
        raise EventLogError("binary header drift: reserved header field must be zero")


class BinaryEventLog(DataSource):
    """``format("binary_event_log")``: reads files or folders, writes one file per task."""

    @classmethod
    def name(cls) -> str:
        return "binary_event_log"

    def schema(self):
        return schema.INDEXED_EVENT

    def reader(self, schema) -> "BinaryEventReader":
        pushed = self.options.get("pushdown", "false") == "true"
        return (FilteringEventReader if pushed else BinaryEventReader)(self.options)

    def writer(self, schema, overwrite: bool) -> "BinaryEventWriter":
        return BinaryEventWriter(self.options, overwrite)


_TESTS = {
    EqualTo: np.equal,
    GreaterThan: np.greater,
    GreaterThanOrEqual: np.greater_equal,
    LessThan: np.less,
    LessThanOrEqual: np.less_equal,
    In: np.isin,
}


class BinaryEventReader(DataSourceReader):
    """Ranges of records, one task each; every task checks its file's header."""

    def __init__(self, options):
        self.tests: list[tuple[str, type, object]] = []
        self.paths = options["paths"].split("\n")
        self.numbers = options.get("numbers", "")
        self.split = max(int(options.get("split", SPLIT_BYTES)) // RECORD_SIZE, 1) * RECORD_SIZE

    def partitions(self) -> list[FileRange]:
        ranges = []
        for number, path, size in numbered_files(self.paths, self.numbers):
            if (size - HEADER_SIZE) % RECORD_SIZE:
                check_header(read_head(path, HEADER_SIZE))
                raise EventLogError(
                    "malformed binary event log: truncated binary event record at index "
                    f"{(size - HEADER_SIZE) // RECORD_SIZE} of {path}"
                )
            # A log without records is one empty range, so that its header is checked too.
            for begin in range(HEADER_SIZE, max(size, HEADER_SIZE + 1), self.split):
                ranges.append(FileRange(path, number, begin, min(begin + self.split, size), size))
        return ranges or [FileRange("", 0, 0, 0, 0)]

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        if part.size == 0:
            return
        system, plain = open_path(part.path)
        with system.open_input_file(plain) as file:
            check_header(file.read_at(HEADER_SIZE, 0))
            for begin in range(part.begin, part.end, _BATCH * RECORD_SIZE):
                size = min(_BATCH * RECORD_SIZE, part.end - begin)
                records = np.frombuffer(file.read_at(size, begin), dtype=RECORD)
                first = (begin - HEADER_SIZE) // RECORD_SIZE
                _check_words(records, first)
                index = np.arange(first + 1, first + 1 + records.size, dtype=np.int64)
                if self.tests:
                    kept = np.ones(records.size, dtype=bool)
                    for name, kind, value in self.tests:
                        kept &= _TESTS[kind](records[name].astype(np.int64), value)
                    records, index = records[kept], index[kept]
                if records.size:
                    yield _to_batch(records, part.file_no, index)


class FilteringEventReader(BinaryEventReader):
    """Tests comparisons of whole-number fields with literals on the raw records, before rows
    are made of them. Spark offers filters to Python sources only where
    ``spark.sql.python.filterPushdown.enabled`` is set, and rejects this reader elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        numbers = set(RECORD.names) - {"event_type", "side"}
        for asked in filters:
            kind, name = type(asked), getattr(asked, "attribute", ())
            if kind in _TESTS and len(name) == 1 and name[0] in numbers:
                value = list(asked.value) if kind is In else asked.value
                if None not in (value if kind is In else [value]):
                    self.tests.append((name[0], kind, value))
                    continue
            yield asked


def _check_words(records: np.ndarray, first: int) -> None:
    for field, limit, label in (("event_type", 7, "MarketEventType"), ("side", 2, "Side")):
        low = 1 if field == "event_type" else 0
        bad = np.flatnonzero((records[field] < low) | (records[field] > limit))
        if bad.size:
            raise EventLogError(
                f"enum drift: record {first + int(bad[0])}: invalid {label} wire value "
                f"{records[field][bad[0]]}"
            )


def _to_batch(records: np.ndarray, file_no: int, index: np.ndarray) -> pa.RecordBatch:
    columns = {
        "event_type": pa.array(_TYPE_NAMES[records["event_type"]], pa.string()),
        "side": pa.array(_SIDE_NAMES[records["side"]], pa.string()),
        # The file number goes above the record number: positions stay ordered across files.
        "event_index": pa.array(index + (file_no << 40)),
    }
    arrays = [
        columns[f.name] if f.name in columns else pa.array(records[f.name].astype(np.int64))
        for f in schema.INDEXED_EVENT.fields
    ]
    return pa.RecordBatch.from_arrays(arrays, names=schema.INDEXED_EVENT.fieldNames())


def _to_records(batch: pa.RecordBatch) -> np.ndarray:
    """Records of the format; a null, unknown word or number out of range is an error."""
    records = np.zeros(batch.num_rows, dtype=RECORD)
    codes = {"event_type": schema.EVENT_TYPES, "side": schema.SIDES}
    for name in RECORD.names:
        column = batch.column(name)
        if name in codes:
            place = pc.index_in(column, pa.array(list(codes[name]), pa.string()))
            if not place.null_count:
                values = np.array(list(codes[name].values()))[place.to_numpy()]
        else:
            place, values = column, column.to_numpy(zero_copy_only=False)
        if place.null_count:
            raise EventLogError(f"cannot write {name}: null or unknown value")
        kind = np.iinfo(RECORD[name])
        if values.size and (values.min() < kind.min or values.max() > kind.max):
            raise EventLogError(f"cannot write {name}: out of range")
        records[name] = values
    return records


@dataclass
class PartFile(WriterCommitMessage):
    path: str
    records: int


class BinaryEventWriter(DataSourceArrowWriter):
    """One part file with its own header per task, renamed into place on commit."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        if overwrite:
            raise ValueError("binary event logs are append-only; choose a new folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFile:
        from uuid import uuid4

        system, plain = open_path(self.path)
        system.create_dir(plain, recursive=True)
        target = f"{plain}/_tmp-{uuid4().hex}.bin"
        records = 0
        with system.open_output_stream(target) as out:
            out.write(header_bytes())
            for batch in iterator:
                out.write(_to_records(batch).tobytes())
                records += batch.num_rows
        return PartFile(target, records)

    def commit(self, messages) -> None:
        system, plain = open_path(self.path)
        kept = [m for m in messages if m is not None and m.records]
        # An append goes on after the parts that are there and never takes the name of one.
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(plain))]
        held = [int(m[1]) for n in names if (m := re.fullmatch(r"part-(\d+)\.bin", n))]
        for number, message in enumerate(kept, max(held, default=-1) + 1):
            target = f"{plain}/part-{number:010d}.bin"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(target)
            system.move(message.path, target)
        for message in messages:
            if message is not None and not message.records:
                system.delete_file(message.path)

    def abort(self, messages) -> None:
        system, _ = open_path(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.path)


def read_binary(
    spark: SparkSession, paths: Sequence[str], split: int = SPLIT_BYTES,
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    spark.dataSource.register(BinaryEventLog)
    return (
        spark.read.format("binary_event_log")
        .option("paths", "\n".join(paths))
        .option("numbers", ",".join(map(str, numbers or [])))
        .option("split", str(split))
        .option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        .load()
    )


def write_binary(events: DataFrame, path: str) -> None:
    """Write parts sorted by event_index and numbered in that order."""
    events.sparkSession.dataSource.register(BinaryEventLog)
    ordered = events.repartitionByRange("event_index").sortWithinPartitions("event_index")
    ordered.select(*schema.EVENT_COLUMNS).write.format("binary_event_log").mode("append").save(path)


def parse_csv(
    spark: SparkSession, paths: Sequence[str], split: int = SPLIT_BYTES,
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    """Typed rows with ``error`` (null when fine), ``line_number`` and ``event_index``.

    Blank lines, comments and exact headers are skipped; a line with two or more column names
    that is not the exact header is a drift error.
    """
    lines = ordered_lines(spark, paths, split, numbers).withColumn(
        "text", F.trim(F.decode("raw", "UTF-8"), F.lit(codec.WHITESPACE))
    )
    numbered = block_scan(
        lines.drop("raw", "ended"),
        ["file_no"],
        ["offset"],
        F.floor(F.col("offset") / F.lit(64_000_000)).cast("bigint"),
        totals={"line_number": F.lit(1).cast("bigint")},
    )
    header = ",".join(schema.EVENT_COLUMNS)
    text = F.col("text")
    named = sum(
        (F.when(text.contains(c), 1).otherwise(0) for c in schema.EVENT_COLUMNS), F.lit(0)
    )
    rows = numbered.filter((text != "") & ~text.startswith("#") & (text != header))
    # Columns out of a generator are computed once a line, however often they are named below; a
    # filter on the error is not pushed beneath them.
    split_rows = rows.select(
        "*", named.alias("_named"), F.explode(F.array(F.split(text, ",", -1))).alias("_p")
    )
    field = lambda i: F.trim(F.get(F.col("_p"), i), F.lit(codec.WHITESPACE))
    unsigned = lambda i, limit: codec.strict_unsigned(field(i), limit)
    u64, u32 = 2**64 - 1, 2**32 - 1
    values = {
        "timestamp_ns": codec.strict_integer(field(0)),
        "sequence_number": unsigned(1, u64),
        "symbol_id": unsigned(2, u32),
        "event_type": codec.decode_event_type(field(3)),
        "side": codec.decode_side(field(4)),
        "price_ticks": codec.strict_integer(field(5)),
        "quantity": codec.strict_integer(field(6)),
        "order_id": unsigned(7, u64),
        "trade_id": unsigned(8, u64),
        "flags": unsigned(9, u32),
    }
    labels = {"event_type": "event_type spelling", "side": "side spelling"}
    typed = split_rows.select(
        "*",
        F.explode(F.array(F.struct(*[col.alias(c) for c, col in values.items()]))).alias("_v"),
    ).select("*", "_v.*")
    drift = F.when(
        F.col("_named") >= 2, F.format_string("CSV column drift: expected v1 header, got %s", text)
    ).when(
        F.size("_p") != 10,
        F.format_string("CSV column drift: expected 10 fields in v1 order, got %d", F.size("_p")),
    )
    for name in schema.EVENT_COLUMNS:
        label = labels.get(name, "numeric")
        drift = drift.when(
            F.col(name).isNull(), f"failed to parse CSV {label} field {name}"
        )
    wide = {"sequence_number", "order_id", "trade_id"}
    # Ids are kept as BIGINT; larger unsigned values are reported, never wrapped.
    for name in sorted(wide):
        drift = drift.when(
            F.col(name) > codec.big(2**63 - 1), f"unsupported CSV numeric field {name}: above 2^63-1"
        )
    checked = typed.withColumn("error", drift)
    return checked.select(
        *[
            F.col(c).try_cast("bigint").alias(c)
            if c not in ("event_type", "side") else F.col(c)
            for c in schema.EVENT_COLUMNS
        ],
        (F.col("line_number") + F.shiftleft(F.col("file_no").cast("bigint"), 40)).alias(
            "event_index"
        ),
        "file",
        "line_number",
        "text",
        "error",
    )


def read_csv(
    spark: SparkSession, paths: Sequence[str], strict: bool = True, split: int = SPLIT_BYTES,
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    """CSV events. ``strict`` rejects everything on the first bad line; otherwise bad lines
    are left out (``quarantine`` lists them)."""
    parsed = parse_csv(spark, paths, split, numbers)
    if strict:
        parsed = stage(parsed.drop("file", "text"), "csv-events")
        bad = parsed.filter("error IS NOT NULL").orderBy("event_index").limit(1).collect()
        if bad:
            raise EventLogError(f"line {bad[0].line_number}: {bad[0].error}")
    return parsed.filter("error IS NULL").select(*schema.INDEXED_EVENT.fieldNames())


def quarantine(spark: SparkSession, paths: Sequence[str], split: int = SPLIT_BYTES) -> DataFrame:
    return parse_csv(spark, paths, split).filter("error IS NOT NULL").select(
        "file", "line_number", "text", "error"
    )


def write_csv(events: DataFrame, path: str) -> None:
    """Write parts with the canonical header, in event_index order."""
    ordered = events.repartitionByRange("event_index").sortWithinPartitions("event_index")
    ordered.select(*schema.EVENT_COLUMNS).write.option("header", True).csv(path)


def read_events(
    spark: SparkSession, paths: Sequence[str] | str, fmt: str = "auto", strict: bool = True
) -> DataFrame:
    """Read event logs; ``auto`` looks at every file's first bytes, mixed folders work."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fmt = parse_format(fmt)
    if fmt == "binary":
        return read_binary(spark, paths)
    if fmt == "csv":
        return read_csv(spark, paths, strict)
    # One number per file over both kinds, so that positions never repeat.
    kinds: dict[str, dict[str, int]] = {"csv": {}, "binary": {}}
    for number, (path, _) in enumerate(list_files(paths)):
        kinds[detect_format(path)][path] = number
    parts = []
    if csv := kinds["csv"]:
        parts.append(read_csv(spark, list(csv), strict, numbers=list(csv.values())))
    if binary := kinds["binary"]:
        parts.append(read_binary(spark, list(binary), numbers=list(binary.values())))
    if not parts:
        raise FileNotFoundError(f"no event logs in {paths}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_events(events: DataFrame, path: str, fmt: str = "auto") -> None:
    fmt = parse_format(fmt)
    fmt = format_for_path(path) if fmt == "auto" else fmt
    (write_binary if fmt == "binary" else write_csv)(events, path)


def convert(spark: SparkSession, source: str, target: str, fmt_in="auto", fmt_out="auto") -> DataFrame:
    """Convert a log and return the events read; compare with ``checksum.same_rows``."""
    events = read_events(spark, source, fmt_in)
    write_events(events, target, fmt_out)
    return events
