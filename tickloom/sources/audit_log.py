"""Risk audit logs: JSON lines or key=value text, with a chained checksum per row."""

import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import codec, fnv
from tickloom.operators.asof import as_of
from tickloom.operators.checksum import running_checksum
from tickloom.operators.scan import (
    DEFAULT_BLOCK_ROWS,
    block_of,
    block_scan,
    follow_blocks,
    number_rows,
)
from tickloom.session import stage
from tickloom.sources.files import SPLIT_BYTES, list_files, open_path, ordered_lines

_FIELDS = schema.AUDIT.fieldNames()


def format_for_path(path: str) -> str:
    return "jsonl" if path.endswith(".jsonl") else "text"


def read_audit(
    spark: SparkSession, paths: Sequence[str], fmt: str = "auto", split: int = SPLIT_BYTES
) -> DataFrame:
    """Audit rows with file, file_no, offset and ``malformed``; empty lines are skipped.

    The files are read in the order given: rotated logs form one chain.
    """
    fmt = format_for_path(paths[0]) if fmt == "auto" else fmt
    lines = ordered_lines(spark, paths, split).withColumn("text", F.decode("raw", "UTF-8"))
    rows = lines.filter(F.trim("text") != "")
    if fmt == "jsonl":
        parsed = rows.withColumn(
            "_r",
            F.from_json(
                "text", schema.AUDIT, {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"}
            ),
        )
        value = lambda name: F.col(f"_r.{name}")
    else:
        parsed = rows.withColumn("_m", F.str_to_map("text", F.lit(" "), F.lit("=")))

        def value(name: str) -> Column:
            text = F.try_element_at("_m", F.lit(name))
            kind = schema.AUDIT[name].dataType.simpleString()
            if kind == "string":
                return text
            if kind == "boolean":
                return text == "true"
            return F.when(text.rlike("^-?[0-9]+$"), text.try_cast(kind))

    typed = parsed.select(
        "file", "file_no", "offset", *[value(c).alias(c) for c in _FIELDS]
    )
    known = F.col("side").isin(*schema.SIDES) & F.col("reject_reason").isin(
        *schema.AUDIT_REJECT_REASONS
    )
    complete = F.lit(True)
    for name in _FIELDS:
        complete = complete & F.col(name).isNotNull()
    return typed.withColumn("malformed", ~F.coalesce(complete & known, F.lit(False)))


def with_chain(
    rows: DataFrame,
    order: str,
    scope: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
    seed: int = fnv.OFFSET,
) -> DataFrame:
    """Add the cumulative ``checksum`` to audit rows in ``order``, per scope.

    ``seed`` is the last checksum of the log that the rows continue.
    """
    return running_checksum(
        rows, scope, [order], codec.audit_payload(), block_of(order, block_rows), seed=seed
    )


def audit_lines(rows: DataFrame, fmt: str = "jsonl") -> Column:
    """Text of one audit line per row."""
    if fmt == "jsonl":
        return F.to_json(F.struct(*[rows[c] for c in _FIELDS]))
    return F.concat_ws(
        " ", *[F.concat(F.lit(f"{c}="), rows[c].cast("string")) for c in _FIELDS]
    )


def write_audit(
    rows: DataFrame,
    path: str,
    order: str,
    fmt: str = "jsonl",
    max_records_per_file: int = 0,
) -> None:
    """Append audit lines in order; files rotate by record count.

    Files are numbered on from the highest number in the folder, so that their names sort in
    chain order over any number of appends. Spark writes them into a hidden folder first; they
    are renamed in order afterwards, and a name that another writer took meanwhile is an error.
    """
    spark = rows.sparkSession
    hidden = f"{path.rstrip('/')}/_append-{uuid.uuid4().hex}"
    writer = (
        rows.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select(audit_lines(rows, fmt).alias("value"))
        .write
    )
    if max_records_per_file > 0:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.text(hidden)
    _number_files(spark, hidden, path)


_PART = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?(\.[a-z0-9.]+)$")
_NUMBERED = re.compile(r"part-(\d{10})\.")


def _number_files(spark: SparkSession, hidden: str, path: str) -> None:
    """Move the part files of one write into ``path``, with the next free numbers."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda folder: [f.getPath().getName() for f in fs.listStatus(new(folder))]
    taken = [int(m[1]) for m in map(_NUMBERED.match, names(path)) if m]
    number = max(taken, default=-1)
    parts = [m for m in map(_PART.match, names(hidden)) if m]
    for part in sorted(parts, key=lambda m: (int(m[1]), int(m[2] or 0))):
        number += 1
        target = new(f"{path.rstrip('/')}/part-{number:010d}{part[3]}")
        if fs.exists(target) or not fs.rename(new(f"{hidden}/{part[0]}"), target):
            raise FileExistsError(target.toString())
    fs.delete(new(hidden), True)


# --- rotation by bytes and records ------------------------------------------------------


_WALK_ROWS = 100_000


def rotate(
    lines: DataFrame,
    order: str,
    max_bytes: int = 0,
    max_records: int = 0,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Cut ordered lines (``order``, ``value``) into files: (``n``, ``value``, ``file_no``).

    A line that would take its file above ``max_bytes`` (line ends counted) or ``max_records``
    opens the next file; 0 means no limit. A line longer than a file has one of its own.

    Where a file that opens at a line would end is known from the running size alone: the
    first line past its size limit is an as-of lookup on mirrored size. The openings that the
    first line leads to are found in blocks, whose entries and exits follow by doubling, so no
    task walks the log.
    """
    if max_bytes <= 0 and max_records <= 0:
        raise ValueError("rotation needs a limit of bytes or records")
    sized = number_rows(
        lines.select(order, "value"), [], [order], "n"
    ).select("n", "value", (F.octet_length("value") + 1).cast("bigint").alias("_size"))
    placed = stage(
        block_scan(
            sized.withColumn("_blk", block_of("n", block_rows)), [], ["n"], "_blk",
            totals={"_upto": F.col("_size")},
        ),
        "rotate-lines",
    )
    asks = placed.select(
        F.col("n").alias("at"), (F.col("_size") - F.col("_upto") - max_bytes - 1).alias("_back")
    )
    following = F.col("at") + max_records if max_records > 0 else F.lit(None).cast("bigint")
    if max_bytes > 0:
        opens = placed.select((-F.col("_upto")).alias("_back"), "n")
        found = as_of(asks, opens, [], "_back", ["n"], slice_ns=block_rows * 256)
        # No line past the limit: the file goes on to the end of the log.
        past = F.when(F.col("n").isNotNull(), F.greatest("n", F.col("at") + 1))
        following = F.least(following, past)
    else:
        found = asks
    jumps = stage(
        found.select("at", following.alias("to")).filter("to IS NOT NULL"), "rotate-jumps"
    )
    openings = follow_blocks(
        placed.filter("n = 1").select(F.col("n").alias("at")), jumps, min(block_rows, _WALK_ROWS)
    )
    opened = placed.join(
        openings.select(F.col("at").alias("n"), F.lit(1).alias("_open")), "n", "left"
    )
    return block_scan(
        opened.withColumn("_open", F.coalesce("_open", F.lit(0)).cast("bigint")),
        [], ["n"], "_blk", totals={"_files": F.col("_open")},
    ).select("n", "value", (F.col("_files") - 1).alias("file_no"))


def rotated_path(path: str, file_no: int) -> str:
    """Name of the n-th file of a log: ``stem.ext``, then ``stem.1.ext``, ``stem.2.ext``, ..."""
    if file_no == 0:
        return path
    folder, _, name = path.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    stem, extension = (stem, dot + extension) if stem else (name, "")
    return f"{folder}/{stem}.{file_no}{extension}"


def write_files(lines: DataFrame, path: str) -> None:
    """Write lines (``file_no``, ``n``, ``value``) as the files of a rotated log at ``path``.

    One task writes a file; the files appear under their names once all are complete, renamed
    by tasks. A log that is there already is an error.
    """
    spark = lines.sparkSession
    hidden = f"{path.rpartition('/')[0]}/_rotate-{uuid.uuid4().hex}"
    system, plain = open_path(hidden)
    system.create_dir(plain, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = open_path(hidden)
        open_no, out, names = None, None, {}
        for batch in batches:
            numbers = batch.column("file_no").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            values = batch.column("value").cast(pa.binary())
            for begin, end in pairwise([0, *cuts.tolist(), len(numbers)]):
                if begin == end:
                    continue
                if numbers[begin] != open_no:
                    if out is not None:
                        out.close()
                    open_no = int(numbers[begin])
                    names[open_no] = uuid.uuid4().hex
                    out = system.open_output_stream(f"{plain}/{names[open_no]}")
                part = [v or b"" for v in values[begin:end].to_pylist()]
                out.write(b"\n".join([*part, b""]))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.string())],
            names=["file_no", "name"],
        )

    # Dealt by a hash of the number: Spark leaves out a repartition by columns that a join below has
    # dealt by already, and the join, turned into a broadcast while it runs, no longer deals at all.
    dealt = lines.repartition(F.xxhash64("file_no"))
    ordered = dealt.sortWithinPartitions("file_no", "n").select(
        F.col("file_no").cast("bigint").alias("file_no"), "value"
    )
    written = stage(ordered.mapInArrow(write, "file_no BIGINT, name STRING"), "rotated-files")
    held = [(number,) for number in _rotated_numbers(path)]
    if held:
        taken = written.join(spark.createDataFrame(held, "file_no BIGINT"), "file_no").first()
        if taken is not None:
            raise FileExistsError(rotated_path(path, taken.file_no))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = open_path(hidden)
        there = lambda p: system.get_file_info(p).type != fs.FileType.NotFound
        for batch in batches:
            for number, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, target = open_path(rotated_path(path, number))
                if there(source := f"{plain}/{name}"):
                    if there(target):
                        raise FileExistsError(target)
                    system.move(source, target)
                elif not there(target):  # else moved by an earlier attempt of this task
                    raise FileNotFoundError(source)
            yield batch

    written.mapInArrow(rename, written.schema).agg(F.count(F.lit(1))).collect()
    system.delete_dir(plain)


def write_rotating_audit(
    rows: DataFrame,
    path: str,
    order: str,
    fmt: str = "auto",
    max_bytes_per_file: int = 0,
    max_records_per_file: int = 0,
) -> None:
    """Write audit rows in order as a rotated log; see ``rotate`` and ``rotated_path``."""
    fmt = format_for_path(path) if fmt == "auto" else fmt
    lines = rows.select(order, audit_lines(rows, fmt).alias("value"))
    write_files(rotate(lines, order, max_bytes_per_file, max_records_per_file), path)


def rotated_paths(path: str) -> list[str]:
    """The files of a rotated log, in the order of its chain."""
    found = _rotated_numbers(path)
    return [found[number] for number in sorted(found)]


def _rotated_numbers(path: str) -> dict[int, str]:
    folder, _, name = path.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    stem, extension = (stem, dot + extension) if stem else (name, "")
    pattern = re.compile(re.escape(stem) + r"(?:\.(\d+))?" + re.escape(extension))
    return {
        int(m[1] or 0): file for file, _ in list_files([folder])
        if (m := pattern.fullmatch(file.rpartition("/")[2])) and file.count("/") == path.count("/")
    }
