"""Audit trails: summaries, chain verification, manifests and signatures."""

import hashlib
import hmac
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import codec, fnv
from tickloom.operators.checksum import chained_checksum
from tickloom.operators.scan import block_scan, whole_div
from tickloom.session import stage
from tickloom.sources.audit_log import read_audit
from tickloom.sources.files import open_path, ordered_lines

# Fixed values of manifest version 1.
SCHEMA_VERSION = 1
SIGNATURE_ALGORITHM = "HMAC-SHA256"
FORMAT_CODES = {"text": 1, "jsonl": 2}

_SLICE = 8_000_000


def summary(entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """Totals and the last checksum of an audit log."""
    place = F.struct(*order)
    return entries.agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if("accepted").alias("accepted_count"),
        F.count_if(~F.col("accepted")).alias("rejected_count"),
        F.max_by("checksum", place).alias("last_checksum"),
    )


def check_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("check_name").agg(F.count(F.lit(1)).alias("entry_count"))


def verify_rows(
    entries: DataFrame, order: Sequence[str], keys: Sequence[str] = (), block=None
) -> DataFrame:
    """Add ``expected`` (checksum computed from the previous row's logged one) and ``valid``.

    Every row logs the cumulative checksum, so a row can be checked from its predecessor
    alone: all rows verify in parallel, and up to the first bad row this equals a recomputed
    chain.
    """
    block = block if block is not None else whole_div(order[-1], _SLICE)
    linked = block_scan(
        entries, keys, order, block, previous={"_logged": F.col("checksum")}
    )
    offset = codec.big(fnv.OFFSET).cast("decimal(20,0)")
    seed = F.unhex(codec.le_hex_unsigned(F.coalesce("_logged", offset)))

    @F.pandas_udf(T.BinaryType())
    def advance(seeds: pd.Series, payloads: pd.Series) -> pd.Series:
        import numpy as np

        ready = payloads.notna()
        start = np.frombuffer(b"".join(seeds[ready]), dtype="<u8")
        states = fnv.chain_rows(start, list(payloads[ready]))
        out = pd.Series([None] * len(payloads), index=payloads.index, dtype=object)
        out[ready] = [int(s).to_bytes(8, "big") for s in states]
        return out

    checked = linked.withColumn("_got", advance(seed, codec.audit_payload()))
    low = F.conv(F.hex("_got"), 16, 10).cast("decimal(20,0)")
    return checked.withColumn("expected", low).withColumn(
        "valid", F.coalesce(F.col("expected") == F.col("checksum"), F.lit(False))
    ).drop("_logged", "_got")


def verify_chain(spark: SparkSession, paths: Sequence[str], fmt: str = "auto") -> DataFrame:
    """One row: valid, files_checked, entries_checked, final_checksum and the first error."""
    entries = stage(read_audit(spark, paths, fmt), "verify-entries")
    order = ["file_no", "offset"]
    slices = F.col("file_no").cast("bigint") * 1_000_000_000 + whole_div("offset", _SLICE)
    judged = verify_rows(entries, order, block=slices)
    lined = block_scan(
        judged,
        ["file_no"],
        ["offset"],
        whole_div("offset", _SLICE),
        totals={"line": F.lit(1).cast("bigint")},
    )
    lined = stage(
        lined.select("file", *order, "line", "valid", "malformed", "expected", "checksum"),
        "verify-lines",
    )
    place = F.struct(*order)
    bad = ~F.col("valid") | F.col("malformed")
    message = F.when(
        F.col("malformed"),
        F.concat_ws(":", "file", F.col("line").cast("string"), F.lit(" malformed audit entry")),
    ).otherwise(
        F.concat_ws(
            ":",
            "file",
            F.col("line").cast("string"),
            F.concat(
                F.lit(" checksum mismatch, expected "), F.col("expected").cast("string"),
                F.lit(", received "), F.col("checksum").cast("string"),
            ),
        )
    )
    first = lined.filter(bad).agg(
        F.min(place).alias("_at"),
        F.min_by(message, place).alias("error"),
        F.min_by("expected", place).alias("_computed"),
        F.min_by("malformed", place).alias("_broken"),
    )
    whole = lined.agg(
        F.max_by("checksum", place).alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct("file_no").alias("_files"),
    )
    upto = (
        lined.select(*order)
        .withColumn("_one", F.lit(0))
        .join(F.broadcast(first.withColumn("_one", F.lit(0))), "_one")  # exactly one row
        .filter(place < F.col("_at"))
        .agg(F.count(F.lit(1)).alias("_before"))
    )
    one = lambda df: df.withColumn("_one", F.lit(0))
    joined = one(first).join(one(whole), "_one").join(one(upto), "_one")
    ok = F.col("_at").isNull()
    return joined.select(
        ok.alias("valid"),
        F.when(ok, F.lit(len(paths))).otherwise(F.col("_at.file_no") + 1).alias("files_checked"),
        F.when(ok, F.col("_rows"))
        .otherwise(F.col("_before") + F.when(F.col("_broken"), 0).otherwise(1))
        .alias("entries_checked"),
        F.when(ok, F.coalesce("_last", codec.big(fnv.OFFSET)))
        .otherwise(F.col("_computed"))
        .cast("decimal(20,0)")
        .alias("final_checksum"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


# --- file statistics and manifests ------------------------------------------------------


def file_statistics(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Bytes, non-blank lines and content checksum of every file, read in ranges."""
    lines = ordered_lines(spark, paths)
    text = F.decode("raw", "ISO-8859-1")
    filled = F.length(F.trim(text, F.lit(" \t\r"))) > 0
    counts = lines.groupBy("file_no", "file").agg(
        F.count_if(filled).alias("record_count"),
        F.sum(F.octet_length("raw") + F.col("ended").cast("int")).alias("byte_size"),
    )
    newline = F.when(F.col("ended"), F.unhex(F.lit("0A"))).otherwise(F.unhex(F.lit("")))
    content = chained_checksum(
        lines,
        ["file_no"],
        ["offset"],
        F.concat("raw", newline),
        whole_div("offset", _SLICE),
        "content_checksum",
    )
    return counts.join(content, "file_no")


def describe_files(
    spark: SparkSession, paths: Sequence[str], fmt: str = "auto"
) -> DataFrame:
    """Manifest rows of a rotated log, one per file in chain order: file_no, file_name,
    record_count, byte_size, content_checksum, audit_chain_checksum.

    The chain value of a file is the checksum its last row logged, or that of the file before
    for a file without rows. The number of files is bounded by the listing that named them.
    """
    named = spark.createDataFrame(
        [(number, os.path.basename(path)) for number, path in enumerate(paths)],
        "file_no INT, file_name STRING",
    )
    last = read_audit(spark, paths, fmt).groupBy("file_no").agg(
        F.max_by("checksum", "offset").alias("_last")
    )
    offset = codec.big(fnv.OFFSET).cast("decimal(20,0)")
    zero = F.lit(0).cast("bigint")
    listed = (
        named.join(file_statistics(spark, paths).drop("file"), "file_no", "left")
        .join(last, "file_no", "left")
    )
    return block_scan(
        listed, [], ["file_no"], F.lit(0).cast("bigint"), latest={"_chain": F.col("_last")}
    ).select(
        "file_no",
        "file_name",
        F.coalesce("record_count", zero).alias("record_count"),
        F.coalesce("byte_size", zero).alias("byte_size"),
        F.coalesce("content_checksum", offset).alias("content_checksum"),
        F.coalesce("_chain", offset).alias("audit_chain_checksum"),
    )


def file_issues(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Differences between manifest rows and the files as they are: kind, file_name, detail.

    ``found`` holds ``file_statistics`` of the files present, with their ``file_name``.
    """
    now = found.select(
        "file_name",
        F.lit(True).alias("_there"),
        F.col("byte_size").alias("_size"),
        F.col("record_count").alias("_records"),
        F.col("content_checksum").alias("_content"),
    )
    offset = codec.big(fnv.OFFSET).cast("decimal(20,0)")
    both = entries.join(now, "file_name", "left").withColumns(
        {
            "_size": F.coalesce("_size", F.lit(0)),
            "_records": F.coalesce("_records", F.lit(0)),
            "_content": F.coalesce("_content", offset),
        }
    )

    def issue(when, kind, text, *values):
        detail = F.format_string(text, *map(F.col, values)) if values else F.lit(text)
        return F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))

    there = F.col("_there")
    issues = F.array(
        issue(there.isNull(), "missing_file", "file not found"),
        issue(
            there & (F.col("_size") != F.col("byte_size")), "size_mismatch",
            "byte size mismatch: expected %d, found %d", "byte_size", "_size",
        ),
        issue(
            there & (F.col("_content") != F.col("content_checksum")),
            "content_checksum_mismatch", "content checksum mismatch",
        ),
        issue(
            there & (F.col("_records") != F.col("record_count")), "record_count_mismatch",
            "record count mismatch: expected %d, found %d", "record_count", "_records",
        ),
    )
    return both.select("file_name", F.explode(F.array_compact(issues)).alias("i")).select(
        "i.kind", "file_name", "i.detail"
    )


def files_now(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file_statistics`` of files that exist, empty ones included, by ``file_name``."""
    named = spark.createDataFrame(
        [(number, os.path.basename(path)) for number, path in enumerate(paths)],
        "file_no INT, file_name STRING",
    )
    if not paths:
        zero = F.lit(0).cast("bigint")
        return named.select("file_name", zero.alias("byte_size"), zero.alias("record_count"),
                            zero.cast("decimal(20,0)").alias("content_checksum"))
    return named.join(file_statistics(spark, paths).drop("file"), "file_no", "left")


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per (small) file for provenance."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )


@dataclass(frozen=True)
class ManifestFile:
    file_name: str
    record_count: int
    byte_size: int
    content_checksum: int
    audit_chain_checksum: int


@dataclass(frozen=True)
class Manifest:
    """Inventory of a rotated audit log; one entry per file."""

    format: str
    files: list[ManifestFile]
    creator: str = ""
    created_at: str = ""
    schema_version: int = SCHEMA_VERSION
    chain_checksum: int = 0
    signature: str | None = None
    signature_algorithm: str = ""
    signature_key_id: str = ""


@dataclass(frozen=True)
class ManifestCheck:
    valid: bool
    files_checked: int
    entries_checked: int
    computed_chain_checksum: int
    signature_present: bool = False
    signature_valid: bool = False
    issues: list[tuple[str, str, str]] = field(default_factory=list)


def _text(value: str) -> bytes:
    raw = value.encode()
    return len(raw).to_bytes(8, "little") + raw


def manifest_chain(manifest: Manifest) -> int:
    """Checksum over the manifest's own entries (one per file, driver side)."""
    data = manifest.schema_version.to_bytes(4, "little")
    data += FORMAT_CODES[manifest.format].to_bytes(1, "little")
    data += len(manifest.files).to_bytes(8, "little")
    for f in manifest.files:
        numbers = (f.record_count, f.byte_size, f.content_checksum, f.audit_chain_checksum)
        data += _text(f.file_name) + b"".join(n.to_bytes(8, "little") for n in numbers)
    return fnv.fnv1a(data)


def canonical_payload(manifest: Manifest, title: str) -> bytes:
    """Signed text. ``title`` is its first line, agreed between signer and verifier."""
    rows = [
        title,
        f"schema_version={manifest.schema_version}",
        f"format={manifest.format}",
        f"creator={manifest.creator}",
        f"chain_checksum={manifest.chain_checksum}",
    ]
    rows += [
        f"file={f.file_name},{f.record_count},{f.byte_size},{f.content_checksum},"
        f"{f.audit_chain_checksum}"
        for f in manifest.files
    ]
    return ("\n".join(rows) + "\n").encode()


def sign(manifest: Manifest, key: bytes, title: str) -> str:
    return hmac.new(key, canonical_payload(manifest, title), hashlib.sha256).hexdigest()


def key_from_file(path: str) -> bytes:
    system, plain = open_path(path)
    with system.open_input_stream(plain) as stream:
        return stream.read()


def key_from_env(name: str) -> bytes | None:
    value = os.environ.get(name)
    return None if value is None else value.encode()


def generate_manifest(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "jsonl",
    *,
    creator: str = "tickloom",
    created_at: str = "",
    signing_key: bytes = b"",
    key_id: str = "",
    title: str = "audit-manifest",
) -> Manifest:
    """Scan the files once, verify their chain and describe them.

    Only one row per file reaches the driver. The chain value of a file is the checksum its
    last row logged, which the single verification pass has proved.
    """
    verified = verify_chain(spark, paths, fmt).first()
    if not verified.valid:
        raise ValueError(f"unable to verify audit chain: {verified.error}")
    rows = describe_files(spark, paths, fmt).orderBy("file_no").collect()
    files = [
        ManifestFile(
            r.file_name, r.record_count, r.byte_size, int(r.content_checksum),
            int(r.audit_chain_checksum),
        )
        for r in rows
    ]
    draft = Manifest(fmt, files, creator, created_at)
    sealed = Manifest(**{**draft.__dict__, "chain_checksum": manifest_chain(draft)})
    if not signing_key:
        return sealed
    return Manifest(
        **{
            **sealed.__dict__,
            "signature": sign(sealed, signing_key, title),
            "signature_algorithm": SIGNATURE_ALGORITHM,
            "signature_key_id": key_id,
        }
    )


def manifest_lines(manifest: Manifest) -> list[str]:
    head = {
        "record": "manifest",
        "schema_version": manifest.schema_version,
        "format": manifest.format,
        "creator": manifest.creator,
        "created_at": manifest.created_at,
        "chain_checksum": manifest.chain_checksum,
    }
    if manifest.signature is not None:
        head["signature_algorithm"] = manifest.signature_algorithm
        head["signature_key_id"] = manifest.signature_key_id
        head["signature"] = manifest.signature
    rows = [head] + [{"record": "file"} | f.__dict__ for f in manifest.files]
    return [json.dumps(r, separators=(",", ":")) for r in rows]


def parse_manifest(text: str) -> Manifest:
    """Read manifest lines: one header first, then file records."""
    head, files = None, []
    for number, line in enumerate((x for x in text.splitlines() if x), start=1):
        row = json.loads(line)
        kind = row.get("record")
        if kind is None:
            raise ValueError(f"line {number}: missing record field")
        if kind == "manifest":
            if head is not None:
                raise ValueError(f"line {number}: duplicate manifest header")
            if not isinstance(row.get("schema_version"), int) or not isinstance(
                row.get("chain_checksum"), int
            ):
                raise ValueError(f"line {number}: malformed manifest header")
            if row.get("format") not in FORMAT_CODES:
                raise ValueError(f"line {number}: invalid format")
            head = row
        elif kind == "file":
            if head is None:
                raise ValueError(f"line {number}: file entry before manifest header")
            try:
                files.append(ManifestFile(**{k: row[k] for k in ManifestFile.__annotations__}))
            except KeyError:
                raise ValueError(f"line {number}: malformed file entry") from None
        else:
            raise ValueError(f"line {number}: unknown record type")
    if head is None:
        raise ValueError("missing manifest header")
    return Manifest(
        head["format"],
        files,
        head.get("creator", ""),
        head.get("created_at", ""),
        head["schema_version"],
        head["chain_checksum"],
        head.get("signature"),
        head.get("signature_algorithm", ""),
        head.get("signature_key_id", ""),
    )


def write_manifest(manifest: Manifest, path: str) -> None:
    system, plain = open_path(path)
    with system.open_output_stream(plain) as out:
        out.write(("\n".join(manifest_lines(manifest)) + "\n").encode())


def read_manifest(path: str) -> Manifest:
    return parse_manifest(key_from_file(path).decode())


def verify_manifest(
    spark: SparkSession,
    manifest: Manifest,
    base_dir: str,
    *,
    signing_key: bytes = b"",
    title: str = "audit-manifest",
) -> ManifestCheck:
    """Compare a manifest with the files as they are now: presence, size, content, records,
    audit chain, own chain and signature."""
    issues: list[tuple[str, str, str]] = []
    own = manifest_chain(manifest)
    if own != manifest.chain_checksum:
        issues.append(
            (
                "manifest_chain_mismatch",
                "",
                f"manifest chain checksum mismatch: expected {own}, recorded "
                f"{manifest.chain_checksum}",
            )
        )
    paths = [os.path.join(base_dir, f.file_name) for f in manifest.files]
    there = [p for p in paths if open_path(p)[0].get_file_info(open_path(p)[1]).is_file]
    rows = spark.createDataFrame(
        [(f.file_name, f.record_count, f.byte_size, Decimal(f.content_checksum))
         for f in manifest.files],
        "file_name STRING, record_count BIGINT, byte_size BIGINT, "
        "content_checksum DECIMAL(20,0)",
    )
    kinds = ("missing_file", "size_mismatch", "content_checksum_mismatch", "record_count_mismatch")
    places = {f.file_name: k for k, f in enumerate(manifest.files)}
    found = [tuple(r) for r in file_issues(rows, files_now(spark, there)).collect()]
    issues += sorted(found, key=lambda i: (i[0] != kinds[0], places[i[1]], kinds.index(i[0])))
    intact = not found
    entries = 0
    if intact and paths:
        chain = verify_chain(spark, paths, manifest.format).first()
        entries = chain.entries_checked
        expected = manifest.files[-1].audit_chain_checksum
        if int(chain.final_checksum) != expected:
            issues.append(
                (
                    "audit_chain_mismatch",
                    "",
                    f"audit chain checksum mismatch: expected {expected}, recomputed "
                    f"{chain.final_checksum}",
                )
            )
    signed, genuine = manifest.signature is not None, False
    if signed and manifest.signature_algorithm != SIGNATURE_ALGORITHM:
        text = f"unsupported signature algorithm: {manifest.signature_algorithm}"
        issues.append(("signature_mismatch", "", text))
    elif signed and not signing_key:
        issues.append(("key_missing", "", "signed manifest but no key provided"))
    elif signed:
        genuine = hmac.compare_digest(sign(manifest, signing_key, title), manifest.signature)
        if not genuine:
            issues.append(("signature_mismatch", "", "HMAC-SHA256 signature mismatch"))
    elif signing_key:
        issues.append(("signature_missing", "", "key provided but manifest is unsigned"))
    return ManifestCheck(
        not issues, len(manifest.files), entries, own, signed, genuine, issues
    )
