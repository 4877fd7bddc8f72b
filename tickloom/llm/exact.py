"""Exact dedup: a two-pass Bloom filter finds the rows that may repeat; only those shuffle.

Pass 1 hashes every row to two cells of a counting filter and keeps the cells that were hit at
least twice, packed into 64-bit words. Pass 2 probes the filter: a row with a cell hit only once
is alone and passes straight through. The others, copies and a few false alarms, are grouped by
their full key. The filter has at most ``max_bits`` cells, whatever the input, so that its words
may be broadcast; where there are more rows than it can tell apart, more rows are grouped and
the result stays the same.

Defined cases: a null text counts as empty, and all empty texts are one group. Null ids sort
last among the rows of a group. Where rows share key, size and id, one of them stays. Input
columns named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import drop_spaces, free_names, text_of, without
from tickloom.session import stage

OUTPUTS = ["keep_id", "group_size", "kept"]
BITS_PER_ROW = 16
MAX_BITS = 1 << 26


def text_key(text: str) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(drop_spaces(text_of(text)).cast("binary"), 256)


def _cells(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(2)]


def _filter_words(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Words of the filter: cells that at least two rows hit."""
    cells = rows.select(F.explode(F.array_distinct(F.array(*_cells(key, bits)))).alias("cell"))
    twice = cells.groupBy("cell").count().filter("count > 1")
    return twice.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )


def mark_copies(rows: DataFrame, key: str, id_col: str, size: str,
                max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with ``keep_id``, ``group_size`` and ``kept``; of equal keys the row with the
    largest ``size``, then the smallest id, stays."""
    rows = without(rows, OUTPUTS, [key, id_col, size])
    columns = rows.columns
    n = rows.count()
    bits = min(max_bits, 1 << max(10, (n * BITS_PER_ROW - 1).bit_length()))
    # At most max_bits / 64 rows: small enough to send to every executor.
    words = F.broadcast(stage(_filter_words(rows, key, bits), "repeat-filter"))
    suspect, word, mask, best, ties, turn = free_names(
        rows, "_suspect", "_word", "_mask", "_best", "_ties", "_turn")
    probed = rows.withColumn(suspect, F.lit(True))
    for cell in _cells(key, bits):
        probed = probed.join(
            words.select(F.col("word").alias(word), F.col("bits").alias(mask)),
            F.shiftright(cell, 6) == F.col(word), "left",
        ).withColumn(
            suspect,
            F.col(suspect) & F.coalesce(
                F.getbit(F.col(mask), cell.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)),
        ).drop(word, mask)
    alone = probed.filter(~F.col(suspect)).select(
        *columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    suspects = probed.filter(suspect).select(*columns)

    # Equal (key, size, id) first, then the best of each key: both combine before the shuffle.
    order = F.struct((-F.col(size)).alias("a"), F.col(id_col).isNull().alias("b"),
                     F.col(id_col).alias("c"))
    groups = (
        suspects.groupBy(key, size, id_col).agg(F.count("*").alias(ties))
        .groupBy(F.col(key).alias(word))
        .agg(F.min(F.struct(order.alias("o"), F.col(ties).alias("n"))).alias(best),
             F.sum(ties).alias("group_size"))
    )
    joined = suspects.join(groups, F.col(key) == F.col(word)).select(
        *columns, F.col(f"{best}.o.c").alias("keep_id"), "group_size",
        (order == F.col(f"{best}.o")).alias("kept"), F.col(f"{best}.n").alias(ties))
    tied = F.col("kept") & (F.col(ties) > 1)
    single = joined.filter(~tied).drop(ties)
    # Rows written twice, with the same id: any one of them stays.
    repeated = (
        joined.filter(tied).withColumn(
            turn, F.row_number().over(Window.partitionBy(key).orderBy(id_col)))
        .withColumn("kept", F.col(turn) == 1).drop(ties, turn)
    )
    return alone.unionByName(single).unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``n_points``.

    Texts are equal when they are so without white space; the longest original text stays.
    """
    docs = without(docs, ["text_sha256", "n_points"], [id_col, text_col])
    keyed = docs.withColumn("text_sha256", text_key(text_col)).withColumn(
        "n_points", F.char_length(text_of(text_col)).cast("long"))
    return mark_copies(keyed, "text_sha256", id_col, "n_points", max_bits)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    inner = docs
    renamed = {}
    for c in docs.columns:
        if c.lower() in {*OUTPUTS, "text_sha256", "n_points"}:
            renamed[c] = free_names(inner, f"_in_{c}")[0]
            inner = inner.withColumnRenamed(c, renamed[c])
    found = exact_dedup(inner, renamed.get(id_col, id_col), renamed.get(text_col, text_col))
    return found.filter("kept").select(
        *[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
