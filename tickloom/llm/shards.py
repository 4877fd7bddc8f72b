"""Sharding: a minimax contiguous partition of atomic groups.

Documents with equal text form a group that is never divided. Groups stand in the order of their
first document. The smallest capacity is searched for which a greedy walk needs no more shards
than there are; the groups are then cut there. The walk only asks "which is the last group end at
or below this offset", so many capacities walk at once: each step is one job in which every
partition of the sorted ends answers by binary search, and the driver holds one number per
capacity under test.

Defined cases: a null text is empty, and all empty texts are one group. Null ids sort first.
Repeated rows are separate rows of one group and get different slots. With fewer groups than
shards, some shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import text_of
from tickloom.session import stage

PROBES = 4096  # capacities under test at once


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("grp"))


def _ordered(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows in group order with their number and byte offset; bytes of all, and of the largest
    group. Range partitions hold the order, so a large group spreads over several of them."""
    groups = docs.groupBy("grp").agg(
        F.min("id").alias("first"), F.sum("size").alias("grp_size"))
    order = ["first", "grp", "id"]
    rows = stage(
        docs.join(groups, "grp").repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().alias("place")), "shard-order")
    # One row per partition.
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"),
                                     F.max("grp_size").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                          F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    totals = parts.agg(F.sum("b").alias("b"), F.max("m").alias("m")).first()
    within = Window.partitionBy("part").orderBy("place")
    placed = rows.join(starts, "part").select(
        "id", "size", "crc", "grp", "grp_size", "place",
        (F.col("n0") + F.row_number().over(within) - 1).alias("row_no"),
        (F.col("b0") + F.sum("size").over(within)).alias("ends"))
    return placed, totals.b or 0, totals.m or 0


def _last_ends(ends: DataFrame, offsets: list[int]) -> list[int]:
    """For each offset the largest group end at or below it, or -1."""
    wanted = np.array(offsets, dtype=np.int64)

    def answer(batches):
        for batch in batches:
            own = np.sort(batch.column(0).to_numpy())
            at = np.searchsorted(own, wanted, side="right") - 1
            hit = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit, pa.int64()), pa.array(own[at[hit]], pa.int64())], ["i", "e"])

    best = ends.mapInArrow(answer, "i long, e long").groupBy("i").agg(F.max("e").alias("e"))
    out = [-1] * len(offsets)
    for i, e in best.collect():  # one row per offset at most
        out[i] = e
    return out


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int,
                 probes: int = PROBES) -> list[int]:
    """Byte offsets at which each shard ends, for the smallest capacity that fits."""
    low = max(largest, -(-total // shards))  # no smaller capacity can do
    high = max(low, total // shards + largest)  # greedy always fits with this
    while True:
        step = max(1, -(-(high - low) // max(1, probes - 1)))
        tries = list(range(low, high, step)) + [high]
        at, walks = [0] * len(tries), [[] for _ in tries]
        for _ in range(shards):
            asked = sorted({min(total, a + c) for a, c in zip(at, tries)})
            found = dict(zip(asked, _last_ends(ends, asked)))
            at = [max(a, found[min(total, a + c)]) for a, c in zip(at, tries)]
            for walk, a in zip(walks, at):
                walk.append(a)
        fit = next(k for k, a in enumerate(at) if a >= total)
        if step == 1 or fit == 0:
            return walks[fit]
        low, high = tries[fit - 1] + 1, tries[fit]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          probes: int = PROBES) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, group_bytes."""
    placed, total, largest = _ordered(stage(_keyed(docs, id_col, text_col), "shard-keys"))
    placed = stage(placed, "shard-places")
    ends = stage(placed.groupBy("grp").agg(F.max("ends").alias("e")).select("e"), "shard-ends")
    cuts = minimax_cuts(ends, total, largest, shards, probes) if total else [0] * shards
    start = F.col("ends") - F.col("size")
    number = sum((F.when(start >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    rows = placed.withColumn("shard", number)
    # One row per shard; rows of a shard are numbered without gaps already.
    firsts = rows.groupBy("shard").agg(F.min("row_no").alias("first_no"))
    return rows.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard",
        (F.col("row_no") - F.col("first_no")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("grp_size").alias("group_bytes"))
