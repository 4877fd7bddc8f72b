"""Packing: best fit decreasing into bins that never hold two documents of a source or of a
duplicate cluster.

Documents longer than a bin are cut into full bins and a rest, so that nothing is lost. Rows are
dealt at random over tasks of about ``per_task`` rows, whatever their source or cluster, and each
task packs its own bins: open bins stand ordered by what is left in them and carry the sources and
clusters they hold as bitmaps. A piece goes to the first bin from its own size upward whose
bitmaps have neither its source nor its cluster; only if no bin does, a new one is opened.

Defined cases: a null source or cluster conflicts with nothing. A null or negative size counts as
0; pieces of size 0 are packed like others. Repeated rows are packed each, and being of one
cluster, apart. Ties go by id, then piece. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

PER_TASK = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int],
             capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for pieces in the given order; source and cluster numbers from 0, -1 none."""
    residual: list[tuple[int, int]] = []  # (left, bin), ordered
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters, by bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s_bit = 1 << source if source >= 0 else 0
        c_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(residual, (size, -1))
        while at < len(residual):
            has_s, has_c = held[residual[at][1]]
            if not (has_s & s_bit or has_c & c_bit):
                break
            at += 1
        if at < len(residual):
            left, number = residual.pop(at)
        else:
            left, number = capacity, len(held)
            held.append((0, 0))
        has_s, has_c = held[number]
        held[number] = (has_s | s_bit, has_c | c_bit)
        out.append((number, capacity - left))
        insort(residual, (left - size, number))
    return out


def _pack_task(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece_size", "id", "piece", "source", "cluster"],
                                ascending=[False, True, True, True, True], kind="stable")
        sources = pd.factorize(rows["source"])[0].tolist()
        clusters = pd.factorize(rows["cluster"])[0].tolist()
        placed = best_fit(rows["piece_size"].tolist(), sources, clusters, capacity)
        task = int(rows["task"].iloc[0])
        return pd.DataFrame({
            "id": rows["id"], "piece": rows["piece"], "piece_start": rows["piece_start"],
            "piece_size": rows["piece_size"], "bin_id": [(task << 32) + b for b, _ in placed],
            "bin_offset": [o for _, o in placed]})
    return run


def pack(rows: DataFrame, capacity: int, id_col: str, size_col: str, source_col: str,
         cluster_col: str, per_task: int = PER_TASK) -> DataFrame:
    """One row per piece: id, piece, piece_start, piece_size, bin_id, bin_offset."""
    keyed = stage(rows.select(
        F.col(id_col).alias("id"),
        F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.col(cluster_col).cast("string").alias("cluster")), "pack-rows")
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = keyed.withColumn("place", F.monotonically_increasing_id()).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.select(
        "id", "piece", (F.col("piece") * capacity).alias("piece_start"),
        F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long")
        .alias("piece_size"), "source", "cluster", "place")
    tasks = max(1, -(-pieces.count() // per_task))
    # The place in the staged rows, not the id, deals: rows of one id spread as well.
    dealt = pieces.withColumn(
        "task", F.pmod(F.xxhash64("place", "piece"), F.lit(tasks)).cast("int")).drop("place")
    id_type = keyed.schema["id"].dataType.simpleString()
    return dealt.groupBy("task").applyInPandas(
        _pack_task(capacity), f"id {id_type}, piece long, piece_start long, piece_size long, "
                              "bin_id long, bin_offset long")
