"""Vectors in numbered blocks, and blocks of searched rows brought together with every query.

A row block and a query chunk are bounded; each pair of them is one group, so no task sees more
than ``block_rows`` rows and about ``query_rows`` queries. Rows are copied once per query chunk,
queries once per row block: a search of a stated query set over all rows, in blocks. Vectors of
different lengths never meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import number_rows, whole_div
from tickloom.session import stage


@dataclass(frozen=True)
class Blocks:
    block_rows: int = 4096
    query_rows: int = 4096


def whole_vectors(vectors: DataFrame) -> Column:
    """Has an id and a vector whose components are all there and finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine, F.lit(False))


def in_blocks(rows: DataFrame, order: list[str], rule: Blocks) -> DataFrame:
    """``rows`` (dim, ...) with ``block`` in ``order`` of each dim and a unique ``row_no``."""
    placed = number_rows(rows, ["dim"], order, "place")
    return stage(placed.select(
        *rows.columns, (F.col("dim").cast("long") * (1 << 40) + F.col("place")).alias("row_no"),
        whole_div(F.col("place") - 1, rule.block_rows).alias("block")), "blocks")


def meeting(rows: DataFrame, queries: DataFrame, rule: Blocks):
    """Cogrouped pairs of (dim, block, chunk): rows of the block, queries of the chunk."""
    chunks = max(1, -(-queries.count() // rule.query_rows))
    blocks = rows.groupBy("dim").agg(F.max("block").alias("last_block"))
    chunk = F.pmod(F.xxhash64("row_no"), F.lit(chunks)).cast("int")
    asked = queries.join(blocks, "dim").withColumns({
        "chunk": chunk, "block": F.explode(F.sequence(F.lit(0).cast("long"), "last_block"))
    }).drop("last_block")
    copied = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    key = ["dim", "block", "chunk"]
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # may stem from ``rows``
    return copied.groupBy(*key).cogroup(asked.groupBy(*key))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """Rows x length of a column of equally long lists."""
    values = table.column(name).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
