"""Training-data pipeline over ``documents``: quality rules, exact dedup, near dedup, mixing and
packing. Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import exact, mix, near, queries, rules
from tickloom.session import configure, shared_dir


# Stages link near copies from 80 % on; the 85 % of op7_near_dedup is that query's own contract.
# 36 bands of 7 registers: a pair at 80 % shares none with chance 2e-4.
NEAR = near.Near(percent=80, band_rows=7)
LINES = rules.LineRules()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are frequent in their host leave the others. Near copies
    count as one document of the host, so that one of them is left for the later stages."""
    return rules.cleaned(docs, LINES)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.deduplicated(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mix, once per epoch."""
    return mix.taken(docs, queries.MIX, queries.domain_of_source())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins: doc_id, piece, piece_start, piece_size, bin_id, bin_offset."""
    return queries.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("packing", packing),
]

# Near duplicates and best-fit bins have no SQL form; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline/{number}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
