"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space, as the contracts of the text operators name it.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def drop_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for every stem that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names


def without(df: DataFrame, outputs: list[str], needed: list[str]) -> DataFrame:
    """``df`` without columns that an operator's outputs replace."""
    clash = {c.lower() for c in outputs} & {c.lower() for c in needed}
    if clash:
        raise ValueError(f"input columns have names of outputs: {sorted(clash)}")
    return df.drop(*[c for c in df.columns if c.lower() in {o.lower() for o in outputs}])
