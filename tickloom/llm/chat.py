"""Chat formatting: every dialogue once per participant, with that speaker as the assistant.

The speaker's own turns are assistant turns and are trained on; the other participants become
named users; system turns stay what they are. Masks are character spans of the rendered text, from
the first character of a trained turn through its end mark. A dialogue is rendered in parts of
``part_turns`` turn numbers, so that no endless dialogue meets in one task; the parts one after
the other are the whole dialogue, and participants are those of the whole dialogue.

Defined cases: a null role is the participant ``unknown``, a null text is empty, a null turn
stands before all others in a part of its own (-1), and null conversation ids are one dialogue.
Equal turn numbers stand by role, then text; repeated rows are repeated turns. A dialogue without
participants (only system turns) gives no rows. Control marks inside a text are broken up, so that
no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
END = "<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text", system_role: str = "system",
           part_turns: int = PART_TURNS) -> DataFrame:
    """conv id, speaker, part, n_turns, rendered, mask (array of start and end), n_trained."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
            .alias("text")).alias("said"))
    speakers = rows.filter(F.col("said.role") != system_role).select(
        F.col("conv").alias("of"), F.col("said.role").alias("speaker")).distinct()
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))
    seen = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of")))
    head = lambda s: (
        F.when(s["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
        .when(s["role"] == system_role, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="),
                            F.regexp_replace(s["role"], "[^A-Za-z0-9_-]", "_"), F.lit("|>\n"))))
    seen = seen.select("conv", "speaker", "part", F.transform("said", lambda s: F.struct(
        head(s).alias("head"), F.concat(s["text"], F.lit(END)).alias("body"),
        (s["role"] == F.col("speaker")).alias("train"))).alias("seg"))
    # Running ends; a part has few turns, so the growing array stays small.
    ends = F.aggregate(
        "seg", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(
            F.element_at(a, -1) + F.char_length(s["head"]) + F.char_length(s["body"]))))
    seen = seen.withColumn("ends", ends)
    spans = F.transform("seg", lambda s, i: F.struct(
        s["train"].alias("train"),
        (F.get("ends", i) + F.char_length(s["head"])).cast("long").alias("start"),
        F.get("ends", i + 1).cast("long").alias("end")))
    seen = seen.withColumn("mask", F.transform(
        F.filter(spans, lambda x: x["train"]),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return seen.select(
        F.col("conv").alias(conv_col), "speaker", "part",
        F.size("seg").cast("long").alias("n_turns"),
        F.array_join(F.transform("seg", lambda s: F.concat(s["head"], s["body"])), "")
        .alias("rendered"), "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        .alias("n_trained"))
