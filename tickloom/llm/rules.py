"""Quality rules: lines that too many documents of a host share are removed; what is then depleted
is rejected.

Every line is normalised (lower case, no white space, digits or ASCII punctuation) and hashed
together with its host. Lines are counted per host once for each different document text, so that
copies of one document never make its own lines frequent; the limit is ``max(min_docs, share *
different documents of the host)``. Near copies have different texts, so lines are counted again: a
text with ``copied_share`` or more of its words in lines above the limit counts for the smallest
key of those lines, all texts with that key once. Near copies agree in that key, whatever else they
edit, while pages that only share boilerplate have words of their own and count by text. A line
that is still above the limit is removed from the documents of that host, and a document left with
fewer than ``min_left`` words, or less than ``min_share`` of its words, is rejected.

Defined cases: a null text has no words and fails; a null host is a host of its own. Lines without
a letter are never counted. Repeated rows get the same verdict. Input columns named as an output
are replaced. Window hashes have 64 bits and are compared within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, drop_spaces, free_names, text_of, words_of
from tickloom.session import stage

# Characters that a line's normal form leaves out.
NOISE = SPACES + "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    min_docs: int = 5  # only keeps a handful of documents apart
    share: float = 0.02
    copied_share: float = 0.8
    min_left: int = 10
    min_share: float = 0.1
    min_words: int = 10
    repeat_percent: int = 20


def _line_key(host: Column, plain: Column) -> Column:
    """Eight bytes for a host's line, in the order of their hexadecimal digits."""
    named = F.concat(F.coalesce(F.concat(F.lit("h"), host), F.lit("")), F.lit("\n"), plain)
    return F.unhex(F.substring(F.md5(named), 1, 16))


def _facts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document: counts for the base rules, and its lines as keys with word counts."""
    text = F.col("t")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"),
        text_of(text_col).alias("t"),
    ).select("*", words_of(text).alias("w"), F.split(text, "\n").alias("l"))
    gram = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)])
    rows = rows.select(
        "id", "host", F.xxhash64("t").alias("content"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(drop_spaces(text)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.filter("l", lambda x: F.char_length(drop_spaces(x)) > 0).alias("worded"),
        F.transform("l", lambda x: F.translate(F.lower(x), NOISE, "")).alias("plain"),
        F.transform("l", lambda x: F.size(words_of(x))).alias("line_words"),
        F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), gram))
        .otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    counts = ["id", "host", "content", "n_words", "word_chars", "n_symbols"]
    rows = rows.select(
        *counts, "line_words", "grams",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.transform("plain", lambda x: F.when(x != "", _line_key(F.col("host"), x))
                    ).alias("line_keys"),
        (F.size("grams") > F.size(F.array_distinct("grams"))).alias("repeats"),
    )
    counts += ["n_dup_lines", "line_keys", "line_words"]
    # Only texts with a repeated window sort their windows.
    rows = rows.select(*counts, F.when(F.col("repeats"), F.sort_array(F.transform(
        "grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("s"))
    same = lambda x, j: x["g"] == F.get("s", j)["g"]
    rows = rows.select(*counts, F.sort_array(F.transform(
        F.filter("s", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False))
                 | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])).alias("p"))
    reach = F.transform("p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("p", j + 1) - p,
                                                                      F.lit(5))))
    return rows.select(*counts, F.coalesce(
        F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
        .alias("n_repeat_words"))


def _lines(facts: DataFrame, *columns: str) -> DataFrame:
    """One row per keyed line: its key, place and words, with ``columns`` of its document."""
    pairs = F.arrays_zip(F.col("line_keys").alias("k"), F.col("line_words").alias("n"))
    return facts.select(*columns, F.posexplode(pairs)).select(
        *columns, "pos", F.col("col.k").alias("key"), F.col("col.n").alias("n")
    ).filter("key is not null")


def _frequent_lines(facts: DataFrame, rules: LineRules) -> DataFrame:
    """Keys of lines above the limit of their host."""
    keys = facts.select("host", "content", F.explode(F.array_distinct("line_keys")).alias("key"))
    keys = keys.filter("key is not null")
    # All documents first: a key and a count per task. Few lines stay, and only their different
    # documents are counted.
    often = keys.groupBy("key").count().filter(F.col("count") > rules.min_docs).select("key")
    hosts = facts.select("host", "content").distinct().groupBy(F.col("host").alias("of")).agg(
        F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(rules.min_docs), F.floor(F.col("host_docs") * rules.share))

    def above(places: DataFrame) -> DataFrame:
        counted = places.groupBy("key", "host").agg(F.count("*").alias("n"))
        return counted.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(
            F.col("n") > limit).select("key")

    first = stage(above(keys.join(often, "key").select("key", "host", "content").distinct()),
                  "line-first")
    # A text's lines are the same in all its rows: places tell them apart.
    hit = _lines(facts, "host", "content", "n_words").join(first, "key").distinct()
    texts = hit.groupBy("host", "content").agg(
        F.sum("n").alias("hit_words"), F.max("n_words").alias("n_words"),
        F.min("key").alias("low"), F.collect_set("key").alias("keys"))
    copied = F.col("hit_words") >= rules.copied_share * F.col("n_words")
    return above(texts.select(
        "host", F.when(copied, F.col("low")).alias("low"),
        F.when(~copied, F.col("content")).alias("content"), F.explode("keys").alias("key")
    ).distinct())


def _removed(facts: DataFrame, frequent: DataFrame) -> DataFrame:
    """Line numbers and words that each document loses."""
    hit = _lines(facts, "id", "host", "content").join(frequent, "key")
    # A row written twice has the same lines: the set holds them once.
    return hit.groupBy("id", "host", "content").agg(
        F.collect_set(F.struct("pos", "n")).alias("gone")
    ).select(F.col("id").alias("i"), F.col("host").alias("h"), F.col("content").alias("c"),
             F.transform("gone", lambda x: x["pos"]).alias("gone"),
             F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]).alias("gone_words"))


def _judged(docs: DataFrame, rules: LineRules, id_col: str, text_col: str,
            host_col: str) -> DataFrame:
    facts = stage(_facts(docs, id_col, text_col, host_col), "line-facts")
    removed = _removed(facts, _frequent_lines(facts, rules))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(("id", "host", "content"), "ihc")]
    left = F.col("n_words") - F.col("words_removed")
    return facts.join(removed, same, "left").select(
        "id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "gone", F.coalesce("gone_words", F.lit(0)).cast("long")
        .alias("words_removed"),
    ).withColumn(
        "base_failed", (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    ).withColumn(
        "depleted", (F.col("words_removed") > 0)
        & ((left < rules.min_left) | (left < rules.min_share * F.col("n_words")))
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
          text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: the counts, ``words_removed``, ``base_failed``, ``depleted``,
    ``kept``."""
    found = _judged(docs, rules, id_col, text_col, host_col)
    return found.drop("host", "content", "gone").withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
            text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that stay, with the columns of ``docs``, without their frequent lines."""
    found = _judged(docs, rules, id_col, text_col, host_col)
    bad = stage(found.filter(~F.col("kept") | (F.col("words_removed") > 0)).select(
        F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("content").alias("_content"),
        F.col("kept").alias("_kept"), F.col("gone").alias("_gone")).dropDuplicates(
        ["_id", "_host", "_content"]), "line-verdicts")
    names = free_names(docs, "_id", "_host", "_content", "_kept", "_gone")
    bad = bad.toDF(*names)
    key = [F.col(id_col), F.col(host_col).cast("string"), F.xxhash64(text_of(text_col))]
    joined = docs.join(bad, [a.eqNullSafe(F.col(b)) for a, b in zip(key, names)], "left")
    kept, gone = F.col(names[3]), names[4]
    lines = F.filter(F.split(text_of(text_col), "\n"),
                     lambda _, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.size(F.col(gone)) > 0, F.array_join(lines, "\n")).otherwise(F.col(text_col))
    return joined.filter(F.coalesce(kept, F.lit(True))).select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
