"""Mixing to target weights: budgets run down a domain-language-source tree.

A node's capacity is what its leaves hold times ``max_epochs``. From the root down, each node's
budget is shared among its children by weight; children that cannot use their share are filled,
and what they leave goes to their siblings. Only when all siblings are full is there anything left
over, so shortages reach an ancestor's siblings last. Each level is one set of window sums in
exact whole numbers. A leaf then takes as many whole epochs as its budget holds, and of the next
epoch's seeded order the prefix that still fits. That prefix is found by summing tokens per slice
of the order; only the one slice in which it ends is sorted.

Defined cases: null tree values count as the empty name, null and empty texts have no tokens.
Documents without tokens in the prefix are taken. Equal places of the order (a repeated id) stand
by token count. An empty table, or no tokens at all, gives no copies. Input columns named as an
output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import free_names, text_of, without, words_of
from tickloom.session import stage

BROADCAST_LEAVES = 50_000
OUTPUTS = ["domain", "n_tokens", "copies", "leaf_budget"]


@dataclass(frozen=True)
class Mix:
    """``percent`` of all tokens is the budget. Weights are whole numbers from 1 by path, as
    ``("web",)`` or ``("web", "en")``; a path not named weighs 1."""

    percent: int = 100
    max_epochs: int = 2
    seed: int = 7
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)


def _weight(path: list[str], weights: dict[tuple[str, ...], int]) -> Column:
    named = {k: v for k, v in weights.items() if len(k) == len(path)}
    if any(v < 1 for v in named.values()):
        raise ValueError("weights are whole numbers from 1")
    out = F.lit(1)
    for key, value in named.items():
        match = F.lit(True)
        for column, name in zip(path, key):
            match = match & (F.col(column) == name)
        out = F.when(match, value).otherwise(out)
    return out.cast("decimal(15,0)")


def allot(nodes: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """``nodes`` (path, cap, w, budget of the parent) with their own budget ``b``."""
    nodes = nodes.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    group = Window.partitionBy(*parent)
    order = group.orderBy("ratio", *path)
    filled = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumn(
        "left", F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    ).withColumn("w_rest", F.sum("w").over(rest))
    nodes = nodes.withColumn("full", F.expr(
        "cast(cap as decimal(20,0)) * cast(w_rest as decimal(15,0))"
        " <= cast(left as decimal(20,0)) * w"))
    nodes = nodes.withColumn(
        "open", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap")))
                                             .over(group), F.lit(0))
    ).withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(group),
                                      F.lit(1)))
    return nodes.withColumn("b", F.expr(
        "if(full, cap, cast((cast(open as decimal(20,0)) * w) div"
        " cast(w_open as decimal(15,0)) as bigint))")).select(*path, "cap", "b")


def leaf_budgets(leaves: DataFrame, tree: list[str], mix: Mix) -> DataFrame:
    """``leaves`` (tree columns, ``tokens``) with ``leaf_budget``."""
    level = leaves.select(*tree, (F.col("tokens") * mix.max_epochs).alias("cap"), "tokens")
    total = level.agg(
        F.sum("cap").alias("cap"),
        F.expr(f"sum(tokens) * {int(mix.percent)} div 100").alias("want")).select(
        F.least("cap", "want").cast("bigint").alias("b"))
    above, parent = total.withColumn("one", F.lit(1)), []
    for depth in range(len(tree)):
        path = tree[: depth + 1]
        nodes = level.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn(
            "w", _weight(path, mix.weights)).withColumn("one", F.lit(1))
        up = above.select("one", *parent, F.col("b").alias("budget"))
        # The total is one row; below it, parents and children meet by their path.
        joined = nodes.join(F.broadcast(up) if depth == 0 else up, ["one", *parent])
        above = allot(joined, parent or ["one"], path).withColumn("one", F.lit(1))
        parent = path
    return above.select(*tree, F.col("b").alias("leaf_budget"))


def mixed(docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with domain, n_tokens, copies (0 where not taken) and leaf_budget."""
    docs = docs.withColumn("domain", F.coalesce(domain.cast("string"), F.lit("")))
    docs = without(docs, OUTPUTS[1:], [id_col, text_col, lang_col, source_col])
    t1, t2, t3, order, cut, before, whole, rest, run, mark = free_names(
        docs, "_t1", "_t2", "_t3", "_order", "_cut", "_before", "_whole", "_rest", "_run", "_mark")
    tree = [t1, t2, t3]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.withColumns({
        t1: F.col("domain"), t2: name(lang_col), t3: name(source_col),
        "n_tokens": F.size(words_of(text_of(text_col))).cast("long")})
    sizes = stage(rows.select(*tree, F.col(id_col).alias("id"), "n_tokens"), "mix-sizes")
    leaves = sizes.groupBy(*tree).agg(F.sum("n_tokens").alias("tokens"))
    plan = stage(leaves.join(leaf_budgets(leaves, tree, mix), tree).select(
        *tree, "leaf_budget",
        F.expr("if(tokens > 0, leaf_budget div tokens, 0)").alias(whole),
        F.expr("if(tokens > 0, leaf_budget % tokens, 0)").alias(rest)), "mix-plan")
    few = plan.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)

    def placed(df: DataFrame, id_name: str) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col(whole), F.coalesce(
            F.col(id_name).cast("string"), F.lit(""))).cast("binary"))
        return df.withColumn(order, key)

    slice_no = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    # At most 65,536 slices per leaf.
    slices = placed(sizes.join(small(plan), tree), "id").groupBy(
        *tree, rest, slice_no.alias("s")).agg(F.sum("n_tokens").alias("n"))
    past = Window.partitionBy(*tree).orderBy("s")
    cuts = stage(slices.select(*tree, rest, "s", "n", F.sum("n").over(past).alias("upto")).filter(
        F.col("upto") > F.col(rest)).groupBy(*tree).agg(
        F.min("s").alias(cut), F.min_by(F.col("upto") - F.col("n"), "s").alias(before)), "mix-cuts")
    full = plan.join(cuts, tree, "left")
    rows = placed(rows.join(small(full), tree), id_col)
    spot = F.when(slice_no < F.coalesce(F.col(cut), F.lit(1 << 16)), -1).when(
        slice_no == F.col(cut), 0).otherwise(1)
    rows = rows.withColumn(mark, spot)
    outside = rows.filter(F.col(mark) != 0).withColumn(
        "copies", F.col(whole) + F.when(F.col(mark) < 0, 1).otherwise(0))
    running = Window.partitionBy(*tree).orderBy(order, id_col, "n_tokens").rowsBetween(
        Window.unboundedPreceding, 0)
    inside = rows.filter(F.col(mark) == 0).withColumn(
        run, F.col(before) + F.sum("n_tokens").over(running)
    ).withColumn("copies", F.col(whole) + F.when(F.col(run) <= F.col(rest), 1).otherwise(0)
                 ).drop(run)
    out = outside.unionByName(inside)
    return out.withColumn("copies", F.col("copies").cast("long")).drop(
        *tree, order, cut, before, whole, rest, mark)


def taken(docs: DataFrame, mix: Mix, domain: Column, **columns: str) -> DataFrame:
    """The chosen rows, once per epoch, with the columns of ``docs``."""
    renamed = {c: f"_in_{c}" for c in docs.columns if c.lower() in OUTPUTS}
    inner = docs.withColumnsRenamed(renamed)
    (turn,) = free_names(inner, "_turn")
    rows = mixed(inner, mix, domain, **columns).filter("copies > 0")
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
