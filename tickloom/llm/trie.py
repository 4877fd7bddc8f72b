"""Prefix trie of conversations, from sorted prefixes and range minima.

Conversations are sorted by their turns. The depth up to which neighbours agree (their LCP) then
holds the whole trie: a node is a run of conversations whose inner LCPs reach its depth. Every
candidate prefix binary-searches the left and the right end of its run by itself, over a sparse
table of range minima; nothing is kept on a stack, so blocks of the sorted order work alone.

* Turns are 16-byte digests; text is read once and never sorted. Sort keys are pages of ``page``
  turns: only conversations that agree on a whole page are sorted again by their next page.
* A task holds one block of the sorted order and the candidates of ``depths`` consecutive depths.
  Runs over block borders leave one partial row per block; the block they start in is found over
  the range minima of all blocks, of which there are ``blocks`` at most, whatever the input.
* Depths that only one conversation reaches come straight from its turns.

Defined cases: rows without conversation id take no part; null role or text is empty; turns of
equal number go by role, then by digest of the text; repeated rows are turns of their own; an
empty table has no node. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_of
from tickloom.operators.scan import block_scan, number_rows, whole_div
from tickloom.session import stage

_NODE = ("depth long, start long, home long, n_convs long, conv_id long, n_children long, "
         "n_leaves long, shared long, before long, parent_conv_id long, parent_home long")
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256")


@dataclass(frozen=True)
class Trie:
    page: int = 64          # turns of one sort key
    block_rows: int = 4096  # conversations of a block, at least
    blocks: int = 65_536    # blocks, at most: their minima go to every task
    depths: int = 4096      # depths whose candidates share a task
    salts: int = 32         # copies of a border node that its children are spread over


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, digest, points): turns in order, from 1; text ends here."""
    role, text = text_of("role"), text_of("text")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("points"))
    return stage(number_rows(turns, ["conv_id"], ["turn", "role", "digest"], "turn_no").select(
        "conv_id", "turn_no", "digest", "points"), "turns")


def grafted(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first ``head`` turns of conversation ``base``, then the own turns
    after the first ``head``. Returns turns (conv_id, pos, digest, points) and all conversations.

    ``base`` and ``head`` are computed from conv_id; ``head`` is ``longest`` at most.
    """
    convs = stage(turns.select("conv_id").distinct().select(
        "conv_id", base.alias("base"), head.cast("long").alias("head")), "convs")
    first = turns.filter(F.col("turn_no") <= longest).withColumnRenamed("conv_id", "base")
    given = convs.filter("head > 0").join(first, "base").filter("turn_no <= head").select(
        "conv_id", F.col("turn_no").alias("pos"), "digest", "points")
    held = first.groupBy("base").agg(F.max("turn_no").alias("held"))
    shift = convs.join(held, "base", "left").select(
        "conv_id", "head", F.least("head", F.coalesce("held", F.lit(0))).alias("taken"))
    own = turns.join(shift, "conv_id").filter("turn_no > head").select(
        "conv_id", (F.col("turn_no") - F.col("head") + F.col("taken")).alias("pos"), "digest",
        "points")
    return stage(given.unionByName(own), "grafted"), convs.select("conv_id")


def _sorted(turns: DataFrame, convs: DataFrame, rule: Trie) -> DataFrame:
    """(conv_id, len, rank, lcp): rank from 0 by turns, then conv_id; lcp with the one before."""
    length = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    page = whole_div(F.col("pos") - 1, rule.page)
    pages = stage(turns.groupBy("conv_id", page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("key")).select(
        "conv_id", "page", F.col("key.digest").alias("key")), "pages")
    rest = convs.join(length, "conv_id", "left").select(
        "conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.lit(0).cast("long").alias("grp"),
        F.lit(-1).cast("long").alias("grp_lcp"))
    done, at = [], 0
    no_key = F.array().cast("array<binary>")
    equal = F.zip_with("before", "key", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(equal, False)
    same = F.when(differs > 0, differs - 1).otherwise(F.size("key").cast("long"))
    while True:
        keyed = rest.join(pages.filter(F.col("page") == at).drop("page"), "conv_id", "left"
                          ).withColumn("key", F.coalesce("key", no_key))
        placed = number_rows(keyed, ["grp"], ["key", "conv_id"], "idx").withColumn(
            "_blk", whole_div("idx", rule.block_rows))
        placed = block_scan(placed, ["grp"], ["idx"], "_blk", previous={"before": F.col("key")})
        first = F.col("idx") == 1
        found = stage(placed.select(
            "conv_id", "len", (F.col("grp") + F.col("idx") - 1).alias("rank"),
            F.when(first, F.col("grp_lcp")).otherwise(same + at * rule.page).alias("lcp"),
            (~first & (same == rule.page)).alias("again")), "ranked")
        if found.filter("again").isEmpty():
            done.append(found)
            break
        runs = stage(block_scan(found, [], ["rank"], whole_div("rank", rule.block_rows),
                                latest={"run": F.when(~F.col("again"), F.col("rank"))}), "runs")
        open_runs = runs.filter("again").select("run").distinct().join(
            runs.filter("not again").select(F.col("rank").alias("run"),
                                            F.col("lcp").alias("grp_lcp")), "run")
        rest = runs.join(open_runs, "run").select("conv_id", "len", F.col("run").alias("grp"),
                                                  "grp_lcp")
        done.append(runs.join(open_runs, "run", "left_anti"))
        at += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return stage(out.select("conv_id", "len", "rank", "lcp"), "sorted")


class _Minima:
    """Range minima of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of first..last, both included."""
        out = np.empty(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = level == k
            t = self.levels[k]
            out[m] = np.minimum(t[first[m]], t[last[m] - (1 << int(k)) + 1])
        return out

    def right_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r with all of at+1..r at least depth."""
        end = at.copy()
        for k in reversed(range(len(self.levels))):
            t = self.levels[k]
            ok = end + 1 < len(t)
            ok[ok] = t[end[ok] + 1] >= depth[ok]
            end[ok] += 1 << k
        return end

    def left_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest l with all of l+1..at at least depth."""
        end = at.copy()
        for k in reversed(range(len(self.levels))):
            width = 1 << k
            ok = end >= width
            ok[ok] = self.levels[k][end[ok] - width + 1] >= depth[ok]
            end[ok] -= width
        return end


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _search(border: np.ndarray, inner: np.ndarray, rows: int, depths: int):
    """Function of one block's conversations and candidates to its nodes and partial nodes.

    border: LCP over the left border of each block; inner: least LCP within it.
    """
    through = np.minimum(border, inner)

    def home(block: int, depth: np.ndarray) -> np.ndarray:
        """Block in which the run of ``depth`` over the left border of ``block`` starts."""
        least = np.minimum.accumulate(through[:block][::-1])
        return block - 1 - np.searchsorted(-least, -depth, side="right")

    def run(convs: pa.Table, wanted: pa.Table) -> pa.Table:
        if convs.num_rows == 0:
            return _rows({})
        convs = convs.sort_by("rank")
        block, part = convs.column("block")[0].as_py(), convs.column("part")[0].as_py()
        ids, lcp, size = (_longs(convs, c) for c in ("conv_id", "lcp", "len"))
        shared, n, first = _longs(convs, "shared"), len(ids), block * rows
        after = border[block + 1] if block + 1 < len(border) else -1
        depth_min, id_min = _Minima(lcp), _Minima(ids)
        leaves = np.concatenate([[0], np.cumsum(np.append(lcp[1:], after) < size)])
        sums = np.concatenate([[0], np.cumsum(shared)])
        opens = size > lcp
        births = np.sort(lcp[opens] * n + np.flatnonzero(opens))

        def born(depth, lo, hi):
            """Conversations of lo..hi that open a child by agreeing up to depth only."""
            return (np.searchsorted(births, depth * n + hi, side="right")
                    - np.searchsorted(births, depth * n + lo, side="left"))

        at, depth = _longs(wanted, "rank") - first, _longs(wanted, "depth")
        end = depth_min.right_end(at, depth)
        up = np.maximum(depth - 1, 0)
        left, right = depth_min.left_end(at, up), depth_min.right_end(at, up)
        from_left = (left == 0) & (border[block] >= up)
        over = (from_left | ((right == n - 1) & (after >= up))) & (depth > 0)
        known = ~over & (depth > 0)
        nodes = {
            "depth": depth, "start": at + first,
            "home": np.ma.array(np.full(len(at), block), mask=~((end == n - 1) & (after >= depth))),
            "n_convs": end - at + 1, "conv_id": id_min.over(at, end),
            "n_children": born(depth, at + 1, end) + (size[at] > depth),
            "n_leaves": leaves[end + 1] - leaves[at], "shared": sums[end + 1] - sums[at + 1],
            "before": _longs(wanted, "before"),
            "parent_conv_id": np.ma.array(id_min.over(left, right), mask=~known),
            "parent_home": np.ma.array(np.where(from_left, home(block, up), block) if block
                                       else np.zeros(len(at), np.int64), mask=~over),
        }
        if block == 0:
            return _rows(nodes)
        depth = np.arange(part * depths, min((part + 1) * depths, border[block] + 1))
        zero = np.zeros(len(depth), np.int64)
        end = depth_min.right_end(zero, depth)
        gone = np.ma.masked_all(len(depth), np.int64)
        return pa.concat_tables([_rows(nodes), _rows({
            "depth": depth, "start": gone, "home": home(block, depth), "n_convs": end + 1,
            "conv_id": id_min.over(zero, end), "n_children": born(depth, zero, end),
            "n_leaves": leaves[end + 1], "shared": sums[end + 1], "before": gone,
            "parent_conv_id": gone, "parent_home": gone})])

    return run


def _rows(columns: dict) -> pa.Table:
    arrays = {}
    for name in (f.strip().split()[0] for f in _NODE.split(",")):
        values = columns.get(name, np.empty(0, np.int64))
        mask = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
        arrays[name] = pa.array(np.asarray(values, np.int64), mask=mask)
    return pa.table(arrays)


def _hash_runs(batches):
    """SHA-256 of each run's ids; rows come sorted, so one hash is open at a time."""
    open_run, state = None, None
    for batch in batches:
        run, ids = batch.column("run").to_numpy(), batch.column("conv_id").to_pylist()
        cuts = np.flatnonzero(np.diff(run)) + 1
        runs, hashes = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(run)]):
            text = ",".join(map(str, ids[lo:hi]))
            if lo < hi and run[lo] == open_run:
                state.update(("," + text).encode())
                continue
            if lo < hi:
                if state is not None:
                    runs.append(open_run)
                    hashes.append(state.hexdigest())
                open_run, state = int(run[lo]), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.int64()),
                                          "ends_sha256": pa.array(hashes, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"run": pa.array([open_run], pa.int64()),
                                          "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _ends(order: DataFrame, rule: Trie) -> DataFrame:
    """(run, len, ends_sha256) of equal conversations; ``run`` is the rank of the first.

    SHA-256 has no form that joins parts, so one task streams a run; it holds one batch of ids.
    """
    opens = F.col("lcp") < F.col("len")
    runs = block_scan(order, [], ["rank"], whole_div("rank", rule.block_rows),
                      latest={"run": F.when(opens, F.col("rank"))})
    hashed = runs.select("run", "rank", "conv_id").repartition("run").sortWithinPartitions(
        "run", "rank").mapInArrow(_hash_runs, "run long, ends_sha256 string")
    return hashed.join(order.select(F.col("rank").alias("run"), "len"), "run")


def prefix_trie(turns: DataFrame, convs: DataFrame, rule: Trie = Trie()) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, pos from 1, digest, points) of ``convs``."""
    sorted_convs = _sorted(turns, convs, rule)
    follower = sorted_convs.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("nxt"))
    order = stage(sorted_convs.join(follower, "rank", "left").withColumn(
        "nxt", F.coalesce("nxt", F.lit(-1))), "order")
    rows = max(rule.block_rows, -(-order.count() // rule.blocks))
    placed = order.withColumn("block", whole_div("rank", rows))

    running = block_scan(turns, ["conv_id"], ["pos"], whole_div("pos", rule.depths),
                         totals={"upto": F.col("points")})
    deep = stage(running.join(order, "conv_id"), "placed-turns")
    shared = deep.filter("pos = lcp").select("rank", F.col("upto").alias("shared"))
    placed = stage(placed.join(shared, "rank", "left").withColumn(
        "shared", F.coalesce("shared", F.lit(0))), "blocks")
    wide = F.greatest("lcp", "nxt") + 1
    wanted = deep.filter((F.col("pos") > F.col("lcp")) & (F.col("pos") <= wide)).select(
        "rank", F.col("pos").alias("depth"), (F.col("upto") - F.col("points")).alias("before")
    ).unionByName(order.filter("rank = 0").select("rank", F.lit(0).alias("depth"),
                                                  F.lit(0).alias("before")))
    wanted = wanted.withColumns({"block": whole_div("rank", rows),
                                 "part": whole_div("depth", rule.depths)})

    minima = placed.groupBy("block").agg(
        F.min_by("lcp", "rank").alias("border"),
        F.min(F.when(F.col("rank") % rows != 0, F.col("lcp"))).alias("inner"))
    known = sorted(minima.collect())  # rule.blocks rows at most
    border = np.array([r.border for r in known], np.int64)
    inner = np.array([np.iinfo(np.int64).max if r.inner is None else r.inner for r in known],
                     np.int64)
    parts = minima.select("block", F.explode(F.sequence(
        F.lit(0).cast("long"), whole_div(F.greatest("border", F.lit(0)), rule.depths))).alias("part")
    ).unionByName(wanted.select("block", "part")).distinct()
    found = stage(placed.join(parts, "block").groupBy("block", "part").cogroup(
        wanted.groupBy("block", "part")).applyInArrow(
        _search(border, inner, rows, rule.depths), _NODE), "nodes")

    over = stage(found.filter("home is not null").groupBy("home", "depth").agg(
        *[F.max(c).alias(c) for c in ("start", "before", "parent_conv_id", "parent_home")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")],
        F.min("conv_id").alias("conv_id")), "border-nodes")
    parents = over.select(
        F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("over_conv"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rule.salts - 1))).alias("salt"))
    nodes = found.filter("home is null").unionByName(over).withColumn(
        "salt", F.pmod("start", F.lit(rule.salts)).cast("long"))
    nodes = nodes.join(parents, ["parent_home", "depth", "salt"], "left").select(
        "start", "depth", "conv_id", F.coalesce("parent_conv_id", "over_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves",
        (F.col("shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"))
    ends = _ends(order, rule).select(F.col("run").alias("start"), F.col("len").alias("depth"),
                                     "ends_sha256")
    none = F.sha2(F.lit(""), 256)
    nodes = nodes.join(ends, ["start", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", none))

    last = F.col("pos") == F.col("len")
    alone = deep.filter(F.col("pos") > wide).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none)
        .alias("ends_sha256"))
    return nodes.select(*_COLUMNS).unionByName(alone.select(*_COLUMNS))
