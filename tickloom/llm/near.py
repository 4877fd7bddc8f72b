"""MinHash near-dedup with HyperMinHash sketches and exact confirmation.

Texts with the same shingle set form a class, which is one node of the link graph. Each class has
a sketch: 256 buckets that hold the number of leading zeros and the next bits of the bucket's
smallest hash. Bands of registers are join keys. Classes that share a band are candidates; the
collision-corrected estimate of their similarity must come within ``sigmas`` standard errors of the
threshold, and what passes is confirmed on the full shingle sets.

No bucket is expanded into all its pairs. First every class of a bucket meets only the bucket's
smallest class. Buckets that are then one component are settled. In the others each class meets,
of other components, the few with the best estimates; and only what still lies in different
components is compared in full. Large buckets are dealt over tasks in blocks. A pair inside one
component is already linked and needs no test, so no link between components is lost.

Defined cases: null and empty texts have no shingles and are linked with nothing. Rows of one id
and text are one document. Null ids join the class of their text, but name no component: rows of a
component without an id get null and are kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import kernels as K
from tickloom.llm.common import free_names, text_of
from tickloom.llm.graph import components
from tickloom.session import stage


@dataclass(frozen=True)
class Near:
    percent: int = 85  # 100 * intersection >= percent * union
    words: int = 5
    band_rows: int = 6
    sigmas: float = 4.0
    slack: float = 0.01
    best: int = 1
    block: int = 1024


def _classes(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            keys, sizes, sketches = [], [], []
            for found in K.shingle_sets(texts, words):
                keys.append(hashlib.md5(found.tobytes()).digest())
                sizes.append(len(found))
                sketches.append(K.sketch(found).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("content"), pa.array(keys, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                ["id", "content", "cls", "n", "sketch"])
    return run


def _bands(rows: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = K.band_keys(np.frombuffer(
                b"".join(batch.column("sketch").to_pylist()), np.uint16
            ).reshape(batch.num_rows, -1), rows)
            owner, band = np.nonzero(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner, band].view(np.int64)),
                 batch.column("cls").take(pa.array(owner)),
                 batch.column("n").take(pa.array(owner))], ["bucket", "cls", "n"])
    return run


def _plausible(near: Near, est: np.ndarray, used: np.ndarray, n: np.ndarray,
               m: np.ndarray) -> np.ndarray:
    # Used registers are a draw without replacement from the union at the threshold.
    goal = near.percent / 100
    union = np.maximum(np.maximum(used, (n + m) / (1 + goal)), 2)
    error = np.sqrt(goal * (1 - goal) / np.maximum(used, 1) * (union - used) / (union - 1))
    fits = 100 * np.minimum(n, m) >= near.percent * np.maximum(n, m)
    return fits & (est >= goal - near.sigmas * error - near.slack)


def _estimated(near: Near):
    """Keeps plausible pairs of (a, b, na, nb, sa, sb)."""
    def run(batches):
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            read = lambda c: np.frombuffer(
                b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(n), -1)
            if len(n) == 0:
                continue
            est, used = K.estimate(read("sa"), read("sb"), n, m)
            ok = pa.array(np.flatnonzero(_plausible(near, est, used, n, m)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(ok),
                                              batch.column("b").take(ok)], ["a", "b"])
    return run


def _meet(near: Near, best: int | None, n, comp, sketches, low, high) -> np.ndarray:
    """Plausible pairs between components, of rows ``low`` with rows ``high``."""
    out = []
    step = max(1, 4096 // max(1, len(high)))  # bounds the compared registers
    for a in range(0, len(low), step):
        x = low[a: a + step]
        est, used = K.estimate(sketches[x][:, None, :], sketches[high][None, :, :],
                               n[x][:, None], n[high][None, :])
        ok = _plausible(near, est, used, n[x][:, None], n[high][None, :]) & (
            comp[x][:, None] != comp[high][None, :])
        if best is not None and len(high) > best:
            rank = np.argsort(np.argsort(np.where(ok, -est, 9.0), axis=1, kind="stable"), axis=1)
            ok &= rank < best
        i, j = np.nonzero(ok)
        out.append(np.c_[x[i], high[j]])
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _across(near: Near, best: int | None):
    """Pairs across components, from rows that come ordered by block pair of a bucket."""
    columns = ["bucket", "span", "i", "j"]

    def pairs(rows: pd.DataFrame):
        key = rows[columns].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), -1)
        n, blk = rows["n"].to_numpy(), rows["blk"].to_numpy()
        comp, cls = pd.factorize(rows["comp"])[0], rows["cls"].to_numpy(dtype=object)
        bands = K.band_keys(sketches, near.band_rows) if best is None and len(rows) else None
        found = [np.empty((0, 2), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1 and (comp[a:b] != comp[a]).any():
                own = np.arange(a, b)
                low, high = own[blk[a:b] == key[a, 2]], own[blk[a:b] == key[a, 3]]
                if best is not None:  # the largest component need not look for partners
                    low = low[comp[low] != np.bincount(comp[a:b]).argmax()]
                met = _meet(near, best, n, comp, sketches, low, high)
                if best is None:  # a pair counts in the first band that it shares
                    x, y = bands[met[:, 0]], bands[met[:, 1]]
                    first = np.argmax((x == y) & (x != 0), axis=1)
                    met = met[x[np.arange(len(x)), first].view(np.int64) == key[a, 0]]
                found.append(met)
        one, other = cls[np.concatenate(found)].T if len(cls) else ([], [])
        both = {(min(p, q), max(p, q)) for p, q in zip(one, other)}
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if len(rows) == 0:
                continue
            last = (rows[columns] == rows[columns].iloc[-1]).all(axis=1).to_numpy()
            first = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            if first:
                yield pairs(rows.iloc[:first])
            rest = rows.iloc[first:].reset_index(drop=True)
        if rest is not None:
            yield pairs(rest)
    return run


def _confirmed(near: Near):
    def run(batches):
        for batch in batches:
            ok = []
            ones = K.shingle_sets(batch.column("ta").to_pylist(), near.words)
            others = K.shingle_sets(batch.column("tb").to_pylist(), near.words)
            for k, (s, t) in enumerate(zip(ones, others)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= near.percent * (len(s) + len(t) - both):
                    ok.append(k)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at),
                                              batch.column("b").take(at)], ["a", "b"])
    return run


def _confirm(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    one = texts.select(F.col("cls").alias("a"), F.col("t").alias("ta"))
    other = texts.select(F.col("cls").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(other, "b").mapInArrow(
        _confirmed(near), "a binary, b binary")


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp) for every class of ``nodes``."""
    found = components(links)
    return nodes.select("cls").join(found, F.col("cls") == F.col("node"), "left").select(
        "cls", F.coalesce("root", "cls").alias("comp"))


def _open_pairs(members: DataFrame, labels: DataFrame, reps: DataFrame, near: Near,
                best: int | None) -> DataFrame:
    """Plausible pairs across components, from the buckets that hold more than one."""
    # Every class has met its bucket's smallest class already. Small sketches share buckets by
    # chance; sizes that differ too much for the threshold never meet in one span.
    step = math.log(max(100 / near.percent, 1.01)) * (1 + 1e-9)
    size = F.floor(F.log("n") / step)
    rows = members.filter("cls <> lead").select(
        "bucket", "cls", F.explode(F.array(size, size + 1)).alias("span")).join(labels, "cls")
    group = ["bucket", "span"]
    mixed = rows.groupBy(*group).agg(
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("k")
    ).filter("c1 <> c2").select(*group, F.ceil(F.col("k") / near.block).cast("int")
                                .alias("blocks"))
    rows = rows.join(mixed, group).join(reps.select("cls", "n", "sketch"), "cls")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*group, F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"),
                       "cls", "comp", "n", "sketch", "blk")
    key = [*group, "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        _across(near, best), "a binary, b binary").distinct()


def near_components(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, content, n_shingles, component_id, kept, n_links (confirmed)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select(
        "id", F.xxhash64("t").alias("content"), "t")
    id_type = docs.schema[id_col].dataType.simpleString()
    known = stage(rows.mapInArrow(
        _classes(near.words),
        f"id {id_type}, content long, cls binary, n long, sketch binary"), "near-classes")
    full = known.filter("n > 0")
    # Below six shingles two different sets never reach 85 %; the bound follows the threshold.
    least = max(1, -(-near.percent // max(1, 100 - near.percent)))
    reps = stage(full.filter(F.col("n") >= least).groupBy("cls").agg(
        F.min(F.struct(F.col("id").alias("id"), F.col("content").alias("content"),
                       F.col("n").alias("n"), F.col("sketch").alias("sketch"))).alias("r")
    ).select("cls", "r.id", "r.content", "r.n", "r.sketch"), "near-reps")
    bands = reps.select("cls", "n", "sketch").mapInArrow(
        _bands(near.band_rows), "bucket long, cls binary, n long")
    shared = bands.groupBy("bucket").agg(
        F.count("*").alias("k"), F.min(F.struct("cls", "n")).alias("l")).filter("k > 1").select(
        "bucket", F.col("l.cls").alias("lead"), F.col("l.n").alias("lead_n"))
    members = stage(bands.join(shared, "bucket"), "near-members")
    nodes = stage(members.select("cls").distinct(), "near-nodes")
    wanted = reps.join(nodes, "cls").select(
        "cls", F.col("id").alias("i"), F.col("content").alias("c"))
    texts = stage(rows.join(wanted, F.col("id").eqNullSafe(F.col("i"))
                            & (F.col("content") == F.col("c"))).select("cls", "t")
                  .dropDuplicates(["cls"]), "near-texts")

    half = lambda s: reps.select(
        F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    fits = 100 * F.least("n", "lead_n") >= near.percent * F.greatest("n", "lead_n")
    pairs = members.filter(fits & (F.col("cls") != F.col("lead"))).select(
        F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    pairs = stage(pairs.join(half("a"), "a").join(half("b"), "b").mapInArrow(
        _estimated(near), "a binary, b binary"), "near-pairs")
    links = stage(_confirm(pairs, texts, near), "near-links")
    for best in (near.best, None):
        labels = stage(_labels(nodes, links), "near-labels")
        more = _open_pairs(members, labels, reps, near, best)
        more = stage(more.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
        links = stage(links.unionByName(_confirm(more, texts, near)), "near-links")
        pairs = pairs.unionByName(more)
    labels = _labels(nodes, links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(
        F.count("*").alias("n_links"))
    # Classes and components combine before they shuffle; copies stay rows of their own.
    owners = full.groupBy("cls").agg(F.min("id").alias("first"))
    named = owners.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    heads = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    verdict = named.join(heads, "comp").join(degree, "cls", "left").select(
        F.col("cls").alias("of"), "component_id", "n_links")
    joined = full.join(verdict, F.col("cls") == F.col("of")).select(
        "id", "content", "n", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = known.filter("n = 0").select(
        "id", "content", "n", F.col("id").alias("component_id"), F.lit(0).cast("long")
        .alias("n_links"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "content", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        .alias("kept"), "n_links")


def deduplicated(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``."""
    found = near_components(docs, near, id_col, text_col)
    lost_id, lost_content = free_names(docs, "_lost_id", "_lost_content")
    lost = found.filter(~F.col("kept")).select(
        F.col(id_col).alias(lost_id), F.col("content").alias(lost_content)).distinct()
    return docs.join(lost, F.col(id_col).eqNullSafe(F.col(lost_id)) & (
        F.xxhash64(text_of(text_col)) == F.col(lost_content)), "left_anti")
