"""Approximate nearest neighbours by collision counting on single projections.

Vectors are scaled into the unit ball of their block and get one more component that makes them
unit vectors; with unit queries the largest inner product is then the smallest distance. Each
block keeps, for every random direction, its rows sorted by their projection. A query opens a
window around its own projection in each array and counts in how many windows a row lies; a row
that reaches the collision threshold is verified on its original vector. Windows grow by virtual
rehashing: the same arrays, a wider half-width, only the new ends are counted.

The search of a query ends when the half-width is ``reach`` times the distance of its k-th best:
a row nearer than that falls into each window with chance ``near`` at least, so it reaches the
threshold with chance ``recall``. The k-th best starts at the one in a bounded sample and is
replaced by better ones found in the block. Windows go on growing while fewer than k rows are
found, so every query gets k rows, or all there are.

Defined cases: rows without id, and vectors that are null, empty, all zero or hold a null or
non-finite component take no part; only vectors of one length are compared; rows with the query's
id are its own; repeated rows count one by one; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.vectors import Blocks, in_blocks, matrix, meeting, numbers, whole_vectors

_FOUND = "row_no long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Search:
    k: int = 20
    directions: int = 64
    near: float = 0.75      # chance of a window to hold a row at the k-th best's distance
    recall: float = 0.93    # chance of such a row to reach the threshold
    growth: float = 2.0     # of the half-width, from one rehashing to the next
    sample: int = 2048      # rows that give the first k-th best
    seed: int = 11
    blocks: Blocks = field(default_factory=Blocks)

    @property
    def reach(self) -> float:
        """Half-width over distance at which a window holds a row with chance ``near``."""
        return NormalDist().inv_cdf((1 + self.near) / 2)

    @property
    def threshold(self) -> int:
        """Largest count that such a row reaches with chance ``recall``."""
        tail = 0.0
        for count in range(self.directions, 0, -1):
            tail += (math.comb(self.directions, count) * self.near ** count
                     * (1 - self.near) ** (self.directions - count))
            if tail >= self.recall:
                return count
        return 1


def _scores(columns: np.ndarray, picked: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component, so equal vectors score equally."""
    return np.add.reduce(columns[:, picked] * query[:, None], axis=0)


def _first_bounds(sample: list[tuple[int, list[float]]], rule: Search):
    """Adds each query's k-th best score within the sample, -inf if there are fewer."""
    by_dim = {}
    for vec_id, vector in sample:
        by_dim.setdefault(len(vector), ([], []))
        by_dim[len(vector)][0].append(vec_id)
        by_dim[len(vector)][1].append(vector)
    held = {d: (np.array(i), np.array(v, np.float64).T.copy()) for d, (i, v) in by_dim.items()}

    def run(batches):
        for batch in batches:
            bounds = []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(),
                                      batch.column("vector").to_pylist()):
                ids, columns = held.get(len(vector), (np.empty(0), None))
                others = np.flatnonzero(ids != vec_id)
                if len(others) < rule.k:
                    bounds.append(-math.inf)
                else:
                    s = _scores(columns, others, np.array(vector))
                    bounds.append(float(np.partition(s, -rule.k)[-rule.k]))
            yield batch.append_column("bound", pa.array(bounds, pa.float64()))

    return run


class _Index:
    """Rows of a block, sorted by their projection on each direction."""

    def __init__(self, rows: pa.Table, rule: Search):
        self.rule = rule
        self.ids, self.vectors = numbers(rows, "vec_id"), matrix(rows, "vector")
        self.columns = self.vectors.T.copy()
        norms = np.sqrt((self.vectors ** 2).sum(axis=1))
        self.top = norms.max()
        unit = self.vectors / self.top
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit ** 2).sum(axis=1)))
        self.n, dim = unit.shape
        self.lines = np.random.default_rng([rule.seed, dim]).normal(
            size=(dim + 1, rule.directions))
        places = (unit @ self.lines[:dim] + rest[:, None] * self.lines[dim]).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.values = np.take_along_axis(places, self.order, axis=1)
        # Place of each row in the sorted arrays, for windows that hold most of them.
        kind = np.uint16 if self.n < 1 << 16 else np.uint32
        self.rank = np.empty((rule.directions, self.n), kind)
        np.put_along_axis(self.rank, self.order, np.arange(self.n, dtype=kind)[None, :], axis=1)
        self.rough = unit.astype(np.float32)

    def windows(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of all queries (directions x queries)."""
        low = [np.searchsorted(v, a - width) for v, a in zip(self.values, at)]
        high = [np.searchsorted(v, a + width, side="right") for v, a in zip(self.values, at)]
        return np.array(low, np.int32), np.array(high, np.int32)

    def widen(self, counts: np.ndarray, old, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collision counts of one query once its windows are ``low``..``high``."""
        was_low, was_high = old if old else (low, low)
        new = int((was_low - low).sum() + (high - was_high).sum())
        if 4 * new > self.rank.size:
            kind = self.rank.dtype  # below ``low`` wraps round to a large number
            inside = self.rank - low[:, None].astype(kind) < (high - low)[:, None].astype(kind)
            return inside.sum(axis=0, dtype=np.int16)
        ends = [self.order[j, a:b] for j, (a, b) in enumerate(zip(low, was_low))]
        ends += [self.order[j, a:b] for j, (a, b) in enumerate(zip(was_high, high))]
        return counts + np.bincount(np.concatenate(ends), minlength=self.n).astype(np.int16)

    def verified(self, picked, scores, new, query):
        """The best k of the rows so far and the new ones, by their original vectors."""
        k = self.rule.k
        if len(new) > k:  # single precision first, with room for its rounding
            line = (query / np.sqrt((query ** 2).sum())).astype(np.float32)
            rough = self.rough[new] @ line
            new = new[rough >= np.partition(rough, -k)[-k] - 4e-7 * (len(query) + 4)]
        picked = np.concatenate([picked, new])
        scores = np.concatenate([scores, _scores(self.columns, new, query)])
        best = np.lexsort((self.ids[picked], -scores))[:k]
        return picked[best], scores[best]

    def search(self, query_ids, queries, bounds):
        """Rows found and their scores, for each query."""
        rule, n_queries = self.rule, len(queries)
        reach, threshold = rule.reach, rule.threshold
        lengths = np.sqrt((queries ** 2).sum(axis=1))
        at = ((queries / lengths[:, None]) @ self.lines[:-1]).T
        scale = lengths * self.top
        counts = np.zeros((n_queries, self.n), np.int16)
        unseen = self.ids[None, :] != query_ids[:, None]
        want = np.minimum(rule.k, unseen.sum(axis=1))
        found = [(np.empty(0, np.int64), np.empty(0))] * n_queries
        old: list = [None] * n_queries
        width = np.zeros(n_queries)
        active = np.flatnonzero(want)
        while len(active):
            best = np.array([max(bounds[q], found[q][1][-1] if len(found[q][1]) == rule.k
                                 else -np.inf) for q in active])
            square = 2.0 - 2.0 * best / scale[active]
            goal = reach * np.sqrt(np.maximum(square, 1e-12))
            goal = np.where(best > -np.inf, goal, np.inf)
            have = np.array([len(found[q][1]) for q in active])
            full = np.array([old[q] is not None and old[q][0].max() == 0
                             and old[q][1].min() == self.n for q in active])
            # Beyond the scale no row of this block can score as much as the k-th best.
            done = full | (square < -1e-9) | ((width[active] >= goal) & (have >= want[active]))
            active, goal, have = active[~done], goal[~done], have[~done]
            if not len(active):
                break
            wider = np.where(width[active] > 0, width[active] * rule.growth,
                             np.where(goal < np.inf, goal, reach) / rule.growth)
            short = (width[active] >= goal) & (have < want[active])
            width[active] = np.where(short, wider, np.minimum(goal, wider))
            low, high = self.windows(at[:, active], width[active])
            for j, q in enumerate(active):
                counts[q] = self.widen(counts[q], old[q], low[:, j], high[:, j])
                old[q] = (low[:, j], high[:, j])
                new = np.flatnonzero(unseen[q] & (counts[q] >= threshold))
                if len(new):
                    unseen[q, new] = False
                    found[q] = self.verified(*found[q], new, queries[q])
        return found


def _search(rule: Search):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found, keys, ids = [], [], []
        if rows.num_rows and queries.num_rows:
            index = _Index(rows, rule)
            query_ids, row_no = numbers(queries, "vec_id"), numbers(queries, "row_no")
            found = index.search(query_ids, matrix(queries, "vector"), numbers(queries, "bound"))
            size = [len(p) for p, _ in found]
            keys, ids = np.repeat(row_no, size), np.repeat(query_ids, size)
            found = [index.ids[np.concatenate([p for p, _ in found])],
                     np.concatenate([s for _, s in found])]
        else:
            found = [[], []]
        return pa.table({
            "row_no": pa.array(keys, pa.int64()), "query_id": pa.array(ids, pa.int64()),
            "vec_id": pa.array(found[0], pa.int64()), "score": pa.array(found[1], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, rule: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every query among ``vectors``
    (vec_id, embedding) by inner product, ties to the smaller id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(whole_vectors(rows) & F.exists("embedding", lambda x: x != 0)).select(
        "vec_id", F.col("embedding").alias("vector"), F.size("embedding").alias("dim"),
        F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))
    # Blocks of like norms: each block's unit ball is then tight.
    rows = in_blocks(rows, ["norm", "vec_id"], rule.blocks)
    sample = [(r.vec_id, r.vector) for r in rows.orderBy(
        F.xxhash64("vec_id"), "vec_id").limit(rule.sample).select("vec_id", "vector").collect()]
    queries = rows.filter(is_query).select("row_no", "dim", "vec_id", "vector")
    queries = queries.mapInArrow(_first_bounds(sample, rule),
                                 "row_no long, dim int, vec_id long, vector array<double>, bound double")
    found = meeting(rows.select("dim", "block", "row_no", "vec_id", "vector"), queries,
                    rule.blocks).applyInArrow(_search(rule), _FOUND)
    best = Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= rule.k).select("query_id", "rank", "vec_id", "score")
