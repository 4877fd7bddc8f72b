"""Hard negatives by angular triangle filtering.

Each row stores its angles to a few reference directions. For an anchor and a row the angle
between them lies, by the triangle inequality on the sphere, between the largest difference and the
smallest sum of their angles to a reference. The cosines of those ends, times both norms and
widened for rounding, bound the score. Rows of a block are sorted by the first angle, so the rows
that can reach a wanted score are a window, found by binary search; the other angles narrow it, and
only what is left gets its integer score: first the rows with the best bounds, then those that these
do not rule out. Every bound is safe, so results are exact.

Positives are found first, then all windows of an anchor's positives together.

Defined cases: rows without id or label, and vectors that are null, empty or hold a null or
non-finite component take no part; only vectors of one length are compared; rows with the anchor's
id are its own; repeated rows count one by one; zero vectors score 0; scores beyond the range of a
long stop at its ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.vectors import Blocks, in_blocks, matrix, meeting, numbers, whole_vectors
from tickloom.session import stage

_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    references: int = 8     # rows whose directions the angles are taken to
    scale: int = 256
    tile: int = 256         # rows scored before the bounds of the others are looked at again
    seed: int = 5
    blocks: Blocks = field(default_factory=Blocks)


def window(positive: int) -> tuple[int, int]:
    """Scores from 50 % to 95 % of a positive's, both included (none below zero)."""
    return (positive + 1) // 2, positive - (positive + 19) // 20


def _with_angles(references: list[list[float]], rule: Mining):
    """Whole-number components, norm and angles to the references of each row."""

    def directions(dim: int) -> np.ndarray:
        found = [r for r in references if len(r) == dim]
        more = np.random.default_rng([rule.seed, dim]).normal(
            size=(rule.references - len(found), dim))
        lines = np.concatenate([np.array(found, np.float64).reshape(-1, dim), more])
        return lines / np.sqrt((lines ** 2).sum(axis=1, keepdims=True))

    def run(batches):
        lines = {}
        for batch in batches:
            whole, norms, angles = [], [], []
            for vector in batch.column("embedding").to_pylist():
                v = np.clip(np.floor(rule.scale * np.array(vector, np.float64)), -1e150, 1e150)
                dim = len(v)
                if dim not in lines:
                    lines[dim] = directions(dim)
                top = np.abs(v).max() or 1.0
                norm = float(top * np.sqrt(((v / top) ** 2).sum()))
                cosines = lines[dim] @ (v / (norm or 1.0))
                whole.append(v)
                norms.append(norm)
                angles.append(np.arccos(np.clip(cosines, -1.0, 1.0)))
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "dim": batch.column("dim"), "vector": pa.array(whole, lists),
                "norm": pa.array(norms, pa.float64()), "angles": pa.array(angles, lists),
                "first": pa.array([a[0] for a in angles], pa.float64())})

    return run


class _Block:
    """Rows of a block, sorted by their first angle."""

    def __init__(self, rows: pa.Table, rule: Mining):
        rows = rows.sort_by("first")
        self.ids, self.labels = numbers(rows, "vec_id"), numbers(rows, "label")
        self.vectors, self.norms = matrix(rows, "vector"), numbers(rows, "norm")
        self.angles = matrix(rows, "angles").T.copy()
        self.row_no = numbers(rows, "row_no")
        self.widest, self.largest = self.norms.max(), np.abs(self.vectors).max()

    def bounded(self, norm, angles, least):
        """Rows whose upper score bound reaches ``least``, with that bound."""
        top, lo, hi = norm * self.widest, 0, len(self.ids)
        if least > -np.inf:
            cosine = (least - 1e-6) / (top * (1 + 1e-9)) if top > 0 else (2.0 if least > 0 else -2.0)
            if cosine > 1:
                return np.empty(0, np.int64), np.empty(0)
            turn = np.arccos(max(cosine, -1.0)) + 2e-7
            lo = np.searchsorted(self.angles[0], angles[0] - turn)
            hi = np.searchsorted(self.angles[0], angles[0] + turn, side="right")
        apart = np.abs(self.angles[:, lo:hi] - angles[:, None]).max(axis=0)
        upper = norm * self.norms[lo:hi] * np.cos(np.maximum(0.0, apart - 1e-7))
        upper += np.abs(upper) * 1e-9 + 1e-6
        found = np.flatnonzero(upper >= least)
        return lo + found, upper[found]

    def tiles(self, picked, upper, first):
        """The ``first`` rows by bound, then the rest: what these score rules most others out."""
        if len(picked) <= first:
            return [(picked, upper)] if len(picked) else []
        high = np.argpartition(-upper, first)
        return [(picked[p], upper[p]) for p in (high[:first], high[first:])]

    def lower(self, picked, norm, angles):
        both = self.angles[:, picked] + angles[:, None]
        wide = np.minimum(np.pi, np.minimum(both, 2 * np.pi - both).min(axis=0) + 1e-7)
        value = norm * self.norms[picked] * np.cos(wide)
        return value - np.abs(value) * 1e-9 - 1e-6

    def scores(self, picked, vector) -> np.ndarray:
        """Exact whole inner products."""
        if self.largest * np.abs(vector).max() * len(vector) < 2.0 ** 53:
            return (self.vectors[picked] @ vector).astype(np.int64)
        whole = lambda a: np.array([int(x) for x in a.ravel()], object).reshape(a.shape)
        exact = whole(self.vectors[picked]) @ whole(vector)
        return np.array([min(max(x, _LONG.min), _LONG.max) for x in exact], np.int64)


def _best(ids, scores, count):
    return np.lexsort((ids, -scores))[:count]


def _table(columns: dict) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64())
                     for k, v in columns.items()})


def _positives(rule: Mining):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_no", "positive_no", "positive_id", "positive_score")}
        if not rows.num_rows or not anchors.num_rows:
            return _table(out)
        block = _Block(rows, rule)
        keys = zip(numbers(anchors, "row_no"), numbers(anchors, "vec_id"), numbers(anchors, "label"),
                   matrix(anchors, "vector"), numbers(anchors, "norm"), matrix(anchors, "angles"))
        there = set(block.labels)
        for number, vec_id, label, vector, norm, angles in keys:
            if label not in there:
                continue
            picked, upper = block.bounded(norm, angles, -np.inf)
            own = (block.labels[picked] == label) & (block.ids[picked] != vec_id)
            held, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            for rows_in, bound in block.tiles(picked[own], upper[own], rule.tile):
                if len(held) == rule.positives:
                    rows_in = rows_in[bound >= scores[-1]]
                held = np.concatenate([held, rows_in])
                scores = np.concatenate([scores, block.scores(rows_in, vector)])
                best = _best(block.ids[held], scores, rule.positives)
                held, scores = held[best], scores[best]
            out["anchor_no"].append(np.full(len(held), number))
            out["positive_no"].append(block.row_no[held])
            out["positive_id"].append(block.ids[held])
            out["positive_score"].append(scores)
        return _table(out)

    return run


def _negatives(rule: Mining):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_no", "positive_no", "negative_id", "negative_score")}
        if not rows.num_rows or not anchors.num_rows:
            return _table(out)
        block = _Block(rows, rule)
        keys = zip(numbers(anchors, "row_no"), numbers(anchors, "label"), matrix(anchors, "vector"),
                   numbers(anchors, "norm"), matrix(anchors, "angles"),
                   anchors.column("positives").to_pylist())
        for number, label, vector, norm, angles, positives in keys:
            wanted = [(p["positive_no"], *window(p["positive_score"])) for p in positives]
            wanted = [w for w in wanted if w[1] <= w[2]]
            if not wanted:
                continue
            least, most = min(w[1] for w in wanted), max(w[2] for w in wanted)
            picked, upper = block.bounded(norm, angles, least)
            fit = block.labels[picked] != label
            picked, upper = picked[fit], upper[fit]
            fit = block.lower(picked, norm, angles) <= most
            held = {w: (np.empty(0, np.int64), np.empty(0, np.int64)) for w in wanted}
            for rows_in, bound in block.tiles(picked[fit], upper[fit], rule.tile):
                if all(len(s) == rule.negatives for _, s in held.values()):
                    rows_in = rows_in[bound >= min(s[-1] for _, s in held.values())]
                scores = block.scores(rows_in, vector)
                for w, (rows_held, scores_held) in held.items():
                    low = max(w[1], scores_held[-1]) if len(rows_held) == rule.negatives else w[1]
                    inside = np.flatnonzero((scores >= low) & (scores <= w[2]))
                    both = np.concatenate([rows_held, rows_in[inside]])
                    values = np.concatenate([scores_held, scores[inside]])
                    best = _best(block.ids[both], values, rule.negatives)
                    held[w] = both[best], values[best]
            for w, (rows_held, scores_held) in held.items():
                out["anchor_no"].append(np.full(len(rows_held), number))
                out["positive_no"].append(np.full(len(rows_held), w[0]))
                out["negative_id"].append(block.ids[rows_held])
                out["negative_score"].append(scores_held)
        return _table(out)

    return run


def mine(vectors: DataFrame, label: Column, is_anchor: Column, rule: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors``
    (vec_id, label, embedding); ``label`` is the class to go by, from those columns."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(whole_vectors(rows) & F.col("label").isNotNull()).select(
        "vec_id", label.cast("long").alias("label"), "embedding", F.size("embedding").alias("dim"))
    references = [r.embedding for r in rows.filter(F.exists("embedding", lambda x: x != 0)).orderBy(
        F.xxhash64("vec_id"), "vec_id").limit(rule.references).select("embedding").collect()]
    rows = rows.mapInArrow(_with_angles(references, rule), "vec_id long, label long, dim int, "
                           "vector array<double>, norm double, angles array<double>, first double")
    rows = in_blocks(rows, ["label", "first", "vec_id"], rule.blocks)
    anchors = rows.filter(is_anchor).drop("block", "first")

    found = meeting(rows, anchors, rule.blocks).applyInArrow(
        _positives(rule),
        "anchor_no long, positive_no long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_no").orderBy(F.desc("positive_score"), "positive_id",
                                                   "positive_no")
    positives = stage(found.withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= rule.positives).drop("place"), "positives")
    paired = anchors.join(positives.groupBy(F.col("anchor_no").alias("row_no")).agg(
        F.collect_list(F.struct("positive_no", "positive_score")).alias("positives")), "row_no")
    found = meeting(rows, paired, rule.blocks).applyInArrow(
        _negatives(rule), "anchor_no long, positive_no long, negative_id long, negative_score long")
    hardest = Window.partitionBy("anchor_no", "positive_no").orderBy(F.desc("negative_score"),
                                                                     "negative_id")
    top = found.withColumn("rank", F.row_number().over(hardest)).filter(
        F.col("rank") <= rule.negatives)
    return top.join(positives, ["anchor_no", "positive_no"]).join(
        anchors.select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id")),
        "anchor_no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                            "negative_score")
