"""Prefix trie, hard negatives and collision search against brute force, and the odd cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, negatives, queries, trie
from tickloom.llm.vectors import Blocks

SF = "/root/testdata/sf0.01"
SMALL = trie.Trie(page=2, block_rows=4, depths=3, salts=3)
TURNS = "conv_id long, turn int, role string, text string, pos string, rank int"
VECTORS = "vec_id long, label int, embedding array<double>, dim string, block string"


def brute_trie(conversations):
    """conversations: {conv_id: [(role, text), ...]} -> rows by node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        return [node] + [x for k in kids[node] for x in below(k)]

    out = []
    for node, held in members.items():
        under = below(node)
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held),
            len(kids[node]), sum(not kids[x] for x in under),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(map(str, out))


def built(spark, conversations, rule=SMALL):
    rows = [(c, n + 1, role, text) for c, turns in conversations.items()
            for n, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string").select(
        "conv_id", "pos", trie.turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.length("text").cast("long").alias("points"))
    convs = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    return sorted(str(tuple(r)) for r in trie.prefix_trie(turns, convs, rule).collect())


def test_trie_over_many_blocks(spark):
    """Runs over block borders, pages that agree in full, copies, a hot first turn, no turns."""
    rng = random.Random(3)
    convs = {}
    for c in range(90):
        n = rng.choice([0, 1, 2, 3, 5, 9])
        convs[c * 7 - 40] = [(rng.choice("ua"), rng.choice(["x", "yy", "zé"])) for _ in range(n)]
    for c in range(1000, 1030):
        convs[c] = [("u", "hot")] + [("a", str(c % 3) * 2)] * (c % 4)
    for c in range(2000, 2011):
        convs[c] = [("u", "hot")] * 13
    assert built(spark, convs) == brute_trie(convs)


def rebuilt(rows):
    """Conversations as op11 has them, from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role or "", digest, text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    return out


def test_trie_query_on_odd_rows(spark, tmp_path):
    rows = [(None, 0, "u", "gone"), (0, None, None, None), (0, 3, "u", "x"), (0, 3, "a", "x"),
            (0, 3, "u", "w"), (1, 0, "u", "x"), (1, 0, "u", "x"), (2, 1, "u", "é\U0001f600" * 50_000),
            (103, 0, "u", None), (-5, 0, None, "x"), (-5, 1, "u", "y"), (207, 9, "u", "z")]
    rows += [(300 + k, n, "u", "same") for k in range(12) for n in range(7)]
    rows += [(201, n, "u", str(n)) for n in range(150)] + [(202, n, "u", str(n)) for n in range(150)]
    spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS).write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    assert [t for c, t in got.dtypes if c != "ends_sha256"] == ["bigint"] * 7
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_trie(rebuilt(rows))


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect() == []


def usable(rows):
    return [r for r in rows if r[0] is not None and r[2]
            and all(x is not None and math.isfinite(x) for x in r[2])]


def brute_negatives(rows):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v])
            for i, y, v in usable([r for r in rows if r[1] is not None])]
    clip = lambda s: min(max(s, -2**63), 2**63 - 1)
    out = []
    for i, y, v in rows:
        if i % 50:
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), j, z) for j, z, w in rows
                        if j != i and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            fit = [s for s in scored if s[2] != y and -50 * p <= -100 * s[0] <= -95 * p]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit[:3])]
    return sorted(out)


def odd_vectors(seed=1, n=260):
    rng = np.random.default_rng(seed)
    rows = [(k, int(rng.integers(0, 4)), list(map(float, rng.normal(size=6)))) for k in range(n)]
    rows += [(1000 + k, 1, [0.5, 0.25, 0.0, 0.0, 0.0, -1.0]) for k in range(130)]
    nan, inf = math.nan, math.inf
    return rows + [
        (None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2050, 1, None), (2100, 1, []),
        (2150, 1, [1.0, None, 0, 0, 0, 0]), (2200, 1, [nan] * 6), (2250, 1, [inf] * 6),
        (2300, 1, [0.0] * 6), (2350, 2, [0.0] * 6), (2400, 1, [1.0, 2.0]), (2401, 1, [2.0, 1.0]),
        (2402, 2, [1.0, 1.0]), (2500, 1, [3.0, 0, 0, 0, 0, 0]), (-50, 2, [0.1] * 6),
        (2600, 3, [1e9, -1e9, 1.0, 0.0, 0.0, 2.0]), (2601, 3, [2e9, 1e9, 1.0, 0.0, 0.0, 2.0]),
        (2602, 2, [1e9, -2e8, 1.0, 0.0, 0.0, 2.0])]


def vectors(spark, rows):
    floats = lambda v: v and [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, y, floats(v), "d", "b") for i, y, v in rows], VECTORS)


@pytest.mark.parametrize("tile", [3, 512])
def test_negatives_brute_force(spark, tile):
    rows = odd_vectors()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rule = negatives.Mining(tile=tile, references=3, blocks=Blocks(block_rows=37, query_rows=3))
    got = negatives.mine(vectors(spark, rows), label, F.col("vec_id") % 50 == 0, rule)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_of_repeated_rows_and_of_none(spark):
    rows = [(50, 1, [1.0, 0.0])] * 2 + [(51, 1, [1.0, 0.0])] * 2 + [(52, 2, [0.75, 0.0])] * 2
    anchor = F.col("vec_id") % 50 == 0
    got = negatives.mine(vectors(spark, rows), F.col("label"), anchor)
    assert sorted(map(tuple, got.collect())) == sorted(
        [(50, 51, k, 52, 65536, 49152) for k in (1, 2)] * 4)
    assert negatives.mine(vectors(spark, []), F.col("label"), anchor).collect() == []


def test_angle_bounds_hold():
    """No bound is on the wrong side of the exact score, also for parallel vectors."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 5))
    near = np.concatenate([base, base * 3, -base, base + 1e-9 * rng.normal(size=base.shape)])
    import pyarrow as pa

    run = negatives._with_angles([], negatives.Mining(references=4))
    batch = pa.RecordBatch.from_pydict({
        "vec_id": list(range(160)), "label": [1] * 160, "dim": [5] * 160,
        "embedding": pa.array(list(near), pa.list_(pa.float64()))})
    rows = pa.Table.from_batches(run([batch])).append_column("row_no", pa.array(range(160)))
    block = negatives._Block(rows, negatives.Mining())
    for k in range(160):
        vector, norm, angles = block.vectors[k], block.norms[k], block.angles[:, k]
        picked, upper = block.bounded(norm, angles, -np.inf)
        exact = block.scores(picked, vector)
        assert (upper >= exact).all() and (block.lower(picked, norm, angles) <= exact).all()
        least = np.quantile(exact, 0.8)
        found, _ = block.bounded(norm, angles, least)
        assert set(picked[exact >= least]) <= set(found)


def brute_nearest(rows, k=20):
    rows = [(i, np.array(v)) for i, _, v in usable(rows) if any(v)]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            out[i] = sorted((-float(np.add.reduce(v * w)), j) for j, w in rows
                            if j != i and len(v) == len(w))
    return {i: s[:k] for i, s in out.items()}


def test_collision_search_on_odd_rows(spark):
    """Recall over many blocks; all candidates where there are few; exact scores, ties by id."""
    rows = odd_vectors(seed=2)
    rule = ann.Search(sample=100, blocks=Blocks(block_rows=61, query_rows=5))
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, rule).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = brute_nearest(rows)
    assert got.keys() == {i for i, s in want.items() if s}
    hits = total = 0
    for i, best in want.items():
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert found == sorted(found, key=lambda r: (r[1], r[2]))
        hits += len({j for _, _, j in found} & {j for _, j in best})
        total += len(best)
    assert hits >= 0.9 * total
    assert len(got[2400]) == 2 and 2300 not in got
    assert ann.nearest(vectors(spark, []), F.lit(True)).collect() == []


def test_collision_search_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    held = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    got = queries.QUERIES["op13_collision_search"](spark, SF).collect()
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(held[r.query_id] @ held[r.vec_id]), abs=1e-12)
    hits = 0
    for i, have in found.items():
        best = sorted((-float(held[i] @ w), j) for j, w in held.items() if j != i)[:20]
        hits += len(have & {j for _, j in best})
    assert len(got) == 20 * sum(i % 20 == 0 for i in held)
    assert hits >= 0.9 * len(got)
