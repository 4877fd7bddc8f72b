import random

import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.operators import scan
from tickloom.operators.scan import block_fold, block_of, block_scan, number_rows


def _rows(seed=1):
    rng = random.Random(seed)
    # Key 1 is hot; positions have gaps.
    return [
        (1 if rng.random() < 0.7 else rng.randint(2, 5), n * 3 + rng.randint(0, 2),
         rng.choice([None, rng.randint(-5, 9)]))
        for n in range(400)
    ]


def test_block_scan_matches_sequential(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k BIGINT, pos BIGINT, v BIGINT")
    got = block_scan(
        df, ["k"], ["pos"], block_of("pos", 50),
        previous={"prev": F.col("v")}, totals={"total": F.col("v")},
        latest={"latest": F.col("v")}, peaks={"peak": F.col("v")},
    )
    found = {(r.k, r.pos): (r.prev, r.total, r.latest, r.peak) for r in got.collect()}
    state = {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        prev, total, latest, peak = state.get(k, (None, 0, None, None))
        total += v or 0
        latest = v if v is not None else latest
        assert found[(k, pos)] == (prev, total, latest, peak)
        peak = v if peak is None else peak if v is None else max(peak, v)
        state[k] = (v, total, latest, peak)


def test_block_scan_without_keys(spark):
    df = spark.range(0, 300).withColumn("v", F.col("id") % 7)
    got = block_scan(df, [], ["id"], block_of("id", 40), totals={"t": F.col("v")})
    total = 0
    for r in sorted(got.collect(), key=lambda r: r.id):
        total += r.v
        assert r.t == total


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("x"))
    got = number_rows(df, ["k"], ["x"], "n").collect()
    for k in range(3):
        xs = sorted((r.x, r.n) for r in got if r.k == k)
        assert [n for _, n in xs] == list(range(1, len(xs) + 1))


def test_block_fold_is_exact_for_state_that_never_forgets(spark):
    """A non-commutative fold whose state always depends on all earlier rows."""
    rng = random.Random(3)
    rows = [(rng.randint(1, 2), n, rng.randint(1, 9)) for n in range(200)]

    def fold(state: bytes, table: pa.Table):
        value = int(state or b"1")
        out = []
        for v in table.column("v").to_pylist():
            value = (value * 31 + v) % 1_000_003
            out.append(value)
        keep = {c: table.column(c).to_pylist() for c in ("k", "pos")}
        return keep | {"value": out}, str(value).encode()

    df = spark.createDataFrame(rows, "k BIGINT, pos BIGINT, v BIGINT")
    got = block_fold(
        df, ["k"], ["pos"], block_of("pos", 60), fold, "k BIGINT, pos BIGINT, value BIGINT"
    )
    found = {(r.k, r.pos): r.value for r in got.collect()}
    state = {}
    for k, pos, v in rows:
        state[k] = (state.get(k, 1) * 31 + v) % 1_000_003
        assert found[(k, pos)] == state[k]


def test_block_fold_streams_keys_that_do_not_settle(spark, monkeypatch):
    """A running sum needs no round per block; a key that forgets and one without a block stay."""
    rows = [(k, n, n % 7 + 1) for k in (1, 2, 3) for n in range(200)] + [(None, 1, 5), (1, None, 4)]

    def fold(state: bytes, table: pa.Table):
        total, out = int(state or b"0"), []
        for k, v in zip(table.column("k").to_pylist(), table.column("v").to_pylist(), strict=True):
            total = v if k == 3 else total + v
            out.append(total)
        keep = {c: table.column(c).to_pylist() for c in ("k", "pos")}
        return keep | {"value": out}, str(total).encode()

    staged = []
    keep = scan.stage
    monkeypatch.setattr(scan, "stage", lambda df, label: staged.append(label) or keep(df, label))
    df = spark.createDataFrame(rows, "k BIGINT, pos BIGINT, v BIGINT")
    got = block_fold(
        df, ["k"], ["pos"], block_of("pos", 10), fold, "k BIGINT, pos BIGINT, value BIGINT"
    )
    found = {(r.k, r.pos): r.value for r in got.collect()}
    assert len(found) == len(rows)
    assert found[(None, 1)] == 5 and found[(1, None)] == 4
    total = {}
    for k, pos, v in rows[:600]:
        total[k] = v if k == 3 else total.get(k, 0) + v
        assert found[(k, pos)] == total[k]
    assert len(staged) <= 6
