"""Findings of round 3: plans that repeated work, on rows of their own."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.llm import repeats
from tickloom.operators import depth
from tickloom.operators.scan import number_rows


def _capture(spark):
    def diff(n, symbol, bids, asks):
        return (n, json.dumps({"e": "depthUpdate", "E": n, "s": symbol, "U": n, "u": n,
                               "b": bids, "a": asks}))

    rows = [
        diff(1, "B", [["1", "1"], ["3", "1"], ["2", "1"]], [["9", "1"], ["7", "1"]]),
        (2, "{bad"),
        (3, json.dumps({"e": "depthUpdate", "U": 1, "u": 2, "b": []})),
        diff(4, "A", [], [["5", "2"]]),
    ]
    return spark.createDataFrame(rows, "raw_index BIGINT, line STRING")


def test_symbol_dictionary_parses_a_line_once(spark, monkeypatch):
    """A filter on kind, pushed below the parsing, repeated it for each field that it names."""
    plans = []
    keep = depth.stage

    def watched(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(depth, "stage", watched)
    found = depth.symbol_dictionary(depth.parse_lines(_capture(spark)))
    assert sorted(map(tuple, found.collect())) == [("A", 4, 2), ("B", 1, 1)]
    assert plans and all(p.count("from_json(") == 2 for p in plans)


def test_legs_are_numbered_best_first_with_one_sort_a_side(spark, monkeypatch):
    plans = {}
    keep = depth.stage

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(depth, "stage", watched)
    events = depth.normalise(_capture(spark)).events.orderBy("sequence_number")
    assert [(r.side, r.price_ticks // depth.PRICE_SCALE) for r in events.collect()] == [
        ("Buy", 3), ("Buy", 2), ("Buy", 1), ("Sell", 7), ("Sell", 9), ("Sell", 5)]
    assert plans["depth-levels"].count("array_sort(") == 2


def test_numbering_moves_its_rows_once(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("v"))
    numbered = number_rows(rows, ["k"], ["v"], "n")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert numbered.count() == 1000
    for k, count in ((0, 334), (1, 333), (2, 333)):
        got = [r.n for r in numbered.filter(F.col("k") == k).orderBy("v").collect()]
        assert got == list(range(1, count + 1))


@pytest.mark.parametrize("copies", [1, 40])
def test_repeats_move_no_text_for_a_join(spark, monkeypatch, copies):
    """A text is dealt once by its key and once to its block; it was also dealt for a join."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the pack again "
    rows = [(n, base + "é" * 3) for n in range(1, copies + 1)]
    rows += [(100, "x" + base), (None, base + "é" * 3), (101, "short"), (102, None)]
    plans = {}
    keep = repeats.stage

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(repeats, "stage", watched)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert "Join" not in plans["repeat-blocks"]
    assert found[1].n_removed == 0
    size = len(rows[0][1].encode())
    assert all(found[n].n_removed == size for n in [*range(2, copies + 1), None])
    assert (found[100].n_bytes, found[100].n_removed) == (len(base) + 1, len(base))
    assert found[101].n_removed == 0 and found[102].n_bytes == 0
