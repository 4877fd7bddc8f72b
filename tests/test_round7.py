"""Round 7: inputs that several steps read are computed once."""

from tickloom.operators import book, checksum, quality


def _counted(spark, df):
    """The same rows, and a counter of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passing, df.schema), seen


def _events(make_events):
    return make_events(
        [(n, n, 1, "Add", "Buy", 100 - n, 5, n) for n in range(1, 6)]
        + [(n, n, 2, "Cancel", "Sell", 100, 5, n) for n in range(1, 3)]
    )


def test_book_checksums_compute_their_orders_once(spark, make_events):
    events = _events(make_events)
    orders, seen = _counted(spark, book.live_orders(events, snapshots=False))
    symbols = events.select("symbol_id").distinct()
    got = checksum.book_checksums(orders, symbols, 2).collect()
    assert sorted(r.symbol_id for r in got) == [1, 2]
    assert seen.value == 5


def test_replay_summary_computes_its_diagnostics_once(spark, make_events):
    events = _events(make_events)
    rules = quality.ReplayOptions(snapshots=False, book=False)
    found, seen = _counted(spark, quality.diagnostics(events, rules))
    got = {r.symbol_id: r for r in checksum.replay_summary(events, found, 2).collect()}
    assert got[1].sequence_valid and got[2].error == "unknown cancel order id"
    assert seen.value == 1
