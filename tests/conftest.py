import pytest
from pyspark.sql import SparkSession

from tickloom.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tickloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from short rows: (ts, seq, symbol, type, side, price, qty, order[, trade, flags])."""
    from tickloom import schema

    def build(rows):
        full = [(*r, *(0, 0)[len(r) - 8 :])[:10] if len(r) < 10 else r for r in rows]
        counts: dict[int, int] = {}
        out = []
        for r in full:
            counts[r[2]] = counts.get(r[2], 0) + 1
            out.append((*r, counts[r[2]]))
        return spark.createDataFrame(out, schema.INDEXED_EVENT)

    return build
