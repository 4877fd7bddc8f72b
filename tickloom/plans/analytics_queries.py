"""Queries over portfolios, latencies, run comparisons, features and lifecycles."""

from pyspark.sql import functions as F

from tickloom.operators import book, compare, features, latency, lifecycle, portfolio
from tickloom.plans import views as V
from tickloom.plans.event_queries import _CLEAN, _TIMELINE
from tickloom.plans.registry import query
from tickloom.session import staged_once

# --- portfolio --------------------------------------------------------------------------

_FILLS = f"""{V.LINES_SQL},
fills AS (
  SELECT 1 + l_suppkey % 64 AS symbol_id,
    CASE WHEN l_partkey % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side,
    CAST(l_quantity AS BIGINT) AS quantity, 900 + l_partkey % 200 AS price_ticks,
    order_id AS fill_index FROM lines),
lined AS (SELECT *, CASE WHEN side = 'Buy' THEN quantity ELSE -quantity END AS signed,
  row_number() OVER (PARTITION BY symbol_id ORDER BY fill_index) AS n FROM fills),
walk AS (
  SELECT symbol_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS c,
    CAST(0 AS BIGINT) AS realised FROM fills GROUP BY symbol_id
  UNION ALL
  SELECT w.symbol_id, l.n, w.q + l.signed,
    CASE WHEN w.q * l.signed >= 0
        THEN (w.c * abs(w.q) + l.price_ticks * l.quantity) // abs(w.q + l.signed)
      WHEN w.q + l.signed = 0 THEN 0
      WHEN sign(w.q + l.signed) <> sign(w.q) THEN l.price_ticks ELSE w.c END,
    w.realised + CASE WHEN w.q * l.signed >= 0 THEN 0
      WHEN w.q > 0 THEN (l.price_ticks - w.c) * least(l.quantity, abs(w.q))
      ELSE (w.c - l.price_ticks) * least(l.quantity, abs(w.q)) END
  FROM walk w JOIN lined l ON l.symbol_id = w.symbol_id AND l.n = w.n + 1),
held AS (
  SELECT symbol_id, arg_max(q, n) AS quantity, arg_max(c, n) AS average_cost_ticks,
    arg_max(realised, n) AS realised_ticks FROM walk GROUP BY symbol_id),
marks AS (SELECT symbol_id, arg_max(price_ticks, fill_index) AS mark_ticks
  FROM fills WHERE symbol_id <> 5 GROUP BY symbol_id),
pos AS (SELECT h.*, coalesce(m.mark_ticks, h.average_cost_ticks) AS mark_ticks,
    m.mark_ticks IS NOT NULL AS marked
  FROM held h LEFT JOIN marks m USING (symbol_id)),
totals AS (SELECT CAST(sum(abs(quantity) * mark_ticks) AS BIGINT) AS gross,
    CAST(sum(quantity * mark_ticks) AS BIGINT) AS net,
    CAST(sum(realised_ticks) AS BIGINT) AS realised,
    CAST(sum((mark_ticks - average_cost_ticks) * quantity) AS BIGINT) AS unrealised,
    count(*) AS n FROM pos),
conc AS (SELECT arg_max(symbol_id, abs(quantity) * mark_ticks * 10000 // gross * 1000 - symbol_id)
    AS sym, max(abs(quantity) * mark_ticks * 10000 // gross) AS bps FROM pos, totals)"""


def _marks(fills):
    return portfolio.last_marks(fills.filter("symbol_id <> 5"))


# Small enough that every symbol's fills cross block borders.
_FILL_BLOCK = 10_000


def _positions(spark, sf_dir):
    fills = V.fills(spark, sf_dir)
    return staged_once(
        spark,
        sf_dir,
        "positions",
        lambda: portfolio.final_positions(portfolio.fold_fills(fills), marks=_marks(fills)),
    )


@query(
    "portfolio_positions",
    f"""WITH RECURSIVE {_FILLS} SELECT symbol_id, quantity, average_cost_ticks, realised_ticks,
    mark_ticks FROM pos""",
)
def portfolio_positions(spark, sf_dir):
    fills = V.fills(spark, sf_dir)
    folded = portfolio.fold_fills(fills, block_rows=_FILL_BLOCK)
    return portfolio.final_positions(folded, marks=_marks(fills))


@query(
    "portfolio_exposure",
    f"""WITH RECURSIVE {_FILLS}
    SELECT gross AS gross_exposure_ticks, abs(net) AS net_exposure_ticks,
      realised AS realised_pnl_ticks, unrealised AS unrealised_pnl_ticks,
      realised + unrealised AS total_pnl_ticks, sym AS max_concentration_symbol,
      CAST(bps AS BIGINT) AS max_concentration_bps, n AS symbol_count FROM totals, conc""",
)
def portfolio_exposure(spark, sf_dir):
    return portfolio.snapshot(_positions(spark, sf_dir))


_STATE = portfolio.PortfolioLimits(10**15, 10**15, 400, 10**12)


@query(
    "portfolio_state_check",
    f"""WITH RECURSIVE {_FILLS} SELECT bps <= 400 AS accepted,
      CASE WHEN bps > 400 THEN 'concentration' ELSE 'none' END AS breach,
      CASE WHEN bps > 400 THEN sym ELSE 0 END AS breach_symbol,
      CAST(CASE WHEN bps > 400 THEN 400 ELSE 0 END AS BIGINT) AS limit_value,
      CAST(CASE WHEN bps > 400 THEN bps ELSE 0 END AS BIGINT) AS observed_value FROM conc""",
)
def portfolio_state_check(spark, sf_dir):
    return portfolio.check_state(portfolio.snapshot(_positions(spark, sf_dir)), _STATE)


@query(
    "portfolio_what_if",
    f"""WITH RECURSIVE {_FILLS}, {V.ORDERS_SQL},
    hyp AS (
      SELECT o.client_order_id, o.timestamp_ns, o.symbol_id AS order_symbol, o.side, p.symbol_id,
        p.marked, p.mark_ticks, p.quantity AS q, p.average_cost_ticks AS c,
        CASE WHEN p.symbol_id <> o.symbol_id THEN 0 WHEN o.side = 'Buy' THEN o.quantity
          ELSE -o.quantity END AS signed, o.price_ticks AS px
      FROM order_requests o, pos p),
    moved AS (
      SELECT *, q + signed AS q2,
        CASE WHEN signed = 0 THEN c WHEN q + signed = 0 THEN 0
          WHEN q * signed >= 0 THEN (c * abs(q) + px * abs(signed)) // abs(q + signed)
          WHEN sign(q + signed) <> sign(q) THEN px ELSE c END AS c2,
        CASE WHEN q * signed >= 0 THEN 0 WHEN q > 0 THEN (px - c) * least(abs(signed), abs(q))
          ELSE (c - px) * least(abs(signed), abs(q)) END AS gain FROM hyp),
    valued AS (SELECT *, CASE WHEN marked THEN mark_ticks ELSE c2 END AS m2 FROM moved),
    agg AS (
      SELECT client_order_id, timestamp_ns, order_symbol, side, sum(abs(q2) * m2) AS g,
        abs(sum(q2 * m2)) AS n, max(abs(q2) * m2) AS top,
        sum(gain) + sum((m2 - c2) * q2) + (SELECT realised FROM totals) AS pnl
      FROM valued GROUP BY ALL),
    lim AS (SELECT gross + 20000 AS mg, abs(net) + 30000 AS mn FROM totals)
    SELECT client_order_id, timestamp_ns, order_symbol AS symbol_id, side,
      NOT (g > mg OR n > mn OR top * 10000 // g > 600) AS accepted,
      CASE WHEN g > mg THEN 'MaxPortfolioGrossExposure' WHEN n > mn THEN 'MaxPortfolioNetExposure'
        WHEN top * 10000 // g > 600 THEN 'MaxSymbolConcentration' ELSE 'None' END AS reject_reason,
      CASE WHEN g > mg THEN 'portfolio_gross_exposure' WHEN n > mn THEN 'portfolio_net_exposure'
        WHEN top * 10000 // g > 600 THEN 'portfolio_concentration'
        ELSE 'portfolio_accepted' END AS check_name,
      CAST(CASE WHEN g > mg THEN mg WHEN n > mn THEN mn WHEN top * 10000 // g > 600 THEN 600
        ELSE 0 END AS BIGINT) AS limit_value,
      CAST(CASE WHEN g > mg THEN g WHEN n > mn THEN n
        WHEN top * 10000 // g > 600 THEN top * 10000 // g ELSE 0 END AS BIGINT) AS observed_value
    FROM agg, lim""",
)
def portfolio_what_if(spark, sf_dir):
    positions = _positions(spark, sf_dir)
    now = portfolio.snapshot(positions).first()
    limits = portfolio.PortfolioLimits(
        now.gross_exposure_ticks + 20_000, now.net_exposure_ticks + 30_000, 600, 0
    )
    return portfolio.check_orders(
        V.order_requests(spark, sf_dir), positions, limits, _marks(V.fills(spark, sf_dir))
    )


@query(
    "order_vwap",
    f"""WITH {V.ORDER_FLOW_SQL} SELECT order_id, CAST(sum(quantity) AS BIGINT) AS filled_quantity,
    CAST(sum(quantity * price_ticks) // sum(quantity) AS BIGINT) AS average_price_ticks
    FROM order_flow WHERE event_type = 'Execute' GROUP BY order_id""",
)
def order_vwap(spark, sf_dir):
    return portfolio.order_vwap(V.order_flow(spark, sf_dir).filter("event_type = 'Execute'"))


# --- latency ----------------------------------------------------------------------------

_STAGES = ("replay", "book_update", "matching", "risk", "strategy", "inference")
_SAMPLES = (
    "samples AS (SELECT CASE event_id % 6 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_STAGES))
    + " END AS stage, CAST(floor(value * 1000) AS BIGINT) AS duration_ns, user_id, event_id,"
    " epoch_us(ts) * 1000 AS timestamp_ns FROM events)"
)


def _samples(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in _STAGES])
    return V.table(spark, sf_dir, "events").select(
        names[(F.col("event_id") % 6).cast("int")].alias("stage"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_ns"),
        "user_id",
        "event_id",
        V.nanos("ts").alias("timestamp_ns"),
    )


def _percentile_sql(key: str, quantiles: dict[str, float]) -> str:
    picks = ", ".join(
        f"min(duration_ns) FILTER (rn >= greatest(ceil({p} * n), 1)) AS {name}"
        for name, p in quantiles.items()
    )
    return f"""WITH {_SAMPLES}, ranked AS (
      SELECT {key}, duration_ns, row_number() OVER (PARTITION BY {key} ORDER BY duration_ns) AS rn,
        count(*) OVER (PARTITION BY {key}) AS n FROM samples)
    SELECT {key}, any_value(n) AS sample_count, min(duration_ns) AS min_ns,
      max(duration_ns) AS max_ns, {picks} FROM ranked GROUP BY {key}"""


@query("latency_percentiles", _percentile_sql("stage", latency.SUMMARY_QUANTILES))
def latency_percentiles(spark, sf_dir):
    return latency.percentiles(_samples(spark, sf_dir), ["stage"])


@query("bench_distribution", _percentile_sql("user_id", latency.BENCH_QUANTILES))
def bench_distribution(spark, sf_dir):
    return latency.percentiles(
        _samples(spark, sf_dir), ["user_id"], quantiles=latency.BENCH_QUANTILES
    )


_BUDGETS = {"replay": 90_000, "risk": 40_000, "inference": 10_000_000}
_REPORTS = f"""{_SAMPLES},
dim AS (SELECT * FROM (VALUES ('replay', 1, 90000), ('book_update', 2, 0), ('matching', 3, 0),
  ('risk', 4, 40000), ('strategy', 5, 0), ('inference', 6, 10000000), ('total', 7, 0))
  v(stage, stage_no, budget)),
reports AS (
  SELECT d.stage, CAST(stage_no AS BIGINT) AS stage_no, budget > 0 AS has_budget,
    CAST(budget AS BIGINT) AS budget_ns, count(s.stage) AS sample_count,
    coalesce(max(duration_ns), 0) AS worst_observed_ns,
    CAST(coalesce(sum(duration_ns), 0) AS BIGINT) AS total_observed_ns,
    CASE WHEN budget > 0 THEN coalesce(max(duration_ns), 0) * 1000000 // budget ELSE 0 END
      AS worst_utilization_ppm,
    budget > 0 AND count(s.stage) > 0 AND max(duration_ns) > budget AS exceeded
  FROM dim d LEFT JOIN samples s USING (stage) GROUP BY d.stage, stage_no, budget)"""


@query(
    "latency_budget",
    f"WITH {_REPORTS} SELECT * REPLACE (coalesce(exceeded, false) AS exceeded) FROM reports",
)
def latency_budget(spark, sf_dir):
    return latency.stage_reports(_samples(spark, sf_dir), _BUDGETS)


@query(
    "latency_budget_summary",
    f"""WITH {_REPORTS} SELECT count(*) FILTER (exceeded) AS exceeded_count,
    string_agg(stage, ',' ORDER BY stage_no) FILTER (exceeded) AS exceeded_stages,
    arg_max(stage, worst_utilization_ppm * 10 - stage_no) FILTER (has_budget AND sample_count > 0)
      AS worst_offender FROM reports""",
)
def latency_budget_summary(spark, sf_dir):
    return latency.budget_summary(latency.stage_reports(_samples(spark, sf_dir), _BUDGETS))


@query(
    "counters",
    "SELECT event_type AS name, CAST(sum(user_id % 7) AS BIGINT) AS value FROM events GROUP BY 1",
)
def counters(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events")
    return latency.counters(
        rows.select(F.col("event_type").alias("name"), (F.col("user_id") % 7).alias("delta"))
    )


@query(
    "throughput",
    f"""WITH {_SAMPLES} SELECT stage, count(*) AS event_count,
    max(timestamp_ns) - min(timestamp_ns) AS elapsed_ns,
    count(*) * 1e9 / (max(timestamp_ns) - min(timestamp_ns)) AS events_per_second
    FROM samples GROUP BY stage""",
)
def throughput(spark, sf_dir):
    return latency.throughput(_samples(spark, sf_dir), ["stage"])


# --- run comparison ---------------------------------------------------------------------

_RUNS = """
runs AS (
  SELECT l_linestatus AS run, l_returnflag || '-' || (l_suppkey % 40) AS name, l_suppkey % 40 AS b,
    count(*) AS iterations, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_ns,
    CAST(sum(CAST(l_quantity AS BIGINT)) // count(*) AS BIGINT) AS avg_ns
  FROM lineitem GROUP BY ALL),
base AS (SELECT * FROM runs WHERE run = 'O' AND b <> 3),
cur AS (SELECT * FROM runs WHERE run = 'F' AND b <> 5)"""


def _runs(spark, sf_dir):
    bucket = F.col("l_suppkey") % 40
    rows = (
        V.table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linestatus").alias("run"),
            F.concat("l_returnflag", F.lit("-"), bucket.cast("string")).alias("name"),
            bucket.alias("b"),
        )
        .agg(
            F.count(F.lit(1)).alias("iterations"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("total_ns"),
        )
        .withColumn("avg_ns", F.expr("total_ns div iterations"))
    )
    return rows.filter("run = 'O' AND b <> 3"), rows.filter("run = 'F' AND b <> 5")


_COMPARED = f"""{_RUNS},
cmp AS (
  SELECT name, CASE WHEN o.name IS NULL THEN 'new' WHEN c.name IS NULL THEN 'missing'
      ELSE 'shared' END AS status,
    o.total_ns AS baseline_value, c.total_ns AS current_value, c.total_ns - o.total_ns AS delta,
    (c.total_ns - o.total_ns) / o.total_ns * 100.0 AS pct_change
  FROM base o FULL JOIN cur c USING (name)),
judged AS (SELECT *, coalesce(pct_change > 5, false) AS regressed,
  coalesce(pct_change < -5, false) AS improved FROM cmp)"""


@query("benchmark_compare", f"WITH {_COMPARED} SELECT * FROM judged")
def benchmark_compare(spark, sf_dir):
    return compare.compare_benchmarks(*_runs(spark, sf_dir), threshold_pct=5, metric="total_ns")


@query(
    "benchmark_compare_summary",
    f"""WITH {_COMPARED} SELECT count(*) FILTER (regressed) AS regressions,
    count(*) FILTER (improved) AS improvements, count(*) FILTER (status = 'new') AS new_benchmarks,
    count(*) FILTER (status = 'missing') AS missing_benchmarks,
    bool_or(regressed) AS has_regressions FROM judged""",
)
def benchmark_compare_summary(spark, sf_dir):
    return compare.comparison_summary(benchmark_compare(spark, sf_dir))


@query("benchmark_only_new", f"WITH {_RUNS} SELECT name FROM cur EXCEPT SELECT name FROM base")
def benchmark_only_new(spark, sf_dir):
    base, current = _runs(spark, sf_dir)
    return compare.only_in(current, base)


@query("benchmark_shared", f"WITH {_RUNS} SELECT name FROM cur INTERSECT SELECT name FROM base")
def benchmark_shared(spark, sf_dir):
    return compare.shared_names(*_runs(spark, sf_dir))


@query(
    "variant_comparison",
    """WITH v AS (SELECT l_shipmode_key AS corpus, l_linestatus AS variant,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_ns, count(*) AS events
      FROM (SELECT *, l_suppkey % 9 AS l_shipmode_key FROM lineitem) GROUP BY ALL),
    w AS (SELECT corpus, max(total_ns) FILTER (variant = 'O') AS O_total_ns,
      max(events) FILTER (variant = 'O') AS O_events, max(total_ns) FILTER (variant = 'F') AS F_total_ns,
      max(events) FILTER (variant = 'F') AS F_events FROM v GROUP BY corpus)
    SELECT *, F_total_ns - O_total_ns AS delta_total_ns, F_total_ns / O_total_ns AS ratio_total_ns,
      F_events - O_events AS delta_events, F_events / O_events AS ratio_events FROM w""",
)
def variant_comparison(spark, sf_dir):
    rows = (
        V.table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 9).alias("corpus"), F.col("l_linestatus").alias("variant"))
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("total_ns"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    return compare.compare_variants(rows, "corpus", "variant", "O", "F", ["total_ns", "events"])


_PAIR = f"""{V.DIRTY_FLOW_SQL},
ls AS (SELECT symbol_id, count(*) AS event_count, max(sequence_number) AS last_sequence,
  max(timestamp_ns) AS last_timestamp_ns FROM supplier_flow GROUP BY ALL),
rs AS (SELECT symbol_id, count(*) AS event_count, max(sequence_number) AS last_sequence,
  max(timestamp_ns) AS last_timestamp_ns FROM dirty_flow WHERE symbol_id % 17 <> 3 GROUP BY ALL),
par AS (
  SELECT symbol_id, ls.symbol_id IS NOT NULL AS present_left, rs.symbol_id IS NOT NULL AS present_right,
    coalesce(ls.event_count = rs.event_count, false) AS event_count_match,
    coalesce(ls.last_sequence = rs.last_sequence, false) AS last_sequence_match,
    coalesce(ls.last_timestamp_ns = rs.last_timestamp_ns, false) AS last_timestamp_ns_match
  FROM ls FULL JOIN rs USING (symbol_id)),
parity AS (SELECT *, present_left AND present_right AND event_count_match AND last_sequence_match
  AND last_timestamp_ns_match AS matched FROM par)"""
_FIELDS = ["event_count", "last_sequence", "last_timestamp_ns"]


def _run_pair(spark, sf_dir):
    def summed(events):
        return events.groupBy("symbol_id").agg(
            F.count(F.lit(1)).alias("event_count"),
            F.max("sequence_number").alias("last_sequence"),
            F.max("timestamp_ns").alias("last_timestamp_ns"),
        )

    # The second run lost some symbols.
    lossy = V.dirty_flow(spark, sf_dir).filter("symbol_id % 17 <> 3")
    return summed(V.supplier_flow(spark, sf_dir)), summed(lossy)


@query("run_parity", f"WITH {_PAIR} SELECT * FROM parity")
def run_parity(spark, sf_dir):
    return compare.compare_runs(*_run_pair(spark, sf_dir), "symbol_id", _FIELDS)


@query(
    "run_parity_summary",
    f"""WITH {_PAIR} SELECT count(*) FILTER (present_left) AS symbol_count_left,
    count(*) FILTER (present_right) AS symbol_count_right,
    count(*) FILTER (NOT matched) AS mismatch_count, bool_and(matched) AS matched FROM parity""",
)
def run_parity_summary(spark, sf_dir):
    return compare.parity_summary(run_parity(spark, sf_dir))


@query(
    "field_differences",
    f"""WITH {_PAIR}, j AS (SELECT ls.symbol_id, ls.event_count AS a, rs.event_count AS b,
      ls.last_timestamp_ns AS c, rs.last_timestamp_ns AS d, ls.last_sequence AS e,
      rs.last_sequence AS f FROM ls JOIN rs USING (symbol_id))
    SELECT symbol_id, 'event_count' AS field, CAST(a AS VARCHAR) AS left_value,
      CAST(b AS VARCHAR) AS right_value FROM j WHERE a <> b
    UNION ALL SELECT symbol_id, 'last_timestamp_ns', CAST(c AS VARCHAR), CAST(d AS VARCHAR)
      FROM j WHERE c <> d
    UNION ALL SELECT symbol_id, 'last_sequence', CAST(e AS VARCHAR), CAST(f AS VARCHAR)
      FROM j WHERE e <> f""",
)
def field_differences(spark, sf_dir):
    return compare.field_differences(*_run_pair(spark, sf_dir), "symbol_id", _FIELDS)


@query(
    "first_difference",
    f"""WITH {V.DIRTY_FLOW_SQL}, j AS (
      SELECT coalesce(a.symbol_id, b.symbol_id) AS symbol_id,
        coalesce(a.event_index, b.event_index) AS event_index,
        CASE WHEN b.symbol_id IS NULL THEN 'left_only' ELSE 'changed' END AS kind
      FROM supplier_flow a FULL JOIN dirty_flow b
        ON a.symbol_id = b.symbol_id AND a.event_index = b.event_index
      WHERE (a.timestamp_ns, a.event_type, a.side, a.price_ticks, a.quantity, a.order_id)
        IS DISTINCT FROM (b.timestamp_ns, b.event_type, b.side, b.price_ticks, b.quantity, b.order_id))
    SELECT symbol_id, min(event_index) AS first_position, arg_min(kind, event_index) AS kind,
      count(*) AS difference_count FROM j GROUP BY symbol_id""",
)
def first_difference(spark, sf_dir):
    return compare.first_difference(
        V.supplier_flow(spark, sf_dir),
        V.dirty_flow(spark, sf_dir),
        ["symbol_id"],
        "event_index",
        ["timestamp_ns", "event_type", "side", "price_ticks", "quantity", "order_id"],
    )


@query(
    "parity_top_levels",
    f"""WITH {_PAIR}, clean AS (SELECT *, 0 AS epoch FROM supplier_flow), {V.states_sql("clean")},
    lv AS (SELECT symbol_id, side, price_ticks, CAST(sum(quantity) AS BIGINT) AS quantity
      FROM live GROUP BY ALL),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol_id, side ORDER BY
      CASE WHEN side = 'Buy' THEN -price_ticks ELSE price_ticks END) AS INTEGER) AS level FROM lv)
    SELECT top.* FROM top JOIN parity USING (symbol_id) WHERE level <= 5 AND NOT matched""",
)
def parity_top_levels(spark, sf_dir):
    orders = book.live_orders(V.supplier_flow(spark, sf_dir), snapshots=False)
    top = book.top_levels(book.l2_levels(orders).drop("order_count"), 5)
    return compare.expected_top_levels(run_parity(spark, sf_dir), top)


# --- features, signals, models ----------------------------------------------------------

_QUOTES = _CLEAN + _TIMELINE.format(log="clean")
_WEIGHTS, _BIAS = (0.5, 0.0, 2.0, 0.001), 1.0


def _quotes(spark, sf_dir):
    return staged_once(
        spark,
        sf_dir,
        "quotes",
        lambda: book.quote_timeline(V.order_flow(spark, sf_dir), snapshots=False),
    )


_FEATURES = f"""{_QUOTES},
feat AS (
  SELECT *, bid_price IS NOT NULL AND ask_price IS NOT NULL AS two,
    CAST(bid_quantity AS DOUBLE) AS bq, CAST(ask_quantity AS DOUBLE) AS aq FROM quotes),
features AS (
  SELECT symbol_id, event_index,
    CASE WHEN two THEN CAST(ask_price AS DOUBLE) - bid_price ELSE 0.0 END AS spread_ticks,
    CASE WHEN two THEN (CAST(ask_price AS DOUBLE) + bid_price) / 2.0 ELSE 0.0 END AS mid_price_ticks,
    CASE WHEN two THEN (bq - aq) / (bq + aq) ELSE 0.0 END AS top_level_imbalance,
    CASE WHEN two THEN bq + aq ELSE 0.0 END AS top_level_quantity FROM feat)"""
_FEATURE_COLUMNS = ["symbol_id", "event_index", "spread_ticks", "mid_price_ticks",
                    "top_level_imbalance", "top_level_quantity"]


@query("l2_features", f"WITH {_FEATURES} SELECT * FROM features")
def l2_features(spark, sf_dir):
    return features.l2_features(_quotes(spark, sf_dir)).select(*_FEATURE_COLUMNS)


@query(
    "linear_scores",
    f"""WITH {_FEATURES} SELECT symbol_id, event_index, 1.0::DOUBLE + 0.5::DOUBLE * spread_ticks
      + 0.0::DOUBLE * mid_price_ticks + 2.0::DOUBLE * top_level_imbalance
      + 0.001::DOUBLE * top_level_quantity AS score FROM features""",
)
def linear_scores(spark, sf_dir):
    rows = l2_features(spark, sf_dir)
    score = features.linear_score(_FEATURE_COLUMNS[2:], _WEIGHTS, _BIAS)
    return rows.select("symbol_id", "event_index", score.alias("score"))


# One weight per place of the vector, exact in binary.
_EMBEDDING_WEIGHTS = [((7 * i) % 11 - 5) / 8 for i in range(64)]


@query(
    "embedding_scores",
    """SELECT vec_id, list_reduce(list_prepend(-0.25::DOUBLE, list_transform(embedding,
      lambda x, i: x::DOUBLE * (((7 * (i - 1)) % 11 - 5) / 8.0::DOUBLE))),
      lambda a, b: a + b) AS score FROM embeddings""",
)
def embedding_scores(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    score = features.reference_score(doubles, _EMBEDDING_WEIGHTS, -0.25)
    return vectors.select("vec_id", score.alias("score"))


@query(
    "batch_scores",
    f"""WITH {_FEATURES} SELECT symbol_id, event_index, spread_ticks * 2.0::DOUBLE + top_level_imbalance
      AS score, 'user' AS backend FROM features""",
)
def batch_scores(spark, sf_dir):
    """A user model in Arrow batches."""
    scored = features.score_batches(
        l2_features(spark, sf_dir),
        ["spread_ticks", "top_level_imbalance"],
        lambda x: x.spread_ticks * 2.0 + x.top_level_imbalance,
    )
    return scored.select("symbol_id", "event_index", "score", "backend")


@query(
    "imbalance_signals",
    f"""WITH {_FEATURES}, s AS (SELECT *, bq / (bq + aq) AS share FROM feat WHERE two)
    SELECT symbol_id, event_index, CASE WHEN share >= 0.6::DOUBLE THEN 'Buy' ELSE 'Sell' END AS side,
      CASE WHEN share >= 0.6::DOUBLE THEN bid_price ELSE ask_price END AS price_ticks,
      CAST(10 AS BIGINT) AS quantity
    FROM s WHERE share >= 0.6::DOUBLE OR 1.0::DOUBLE - share >= 0.6::DOUBLE""",
)
def imbalance_signals(spark, sf_dir):
    found = features.imbalance_signals(_quotes(spark, sf_dir), 0.6, 10)
    return found.select("symbol_id", "event_index", "side", "price_ticks", "quantity")


@query(
    "quote_signals",
    f"""WITH {_QUOTES}, room AS (SELECT * FROM quotes WHERE ask_price > bid_price + 1)
    SELECT symbol_id, event_index, 'Buy' AS side, bid_price + 1 AS price_ticks,
      CAST(10 AS BIGINT) AS quantity FROM room
    UNION ALL SELECT symbol_id, event_index, 'Sell', ask_price - 1, 10 FROM room""",
)
def quote_signals(spark, sf_dir):
    found = features.quote_signals(_quotes(spark, sf_dir), 10)
    return found.select("symbol_id", "event_index", "side", "price_ticks", "quantity")


@query(
    "reference_prices",
    f"""WITH {_QUOTES} SELECT q.symbol_id, q.event_index,
      coalesce((bid_price + ask_price) // 2, bid_price, ask_price, price_ticks) AS reference_price
    FROM quotes q JOIN clean c USING (symbol_id, event_index)""",
)
def reference_prices(spark, sf_dir):
    events = V.order_flow(spark, sf_dir).select("symbol_id", "event_index", "price_ticks")
    return _quotes(spark, sf_dir).join(events, ["symbol_id", "event_index"]).select(
        "symbol_id",
        "event_index",
        features.reference_price(F.col("price_ticks")).alias("reference_price"),
    )


@query(
    "model_frames",
    f"""WITH {_FEATURES}, f AS (
      SELECT *, count(*) OVER w AS n, first_value(spread_ticks) OVER w AS oldest_spread,
        lead(mid_price_ticks, 5) OVER o - mid_price_ticks AS move,
        flatten(list([spread_ticks, mid_price_ticks, top_level_imbalance,
                      top_level_quantity / 10.0::DOUBLE]) OVER w) AS frame
      FROM features WINDOW o AS (PARTITION BY symbol_id ORDER BY event_index),
        w AS (PARTITION BY symbol_id ORDER BY event_index ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
    SELECT symbol_id, event_index, CAST(64 AS INTEGER) AS frame_size, oldest_spread,
      list_reduce(list_transform(frame, lambda x, i: x * (1 + i % 13)::DOUBLE),
                  lambda a, b: a + b) AS weighted_sum,
      top_level_quantity / 10.0::DOUBLE AS newest_quantity,
      CAST(CASE WHEN move > 0.5::DOUBLE THEN 1 WHEN move < -0.5::DOUBLE THEN -1 ELSE 0 END AS INTEGER) AS label
    FROM f WHERE n = 16 AND move IS NOT NULL""",
)
def model_frames(spark, sf_dir):
    frames = features.model_frames(
        l2_features(spark, sf_dir),
        ["symbol_id"],
        "event_index",
        _FEATURE_COLUMNS[2:],
        threshold=0.5,
        std=[1.0, 1.0, 1.0, 10.0],
    )
    return frames.select(
        "symbol_id",
        "event_index",
        F.size("frame").alias("frame_size"),
        F.col("frame")[0].alias("oldest_spread"),
        # Every value counts, each place with another weight.
        F.aggregate(
            F.transform("frame", lambda x, i: x * (1 + (i + 1) % 13).cast("double")),
            F.lit(0.0), lambda a, b: a + b,
        ).alias("weighted_sum"),
        F.col("frame")[63].alias("newest_quantity"),
        "label",
    )


_SIGNALS = """
signals AS (
  SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS latency_ns,
    epoch_us(ts) * 1000 AS now_ns,
    epoch_us(ts) * 1000 - CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000000000 AS signal_timestamp_ns
  FROM events),
judged AS (
  SELECT *, latency_ns > 5000 AS timed_out, now_ns - signal_timestamp_ns > 60000000000 AS late_signal
  FROM signals),
decided AS (SELECT *, NOT timed_out AND NOT late_signal AS accepted,
  CASE WHEN timed_out AND late_signal THEN 'timeout_and_late_signal' WHEN timed_out THEN 'timeout'
    WHEN late_signal THEN 'late_signal' ELSE 'accept' END AS decision FROM judged)"""

_POLICY = features.SignalPolicy(
    timeout_ns=5_000,
    max_signal_age_ns=60_000_000_000,
    disable_on_repeated_late_signals=True,
    max_consecutive_late_signals=4,
)


def _signal_columns():
    age = F.get_json_object("props", "$.k").cast("bigint") * 1_000_000_000
    return [
        F.col("user_id"),
        F.col("event_id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("latency_ns"),
        V.nanos("ts").alias("now_ns"),
        (V.nanos("ts") - age).alias("signal_timestamp_ns"),
    ]


def _signals(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(*_signal_columns())


@query(
    "signal_policy",
    f"WITH {_SIGNALS} SELECT event_id, timed_out, late_signal, accepted, decision FROM decided",
)
def signal_policy(spark, sf_dir):
    judged = features.judge_signals(_signals(spark, sf_dir), _POLICY)
    return judged.select("event_id", "timed_out", "late_signal", "accepted", "decision")


@query(
    "late_streak_latch",
    f"""WITH {_SIGNALS}, isl AS (
      SELECT *, sum(CASE WHEN late_signal THEN 0 ELSE 1 END) OVER (
        PARTITION BY user_id ORDER BY event_id) AS island FROM decided),
    streaks AS (
      SELECT *, CAST(sum(CASE WHEN late_signal THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS late_streak FROM isl),
    latched AS (SELECT *, max(late_streak) OVER (PARTITION BY user_id ORDER BY event_id) >= 4
      AS model_disabled FROM streaks)
    SELECT user_id, event_id, late_streak, model_disabled, accepted AND NOT model_disabled AS accepted
    FROM latched""",
)
def late_streak_latch(spark, sf_dir):
    rows = features.late_streaks(
        _signals(spark, sf_dir),
        _POLICY,
        ["user_id"],
        "event_id",
        F.floor(F.col("event_id") / 1_000_000).cast("bigint"),
    )
    return rows.select("user_id", "event_id", "late_streak", "model_disabled", "accepted")


# --- model contracts --------------------------------------------------------------------

# One model per part. Its own arithmetic breaks one rule or several in some of them.
_MODELS = """SELECT p_partkey AS model_id,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN NULL ELSE p_name END AS model_name,
  CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 4 END AS feature_count,
  p_size % 5 AS window_length, 1 + p_partkey % 2 AS feature_version,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 4000000000 ELSE 1 END AS d0,
  CASE WHEN p_partkey % 19 = 0 THEN 4000000000 ELSE p_size % 5 END AS d1,
  CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 3 ELSE 4 END AS d2,
  1 + p_partkey % 2 AS o0, p_partkey % 6 AS o1,
  (p_size % 5) * 4 AS n_input, (p_partkey % 6) * (1 + p_partkey % 2) AS n_output,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 5 END AS n_weights,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'trained_recorded_public_l2'
    ELSE p_brand END AS artefact_type,
  CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 2 THEN false ELSE true END AS trained_model
FROM part"""


@query(
    "model_contracts",
    f"""WITH models AS ({_MODELS}), sized AS (SELECT *,
      CASE WHEN d0 > 0 AND d1 > 0 AND d2 > 0
        AND d0::HUGEINT * d1 * d2 <= 9223372036854775807 THEN d0::HUGEINT * d1 * d2 END AS inputs,
      CASE WHEN o0 > 0 AND o1 > 0 THEN o0 * o1 END AS outputs,
      coalesce(artefact_type, '') = 'trained_recorded_public_l2' AS recorded FROM models),
    judged AS (SELECT *, list_filter([
      CASE WHEN coalesce(model_name, '') = '' THEN 'name' END,
      CASE WHEN feature_count <= 0 THEN 'feature_count' END,
      CASE WHEN window_length <= 0 THEN 'window_length' END,
      CASE WHEN feature_version <= 0 THEN 'feature_version' END,
      CASE WHEN inputs IS NULL THEN 'input_shape' END,
      CASE WHEN outputs IS NULL THEN 'output_shape' END,
      CASE WHEN inputs IS DISTINCT FROM feature_count * window_length THEN 'frame_size' END,
      CASE WHEN inputs IS DISTINCT FROM n_input THEN 'sample_input' END,
      CASE WHEN outputs IS DISTINCT FROM n_output THEN 'sample_output' END,
      CASE WHEN recorded AND (d0 IS DISTINCT FROM 1 OR d1 <> window_length OR d2 <> feature_count)
        THEN 'recorded_input' END,
      CASE WHEN recorded AND o0 <> 1 THEN 'recorded_output' END,
      CASE WHEN n_weights NOT IN (0, feature_count) THEN 'weights' END,
      CASE WHEN coalesce(artefact_type, '') NOT IN ('', 'trained_recorded_public_l2') THEN 'kind' END,
      CASE WHEN recorded AND NOT coalesce(trained_model, false) THEN 'kind_untrained' END
      ], lambda x: x IS NOT NULL) AS broken FROM sized)
    SELECT model_id, array_to_string(broken, ',') AS violations,
      len(broken) = 0 AND feature_count = 4 AND feature_version = 1 AS compatible FROM judged""",
)
def model_contracts(spark, sf_dir):
    rows = spark.sql(_MODELS.replace("FROM part", "FROM {part}"),
                     part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    repeated = lambda n: F.expr(f"array_repeat(0D, cast({n} as int))")
    models = rows.select(
        "model_id", "model_name", "artefact_type", "trained_model",
        *[F.col(c).cast("bigint") for c in ("feature_count", "window_length", "feature_version")],
        F.expr("array(d0, d1, d2)").cast("array<bigint>").alias("input_shape"),
        F.expr("array(o0, o1)").cast("array<bigint>").alias("output_shape"),
        repeated("n_input").alias("expected_test_input"),
        repeated("n_output").alias("expected_test_output"),
        repeated("n_weights").alias("reference_weights"),
    )
    return features.contract_violations(models, feature_count=4, feature_version=1).select(
        "model_id", F.array_join("violations", ",").alias("violations"), "compatible"
    )


# --- lifecycle --------------------------------------------------------------------------

_LIFE = f"""{V.ORDER_FLOW_SQL},
life AS (
  SELECT order_id, event_index * 4 + 1 AS event_index,
    CASE event_type WHEN 'Add' THEN 'order_accepted' WHEN 'Execute' THEN 'order_filled'
      ELSE 'cancel_requested' END AS event_type FROM order_flow
  UNION ALL
  SELECT order_id, event_index * 4 + 2, CASE event_type WHEN 'Cancel' THEN 'cancel_acknowledged'
    WHEN 'Replace' THEN 'cancel_rejected' ELSE 'order_filled' END
  FROM order_flow WHERE event_type IN ('Cancel', 'Replace', 'Execute')),
hist AS (
  SELECT *, lag(event_type, 1, 'none') OVER (PARTITION BY order_id ORDER BY event_index) AS prev
  FROM life),
known AS (
  SELECT order_id, event_index, event_type,
    NOT (event_type = 'order_filled' AND prev = 'order_filled') AS valid,
    CASE prev WHEN 'none' THEN 'none' WHEN 'order_accepted' THEN 'accepted'
      WHEN 'cancel_requested' THEN 'pending_cancel' WHEN 'cancel_acknowledged' THEN 'canceled'
      WHEN 'cancel_rejected' THEN 'accepted' ELSE 'filled' END AS state_before,
    CASE event_type WHEN 'order_accepted' THEN 'accepted' WHEN 'cancel_requested' THEN 'pending_cancel'
      WHEN 'cancel_acknowledged' THEN 'canceled' WHEN 'cancel_rejected' THEN 'accepted'
      ELSE 'filled' END AS state_after FROM hist)"""


def _life(spark, sf_dir):
    kind = F.col("event_type")
    leg = lambda offset, name: F.struct(
        (F.col("event_index") * 4 + offset).alias("event_index"), name.alias("event_type")
    )
    first = F.when(kind == "Add", "order_accepted").when(kind == "Execute", "order_filled").otherwise(
        "cancel_requested"
    )
    second = F.when(kind == "Cancel", "cancel_acknowledged").when(
        kind == "Replace", "cancel_rejected"
    ).otherwise("order_filled")
    legs = F.array_compact(F.array(leg(1, first), F.when(kind != "Add", leg(2, second))))
    return V.order_flow(spark, sf_dir).select("order_id", F.explode(legs).alias("l")).select(
        "order_id", "l.*"
    )


@query("lifecycle_history", f"WITH {_LIFE} SELECT * FROM known")
def lifecycle_history(spark, sf_dir):
    return lifecycle.state_history(_life(spark, sf_dir))


@query(
    "lifecycle_summary",
    f"""WITH {_LIFE}, last AS (SELECT order_id, arg_max(state_after, event_index) AS s FROM known GROUP BY ALL)
    SELECT count(*) FILTER (s IN ('accepted', 'pending_cancel')) AS live_order_count,
      count(*) FILTER (s = 'pending_cancel') AS pending_cancel_count,
      count(*) FILTER (s = 'filled') AS filled_order_count,
      count(*) FILTER (s = 'canceled') AS canceled_order_count,
      (SELECT count(*) FROM known WHERE valid AND event_type = 'cancel_rejected') AS cancel_reject_count,
      (SELECT count(*) FROM known WHERE valid) AS event_count,
      (SELECT count(*) FROM known WHERE NOT valid) AS invalid_event_count FROM last""",
)
def lifecycle_summary(spark, sf_dir):
    return lifecycle.summary(lifecycle.state_history(_life(spark, sf_dir)))
