"""Order-dependent primitives that survive a hot key.

A plain window over a key puts that key in one task. Here every key is cut into blocks of
its order column. Work inside a block runs in parallel; only one summary row per block
passes through the per-key step, so a key with 10^12 rows and blocks of 10^6 rows leaves
10^6 summary rows there.

* ``block_scan``   running sums, previous values, last non-null values and running maxima
* ``number_rows``  dense row numbers over a total order
* ``block_fold``   an arbitrary sequential fold, exact, by re-running only the blocks whose
                   entry state turned out different from the assumed one; keys whose states do
                   not settle are streamed block after block
* ``follow``       all positions of pointer chains, by doubling; ``follow_blocks`` doubles only
                   where chains enter and leave blocks
"""

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import stage

DEFAULT_BLOCK_ROWS = 1_000_000


def whole_div(value: Column | str, unit: int) -> Column:
    """Floor of a whole number over a positive unit, in whole numbers."""
    col = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    unit = F.lit(unit).cast("bigint")
    return F.call_function("div", col - F.pmod(col, unit), unit)


def block_of(position: Column | str, rows: int) -> Column:
    """Block number of a unique integer position: at most ``rows`` rows per key and block."""
    col = F.col(position) if isinstance(position, str) else position
    return whole_div(col, rows)


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    *,
    previous: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    peaks: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key, in ``order``.

    previous: value on the row before (null on the first row of the key)
    totals:   running sum including the row
    latest:   last non-null value up to and including the row
    peaks:    maximum over the rows before (null on the first row of the key)

    ``block`` must not decrease along ``order``. One shuffle of the rows on (keys, block);
    the block summaries are combined map-side and the join back reuses that partitioning.
    Give ``block`` as the name of a column to keep that column: a second scan over the same
    keys and column then needs no further shuffle of the rows.
    """
    previous, totals = previous or {}, totals or {}
    latest, peaks = latest or {}, peaks or {}
    keys, order = list(keys), list(order)
    point = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    kept_block = isinstance(block, str)
    place = block if kept_block else "_scan_block"
    base = df if kept_block else df.withColumn(place, block)
    inputs = {}
    for group in (previous, totals, latest, peaks):
        for name, col in group.items():
            inputs[f"_in_{name}"] = col
    base = base.withColumns(inputs)

    local_window = Window.partitionBy(*keys, place).orderBy(*order)
    upto = local_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    if previous:
        local["_inner"] = F.lag(F.lit(True)).over(local_window)
    for name in previous:
        local[f"_loc_{name}"] = F.lag(f"_in_{name}").over(local_window)
    for name in totals:
        local[f"_loc_{name}"] = F.sum(f"_in_{name}").over(upto)
    for name in latest:
        local[f"_loc_{name}"] = F.last(f"_in_{name}", ignorenulls=True).over(upto)
    for name in peaks:
        local[f"_loc_{name}"] = F.max(f"_in_{name}").over(
            local_window.rowsBetween(Window.unboundedPreceding, -1)
        )
    rows = base.withColumns(local)

    aggregates = [F.count(F.lit(1)).alias("_n")]
    for name in previous:
        aggregates.append(F.max_by(f"_in_{name}", point).alias(f"_out_{name}"))
    for name in totals:
        aggregates.append(F.sum(f"_in_{name}").alias(f"_out_{name}"))
    for name in latest:
        present = F.when(F.col(f"_in_{name}").isNotNull(), point)
        aggregates.append(F.max_by(f"_in_{name}", present).alias(f"_out_{name}"))
    for name in peaks:
        aggregates.append(F.max(f"_in_{name}").alias(f"_out_{name}"))
    summary = base.groupBy(*keys, place).agg(*aggregates)

    key_window = Window.partitionBy(*keys).orderBy(place)
    before = key_window.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name in previous:
        carried.append(F.lag(f"_out_{name}").over(key_window).alias(f"_carry_{name}"))
    for name in totals:
        carried.append(F.sum(f"_out_{name}").over(before).alias(f"_carry_{name}"))
    for name in latest:
        carried.append(
            F.last(f"_out_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}")
        )
    for name in peaks:
        carried.append(F.max(f"_out_{name}").over(before).alias(f"_carry_{name}"))
    carry = summary.select(*keys, place, *carried)

    joined = rows.join(carry, [*keys, place], "left")
    out = {}
    for name in previous:
        out[name] = F.when(F.col("_inner"), F.col(f"_loc_{name}")).otherwise(
            F.col(f"_carry_{name}")
        )
    for name in totals:
        out[name] = F.coalesce(F.col(f"_loc_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_carry_{name}"), F.lit(0)
        )
    for name in latest:
        out[name] = F.coalesce(f"_loc_{name}", f"_carry_{name}")
    for name in peaks:
        out[name] = F.greatest(f"_loc_{name}", f"_carry_{name}")
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[col.alias(name) for name, col in out.items()])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Dense 1-based row number per key over a total order, without a per-key task.

    Rows are range-partitioned on (keys, order), so a hot key spreads over many partitions,
    and staged once; the offset of each partition follows from its row count.
    """
    keys, order = list(keys), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    staged = stage(ranged, f"order-{name}").withColumn(
        "_part", F.shiftright("_row", 33).cast("bigint")
    )
    counts = staged.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    # Staged, their size is known: few of them are broadcast, and the rows need no second shuffle.
    return (
        staged.join(stage(offsets, f"offsets-{name}"), [*keys, "_part"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_offset") + 1)
        .drop("_row", "_part", "_first", "_offset")
        .select(*df.columns, name)
    )


def follow(start: DataFrame, jumps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positions (keys, ``at``) on the chains that ``jumps`` (keys, ``at``, ``to``) makes from
    ``start`` (keys, ``at``), the start included. Jumps lead forward, one from each position.

    With the positions up to the 2^k-th and pointers over 2^k of them, one join gives as many
    positions again and one the pointers over twice as many: rounds grow with the logarithm of
    the longest chain.
    """
    keys = list(keys)
    reached = start
    while not jumps.isEmpty():
        new = reached.join(jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        reached = stage(reached.unionByName(new), "follow-reached")
        further = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
        jumps = stage(
            jumps.join(further, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")),
            "follow-jumps",
        )
    return reached


def follow_blocks(start: DataFrame, jumps: DataFrame, block_rows: int) -> DataFrame:
    """``follow`` without keys, for chains with many positions in a block of ``block_rows``.

    A block gives the exit of each position at which a chain may enter it: the targets of jumps
    from other blocks. Only entries and exits are doubled; the blocks then walk from the entries
    that were reached.
    """
    rows = stage(jumps.withColumn("_block", block_of("at", block_rows)), "follow-blocks")
    crossing = rows.filter(block_of("to", block_rows) != F.col("_block"))
    entries = start.select("at").unionByName(crossing.select(F.col("to").alias("at"))).distinct()

    def links(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, targets, place of each target among the positions, whether it is there."""
        ordered = table.sort_by("at")
        at, to = ordered.column("at").to_numpy(), ordered.column("to").to_numpy()
        place = np.minimum(np.searchsorted(at, to), at.size - 1)
        return at, to, place, at[place] == to

    def leave(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"at": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        at, to, place, inside = links(left)
        last = np.where(inside, place, np.arange(at.size))
        while not np.array_equal(further := last[last], last):
            last = further
        picked = np.isin(at, right.column("at").to_numpy())
        return pa.table({"at": at[picked], "to": to[last][picked]})

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        found = set(right.column("at").to_pylist())
        if left.num_rows and found:
            at, to, place, inside = links(left)
            for entry in sorted(found):
                here = int(np.searchsorted(at, entry))
                while here < at.size and at[here] == entry and inside[here]:
                    here = int(place[here])
                    entry = int(at[here])
                    found.add(entry)
        return pa.table({"at": pa.array(sorted(found), pa.int64())})

    def beside(df: DataFrame):
        return df.withColumn("_block", block_of("at", block_rows)).groupBy("_block")

    by_block = rows.groupBy("_block")
    exits = by_block.cogroup(beside(entries)).applyInArrow(leave, "at BIGINT, to BIGINT")
    reached = follow(start.select("at"), stage(exits, "follow-exits"))
    return by_block.cogroup(beside(reached)).applyInArrow(walk, "at BIGINT")


def block_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    fold: Callable[[bytes, pa.Table], tuple[dict, bytes]],
    output: str,
    *,
    initial: bytes = b"",
    initial_states: DataFrame | None = None,
    label: str = "fold",
) -> DataFrame:
    """Exact sequential fold per key in parallel blocks.

    ``fold(state, rows)`` takes the rows of one block, sorted by ``order``, and returns the
    output columns (``output`` DDL, keys included) and the state after the block. The first
    round starts every block from the initial state; each later round re-runs only blocks
    whose entry state changed. A block is right as soon as its predecessor is; folds that
    forget their start end after two rounds. Rounds go on while each leaves at most half of the
    blocks of the one before. States that do not forget would need a round per block, so the
    rest of a key is then streamed once, block after block, from its first open block: total
    work is a few folds of every row, and keys stay parallel.

    ``initial_states`` (keys + ``_state``) overrides the initial state per key.
    No task ever holds more than one block, and the state crosses blocks as a small binary.
    """
    keys, order = list(keys), list(order)
    schema = T.StructType.fromDDL(output)
    key_types = {f.name: f.dataType for f in df.schema.fields}
    state_fields = [T.StructField(k, key_types[k]) for k in keys] + [
        T.StructField("_block", T.LongType()),
        T.StructField("_exit", T.BinaryType()),
    ]
    sort_keys = [(c, "ascending") for c in order]
    rows = stage(df.withColumn("_block", block), f"{label}-rows")
    group = [*keys, "_block"]

    def run_exit(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table(
                {f.name: pa.array([], type=_arrow(f.dataType)) for f in state_fields}
            )
        _, state = fold(right.column("_entry")[0].as_py(), left.sort_by(sort_keys))
        data = {k: [left.column(k)[0].as_py()] for k in keys}
        data["_block"] = [left.column("_block")[0].as_py()]
        data["_exit"] = [state]
        return pa.table(
            {f.name: pa.array(data[f.name], type=_arrow(f.dataType)) for f in state_fields}
        )

    def run_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            columns = {f.name: [] for f in schema.fields}
        else:
            columns, _ = fold(right.column("_entry")[0].as_py(), left.sort_by(sort_keys))
        return pa.table(
            {f.name: pa.array(columns[f.name], type=_arrow(f.dataType)) for f in schema.fields}
        )

    by_block = Window.partitionBy(*keys).orderBy("_block")
    states = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).select(
        *group, F.row_number().over(by_block).alias("_ordinal")
    )
    if initial_states is not None:
        states = states.join(initial_states.select(*keys, "_state"), keys, "left")
    else:
        states = states.withColumn("_state", F.lit(None).cast("binary"))
    states = states.select(
        *group,
        "_ordinal",
        F.coalesce("_state", F.lit(bytearray(initial))).alias("_start"),
    ).withColumns(
        {
            "_entry": F.col("_start"),
            "_exit": F.lit(None).cast("binary"),
            "_todo": F.lit(True),
        }
    )
    states = stage(states, f"{label}-states")

    open_blocks = None
    while True:
        todo = states.filter("_todo").select(*group, "_entry")
        exits = (
            rows.join(todo.select(*group), group, "left_semi")
            .groupBy(*group)
            .cogroup(todo.groupBy(*group))
            .applyInArrow(run_exit, schema=T.StructType(state_fields))
        )
        merged = states.drop("_todo").join(
            exits.withColumnRenamed("_exit", "_new"), group, "left"
        ).select(
            *group, "_ordinal", "_start", "_entry", F.coalesce("_new", "_exit").alias("_exit")
        )
        follow = F.when(F.col("_ordinal") == 1, F.col("_start")).otherwise(
            F.lag("_exit").over(by_block)
        )
        states = stage(
            merged.withColumn("_next", follow).select(
                *group,
                "_ordinal",
                "_start",
                F.col("_next").alias("_entry"),
                "_exit",
                (F.col("_next") != F.col("_entry")).alias("_todo"),
            ),
            f"{label}-states",
        )
        before, open_blocks = open_blocks, states.filter("_todo").count()
        if not open_blocks or (before is not None and 2 * open_blocks > before):
            break

    def settled(rows: DataFrame, states: DataFrame) -> DataFrame:
        return (
            rows.groupBy(*group)
            .cogroup(states.select(*group, "_entry").groupBy(*group))
            .applyInArrow(run_rows, schema=schema)
        )

    if not open_blocks:
        return settled(rows, states)

    def run_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = b""
        for block in whole_groups(batches, group):
            if block.column("_lead")[0].as_py():
                state = block.column("_entry")[0].as_py()
                block = block.slice(1)
            table = pa.Table.from_batches([block]).select(inputs)
            columns, state = fold(state, table.sort_by(sort_keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=_arrow(f.dataType)) for f in schema.fields],
                names=schema.names,
            )

    # A lead row brings the state of a key to its first open block.
    inputs = rows.columns
    by_key = Window.partitionBy(*keys)
    first = states.withColumn(
        "_open", F.min(F.when(F.col("_todo"), F.col("_ordinal"))).over(by_key)
    )
    leads = stage(
        first.filter("_ordinal = _open").select(
            *group, "_entry", F.lit(True).alias("_lead")
        ),
        f"{label}-leads",
    )
    starts = leads.select(*keys, F.col("_block").alias("_from"))
    chain = (
        rows.join(starts, keys)
        .filter(F.col("_block") >= F.col("_from"))
        .drop("_from")
        .withColumns({"_entry": F.lit(None).cast("binary"), "_lead": F.lit(False)})
        .unionByName(leads, allowMissingColumns=True)
        .repartition(*keys)
        .sortWithinPartitions(*group, F.col("_lead").desc())
    )
    done = first.filter("_open IS NULL OR _ordinal < _open")
    same = [rows[c].eqNullSafe(F.col(f"_of_{c}")) for c in group]
    kept = rows.join(
        done.select(*[F.col(c).alias(f"_of_{c}") for c in group]), same, "left_semi"
    )
    return settled(kept, done).unionByName(chain.mapInArrow(run_chain, schema=schema))


def whole_groups(
    batches: Iterator[pa.RecordBatch], place: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    """One batch per group of ``place``, from sorted batches that cut groups anywhere."""
    parts: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(c) for c in place]
        starts = group_starts(columns, last)
        last = [c[-1].as_py() for c in columns]
        for begin, end in pairwise(sorted({0, *starts, batch.num_rows})):
            if begin in starts and parts:
                yield whole()
                parts = []
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield whole()


def group_starts(place: list[pa.Array], last: list | None) -> set[int]:
    """Row numbers at which another group begins in a sorted batch."""
    size = len(place[0])
    changed = np.zeros(size, dtype=bool)
    for column in place:
        values = column.to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    if size and last != [c[0].as_py() for c in place]:
        changed[0] = True
    return set(np.flatnonzero(changed).tolist())


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)
