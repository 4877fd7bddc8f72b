"""Streaming replay: the same diagnostics and books as batch, event by event.

State per symbol: the cursor (expected sequence, last time, halted, top of the book), the live
orders and the price levels. A halted symbol stays halted for good: its cursor has no expiry, its
orders and levels leave the state. ``ReplayProcessor`` holds one entry per order and level;
``PackedReplayProcessor`` packs orders into buckets of a bounded size and the levels into the
cursor, so that a micro-batch costs a message per bucket and not one per order.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = (
    "symbol_id BIGINT, event_index BIGINT, sequence_number BIGINT, status STRING, "
    "reason STRING, live_orders BIGINT, bid_price BIGINT, ask_price BIGINT"
)

_NEED_ID = {"Add", "Cancel", "Replace", "Execute"}
_NEED_PRICE = {"Add", "Replace", "Trade"}
_NEED_SIZE = {"Add", "Replace", "Execute", "Trade"}


_COLUMNS = [part.split()[0] for part in RESULT.split(", ")]
_READ = [
    "sequence_number", "timestamp_ns", "symbol_id", "event_type", "side", "price_ticks", "quantity",
    "order_id", "flags",
]
_CHUNK = 50_000


def _fault(kind, side, symbol, order_id, price, quantity, order: tuple | None) -> str | None:
    """First violated field or state rule of an event."""
    sided = side in ("Buy", "Sell")
    if symbol == 0:
        return "invalid symbol id"
    if kind in _NEED_ID and order_id == 0:
        return "invalid order id"
    if kind in ("Add", "Replace") and not sided:
        return "invalid side"
    if kind in _NEED_PRICE and price <= 0:
        return "invalid price"
    if price < 0:
        return "invalid negative price"
    if kind in _NEED_SIZE and quantity <= 0:
        return "invalid quantity"
    if quantity < 0:
        return "invalid negative quantity"
    if kind == "Snapshot" and order_id != 0:
        if not sided:
            return "invalid snapshot side"
        if price <= 0:
            return "invalid snapshot price"
        if quantity <= 0:
            return "invalid snapshot quantity"
    if order is not None:
        if kind == "Add":
            return "duplicate order id"
        if kind in ("Cancel", "Execute") and quantity > order[2]:
            return "invalid quantity exceeds resting order quantity"
    elif kind in ("Cancel", "Replace", "Execute"):
        return f"unknown {kind.lower()} order id"
    return None


# A symbol's live orders are read at once where a micro-batch names one in so many of them.
_READ_ALL = 8


class _Orders:
    """Live orders of a symbol, read from state and written back once: all together, or each when
    first touched where ``known`` is false. Nothing is asked of the state about the rest."""

    def __init__(self, state, held: dict[int, tuple], known: bool):
        self.state = state
        self.known = known
        self.stored: dict[int, tuple | None] = held
        self.now: dict[int, tuple | None] = dict(held)

    def __getitem__(self, order_id: int) -> tuple | None:
        """(side, price, quantity) of a live order."""
        if order_id == 0:
            return None
        if order_id not in self.now:
            found = None if self.known else self.state.getValue((order_id,))
            self.now[order_id] = self.stored[order_id] = tuple(found) if found else None
        return self.now[order_id]

    def __setitem__(self, order_id: int, order: tuple | None) -> None:
        self.now[order_id] = order

    def clear(self) -> None:
        self.state.clear()
        self.stored, self.now, self.known = {}, {}, True

    def save(self) -> None:
        for order_id, order in self.now.items():
            if order == self.stored.get(order_id):
                continue
            if order is None:
                self.state.removeKey((order_id,))
            else:
                self.state.updateValue((order_id,), order)


class _Levels:
    """Orders per price of both sides; a heap per side gives the best price.

    A price enters its heap when its level opens and leaves it when it has become the top without
    an order left, so an event costs a logarithm of the levels.
    """

    def __init__(self, state, held: dict[tuple[str, int], int]):
        self.state = state
        self.stored, self.counts = held, dict(held)
        self.changed: set[tuple[str, int]] = set()
        self.heaps: dict[str, list[int]] = {"Buy": [], "Sell": []}
        for side, price in self.counts:
            self.heaps[side].append(self._rank(side, price))
        for heap in self.heaps.values():
            heapq.heapify(heap)

    @staticmethod
    def _rank(side: str, price: int) -> int:
        return -price if side == "Buy" else price

    def move(self, side: str, price: int, change: int) -> None:
        level = side, price
        if level not in self.counts:
            self.counts[level] = 0
            heapq.heappush(self.heaps[side], self._rank(side, price))
        self.counts[level] += change
        self.changed.add(level)

    def best(self, side: str) -> int | None:
        heap = self.heaps[side]
        while heap:
            price = self._rank(side, heap[0])
            if self.counts[side, price]:
                return price
            heapq.heappop(heap)
            del self.counts[side, price]
        return None

    def clear(self) -> None:
        self.state.clear()
        self.stored, self.counts, self.changed = {}, {}, set()
        self.heaps = {"Buy": [], "Sell": []}

    def save(self) -> None:
        for level in self.changed:
            count = self.counts.get(level, 0)
            if count and count != self.stored.get(level):
                self.state.updateValue(level, (count,))
            elif not count and level in self.stored:
                self.state.removeKey(level)


_BUCKET = 256
_PACKED = {"Buy": 0, "Sell": 1}
_SIDES = ("Buy", "Sell")


def _pack(rows: list[tuple]) -> bytes:
    return np.array(rows, dtype=np.int64).tobytes()


def _unpack(data: bytes, width: int) -> list[list[int]]:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, width).tolist()


class _Buckets:
    """Live orders of a symbol in buckets by a hash of their ids, a power of two of them. A bucket
    is read when one of its orders is first touched, or with all others where ``whole``; it is
    written back once. Buckets double with the orders, so one holds some ``_BUCKET`` at most."""

    def __init__(self, state, buckets: int, new: bool, whole: bool):
        self.state, self.buckets = state, buckets
        self.held: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        self.known = new
        if whole and not new:
            self._read_rest()

    def _read_rest(self) -> None:
        for (bucket,), (data,) in self.state.iterator():
            if bucket not in self.held:
                self.held[bucket] = self._orders(data)
        self.known = True

    @staticmethod
    def _orders(data: bytes) -> dict[int, tuple]:
        return {n: (_SIDES[side], price, left) for n, side, price, left in _unpack(data, 4)}

    def _place(self, order_id: int) -> int:
        if self.buckets == 1:
            return 0
        return (order_id * 0x9E3779B97F4A7C15 >> 32) & (self.buckets - 1)

    def _bucket(self, place: int) -> dict[int, tuple]:
        found = self.held.get(place)
        if found is None:
            data = None if self.known else self.state.getValue((place,))
            found = self.held[place] = self._orders(data[0]) if data else {}
        return found

    def __getitem__(self, order_id: int) -> tuple | None:
        """(side, price, quantity) of a live order."""
        return self._bucket(self._place(order_id)).get(order_id) if order_id else None

    def __setitem__(self, order_id: int, order: tuple | None) -> None:
        place = self._place(order_id)
        self.changed.add(place)
        if order is None:
            self._bucket(place).pop(order_id, None)
        else:
            self._bucket(place)[order_id] = order

    def clear(self) -> None:
        self.state.clear()
        self.held, self.changed, self.known = {}, set(), True

    def save(self, live: int) -> int:
        """Write what changed; the number of buckets from now on."""
        if live > self.buckets * _BUCKET:
            if not self.known:
                self._read_rest()
            orders = [x for held in self.held.values() for x in held.items()]
            self.clear()
            while live > self.buckets * _BUCKET // 2:
                self.buckets *= 2
            for order_id, order in orders:
                self[order_id] = order
        for place in self.changed:
            if held := self.held[place]:
                self.state.updateValue((place,), (_pack(
                    [(n, _PACKED[side], price, left) for n, (side, price, left) in held.items()]
                ),))
            else:
                self.state.removeKey((place,))
        return self.buckets


class _Unstored:
    """Stands in for the state of levels that are kept elsewhere."""

    def clear(self) -> None:
        pass


def _frame(columns: list[list]) -> pd.DataFrame:
    """Output rows of columns in the order of ``RESULT``."""
    return pd.DataFrame({
        name: pd.Series(values, dtype=object)
        for name, values in zip(_COLUMNS, columns, strict=True)
    })


def _skipped(symbol: int, index: list, sequence: list, top: tuple) -> Iterator[pd.DataFrame]:
    """Rows of a halted symbol, with the state it stopped in."""
    for begin in range(0, len(index), _CHUNK):
        part = index[begin : begin + _CHUNK]
        same = ([value] * len(part) for value in ("skipped", None, *top))
        yield _frame([[symbol] * len(part), part, sequence[begin : begin + _CHUNK], *same])


class ReplayProcessor(StatefulProcessor):
    """One row per event; a halting event carries its reason, later ones are skipped.

    A call sees one micro-batch of a symbol, so its size is bounded by the source's
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``; rows leave in chunks as they are made.
    """

    def __init__(self, sequence: bool = True, timestamps: bool = True):
        self.sequence = sequence
        self.timestamps = timestamps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState(
            "cursor",
            "expected BIGINT, last BIGINT, halted BOOLEAN, live BIGINT, bid BIGINT, ask BIGINT",
        )
        self.order_state = handle.getMapState(
            "orders", "order_id BIGINT", "side STRING, price BIGINT, quantity BIGINT"
        )
        self.level_state = handle.getMapState("levels", "side STRING, price BIGINT", "orders BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        cursor = self.cursor.get()
        self.expected, self.last, self.halted, *top = (
            cursor[:6] if cursor else (None, None, False, 0, None, None)
        )
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if not batch["event_index"].is_monotonic_increasing:
            batch = batch.sort_values("event_index")
        index, sequence = batch["event_index"].tolist(), batch["sequence_number"].tolist()
        symbol = int(key[0])
        if self.halted:
            yield from _skipped(symbol, index, sequence, top)
            return
        self.live = top[0]
        self._load(batch, cursor)
        out: tuple[list, ...] = tuple([] for _ in _COLUMNS)
        done = begun = 0
        best = self.levels.best
        for done, e in enumerate(zip(*(batch[c].tolist() for c in _READ), strict=True), 1):
            reason = self._step(*e)
            top = self.live, best("Buy"), best("Sell")
            reason = reason or self._crossed(*top[1:])
            self.halted = reason is not None
            for column, value in zip(out[4:], (reason, *top), strict=True):
                column.append(value)
            if self.halted or done - begun == _CHUNK:
                yield self._rows(symbol, index, sequence, begun, done, out)
                begun = done
                out = tuple([] for _ in _COLUMNS)
            if self.halted:
                break
        self._save(cursor, top)
        if begun < done:
            yield self._rows(symbol, index, sequence, begun, done, out)
        yield from _skipped(symbol, index[done:], sequence[done:], top)

    def _rows(self, symbol, index, sequence, begin, end, out) -> pd.DataFrame:
        status = ["applied"] * (end - begin)
        if self.halted:
            status[-1] = "halted"
        return _frame(
            [[symbol] * (end - begin), index[begin:end], sequence[begin:end], status, *out[4:]]
        )

    def _reads_all(self, batch: pd.DataFrame) -> bool:
        """Whether a batch names a good part of the live orders, which are then read together."""
        return self.live <= _READ_ALL * batch["order_id"].nunique()

    def _load(self, batch: pd.DataFrame, cursor: tuple | None) -> None:
        """Book of the symbol. A new symbol holds nothing, so nothing is asked for."""
        new = cursor is None
        whole = new or self._reads_all(batch)
        held = {} if new or not whole else {
            order_id: order for (order_id,), order in self.order_state.iterator()
        }
        self.orders = _Orders(self.order_state, held, whole)
        self.levels = _Levels(self.level_state, {} if new else {
            level: count for level, (count,) in self.level_state.iterator()
        })

    def _save(self, cursor: tuple | None, top: tuple) -> None:
        if not self.halted:
            self.orders.save()
            self.levels.save()
        elif cursor is not None:
            self.order_state.clear()
            self.level_state.clear()
        self.cursor.update((self.expected, self.last, self.halted, *top))

    def _step(
        self, sequence, now, symbol, kind, side, price, quantity, order_id, flags
    ) -> str | None:
        """Apply an event, or say why it stops its symbol."""
        sequence, now = int(sequence), int(now)
        if self.sequence and self.expected not in (None, sequence):
            return f"sequence gap: expected {self.expected}, received {sequence}"
        if self.timestamps and self.last is not None and now < self.last:
            return f"timestamp reversal: previous {self.last}, received {now}"
        self.expected, self.last = sequence + 1, now
        order = self.orders[int(order_id)]
        return _fault(kind, side, symbol, order_id, price, quantity, order) or self._apply(
            kind, side, int(order_id), int(price), int(quantity), flags
        )

    @staticmethod
    def _crossed(bid: int | None, ask: int | None) -> str | None:
        if bid is not None and ask is not None and bid >= ask:
            return f"crossed book state: best bid {bid} >= best ask {ask}"
        return None

    def _put(self, order_id: int, side: str, price: int, quantity: int) -> None:
        self.orders[order_id] = (side, price, quantity)
        self.levels.move(side, price, 1)
        self.live += 1

    def _drop(self, order_id: int, order: tuple) -> None:
        self.orders[order_id] = None
        self.levels.move(order[0], order[1], -1)
        self.live -= 1

    def _apply(self, kind, side, order_id, price, quantity, flags) -> str | None:
        if kind == "Snapshot" and int(flags) & 1:
            self.orders.clear()
            self.levels.clear()
            self.live = 0
        order = self.orders[order_id]
        if kind == "Snapshot" and order is not None:
            return "failed to apply Snapshot event"
        if kind == "Add" or kind == "Snapshot" and order_id:
            self._put(order_id, side, price, quantity)
        elif kind == "Replace":
            self._drop(order_id, order)
            self._put(order_id, order[0], price, quantity)
        elif kind in ("Cancel", "Execute"):
            left = order[2] - quantity
            if left > 0 and quantity > 0:
                self.orders[order_id] = (*order[:2], left)
            else:
                self._drop(order_id, order)
        return None


class PackedReplayProcessor(ReplayProcessor):
    """The same replay with its orders in buckets and its levels beside the cursor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState(
            "cursor",
            "expected BIGINT, last BIGINT, halted BOOLEAN, live BIGINT, bid BIGINT, ask BIGINT, "
            "buckets BIGINT, levels BINARY",
        )
        self.order_state = handle.getMapState("orders", "bucket BIGINT", "orders BINARY")

    def _load(self, batch: pd.DataFrame, cursor: tuple | None) -> None:
        new = cursor is None
        buckets, levels = cursor[6:] if cursor else (1, b"")
        whole = not new and buckets > 1 and self._reads_all(batch)
        self.orders = _Buckets(self.order_state, buckets, new, whole)
        self.levels = _Levels(_Unstored(), {
            (_SIDES[side], price): count for side, price, count in _unpack(levels, 3)
        })

    def _save(self, cursor: tuple | None, top: tuple) -> None:
        buckets, levels = 1, b""
        if not self.halted:
            buckets = self.orders.save(self.live)
            levels = _pack([
                (_PACKED[side], price, count)
                for (side, price), count in self.levels.counts.items() if count
            ])
        elif cursor is not None:
            self.order_state.clear()
        self.cursor.update((self.expected, self.last, self.halted, *top, buckets, levels))


def replay_stream(
    events: DataFrame, sequence: bool = True, timestamps: bool = True, packed: bool = False
) -> DataFrame:
    """Replay a stream of indexed events. Events of a symbol must arrive in batch order;
    inside a micro-batch they are sorted by position. ``packed`` keeps the state in few large
    entries; a checkpoint holds one layout or the other."""
    processor = PackedReplayProcessor if packed else ReplayProcessor
    return events.groupBy("symbol_id").transformWithStateInPandas(
        processor(sequence, timestamps),
        outputStructType=RESULT,
        outputMode="append",
        timeMode="None",
    )
