"""Streaming limits: message rates, late-signal gates and stale prices."""

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.features import SignalPolicy, judge_signals
from tickloom.streaming.windows import event_time

MILLI = 1_000_000

RATE_RESULT = "client_id BIGINT, arrival BIGINT, observed_rate BIGINT, allowed BOOLEAN"
GATE_RESULT = (
    "user_id BIGINT, event_id BIGINT, late_streak BIGINT, model_disabled BOOLEAN, "
    "accepted BOOLEAN"
)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


class RateProcessor(StatefulProcessor):
    """Fixed or sliding message windows per client; only live timestamps stay in state.

    With event time, a timer ends the state of a client whose window has passed without a message.
    """

    def __init__(self, limit: int, window_ns: int, sliding: bool, expires: bool):
        self.limit, self.window, self.sliding = limit, window_ns, sliding
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.sliding:
            self.times = handle.getListState("times", "at BIGINT")
        else:
            self.span = handle.getValueState("span", "start BIGINT, seen BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(
            [part[["arrival", "timestamp_ns"]] for part in rows], ignore_index=True
        ).sort_values("arrival")
        seen = (self._sliding if self.sliding else self._fixed)(batch.timestamp_ns.tolist())
        yield pd.DataFrame(
            {
                "client_id": int(key[0]),
                "arrival": batch.arrival.to_numpy(),
                "observed_rate": seen,
                "allowed": [n <= self.limit for n in seen],
            },
            columns=_names(RATE_RESULT),
        )

    def _sliding(self, times: list[int]) -> list[int]:
        """Live messages after each one; the oldest leave a heap, so times may come in any order."""
        live = [at for (at,) in self.times.get()]
        heapq.heapify(live)
        seen = []
        for now in times:
            while live and now - live[0] >= self.window:
                heapq.heappop(live)
            heapq.heappush(live, now)
            seen.append(len(live))
        self.times.put([(at,) for at in live])
        self._expire_at(max(live))
        return seen

    def _fixed(self, times: list[int]) -> list[int]:
        start, count = self.span.get() if self.span.exists() else (None, 0)
        seen = []
        for now in times:
            if start is None or now - start >= self.window:
                start, count = now, 0
            count += 1
            seen.append(count)
        self.span.update((start, count))
        self._expire_at(start)
        return seen

    def _expire_at(self, newest: int) -> None:
        if not self.expires:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-(newest + self.window) // MILLI))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (self.times if self.sliding else self.span).clear()
        yield pd.DataFrame([], columns=_names(RATE_RESULT))


def _timed(messages: DataFrame, watermark: str | None) -> DataFrame:
    if watermark is None:
        return messages
    return messages.withColumn("_ts", event_time()).withWatermark("_ts", watermark)


def rate_stream(
    messages: DataFrame,
    limit: int,
    window_ns: int,
    sliding: bool = True,
    watermark: str | None = "1 hour",
) -> DataFrame:
    """Observed message rate per client over a stream (client_id, arrival, timestamp_ns).

    A client's state goes once the watermark has passed its window. Spark drops messages that come
    later than the watermark; with ``watermark=None`` none is dropped and state never ends.
    """
    return _timed(messages, watermark).groupBy("client_id").transformWithStateInPandas(
        RateProcessor(limit, window_ns, sliding, watermark is not None),
        outputStructType=RATE_RESULT,
        outputMode="append",
        timeMode="None" if watermark is None else "EventTime",
    )


class GateProcessor(StatefulProcessor):
    """Late streak and latch per model; a ``reset`` row clears both."""

    def __init__(self, policy: SignalPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "streak BIGINT, disabled BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        streak, disabled = self.state.get() if self.state.exists() else (0, False)
        policy = self.policy
        batch = pd.concat(list(rows), ignore_index=True).sort_values("event_id")
        resets = batch["reset"] if "reset" in batch else [False] * len(batch)
        out = []
        for event, late, fine, reset in zip(
            batch.event_id, batch.late_signal, batch.accepted, resets, strict=True
        ):
            if reset:
                streak, disabled = 0, False
                continue
            streak = streak + 1 if late else 0
            trips = policy.disable_on_repeated_late_signals and (
                0 < policy.max_consecutive_late_signals <= streak
            )
            disabled = bool(disabled or trips)
            out.append((int(key[0]), int(event), streak, disabled, bool(fine) and not disabled))
        self.state.update((streak, disabled))
        yield pd.DataFrame(out, columns=_names(GATE_RESULT))


def gate_stream(signals: DataFrame, policy: SignalPolicy) -> DataFrame:
    """Judge a stream of signals and switch models off after repeated late ones."""
    return (
        judge_signals(signals, policy)
        .groupBy("user_id")
        .transformWithStateInPandas(
            GateProcessor(policy),
            outputStructType=GATE_RESULT,
            outputMode="append",
            timeMode="None",
        )
    )


STALE_RESULT = (
    "symbol_id BIGINT, timestamp_ns BIGINT, client_order_id BIGINT, reference_price_ticks BIGINT, "
    "age_ns BIGINT, stale BOOLEAN"
)


class StaleProcessor(StatefulProcessor):
    """Latest reference price per symbol; orders are judged against its age.

    With event time, a price that stands longer than the limit raises one row of its own: from a
    timer when the watermark gets there, or from the next price if that comes first.
    """

    def __init__(self, stale_after_ns: int, alerts: bool):
        self.limit = stale_after_ns
        self.alerts = alerts and stale_after_ns > 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("market", "price BIGINT, since BIGINT, raised BOOLEAN")

    def _due(self, since: int) -> int:
        """First millisecond at which a price of that time is too old."""
        return (since + self.limit) // MILLI + 1

    def _alert(self, symbol: int, price: int, since: int) -> tuple:
        due = self._due(since) * MILLI
        return symbol, due, None, price, due - since, True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        symbol = int(key[0])
        before = market = self.state.get() if self.state.exists() else None
        batch = pd.concat(list(rows), ignore_index=True)
        batch["_order"] = batch.client_order_id.notna()
        batch = batch.sort_values(["timestamp_ns", "_order"], kind="stable")
        out = []
        for now, order, price in zip(
            batch.timestamp_ns, batch.client_order_id, batch.reference_price_ticks, strict=True
        ):
            now = int(now)
            if pd.isna(order):
                if self.alerts and market and not market[2] and now - market[1] > self.limit:
                    out.append(self._alert(symbol, market[0], market[1]))
                market = (int(price), now, False)
            elif market is None:
                out.append((symbol, now, int(order), None, None, True))
            else:
                age = now - market[1]
                stale = self.limit > 0 and age > self.limit
                out.append((symbol, now, int(order), market[0], age, stale))
        if market is not before:
            self.state.update(market)
            if self.alerts:
                if before is not None and not before[2]:
                    self.handle.deleteTimer(self._due(before[1]))
                self.handle.registerTimer(self._due(market[1]))
        yield pd.DataFrame(out, columns=_names(STALE_RESULT), dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        price, since, _ = self.state.get()
        self.state.update((price, since, True))
        yield pd.DataFrame(
            [self._alert(int(key[0]), price, since)], columns=_names(STALE_RESULT), dtype=object
        )


def stale_stream(
    messages: DataFrame, stale_after_ns: int, watermark: str | None = None
) -> DataFrame:
    """Staleness of orders against market updates in one stream: rows carry symbol_id,
    timestamp_ns and either client_order_id or reference_price_ticks.

    With a ``watermark``, every price that grows too old also raises one row without an order,
    whether or not a message follows; Spark then drops messages later than the watermark.
    """
    return _timed(messages, watermark).groupBy("symbol_id").transformWithStateInPandas(
        StaleProcessor(stale_after_ns, watermark is not None),
        outputStructType=STALE_RESULT,
        outputMode="append",
        timeMode="None" if watermark is None else "EventTime",
    )
