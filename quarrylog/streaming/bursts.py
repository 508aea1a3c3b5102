"""Bursts and sprays over a stream: what ``operators.bursts`` finds, as soon as the watermark has passed a window.

The state of a key is the list of its events that no decision has been made on yet: those of one window and of the
watermark's delay. A timer stands at the end of the first event's window. When the watermark has passed it, no event of that window can
still come, so it is a burst or its first event goes, as in the batch walk; then the timer moves on to the next
event. A key without events has no state. Rows later than the watermark are dropped by Spark; over the others the bursts are
those of the batch, whatever the order in which lines came.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylog.config import AnalyzerConfig, BruteForceConfig, PasswordSprayConfig, block
from quarrylog.operators import detectors
from quarrylog.streaming.state import event_time, micros, use_rocksdb

EVENT = "t long, line_no long, source string, value string"


def walk(events: list[tuple], threshold: int, window: int, until: int, distinct: bool) -> tuple[list[tuple], list[tuple]]:
    """Bursts (t, line_no, n, end, seen, members) whose window ends by ``until``, and the events that are left; events sorted."""
    held: deque = deque()
    values: Counter = Counter()
    out: list[tuple] = []
    rest = deque(events)
    while held or (rest and rest[0][0] + window <= until):
        if not held:
            held.append(rest.popleft())
            values[held[-1][3]] += 1
        if held[0][0] + window > until:
            break
        while rest and rest[0][0] - held[0][0] <= window:
            held.append(rest.popleft())
            values[held[-1][3]] += 1
        n = len(values) if distinct else len(held)
        if n >= threshold:
            out.append((held[0][0], held[0][1], n, held[-1][0], sorted({e[2] for e in held if e[2]}), sorted(values) if distinct else None))
            held.clear(), values.clear()
        else:
            gone = held.popleft()[3]
            values[gone] -= 1
            if not values[gone]:
                del values[gone]
    return out, [*held, *rest]


class _Bursts(StatefulProcessor):
    def __init__(self, keys: list[str], threshold: int, window: int, distinct: bool) -> None:
        self.keys, self.threshold, self.window, self.distinct = keys, threshold, window, distinct

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, first: int) -> None:
        """One timer a key, at the first millisecond by which the first event's window is over."""
        ms = -(-(first + self.window) // 1000)
        old = self.due.get()[0] if self.due.exists() else None
        if old != ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            new = list(pdf[["t", "line_no", "source", "value"]].itertuples(index=False, name=None))
            if new:
                self.events.appendList([(int(t), int(n), s, v) for t, n, s, v in new])
                first = min([e[0] for e in new] + ([] if first is None else [first]))
        if first is not None and (not self.due.exists() or self.due.get()[0] > -(-(first + self.window) // 1000)):
            self._wake(int(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        events = sorted(tuple(e) for e in self.events.get())
        found, rest = walk(events, self.threshold, self.window, timerValues.getCurrentWatermarkInMs() * 1000, self.distinct)
        if rest:
            self.events.put(rest)
            self._wake(rest[0][0])
        else:
            self.events.clear()
        if found:
            yield pd.DataFrame([(*key, *f) for f in found], columns=[*self.keys, "t", "line_no", "n", "end", "seen", "members"])

    def close(self) -> None:
        pass


def stream_bursts(entries: DataFrame, keys: list[str], threshold: int, window_s: int, delay: str = "10 minutes", distinct: str | None = None) -> DataFrame:
    """The columns of ``greedy_bursts`` over a stream with timestamp, line_no and source, in append mode."""
    use_rocksdb(entries.sparkSession)
    df = event_time(entries, delay)
    value = F.col(distinct) if distinct else F.lit("")
    df = df.select(*keys, "event_time", micros().alias("t"), "line_no", F.coalesce("source", F.lit("")).alias("source"), value.alias("value"))
    schema = ", ".join([*[f"{k} string" for k in keys], "t long, line_no long, n int, end long, seen array<string>, members array<string>"])
    found = df.groupBy(*keys).transformWithStateInPandas(_Bursts(keys, threshold, window_s * 1_000_000, bool(distinct)), schema, "append", "eventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(*keys, at("t").alias("timestamp"), "n", "line_no", "members", at("end").alias("end"), "seen")


def brute_force(entries: DataFrame, config: AnalyzerConfig | BruteForceConfig | None = None, delay: str = "10 minutes") -> DataFrame:
    """``detectors.brute_force`` over a stream of entries."""
    c = block(config, BruteForceConfig)
    return detectors.brute_force_alerts(stream_bursts(entries.where(detectors.FAILED), ["username", "ip_address"], c.failed_attempt_threshold, c.window_seconds, delay), c)


def password_spray(entries: DataFrame, config: AnalyzerConfig | PasswordSprayConfig | None = None, delay: str = "10 minutes") -> DataFrame:
    """``detectors.password_spray`` over a stream of entries."""
    c = block(config, PasswordSprayConfig)
    return detectors.password_spray_alerts(stream_bursts(entries.where(detectors.FAILED), ["ip_address"], c.unique_user_threshold, c.window_seconds, delay, "username"), c)
