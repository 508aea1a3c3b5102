"""Impossible travel over a stream: logins are put in order behind the watermark and compared with the user's last one.

The state of a user is the last login that the watermark has passed and the list of later ones. As no two places lie further apart
than half the earth's girth, a last login older than that distance takes at the highest plausible speed can't
give an alert any more: a timer removes it, so the state holds the users of such a span, not all there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, pi

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylog.config import AnalyzerConfig, ImpossibleTravelConfig, block
from quarrylog.operators import detectors
from quarrylog.streaming.state import event_time, micros, use_rocksdb

#: Kilometres from a place to the one opposite.
FARTHEST = pi * 6371.0
PLACE = ("ip_address", "city", "country", "lat", "lon")
LOGIN = "t long, line_no long, source string, ip_address string, city string, country string, lat double, lon double"
NAMES = [x.split()[0] for x in LOGIN.split(", ")]


def _plain(row: tuple) -> tuple:
    """Without NaN and numpy types."""
    return tuple(None if x is None or x != x else x for x in (int(row[0]), int(row[1]), *row[2:6], *(None if pd.isna(x) else float(x) for x in row[6:8])))


class _Pairs(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", LOGIN)
        self.last = handle.getValueState("last", LOGIN)
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if old != ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [_plain(r) for pdf in rows for r in pdf[NAMES].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            ms = -(-min(r[0] for r in new) // 1000)
            if not self.due.exists() or self.due.get()[0] > ms:
                self._wake(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in waiting if r[0] <= now * 1000]
        rest = waiting[len(ready) :]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in ready:
            if before is not None:
                out.append((key[0], *r, *before))
            before = r
        if ready:
            self.last.update(before)
        if rest:
            self.waiting.put(rest)
            self._wake(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
            if before is not None:
                if (until := -(-before[0] // 1000) + self.keep_ms) <= now:
                    self.last.clear()
                else:
                    self._wake(until)
        if out:
            yield pd.DataFrame(out, columns=["username", *NAMES, *[f"p_{n}" for n in NAMES]])

    def close(self) -> None:
        pass


def impossible_travel(entries: DataFrame, places: DataFrame, config: AnalyzerConfig | ImpossibleTravelConfig | None = None, delay: str = "10 minutes") -> DataFrame:
    """``detectors.impossible_travel`` over a stream of entries, in append mode; ``places`` is a table."""
    use_rocksdb(entries.sparkSession)
    c = block(config, ImpossibleTravelConfig)
    most = float(c.max_plausible_speed_kmh)
    keep = 1000 * ceil(3600 * FARTHEST / most) if most > 0 else 2**53
    df = event_time(detectors.logins_at(entries, places), delay)
    df = df.select("username", "event_time", micros().alias("t"), "line_no", "source", *PLACE)
    pair = ", ".join(["username string", LOGIN, *[f"p_{x}" for x in LOGIN.split(", ")]])
    found = df.groupBy("username").transformWithStateInPandas(_Pairs(keep), pair, "append", "eventTime")
    before = F.struct(*[F.col(f"p_{n}").alias(n) for n in ("ip_address", "t", "city", "country", "lat", "lon")])
    found = found.withColumns({"p": before, "timestamp": F.timestamp_micros("t").cast("timestamp_ntz")})
    return detectors.travel_alerts(found, most)
