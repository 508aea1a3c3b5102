"""Hot keys: bursts inside one island walked in blocks, rows before and latest values over ranges, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig
from quarrylog.operators import correlation, detectors
from quarrylog.operators.bursts import greedy_bursts
from quarrylog.plans import ordered as ordered_rows

BASE = datetime(2026, 1, 1)
SCHEMA = "ip string, user string, timestamp timestamp_ntz, line_no long, source string"


def plain(rows, threshold, window, distinct):
    """The two-pointer loop over each key's events: (key, start, line, n, end, sources, members)."""
    out = []
    for key in sorted({r[0] for r in rows}):
        events = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3]))
        left = 0
        while left < len(events):
            right = left
            while right + 1 < len(events) and (events[right + 1][2] - events[left][2]).total_seconds() <= window:
                right += 1
            some = events[left : right + 1]
            users = sorted({r[1] for r in some})
            n = len(users) if distinct else len(some)
            if n >= threshold:
                out.append((key, some[0][2], some[0][3], n, some[-1][2], sorted({r[4] for r in some if r[4]}), users if distinct else None))
                left = right + 1
            else:
                left += 1
    return out


def events(seed, n, users, gaps, keys=("a",)):
    rng = random.Random(seed)
    rows = []
    for key in keys:
        t = BASE
        for _ in range(n):
            t += timedelta(seconds=rng.choice(gaps))
            rows.append((key, f"u{min(int(rng.expovariate(1) * users / 3), users)}", t, len(rows), rng.choice(["linux", "windows", ""])))
    rng.shuffle(rows)
    return rows


def bursts(spark, rows, threshold, window, distinct, limit, size):
    found = greedy_bursts(spark.createDataFrame(rows, SCHEMA), ["ip"], threshold, window, "user" if distinct else None, limit, size)
    return sorted(tuple(r[c] for c in ("ip", "timestamp", "line_no", "n", "end", "seen", "members")) for r in found.collect())


@pytest.mark.parametrize("distinct,seed,n,users,gaps,threshold,window,size", [
    (False, 1, 90, 6, [0, 0, 1, 3, 9, 30], 4, 10, 12),  # blocks hold several windows, and islands are of many sizes
    (True, 2, 110, 3, [0, 0, 0, 0, 1], 3, 6, 8),  # windows hold several blocks
])
def test_blocks_of_an_island(spark, seed, n, users, gaps, threshold, window, size, distinct):
    rows = events(seed, n, users, gaps, ("a", "b"))
    want = plain(rows, threshold, window, distinct)
    assert bursts(spark, rows, threshold, window, distinct, 10, size) == want and len(want) > 3
    assert bursts(spark, rows, threshold, window, distinct, 10**9, size) == want


def test_one_island_of_many_events(spark):
    """Without a pause, of one address; only counts are compared here, with a loop over the times."""
    n, window = 100_000, 120
    df = spark.range(n).select(F.lit("x").alias("ip"), F.concat(F.lit("u"), (F.pmod(F.xxhash64("id"), F.lit(5000)) * (F.col("id") % 3000 > 1000).cast("long")).cast("string")).alias("user"), F.timestamp_millis(F.col("id") * 50 + F.pmod(F.hash("id"), F.lit(400))).cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("line_no"), F.lit("linux").alias("source"))
    rows = sorted((r["timestamp"], r["line_no"], r["user"]) for r in df.collect())
    for distinct, threshold in ((False, 5), (True, 40)):
        want, left, right = [], 0, 0
        seen: dict = {}
        while left < n:
            while right < n and (rows[right][0] - rows[left][0]).total_seconds() <= window:
                seen[rows[right][2]] = seen.get(rows[right][2], 0) + 1
                right += 1
            if (len(seen) if distinct else right - left) >= threshold:
                want.append((rows[left][0], rows[left][1], len(seen) if distinct else right - left))
                left, seen = right, {}
            else:
                seen[rows[left][2]] -= 1
                if not seen[rows[left][2]]:
                    del seen[rows[left][2]]
                left += 1
        found = greedy_bursts(df, ["ip"], threshold, window, "user" if distinct else None, 10_000, 14_000)
        assert sorted((r["timestamp"], r["line_no"], r["n"]) for r in found.collect()) == want and len(want) > 30


def test_row_before_and_latest_value(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randrange(50), k, rng.choice([None, None, None, k])) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, t long, id long, v long")
    w = Window.partitionBy("key").orderBy("t", "id")
    want = df.select("id", F.lag("t").over(w), F.lag("v").over(w), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for limit, size in ((40, 7), (10**6, 7), (0, 3)):
        o = ordered_rows.ordered(df, ["key"], ["t", "id"], limit, size)
        assert o.split == (limit < 400)
        got = o.previous("p", "t", "v").latest("l", F.col("v")).rows
        if o.split:
            assert got.where("block > 0").groupBy("block").count().agg(F.max("count")).first()[0] < 40  # no key's rows together
        assert sorted(map(repr, map(tuple, got.select("id", "p.t", "p.v", "l").collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_detectors_and_incidents_of_hot_keys_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [("admin" if rng.random() < 0.9 else f"u{k % 5}", rng.choice(["203.0.113.10", "198.51.100.50", "10.0.0.7"]), BASE + timedelta(seconds=k * rng.choice([1, 100, 400])), k) for k in range(300)]
    logins = spark.createDataFrame(base, "username string, ip_address string, timestamp timestamp_ntz, line_no long").select("*", F.lit("LOGIN_SUCCESS").alias("event_type"), F.lit("linux").alias("source"))
    places = spark.createDataFrame([("203.0.113.10", "Mumbai", 19.0, 72.8, "IN"), ("198.51.100.50", "New York", 40.7, -74.0, "US")], "ip string, city string, lat double, lon double, country string")
    alerts = logins.select(F.lit("X").alias("alert_type"), F.lit("LOW").alias("severity"), "timestamp", "username", "ip_address", F.lit(0.5).alias("confidence"), F.lit(1).alias("risk_score"), "line_no", "source", F.lit("").alias("description"), F.lit("").alias("evidence"))
    alerts = correlation.deduplicate(alerts.where("ip_address <> '10.0.0.7'"))

    def both():
        travel = detectors.impossible_travel(logins, places).select("line_no", "confidence", "evidence")
        return sorted(map(tuple, travel.collect())), sorted(map(tuple, correlation.memberships(alerts, AnalyzerConfig()).collect()))

    want = both()
    monkeypatch.setattr(ordered_rows.ordered, "__defaults__", (50, 20, None))
    assert both() == want and len(want[0]) > 20
