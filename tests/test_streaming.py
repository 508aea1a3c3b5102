"""Streams of shuffled and late rows against the batch over the rows that the watermark lets through, with a restart from the checkpoint."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, BruteForceConfig, PasswordSprayConfig
from quarrylog.operators import correlation, detectors, parsing
from quarrylog.sources import logs
from quarrylog.streaming import bursts, lines, travel
from quarrylog.streaming.bursts import walk
from quarrylog.streaming.incidents import IncidentStore

T0 = datetime(2026, 3, 1)
ENTRY = "line_no long, timestamp timestamp_ntz, username string, ip_address string, source string, event_type string"
COLUMNS = ["alert_type", "timestamp", "username", "ip_address", "confidence", "risk_score", "line_no", "source", "description", "evidence"]


def arrivals(rng, n, event_type, spread=90):
    """Batches in the order of arrival: rows come up to ``spread`` seconds after their time, a few much later; a last row ends all windows."""
    rows = []
    for k in range(n):
        at = timedelta(seconds=k * 4 + rng.choice([0, 0, 1, 40]))
        rows.append((k, T0 + at, rng.choice(["admin", "amy", "bo", "cy"]), rng.choice(["203.0.113.10", "198.51.100.50", "10.0.0.7"]), rng.choice(["linux", "windows"]), event_type))
    rows.sort(key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, spread) if rng.random() < 0.95 else 5000), r[0]))
    size = n // 6
    return [rows[k : k + size] for k in range(0, n, size)] + [[(10**6, T0 + timedelta(days=9), "zz", "9.9.9.9", "linux", event_type)]]


def on_time(batches, delay):
    """The rows that Spark lets through: those not behind the watermark by which the batch before had closed its state.

    A batch closes by the latest time of the batches before it, less the delay; at the end of a run an empty batch follows.
    """
    kept, closed, latest = [], datetime.min, datetime.min + delay
    for k, batch in enumerate(batches):
        kept += [r for r in batch if r[1] > closed]
        closed, latest = latest - delay, max([latest, *[r[1] for r in batch]])
        if k == len(batches) // 2 - 1:
            closed = latest - delay
    return kept


class Feed:
    """A folder of files, one for each batch, and a query on it that can be stopped and started again."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0
        os.makedirs(tmp_path / "in")

    def put(self, batch):
        file = self.path / "in" / f"{self.n}.json"
        self.spark.createDataFrame(batch, self.schema).coalesce(1).toPandas().to_json(file, orient="records", lines=True, date_format="iso", date_unit="us")
        os.utime(file, (1_000_000_000 + self.n, 1_000_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))

    def run(self, df, mode="append"):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", str(self.path / "checkpoint")).format("parquet").option("path", str(self.path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return q

    def rows(self, columns):
        return sorted(map(tuple, self.spark.read.parquet(str(self.path / "out")).select(*columns).collect()), key=repr)


def replay(spark, tmp_path, batches, build):
    """The stream's alerts: half of the batches, a restart, then the rest."""
    feed = Feed(spark, tmp_path, ENTRY)
    for batch in batches[: len(batches) // 2]:
        feed.put(batch)
    feed.run(build(feed.stream()))
    for batch in batches[len(batches) // 2 :]:
        feed.put(batch)
    return feed.rows(COLUMNS), feed.run(build(feed.stream()))


@pytest.mark.parametrize("kind", ["brute_force", "password_spray", "impossible_travel"])
def test_alerts_of_a_stream_are_those_of_the_batch(spark, tmp_path, kind):
    rng = random.Random(len(kind))
    batches = arrivals(rng, 240, "LOGIN_SUCCESS" if kind == "impossible_travel" else "LOGIN_FAILED")
    kept = on_time(batches, timedelta(seconds=120))
    assert 0 < sum(map(len, batches)) - len(kept) < 40
    config = AnalyzerConfig(brute_force=BruteForceConfig(failed_attempt_threshold=4), password_spray=PasswordSprayConfig(unique_user_threshold=3))
    batch = spark.createDataFrame(kept, ENTRY)
    if kind == "impossible_travel":
        want = detectors.impossible_travel(batch, logs.places(spark))
        build = lambda s: travel.impossible_travel(s, logs.places(spark), delay="120 seconds").select(*COLUMNS)
    else:
        want = getattr(detectors, kind)(batch, config)
        build = lambda s: getattr(bursts, kind)(s, config, "120 seconds").select(*COLUMNS)
    first, query = replay(spark, tmp_path, batches, build)
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).collect()), key=repr)
    assert found == sorted(map(tuple, want.select(*COLUMNS).collect()), key=repr)
    assert 0 < len(first) < len(found)  # some came before the restart, none twice
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    held = state[-1]["numRowsTotal"]
    assert held <= 4 * 2 + 3  # only the last row and its timer are left, and users' last logins until they expire


def test_walk_decides_only_what_is_over():
    events = [(t, k, "linux", f"u{k % 2}") for k, t in enumerate([0, 1, 2, 10, 11, 12, 30])]
    assert walk(events, 3, 5, 4, False) == ([], events)
    found, rest = walk(events, 3, 5, 16, False)
    assert [(f[0], f[2]) for f in found] == [(0, 3), (10, 3)] and rest == events[6:]
    found, rest = walk(events, 3, 5, 15, True)
    assert found == [] and rest == events[4:]
    assert walk([], 3, 5, 99, True) == ([], [])


LINES = [
    "Jun 26 09:02:{:02d} server sshd[1014]: Failed password for admin from 203.0.113.10 port 22 ssh2",
    '172.16.1.11 - - [26/Jun/2026:09:03:{:02d} +0000] "GET /p?id=1+UNION+SELECT+x HTTP/1.1" 200 342',
    "2026-06-26T09:00:{:02d} EVENT_ID=4624 USER=bob IP=10.0.0.16 MESSAGE=ok",
    "nothing known {}",
    "",
]


def test_lines_of_a_folder_with_running_counts(spark, tmp_path):
    os.makedirs(tmp_path / "logs")
    texts = [LINES[k % 5].format(k % 60) for k in range(200)]
    for k in range(4):
        (tmp_path / "logs" / f"{k}.log").write_text("\n".join(texts[50 * k : 50 * k + 50]))
    stream = lines.read_lines(spark, str(tmp_path / "logs"), 1)

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return spark.table(name)

    stats = run(lines.running_parse_stats(parsing.parse(stream)), "stats", "complete")
    batch = parsing.parse(logs.read_lines(spark, str(tmp_path / "logs")))
    want = batch.groupBy(F.coalesce("source", F.lit("")), "outcome").count()
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, want.collect()))
    found = lines.entries(stream)
    counts = run(lines.running_counts(found, "10 minutes", "1 hour"), "counts", "update")
    last = counts.groupBy("source", "event_type").agg(F.max("n"), F.max("users"), F.max("ips"))
    assert sorted(map(tuple, last.collect())) == [("apache", "HTTP_REQUEST", 40, 0, 1), ("linux", "LOGIN_FAILED", 40, 1, 1), ("windows", "LOGIN_SUCCESS", 40, 1, 1)]
    alerts = run(lines.web_alerts(found, "1 hour"), "alerts", "append")
    entries = batch.where("outcome = 'parsed'").withColumnRenamed("value", "raw_message").drop("outcome")
    whole = correlation.deduplicate(detectors.web_alerts(entries))
    assert sorted(r["alert_id"] for r in alerts.collect()) == sorted(r["alert_id"] for r in whole.collect())
    per_type = run(lines.running_alert_counts(detectors.web_alerts(found)), "per_type", "complete")
    assert [tuple(r) for r in per_type.collect()] == [("SQL_INJECTION", "CRITICAL", 40)]


def test_incidents_of_any_batches_are_those_of_all_alerts(spark, tmp_path):
    rng = random.Random(3)
    kinds = [("BRUTE_FORCE", "HIGH"), ("XSS", "LOW"), ("SQL_INJECTION", "CRITICAL")]
    rows = [(*rng.choice(kinds), T0 + timedelta(seconds=rng.randrange(9000)), rng.choice(["admin", "amy,bo", "cy", "-"]), rng.choice(["1.1.1.1", "2.2.2.2", "", "3.3.3.3"]), rng.random(), 50, k, "linux", "", str(k)) for k in range(70)]
    schema = "alert_type string, severity string, timestamp timestamp_ntz, username string, ip_address string, confidence double, risk_score int, line_no long, source string, description string, evidence string"
    whole = correlation.deduplicate(spark.createDataFrame(rows, schema))
    members = sorted(map(tuple, correlation.memberships(whole).collect()))
    scored = correlation.incidents(whole)
    want = sorted(map(repr, map(tuple, scored.collect())))
    assert 5 < len(want) < 60
    store = IncidentStore(spark, str(tmp_path / "store"))
    assert store.incidents() is None
    parts = [rows[:50], rows[50:] + rows[:5]]  # repeated alerts change nothing
    for k, part in enumerate(parts):
        store.add(spark.createDataFrame(part, schema), k)
    store.add(spark.createDataFrame(parts[1], schema), 1)  # once more, as after a failure
    assert sorted(map(tuple, store.memberships().collect())) == members
    found = store.incidents().select(*scored.columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == want
    assert spark.read.parquet(str(tmp_path / "store/incidents/batch=1")).count() < len(want)  # only what the batch touched
