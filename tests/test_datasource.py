"""The data source gives the entries of parse_logs, and reads less where filters leave less to find."""

import io
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrylog.exceptions import LogFileError
from quarrylog.operators.parsing import parse_logs
from quarrylog.queries import log_lines
from quarrylog.sources import datasource
from quarrylog.sources.logs import from_lines, read_lines

SF = "/root/testdata/sf0.001"


def odd_lines(n, seed=3):
    """Lines that nearly are entries: pieces swapped for odd ones."""
    rng = random.Random(seed)
    pick = lambda usual, *odd: usual if rng.random() < 0.8 else rng.choice(odd)
    out = []
    for _ in range(n):
        gap = lambda: pick(" ", "  ", "\t", "\x1c", " ", " ", "")
        ip = pick("10.0.0.7", "1.2.3", "999.1.1.1", "١.2.3.4", "1.2.3.4.5")
        user = pick("ann", "-", "b,c", "\x1fd", "é", "")
        clock = pick("9:01:20", "09:01:60", "24:00:00", "9:1:2", "٩:01:20", "009:01:20")
        day = pick("26", "31", "0", "00007", "6", "99999999999999999999")
        month = pick("Jun", "JUN", "Feb", "June", "Jux", "äbc")
        kind = rng.randrange(4)
        if kind == 0:
            how = pick("Failed password for ", "Accepted password for ", "Failed password for invalid user ", "Accepted  password\tfor ", "failed password for ")
            line = f"{month}{gap()}{day} {clock}{gap()}host {pick('sshd[7]:', 'sshd[٧]:', 'sshd[]:')} {how}{user}{gap()}from {ip} port 4 ssh2"
        elif kind == 1:
            line = f"{month} {day} {clock} host sshd[7]: Invalid{gap()}user {user} from {ip}{pick('', ' port 1', 'x')}"
        elif kind == 2:
            stamp = pick("2026-06-26T09:00:25", "2026-06-31T09:00:25", "2026-06-26T09:00:25.1234567", "2026-06-26 09:00:25", "2026-06-26T09:00:25.5", "2026-6-26T09:00:25")
            line = f"{stamp}{gap()}EVENT_ID={pick('4624', '4625', '4634', '')} USER={user} IP={ip} MESSAGE=\"ok\""
        else:
            line = f'{ip} - {user}{gap()}[{day}/{month}/2026:{clock}{gap()}{pick("+0000", "Z", "-03:30", "+0060", "")}] "{pick("GET", "get", "P0ST")} {pick("/a?q=%3C", "/b c", "")} HTTP/1.1" {pick("200", "404", "٢٠٠", "20")} 5'
        out.append(pick("", " ", "﻿", " ﻿") + line + pick("", " ", "\x1c", " "))
    return out


def test_entries_of_odd_lines(spark):
    """The reader's own parsing against the column expressions."""
    lines = [*odd_lines(6000), "", " ", "what is this"]
    want = {r["line_no"]: tuple(r[c] for c in datasource.TYPES)[1:] for r in parse_logs(from_lines(spark, lines), 2024).collect()}
    got = {}
    for k, raw in enumerate(lines):
        line = raw.strip().lstrip("﻿")
        source = datasource.claimed_by(line)
        entry = source and datasource.entry_of(line, source, 2024)
        if entry:
            got[k] = entry
    assert len(want) > 1000 and {e[1] for e in got.values()} == {"linux", "windows", "apache"}
    assert [(k, lines[k], got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)] == []


def test_lines_between():
    """Any cut of a file gives each line once, whatever its ends; lines are longer than what is read at once, too."""
    rng = random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice(["a", "bc", "\n", "\r", "\r\n", "\n\n"]) for _ in range(rng.randrange(30))).encode()
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(6)))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in datasource.lines_between(io.BytesIO(data), a, b)]
        assert [p for _, p in got] == data.splitlines(keepends=True)
        assert all(data[at : at + len(p)] == p for at, p in got)


def test_lines_longer_than_a_read(monkeypatch):
    monkeypatch.setattr(datasource, "CHUNK", 4)
    data = b"x" * 1000 + b"\r\n" + b"y" * 37 + b"\r" + b"z\n\n" + b"w" * 9
    for step in (1, 2, 5, 999, 1001, 5000):
        got = [p for a in range(0, len(data), step) for _, p in datasource.lines_between(io.BytesIO(data), a, min(a + step, len(data)))]
        assert got == data.splitlines(keepends=True)


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Two files in a folder with a space, lines in order of time, blank lines between; ranges of 20,000 bytes."""
    folder = tmp_path_factory.mktemp("with space") / "all logs"
    folder.mkdir()
    lines = [r["value"] or "" for r in log_lines(spark, SF).orderBy("line_no").collect()]
    half = len(lines) // 2
    (folder / "a 1.log").write_bytes("\r\n".join(lines[:half]).encode())
    (folder / "b%20.log").write_bytes("\n\n".join(lines[half:]).encode() + b"\n")
    (folder / "_hidden").write_text("Jun 26 09:01:20 h sshd[1]: Invalid user x from 1.2.3.4")
    (folder / "empty.log").touch()
    datasource.register(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    index = str(folder.parent / "the index")
    datasource.index_logs(spark, str(folder), index, 2024)
    yield str(folder), index
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def source(spark, path, **options):
    return spark.read.format("quarrylog").options(year=2024, **options).load(path)


def same(a, b):
    b = b.select(a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_same_rows(spark, logs):
    folder, index = logs
    want = parse_logs(read_lines(spark, folder), 2024)
    same(source(spark, folder, index=index), want)
    for block in (64, 5000, 1 << 26):
        got = source(spark, folder, block=block)
        same(got.drop("line_no"), want.drop("line_no"))
    assert [r["raw_message"] for r in got.orderBy("line_no").collect()] == [r["raw_message"] for r in want.orderBy("line_no").collect()]
    same(source(spark, f"{folder}/a 1.log").drop("line_no"), parse_logs(read_lines(spark, f"{folder}/a 1.log"), 2024).drop("line_no"))


def test_filters_are_pushed_and_read_less(spark, logs):
    folder, index = logs
    want = parse_logs(read_lines(spark, folder), 2024).cache()
    low, high = want.select(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), [0.4, 0.5])).first()[0]
    at = [datetime.fromisoformat(spark.sql(f"SELECT string(timestamp_micros({x}))").first()[0]) for x in (low, high)]
    tests = [
        f"timestamp >= timestamp_ntz'{at[0]}' AND timestamp < timestamp_ntz'{at[1]}'",
        f"timestamp > timestamp_ntz'{at[1]}' AND source = 'linux'",
        f"timestamp <= timestamp_ntz'{at[0]}' AND source IN ('apache', 'windows') AND username <> 'admin'",
        f"timestamp = timestamp_ntz'{at[0]}'",
        f"source = 'linux' OR timestamp < timestamp_ntz'{at[0]}'",
        f"source > 'b' AND source IS NOT NULL AND timestamp IN (timestamp_ntz'{at[0]}', timestamp_ntz'{at[1]}')",
    ]
    for where in tests:
        same(source(spark, folder, index=index).where(where), want.where(where))
        same(source(spark, folder).where(where).drop("line_no"), want.where(where).drop("line_no"))
    whole = source(spark, folder, index=index).rdd.getNumPartitions()
    part = source(spark, folder, index=index).where(tests[0])
    assert part.rdd.getNumPartitions() * 2 < whole
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "FilterExec" not in plan and "Filter (" not in plan
    assert source(spark, folder, index=index).where("timestamp > timestamp_ntz'2100-01-01 00:00:00'").count() == 0
    assert source(spark, folder, index=index).where("source = 'other'").count() == 0
    want.unpersist()


def test_ranges_read(logs):
    """Bytes that the ranges cover, before and after a filter on time."""
    folder, index = logs
    reader = lambda: datasource.LogReader({"path": folder, "index": index})
    every, some = reader(), reader()
    left = list(some.pushFilters([datasource.GreaterThan(("timestamp",), datetime(2024, 1, 28)), datasource.EqualTo(("username",), "admin"), datasource.EqualTo(("source",), None)]))
    assert [f.attribute for f in left] == [("username",), ("source",)]
    size = lambda r: sum(p.stop - p.start for p in r.partitions())
    assert 0 < size(some) * 4 < size(every)


def test_sql_and_errors(spark, logs, tmp_path):
    folder, index = logs
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW own_logs USING quarrylog OPTIONS (path '{folder}', index '{index}', year '2024')")
    want = parse_logs(read_lines(spark, folder), 2024).groupBy("source").count()
    same(spark.sql("SELECT source, count(*) AS count FROM own_logs GROUP BY source"), want)
    spark.catalog.dropTempView("own_logs")
    with pytest.raises(LogFileError, match="not found"):
        datasource.LogReader({"path": str(tmp_path / "none")}).partitions()
    with pytest.raises(LogFileError, match="run index_logs again"):
        datasource.LogReader({"path": f"{folder}/a 1.log", "index": index}).partitions()
    (tmp_path / "x.log.gz").touch()
    with pytest.raises(LogFileError, match="compressed"):
        datasource.LogReader({"path": str(tmp_path)}).partitions()
    with pytest.raises(LogFileError):
        datasource.LogReader({})
    (tmp_path / "x.log.gz").rename(tmp_path / "x.log")
    assert source(spark, str(tmp_path)).count() == 0
