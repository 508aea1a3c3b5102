"""Detectors and components against plain loops and hand-made cases."""

import html
import random
from datetime import datetime, timedelta
from html.entities import html5

from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, BruteForceConfig, CorrelationConfig, InsiderThreatConfig, PasswordSprayConfig, RiskScoringConfig
from quarrylog.functions import text
from quarrylog.functions.text import normalize_line, normalize_request
from quarrylog.operators import anomaly, correlation, detectors, parsing
from quarrylog.operators.components import connected_components

T0 = datetime(2026, 6, 26, 9)
ENTRY = "line_no long, timestamp timestamp_ntz, username string, ip_address string, status string, source string, event_type string, request string, status_code int"


def entry(n, seconds, user="admin", ip="203.0.113.10", kind="LOGIN_FAILED", request=""):
    return (n, T0 + timedelta(seconds=seconds), user, ip, "FAILED", "linux", kind, request, None)


def test_bursts_as_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [entry(n, rng.randrange(300), rng.choice("abc"), rng.choice(["1.1.1.1", "2.2.2.2"])) for n in range(150)]
    want = []
    for key in sorted({(r[2], r[3]) for r in rows}):
        ts = sorted(r[1] for r in rows if (r[2], r[3]) == key)
        left = 0
        while left < len(ts):
            right = left
            while right + 1 < len(ts) and ts[right + 1] - ts[left] <= timedelta(seconds=20):
                right += 1
            if right - left + 1 >= 4:
                want.append((*key, ts[left], right - left + 1))
                left = right + 1
            else:
                left += 1
    got = detectors.brute_force(spark.createDataFrame(rows, ENTRY), BruteForceConfig(failed_attempt_threshold=4, window_seconds=20)).select("username", "ip_address", "timestamp", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_spray_names_its_users(spark):
    rows = [entry(n, 5 * n, u) for n, u in enumerate(["eve", "bob", "eve", "amy", "dan"])]
    got = detectors.password_spray(spark.createDataFrame(rows, ENTRY), PasswordSprayConfig(unique_user_threshold=4, window_seconds=60)).collect()
    assert [(r["username"], r["n"], r["risk_score"]) for r in got] == [("amy,bob,dan,eve", 4, 70)]


def test_parse_counts(spark):
    lines = [
        "Mar  6 07:11:20 web3 sshd[88]: Accepted password for olga from 10.20.0.18 port 40945 ssh2",
        "Mar 26 07:11:20 web3 sshd[88]: Invalid user piet from 10.20.0.1",
        "Feb 30 07:11:20 web3 sshd[1]: Failed password for x from 10.20.0.1 port 1",
        '2026-03-26T07:10:25 EVENT_ID=4624 USER=piet IP=10.20.0.16 NOTE="in"',
        '10.30.1.73 - - [26/Mar/2026:07:11:14 +0530] "GET /goods HTTP/1.1" 200 342',
        '10.30.1.73 - - [26/Mar/2026:07:11:14 +0000] "GET /?EVENT_ID=1 HTTP/1.1" 200 342',
        "hello",
        "1.2.3.4 - - [garbage",
        '1.2.3.4 - - [26/Mar/2026:07:11:14 +0000] "get /x HTTP/1.1" 200 1',
        '1.2.3.4 - - [26/Mar/2026:07:11:14 +0000] "GET  HTTP/1.1" 200 1',
        '1.2.3.4 - - [26/Mar/2026:07:11:14 Z] "GET /a b HTTP/1.1" 2000 1',
        '1.2.3.4 - - [26/Mar/2026:07:11:14] "GET /x HTTP/1.1" 200 1',
        "2026-03-26T07:10:25 EVENT_ID=4700 USER=piet IP=10.20.0.16",
        None,
        "",
    ]
    df = parsing.parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), 2026)
    got = {r["line_no"]: r for r in df.collect()}
    want = "parsed parsed malformed parsed parsed malformed unsupported unsupported malformed malformed parsed malformed malformed unsupported unsupported"
    assert [got[k]["outcome"] for k in range(len(lines))] == want.split()
    assert got[0]["timestamp"] == datetime(2026, 3, 6, 7, 11, 20) and got[4]["timestamp"] == datetime(2026, 3, 26, 7, 11, 14)
    assert got[1]["username"] == "piet" and got[1]["event_type"] == "LOGIN_FAILED"
    assert (got[10]["status_code"], got[10]["path"], got[10]["method"], got[10]["username"]) == (200, "/a b", "GET", "-")
    stats = parsing.parse_stats(df).first()
    assert (stats["total_lines"], stats["parsed_lines"], stats["malformed_lines"], stats["unsupported_lines"]) == (15, 5, 6, 4)
    assert parsing.parse_stats(df.limit(0)).first()["total_lines"] == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("﻿ x  ", "/a?q=%253Cscript%253E+100%")], "a string, b string")
    assert tuple(df.select(normalize_line(F.col("a")), normalize_request(F.col("b"))).first()) == (" x", "/a?q=<script> 100%")
    hidden = ["/a?x=&#60;script&#62;", "JAVASCRIPT&colon;alert(1)", "a&ltb", "a&b=2", "%26lt;&#x3C;&#99999999;", None]
    df = spark.createDataFrame([(x,) for x in hidden], "b string")
    assert [r[0] for r in df.select(normalize_request(F.col("b"))).collect()] == ["/a?x=<script>", "javascript:alert(1)", "a<b", "a&b=2", "<<\ufffd", ""]


def test_travel_and_incidents(spark):
    from quarrylog.sources.logs import places

    rows = [entry(0, 0, "eve", "203.0.113.10", "LOGIN_SUCCESS"), entry(1, 300, "eve", "198.51.100.50", "LOGIN_SUCCESS")]
    travel = detectors.impossible_travel(spark.createDataFrame(rows, ENTRY), places(spark)).collect()
    assert [(r["confidence"], r["risk_score"]) for r in travel] == [(0.95, 90)]
    flood = [entry(n, 6 * n) for n in range(5)]
    alerts = correlation.deduplicate(detectors.brute_force(spark.createDataFrame(flood, ENTRY)))
    got = correlation.incidents(alerts).collect()
    assert [(r["incident_type"], r["severity"], r["alert_count"], r["risk_score"]) for r in got] == [("BRUTE_FORCE", "HIGH", 1, 78)]


def test_components_as_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_alerts_carry_evidence_and_differ_by_it(spark):
    requests = ["/a?q=1 union select x", "/b?q=' or '1'='1' and 1=1", "/a?q=1 union select x"]
    rows = [entry(n, 0, "-", "9.9.9.9", "HTTP_REQUEST", q) for n, q in enumerate(requests)]
    alerts = detectors.web_alerts(spark.createDataFrame(rows, ENTRY), [detectors.SQLI_BANK])
    got = {r["line_no"]: r for r in correlation.deduplicate(alerts).collect()}
    assert sorted(got) == [0, 1] and len({r["alert_id"] for r in got.values()}) == 2
    assert '"pattern":"UNION SELECT"' in got[0]["evidence"] and "AND 1=1" in got[1]["evidence"]
    flood = detectors.brute_force(spark.createDataFrame([entry(n, 6 * n) for n in range(5)], ENTRY)).first()
    assert '"attempts":5' in flood["evidence"] and '"end_time":"2026-06-26 09:00:24"' in flood["evidence"] and flood["source"] == "linux"


def test_flood_from_one_address_is_cut_at_pauses(spark):
    """A million failures of one address, with a pause after each thousand: spans of 121 seconds burst, as in a plain loop over one span."""
    df = spark.range(1_000_000).select(F.col("id").alias("line_no"), F.timestamp_micros((F.col("id") + F.floor(F.col("id") / 1000) * 500) * 1_000_000).cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("u"), F.col("id") % 3).alias("username"), F.lit("9.9.9.9").alias("ip_address"), F.lit("linux").alias("source"), F.lit("LOGIN_FAILED").alias("event_type"))
    spray = detectors.password_spray(df, PasswordSprayConfig(unique_user_threshold=3))
    got = spray.groupBy("n", "username").count().collect()
    assert [(r["n"], r["username"], r["count"]) for r in got] == [(3, "u0,u1,u2", 9 * 1000)]
    force = detectors.greedy_bursts(df, ["ip_address"], 5, 120).groupBy("n").count().collect()
    assert sorted((r["n"], r["count"]) for r in force) == [(32, 1000), (121, 8000)]


def test_insider_evidence_and_settings(spark):
    rows = [entry(n, n, "admin", "1.1.1.1" if n < 15 else f"2.2.2.{n % 2}", "LOGIN_SUCCESS") for n in range(20)] + [entry(99, 99, "-", "3.3.3.3")]
    df = spark.createDataFrame(rows, ENTRY)
    (got,) = detectors.insider_threat(df, InsiderThreatConfig(unusual_hour_start=8, unusual_hour_end=10)).collect()
    assert got["majority_ip"] == "1.1.1.1" and got["unusual_ips"] == ["2.2.2.0", "2.2.2.1"] and got["risk_score"] == 85
    assert '"majority_ip":"1.1.1.1","unusual_ips":["2.2.2.0","2.2.2.1"]' in got["evidence"]
    assert detectors.insider_scores(df, InsiderThreatConfig(unusual_hour_start=22, unusual_hour_end=9)).first()["unusual_hours"] == 0
    assert detectors.insider_threat(df, InsiderThreatConfig(alert_score_threshold=90)).count() == 0


def test_web_alerts_read_the_path_where_no_request_is(spark):
    df = spark.createDataFrame([entry(1, 0, "", "1.1.1.1", "HTTP_REQUEST")], ENTRY).withColumn("path", F.lit("/x?q=<svg onload=1>"))
    (got,) = detectors.web_alerts(df).collect()
    assert (got["alert_type"], got["pattern"], got["username"]) == ("XSS", "onload=", "-") and '["onload=","<svg"]' in got["evidence"]


def test_incidents_hold_their_lists_and_settings(spark):
    columns = "alert_type string, severity string, timestamp timestamp_ntz, username string, ip_address string, confidence double, risk_score int, line_no long, source string, description string, evidence string"
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        ("XSS", "high", at(10), "-", " 1.1.1.1 ", 0.9, 80, 3, "apache", "", "{}"),
        ("PASSWORD_SPRAY", "HIGH", at(0), "Root,amy", "1.1.1.1", 0.9, 80, 1, "linux", "", "{}"),
        ("BRUTE_FORCE", "odd", at(200), "amy", "2.2.2.2", 0.0, 80, 2, "linux", "", "{}"),
        ("BRUTE_FORCE", "odd", at(9000), "amy", "2.2.2.2", 0.1, 80, 9, "linux", "", "{}"),
    ]
    alerts = correlation.deduplicate(spark.createDataFrame(rows + rows[:1], columns))
    got = correlation.by_risk(correlation.incidents(alerts)).collect()
    assert [(r["incident_type"], r["severity"], r["alert_count"], r["risk_score"]) for r in got] == [("CORRELATED_ACTIVITY", "HIGH", 3, 98), ("BRUTE_FORCE", "MEDIUM", 1, 40)]
    first = got[0]
    assert first["source_ips"] == ["1.1.1.1", "2.2.2.2"] and first["usernames"] == ["amy", "root"] and len(first["alert_ids"]) == 3
    assert first["attack_chain"] == ["PASSWORD_SPRAY", "XSS", "BRUTE_FORCE"] and first["alert_types"] == sorted(first["attack_chain"])
    assert '"base_score":70,"multiple_alert_bonus":10,"multiple_attack_type_bonus":10,"privileged_user_bonus":5,"confidence_bonus":3,"average_alert_confidence":0.9,"final_score":98' in first["risk_breakdown"]
    members = {(r["alert_id"], r["incident_id"]) for r in correlation.memberships(alerts).collect()}
    assert {(a, r["incident_id"]) for r in got for a in r["alert_ids"]} == members
    alone = correlation.correlate(alerts, CorrelationConfig(enabled=False))
    assert alone.count() == 4 and {r["risk_score"] for r in correlation.score(alone, RiskScoringConfig(enabled=False)).collect()} == {70, 40}
    by_user = correlation.correlate(alerts, CorrelationConfig(correlate_by_ip=False)).collect()
    assert sorted(r["alert_count"] for r in by_user) == [1, 1, 2]
    assert correlation.incidents(alerts.limit(0)).count() == 0
    for config in (None, AnalyzerConfig(risk_scoring=RiskScoringConfig(privileged_users=("amy",))), AnalyzerConfig(risk_scoring=RiskScoringConfig(enabled=False)), AnalyzerConfig(correlation=CorrelationConfig(enabled=False))):
        large, usual = correlation.large_incidents(alerts, config), correlation.incidents(alerts, config)
        shared = [c for c in usual.columns if c not in ("source_ips", "usernames", "alert_ids")]
        sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("source_ips", "usernames")]
        assert {str(r) for r in large.select(*shared, "n_source_ips", "n_usernames").collect()} == {str(r) for r in usual.select(*shared, *sizes).collect()}
    members = correlation.memberships(alerts)
    values = sorted(tuple(r)[1:] for r in correlation.incident_values(alerts, members).where(F.col("incident_id") == first["incident_id"]).collect())
    assert values == [("ip_address", "1.1.1.1"), ("ip_address", "2.2.2.2"), ("username", "amy"), ("username", "root")]
    assert correlation.large_incidents(alerts.limit(0)).count() == 0


def test_large_incidents_keep_no_lists(spark):
    """Of one incident of 200,000 alerts, no row has more than counts; alerts without address and user are incidents of their own."""
    rows = spark.range(200_000).selectExpr(
        "'XSS' as alert_type", "'HIGH' as severity", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as timestamp", "concat('u', id % 101) as username", "if(id % 2 = 0, '1.1.1.1', concat('2.2.', id % 7, '.1')) as ip_address",
        "0.5D as confidence", "80 as risk_score", "id as line_no", "'apache' as source", "'' as description", "cast(id as string) as evidence",
    )
    lone = rows.where("line_no < 2").withColumns({"username": F.lit("-"), "ip_address": F.lit(None).cast("string")})
    alerts = correlation.deduplicate(rows.union(lone))
    found = correlation.large_incidents(alerts)
    got = sorted((r["alert_count"], r["n_source_ips"], r["n_usernames"], r["risk_score"]) for r in found.collect())
    assert got == [(1, 0, 0, 70), (1, 0, 0, 70), (200_000, 8, 101, 85)]
    assert not [f.name for f in found.schema if f.name in ("source_ips", "usernames", "alert_ids")]


def test_html_references_are_undone_as_the_library_does(spark):
    """Every entity with and without its semicolon, all sorts of numbers, and random strings; no Python in the plan."""
    rng = random.Random(1)
    numbers = [*range(200), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000, 10**30, 0x1F600]
    texts = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')}" for n in html5] + [f"&#{n};x" for n in numbers] + [f"&#X{n:x}" for n in numbers]
    texts += ["&#00065;", "&#;", "&#x;", "&#xg", "&", "&&amp;&", "&amp;amp;", "&notit;", "&notin;", "&" + "a" * 40 + ";", ""]
    parts = ["&", "#", "x", ";", "amp", "lt", "notin", "not", "copy", "41", "0", "é", " ", "\n", "<", "😀", "&amp;", "&lt", "frac12", "sup1"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(10_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.html_unescape(F.col("t")).alias("u"))
    assert [(r["t"], r["u"]) for r in df.collect() if r["u"] != html.unescape(r["t"])] == []
    shown = detectors.web_alerts(spark.createDataFrame([entry(1, 0)], ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in shown and "EvalArrow" not in shown and "ArrowEval" not in shown


def test_features_of_addresses_and_users_from_one_scan(spark):
    rng = random.Random(2)
    rows = [(k, T0 + timedelta(hours=k % 30), rng.choice(["amy", "bo", "", "-"]), rng.choice(["1.1.1.1", "2.2.2.2", ""]), "SUCCESS", rng.choice(["linux", "apache", ""]), rng.choice(["LOGIN_FAILED", "LOGIN_SUCCESS", "HTTP_REQUEST"]), rng.choice(["", "/a", "/b", "/c"]), rng.choice([None, 200, 404, 500])) for k in range(200)]
    df = spark.createDataFrame(rows, "line_no long, timestamp timestamp_ntz, username string, ip_address string, status string, source string, event_type string, request string, status_code int")
    found = {(r["entity"], r["entity_id"]): r for r in detectors.entity_features(df).collect()}
    for column, at, none in (("ip_address", 3, {""}), ("username", 2, {"", "-"})):
        for key in {r[at] for r in rows} - none:
            own = [r for r in rows if r[at] == key]
            count = lambda f: float(sum(map(f, own)))
            want = {
                "total": float(len(own)), "failed": count(lambda r: r[6] == "LOGIN_FAILED"), "success": count(lambda r: r[6] == "LOGIN_SUCCESS"), "users": float(len({r[2] for r in own} - {"", "-"})), "ips": float(len({r[3] for r in own} - {""})),
                "paths": float(len({r[7] for r in own} - {""})), "http": count(lambda r: r[6] == "HTTP_REQUEST"), "http_errors": count(lambda r: r[6] == "HTTP_REQUEST" and (r[8] or 0) >= 400), "auth": count(lambda r: r[6] != "HTTP_REQUEST"),
                "unusual_hours": count(lambda r: r[1].hour < 5), "sources": float(len({r[5] for r in own})), "last_seen": max(r[1] for r in own), "seen_sources": sorted({r[5] for r in own} - {""}),
            }
            got = found[column, key].asDict()
            assert {n: got[n] for n in want} == want and got["failed_ratio"] == want["failed"] / want["total"]
    assert len(found) == 4
    df.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/features-test")
    plan = detectors.entity_features(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan


def test_notes_without_peers(spark):
    columns = list(anomaly.NAMES)
    v = dict.fromkeys(columns, 0.0) | {"failed_ratio": 0.5, "failed": 12.0, "users": 5.0, "paths": 99.0, "total": 9.0}
    df = spark.createDataFrame([("ip", "a", [v[c] for c in columns])], "entity_type string, entity_id string, v array<double>")
    assert anomaly.describe(df, with_peers=False).first()["notes"] == ["failed logins: 12", "unique users: 5", "failed login ratio: 0.50"]
    assert anomaly.describe(df).first()["notes"] == ["unique paths: 99", "failed logins: 12", "total events: 9", "unique users: 5"]
