"""Queries over the test tables, by name, with the SQL that must give the same rows.

The tables hold no logs, so lines and entries are derived from ``events`` by SQL that both engines run; as its events of one
user lie hours apart, the burst detectors run with windows of days.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, AnomalyConfig, BruteForceConfig, PasswordSprayConfig
from quarrylog.functions import sql
from quarrylog.operators import anomaly, correlation, detectors, parsing
from quarrylog.plans.lineage import cut
from quarrylog.plans.scratch import Scratch
from quarrylog.reporting import attack_type_counts, severity_counts
from quarrylog.service import find_alerts
from quarrylog.sources import datasource
from quarrylog.sources.logs import ENTRIES_SQL, PLACES, log_entries, places
from quarrylog.streaming import bursts as stream_bursts
from quarrylog.streaming import travel as stream_travel
from quarrylog.streaming.state import drained

DAY = 86_400
#: The derived logs have eleven addresses only, so the forest is grown from ten entities on.
FEW = 10
CONFIG = AnalyzerConfig(
    brute_force=BruteForceConfig(failed_attempt_threshold=3, window_seconds=3 * DAY),
    password_spray=PasswordSprayConfig(unique_user_threshold=3, window_seconds=3 * DAY),
    anomaly=AnomalyConfig(minimum_samples=FEW, alert_threshold=60.0),
)
#: The rules alone: the forest's alerts can't be had from SQL.
RULES = replace(CONFIG, anomaly=replace(CONFIG.anomaly, enabled=False))
#: How long the streams wait for late events.
DELAY = "2 days"
#: Lines of all formats, well and badly formed; %L(ts) and the like stand for a formatted time.
LINES_SQL = """SELECT event_id AS line_no, CASE event_id % 16
 WHEN 0 THEN concat(%L(ts), ' host sshd[', CAST(event_id AS STRING), ']: Failed password for invalid user u', CAST(user_id AS STRING), ' from 10.0.0.', CAST(user_id % 200 AS STRING), ' port 22 ssh2')
 WHEN 1 THEN concat(%W(ts), ' EVENT_ID=', CASE event_id % 3 WHEN 0 THEN '4624' WHEN 1 THEN '4625' ELSE '4700' END, ' USER=u', CAST(user_id AS STRING), ' IP=10.0.1.7')
 WHEN 2 THEN concat('10.0.2.9 - - [', %A(ts), ' +0000] "GET /p?id=', CAST(event_id AS STRING), ' HTTP/1.1" 404 12')
 WHEN 3 THEN 'sshd[1]: garbage'
 WHEN 4 THEN concat('   ', %L(ts), '  host  sshd[7]: Accepted password for u', CAST(user_id AS STRING), ' from 10.0.0.1 port 22 ')
 WHEN 5 THEN concat(%L(ts), ' host sshd[7]: Invalid user u', CAST(user_id AS STRING), ' from 10.9.0.1')
 WHEN 6 THEN concat('10.0.2.9 - bob [', %A(ts), ' Z] "POST /a b HTTP/2" 2000 -')
 WHEN 7 THEN '1.2.3.4 - - [garbage'
 WHEN 8 THEN concat('10.0.2.9 - - [', %A(ts), ' +0530] "get /lower HTTP/1.1" 200 1')
 WHEN 9 THEN concat('10.0.2.9 - - [', %A(ts), ' +0000] "GET  HTTP/1.1" 200 1')
 WHEN 10 THEN concat('10.0.2.9 - - [', %A(ts), ' -05:00] "GET /?EVENT_ID=', CAST(event_id AS STRING), ' HTTP/1.1" 200 1')
 WHEN 11 THEN concat('Feb 30 10:00:0', CAST(event_id % 10 AS STRING), ' host sshd[9]: Failed password for x from 10.0.0.1 port 1')
 WHEN 12 THEN concat('10.0.2.9 - - [', %A(ts), '] "GET /nozone HTTP/1.1" 200 1')
 WHEN 13 THEN concat(%W(ts), '.25 EVENT_ID=4624 USER=', CAST(user_id AS STRING), ' IP=300.1.2.3 more')
 WHEN 14 THEN ''
 ELSE 'nothing known' END AS value FROM events"""
_FORMATS = {"L": ("%b %d %H:%M:%S", "MMM dd HH:mm:ss"), "W": ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), "A": ("%d/%b/%Y:%H:%M:%S", "dd/MMM/yyyy:HH:mm:ss")}


def _lines_sql(duckdb: bool) -> str:
    sql = LINES_SQL
    for mark, (theirs, ours) in _FORMATS.items():
        made = f"strftime(ts, '{theirs}')" if duckdb else "date_format(ts, '{}')".format(ours.replace("'", "''"))
        sql = sql.replace(f"%{mark}(ts)", made)
    return sql


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_lines_sql(False).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(log_lines(spark, sf_dir), 2024)


def _alerts(spark: SparkSession, sf_dir: str, config: AnalyzerConfig) -> DataFrame:
    return cut(find_alerts(cut(log_entries(spark, sf_dir)), config))


def _web(spark: SparkSession, sf_dir: str, bank: tuple) -> DataFrame:
    found = detectors.web_alerts(log_entries(spark, sf_dir), [bank])
    names = F.from_json("evidence", "matched_indicators array<string>")["matched_indicators"]
    return found.select("line_no", "pattern", "severity", "username", _six("confidence"), F.col("risk_score").cast("long"), F.array_join(names, "|").alias("indicators"))


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _flat(incidents: DataFrame) -> DataFrame:
    joined = [F.array_join(c, "|").alias(c) for c in ("source_ips", "usernames", "attack_chain", "alert_types")]
    return incidents.select("incident_type", "severity", "first_seen", "last_seen", "alert_count", *joined, F.col("risk_score").cast("long").alias("risk_score"))


def _force(alerts: DataFrame) -> DataFrame:
    return alerts.select("username", "ip_address", "timestamp", "end", "source", F.col("n").cast("long").alias("attempts"), _six("confidence"), F.col("risk_score").cast("long"))


def _spray(alerts: DataFrame) -> DataFrame:
    return alerts.select("ip_address", "timestamp", "end", F.col("username").alias("users"), F.col("n").cast("long").alias("unique_users"), _six("confidence"), F.col("risk_score").cast("long"))


def _pairs(alerts: DataFrame) -> DataFrame:
    return alerts.select("username", "ip_address", "timestamp", "line_no", F.round("km", 3).alias("km"), _six("confidence"), F.col("risk_score").cast("long"))


def _told(alerts: DataFrame, keys: tuple[str, ...], **fields: str) -> DataFrame:
    """Columns of the alerts and the fields of their evidence; lists are joined by bars."""
    e = F.from_json("evidence", ", ".join(f"{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in fields.items()))
    shown = [F.array_join(e[n], "|") if t.startswith("array") else e[n].cast(t) for n, t in fields.items()]
    return alerts.select(*keys, *[c.alias(n) for c, n in zip(shown, fields, strict=True)])


_BURST = {"threshold": "bigint", "window_seconds": "bigint", "start_time": "timestamp_ntz", "end_time": "timestamp_ntz"}
_PLACE = ("username", "line_no")
_BONUSES = ("base_score", "multiple_alert_bonus", "multiple_attack_type_bonus", "repeated_activity_bonus", "privileged_user_bonus", "confidence_bonus")


def _breakdown(incidents: DataFrame) -> DataFrame:
    e = F.from_json("risk_breakdown", ", ".join(f"{n} bigint" for n in (*_BONUSES, "final_score")) + ", average_alert_confidence double")
    keys = [F.array_join(c, "|").alias(c) for c in ("source_ips", "usernames", "attack_chain")]
    return incidents.select("first_seen", "last_seen", "alert_count", *keys, e.alias("e")).select("first_seen", "last_seen", "alert_count", "source_ips", "usernames", "attack_chain", "e.*")


#: Texts that call the functions of ``functions.sql``.
SQL_ENTRIES = """SELECT line_no, source, timestamp, username, ip_address, status, event_type, method, path, status_code
 FROM (SELECT line_no, parse_log_line(value, 2024) AS entry FROM {lines}) LATERAL VIEW inline(array(entry)) e WHERE outcome = 'parsed'"""
SQL_WEB = """SELECT line_no, pattern, round(confidence, 6) AS confidence, CAST(risk_score AS BIGINT) AS risk_score
 FROM (SELECT line_no, sqli_match(request) AS sqli, xss_match(request) AS xss FROM {entries} WHERE event_type = 'HTTP_REQUEST') LATERAL VIEW inline(array(sqli, xss)) m WHERE pattern IS NOT NULL"""


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    sql.register(spark)
    return spark.sql(text, **tables)


def _source_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as text files with an index, read through the data source under filters that it takes."""
    folder = Scratch(spark).folder
    log_lines(spark, sf_dir).select("value").write.text(f"{folder}/lines")
    datasource.index_logs(spark, f"{folder}/lines", f"{folder}/index", 2024)
    datasource.register(spark)
    entries = spark.read.format("quarrylog").options(index=f"{folder}/index", year=2024).load(f"{folder}/lines")
    entries = entries.where("timestamp >= timestamp_ntz'2024-01-10 00:00:00' AND timestamp < timestamp_ntz'2024-01-24 12:00:00' AND source IN ('linux', 'apache')")
    return entries.select("source", "timestamp", "username", "ip_address", "status", "event_type", "method", "path", "status_code")


QUERIES = {
    "parse_classify": lambda s, d: _parsed(s, d).select("line_no", "outcome", F.coalesce("source", F.lit("")).alias("source")),
    "parse_entries": lambda s, d: _parsed(s, d).where("outcome = 'parsed'").select("line_no", "source", "timestamp", "username", "ip_address", "status", "event_type", "method", "path", "status_code"),
    "sql_entries": lambda s, d: _sql(s, SQL_ENTRIES, lines=log_lines(s, d)),
    "source_entries": _source_entries,
    "sql_web_alerts": lambda s, d: _sql(s, SQL_WEB, entries=log_entries(s, d)),
    "parse_stats": lambda s, d: parsing.parse_stats(_parsed(s, d)),
    "statistics": lambda s, d: detectors.statistics(log_entries(s, d)),
    "top_user": lambda s, d: detectors.top_value(log_entries(s, d), "username"),
    "top_ip": lambda s, d: detectors.top_value(log_entries(s, d), "ip_address"),
    "sqli_alerts": lambda s, d: _web(s, d, detectors.SQLI_BANK),
    "xss_alerts": lambda s, d: _web(s, d, detectors.XSS_BANK),
    "brute_force": lambda s, d: _force(detectors.brute_force(log_entries(s, d), CONFIG)),
    "password_spray": lambda s, d: _spray(detectors.password_spray(log_entries(s, d), CONFIG)),
    "impossible_travel": lambda s, d: _pairs(detectors.impossible_travel(log_entries(s, d), places(s))),
    "stream_brute_force": lambda s, d: _force(drained(stream_bursts.brute_force(log_entries(s, d, True), CONFIG, DELAY))),
    "stream_password_spray": lambda s, d: _spray(drained(stream_bursts.password_spray(log_entries(s, d, True), CONFIG, DELAY))),
    "stream_impossible_travel": lambda s, d: _pairs(drained(stream_travel.impossible_travel(log_entries(s, d, True), places(s), None, DELAY))),
    "insider_scores": lambda s, d: detectors.insider_scores(log_entries(s, d)).select("username", "events", "unusual_hours", "sensitive", F.col("score").cast("long").alias("score"), "majority_ip"),
    "insider_threat": lambda s, d: detectors.insider_threat(log_entries(s, d)).select("username", "timestamp", "ip_address", "line_no", _six("confidence"), F.col("risk_score").cast("long"), "majority_ip", F.array_join("unusual_ips", "|").alias("unusual_ips")),
    "features_ip": lambda s, d: detectors.features(log_entries(s, d), "ip_address"),
    "features_user": lambda s, d: detectors.features(log_entries(s, d), "username"),
    "alert_counts": lambda s, d: _alerts(s, d, RULES).groupBy("alert_type", "severity").agg(F.count("*").alias("n")),
    "alert_severities": lambda s, d: severity_counts(_alerts(s, d, RULES)),
    "attack_types": lambda s, d: attack_type_counts(_alerts(s, d, RULES)),
    "web_evidence": lambda s, d: _told(detectors.web_alerts(log_entries(s, d)), ("line_no", "alert_type"), pattern="string", request="string", normalized_request="string", matched_indicators="array<string>"),
    "brute_force_evidence": lambda s, d: _told(detectors.brute_force(log_entries(s, d), CONFIG), ("username", "ip_address"), attempts="bigint", **_BURST),
    "password_spray_evidence": lambda s, d: _told(detectors.password_spray(log_entries(s, d), CONFIG), ("ip_address",), unique_users="bigint", users="array<string>", **_BURST),
    "impossible_travel_evidence": lambda s, d: _told(
        detectors.impossible_travel(log_entries(s, d), places(s)), _PLACE, previous_ip="string", current_ip="string", previous_location="string", current_location="string",
        distance_km="double", elapsed_seconds="double", required_speed_kmh="double", configured_speed_threshold="double",
    ),
    "insider_threat_evidence": lambda s, d: _told(
        detectors.insider_threat(log_entries(s, d)), _PLACE, score="bigint", threshold="bigint", signals="array<string>", event_count="bigint", privileged="boolean", unusual_hour_count="bigint",
        sensitive_access_count="bigint", majority_ip="string", unusual_ips="array<string>",
    ),
    "risk_breakdown": lambda s, d: _breakdown(correlation.incidents(_alerts(s, d, RULES), RULES)),
    "anomaly_scores": lambda s, d: anomaly.score(anomaly.entity_vectors(log_entries(s, d)), minimum=FEW).select("entity_type", "entity_id", "decision", "score"),
    "incident_risk": lambda s, d: _flat(correlation.incidents(_alerts(s, d, RULES), RULES)),
    "large_incident_risk": lambda s, d: correlation.large_incidents(_alerts(s, d, RULES), RULES).select(
        "incident_type", "severity", "first_seen", "last_seen", "alert_count", "n_source_ips", "n_usernames", F.array_join("attack_chain", "|").alias("attack_chain"), F.col("risk_score").cast("long").alias("risk_score")
    ),
    "incident_risk_with_anomalies": lambda s, d: _flat(correlation.incidents(_alerts(s, d, CONFIG), CONFIG)),
}

_E = f"WITH e AS ({ENTRIES_SQL})"
_TOP = "SELECT {c} AS value, count(*) AS n FROM e GROUP BY {c} ORDER BY n DESC, min(line_no) LIMIT 1"
_NORMAL = "lower(url_decode(replace(url_decode(replace(request, '+', ' ')), '+', ' ')))"
_FEATURES = """SELECT {c} AS entity_id, CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (event_type = 'LOGIN_FAILED') AS DOUBLE) AS failed, CAST(count(*) FILTER (event_type = 'LOGIN_SUCCESS') AS DOUBLE) AS success,
 CAST(count(DISTINCT CASE WHEN username NOT IN ('', '-') THEN username END) AS DOUBLE) AS users, CAST(count(DISTINCT ip_address) AS DOUBLE) AS ips, CAST(count(DISTINCT CASE WHEN request <> '' THEN request END) AS DOUBLE) AS paths,
 CAST(count(*) FILTER (event_type = 'HTTP_REQUEST') AS DOUBLE) AS http, CAST(count(*) FILTER (event_type = 'HTTP_REQUEST' AND status_code >= 400) AS DOUBLE) AS http_errors, CAST(count(*) FILTER (event_type <> 'HTTP_REQUEST') AS DOUBLE) AS auth,
 CAST(count(*) FILTER (hour(timestamp) < 5) AS DOUBLE) AS unusual_hours, CAST(count(DISTINCT source) AS DOUBLE) AS sources, count(*) FILTER (event_type = 'LOGIN_FAILED') / count(*) AS failed_ratio FROM e {w} GROUP BY 1"""
_PLACES = ", ".join(f"('{ip}', '{city}', {lat}, {lon}, '{country}')" for ip, city, lat, lon, country in PLACES)
_LINES = rf"""WITH raw AS ({_lines_sql(True)}), n AS (SELECT line_no, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v FROM raw),
 c AS (SELECT *, CASE WHEN regexp_matches(v, 'sshd\[\d+\]:') THEN 'linux' WHEN regexp_matches(v, 'EVENT_ID=\d+') THEN 'windows' WHEN regexp_matches(v, '^\d{{1,3}}(\.\d{{1,3}}){{3}}\s+\S+\s+\S+\s+\[[^\]]+\]\s+"') THEN 'apache' END AS source FROM n),
 l AS (SELECT *, regexp_extract(v, '^(\w+\s+\d+\s+\d+:\d+:\d+)\s+\S+\s+sshd\[\d+\]:\s+(Accepted|Failed)\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+(\d{{1,3}}(?:\.\d{{1,3}}){{3}})\s+port\s+\d+', ['ts', 'said', 'user', 'ip']) AS p,
  regexp_extract(v, '^(\w+\s+\d+\s+\d+:\d+:\d+)\s+\S+\s+sshd\[\d+\]:\s+Invalid\s+user\s+(\S+)\s+from\s+(\d{{1,3}}(?:\.\d{{1,3}}){{3}})', ['ts', 'user', 'ip']) AS i,
  regexp_extract(v, '^(\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?)\s+EVENT_ID=(\d+)\s+USER=(\S+)\s+IP=(\d{{1,3}}(?:\.\d{{1,3}}){{3}})', ['ts', 'event', 'user', 'ip']) AS w,
  regexp_extract(v, '^(\d{{1,3}}(?:\.\d{{1,3}}){{3}})\s+\S+\s+\S+\s+\[([^\]]+?)\s+(?:[+-]\d\d:?[0-5]\d|Z)\]\s+"([A-Z]+)\s+(.+?)\s+HTTP/\d(?:\.\d)?"\s+(\d{{3}})', ['ip', 'ts', 'method', 'path', 'code']) AS a FROM c),
 f AS (SELECT *, CASE source WHEN 'linux' THEN try_strptime('2024 ' || regexp_replace(CASE WHEN p.ts <> '' THEN p.ts ELSE i.ts END, '\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') WHEN 'windows' THEN TRY_CAST(w.ts AS TIMESTAMP) WHEN 'apache' THEN try_strptime(a.ts, '%d/%b/%Y:%H:%M:%S') END AS stamp,
  CASE source WHEN 'linux' THEN CASE WHEN p.said = 'Accepted' THEN true WHEN p.said = 'Failed' OR i.user <> '' THEN false END WHEN 'windows' THEN CASE w.event WHEN '4624' THEN true WHEN '4625' THEN false END WHEN 'apache' THEN TRY_CAST(a.code AS INTEGER) < 400 END AS ok FROM l),
 p AS (SELECT line_no, coalesce(source, '') AS source, stamp AS timestamp, CASE source WHEN 'linux' THEN coalesce(nullif(p.user, ''), i.user) WHEN 'windows' THEN w.user ELSE '-' END AS username,
  CASE source WHEN 'linux' THEN coalesce(nullif(p.ip, ''), i.ip) WHEN 'windows' THEN w.ip ELSE a.ip END AS ip_address, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN source = 'apache' THEN 'HTTP_REQUEST' WHEN ok THEN 'LOGIN_SUCCESS' ELSE 'LOGIN_FAILED' END AS event_type, CASE WHEN source = 'apache' THEN a.method ELSE '' END AS method, CASE WHEN source = 'apache' THEN a.path ELSE '' END AS path,
  CASE WHEN source = 'apache' THEN TRY_CAST(a.code AS INTEGER) END AS status_code, CASE WHEN source IS NULL THEN 'unsupported' WHEN stamp IS NOT NULL AND ok IS NOT NULL THEN 'parsed' ELSE 'malformed' END AS outcome FROM f)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _bank(bank: tuple, where: str = "e") -> str:
    """The best pattern of each request, its confidence and risk, and all that match."""
    kind, severity, patterns = bank
    best = sorted(patterns, key=lambda p: (-p[2], -p[3]))
    case = lambda k: " ".join(f"WHEN regexp_matches(q, {_quoted(p[1])}) THEN {_quoted(p[0]) if k == 0 else p[k]}" for p in best)
    names = ", ".join(f"CASE WHEN regexp_matches(q, {_quoted(p[1])}) THEN {_quoted(p[0])} END" for p in patterns)
    return f"""SELECT '{kind}' AS alert_type, '{severity}' AS severity, line_no, timestamp, username, ip_address, request, CASE {case(0)} END AS pattern, CAST(CASE {case(2)} END AS DOUBLE) AS confidence, CAST(CASE {case(3)} END AS BIGINT) AS risk_score,
 concat_ws('|', {names}) AS indicators FROM (SELECT *, {_NORMAL} AS q FROM {where} WHERE event_type = 'HTTP_REQUEST' AND request <> '') WHERE pattern IS NOT NULL"""


def _bursts(keys: str, measure: str, out: str, more: str, tag: str = "") -> tuple[str, str]:
    """(common table expressions, select) of the greedy bursts."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    of_a = ", ".join(f"a.{k}" for k in keys.split(", "))
    frame = f"OVER (PARTITION BY {keys} ORDER BY t RANGE BETWEEN CURRENT ROW AND {3 * DAY * 1_000_000} FOLLOWING)"
    with_ = f"""f{tag} AS (SELECT *, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp, line_no) AS rn FROM e WHERE event_type = 'LOGIN_FAILED'),
 g{tag} AS (SELECT *, max(rn) {frame} AS r, {measure.replace('FRAME', frame)} AS u, max(timestamp) {frame} AS "end", list(username) {frame} AS members, list(source) {frame} AS seen FROM f{tag}), c{tag} AS (SELECT *, CASE WHEN u = -1 THEN r - rn + 1 ELSE u END AS n FROM g{tag}), able{tag} AS (SELECT * FROM c{tag} WHERE n >= 3),
 nxt{tag} AS (SELECT {of_a}, a.rn, min(b.rn) AS after FROM able{tag} a LEFT JOIN able{tag} b ON {same} AND b.rn > a.r GROUP BY ALL),
 walk{tag} AS (SELECT {keys}, min(rn) AS rn FROM able{tag} GROUP BY {keys} UNION ALL SELECT {of_a}, b.after FROM walk{tag} a JOIN nxt{tag} b ON {same} AND a.rn = b.rn WHERE b.after IS NOT NULL)"""
    graded = "round(least(0.99::DOUBLE, 0.85::DOUBLE + 0.02::DOUBLE * (b.n - 3)), 6) AS confidence, CAST(least(95, 70 + 2 * (b.n - 3)) AS BIGINT) AS risk_score"
    return with_, f"""SELECT {of_a}, b.timestamp, b."end", {more}, CAST(b.n AS BIGINT) AS {out}, {graded} FROM walk{tag} a JOIN able{tag} b ON {same} AND a.rn = b.rn"""


_MEMBERS = "array_to_string(list_sort(list_distinct(b.members)), ',')"
_FORCE = _bursts("username, ip_address", "-1", "attempts", "CASE WHEN len(list_distinct(b.seen)) = 1 THEN b.seen[1] ELSE 'mixed' END AS source")
_SPRAY = _bursts("ip_address", "count(DISTINCT username) FRAME", "unique_users", f"{_MEMBERS} AS users", "_s")
_TRAVEL = f"""places(ip, city, lat, lon, country) AS (VALUES {_PLACES}), h AS (SELECT e.*, l.* FROM e LEFT JOIN places l ON e.ip_address = l.ip WHERE event_type = 'LOGIN_SUCCESS' AND username <> '-'),
 p AS (SELECT *, lag(ip_address) OVER w AS i0, lag(city) OVER w AS c0, lag(country) OVER w AS k0, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 AS s FROM h WINDOW w AS (PARTITION BY username ORDER BY timestamp, line_no)),
 q AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - a0) / 2), 2) + cos(radians(a0)) * cos(radians(lat)) * pow(sin(radians(lon - o0) / 2), 2))) AS dist FROM p WHERE i0 <> ip_address AND c0 <> city),
 travel AS (SELECT username, ip_address, timestamp, line_no, round(dist, 3) AS km, s, i0, concat(c0, ', ', k0) AS previous_location, concat(city, ', ', country) AS current_location, round(dist, 2) AS distance_km, CASE WHEN s > 0 THEN round(dist / (s / 3600), 2) END AS required_speed_kmh, CASE WHEN s <= 0 THEN 1e308 ELSE dist / (s / 3600) / 900 END AS ratio FROM q WHERE s <= 0 OR dist / (s / 3600) > 900)"""
_INSIDER = """u AS (SELECT username, count(*) AS events, count(*) FILTER (hour(timestamp) < 5) AS unusual_hours, count(*) FILTER (request LIKE '/admin%') AS sensitive FROM e WHERE username <> '-' GROUP BY 1),
 i AS (SELECT username, ip_address, count(*) AS n, min(line_no) AS first FROM e WHERE username <> '-' GROUP BY 1, 2),
 m AS (SELECT username, max(n) AS majority, count(*) AS ips, first(ip_address ORDER BY n DESC, first) AS majority_ip FROM i GROUP BY 1),
 score AS (SELECT u.*, CAST(CASE WHEN username = 'admin' THEN 30 ELSE 0 END + CASE WHEN unusual_hours > 0 THEN 20 ELSE 0 END + CASE WHEN events >= 20 THEN 20 ELSE 0 END + CASE WHEN sensitive > 0 THEN 20 ELSE 0 END + CASE WHEN majority >= 2 AND ips > 1 THEN 20 ELSE 0 END AS BIGINT) AS score, majority_ip FROM u JOIN m USING (username)),
 anchor AS (SELECT username, coalesce(max(line_no) FILTER (request LIKE '/admin%'), max(line_no) FILTER (hour(timestamp) < 5), max(line_no)) AS line_no FROM e GROUP BY 1),
 insider AS (SELECT s.username, e.timestamp, e.ip_address, e.line_no, round(least(0.95::DOUBLE, 0.55::DOUBLE + s.score / 50::DOUBLE * 0.2::DOUBLE), 6) AS confidence, CAST(least(90, 40 + s.score // 2) AS BIGINT) AS risk_score, s.majority_ip,
  (SELECT array_to_string(list_sort(list(i.ip_address)), '|') FROM i WHERE i.username = s.username AND i.ip_address <> s.majority_ip) AS unusual_ips FROM score s JOIN anchor a USING (username) JOIN e ON e.line_no = a.line_no WHERE s.score >= 50)"""
_TRAVEL_ROWS = "SELECT username, ip_address, timestamp, line_no, km, round(least(0.99::DOUBLE, 0.75::DOUBLE + least(ratio, 5) * 0.04::DOUBLE), 6) AS confidence, CAST(least(95, 70 + CAST(floor(least(ratio, 10) * 2) AS BIGINT)) AS BIGINT) AS risk_score FROM travel"
_WEB = " UNION ALL ".join(f"SELECT alert_type, severity, timestamp, username, ip_address, confidence, concat(request, pattern) AS ev, 2 AS seq FROM ({_bank(b)})" for b in (detectors.SQLI_BANK, detectors.XSS_BANK))
#: All alerts of the rules, and the chains and components of them.
_ALERTS = f"""WITH RECURSIVE e AS ({ENTRIES_SQL}), {_FORCE[0]}, {_SPRAY[0]}, {_TRAVEL}, {_INSIDER},
 alerts AS (SELECT DISTINCT * FROM (SELECT 'BRUTE_FORCE' AS alert_type, 'HIGH' AS severity, timestamp, username, ip_address, confidence, '' AS ev, 0 AS seq FROM ({_FORCE[1]})
  UNION ALL SELECT 'PASSWORD_SPRAY', 'HIGH', timestamp, users, ip_address, confidence, '', 1 FROM ({_SPRAY[1]}) UNION ALL {_WEB}
  UNION ALL SELECT 'IMPOSSIBLE_TRAVEL', 'HIGH', timestamp, username, ip_address, confidence, '', 3 FROM ({_TRAVEL_ROWS}) UNION ALL SELECT 'INSIDER_THREAT', 'MEDIUM', timestamp, username, ip_address, confidence, '', 4 FROM insider))"""
_INCIDENTS = f"""{_ALERTS}, numbered AS (SELECT *, row_number() OVER (ORDER BY timestamp, seq, alert_type, username, ip_address, ev) AS id FROM alerts),
 named AS (SELECT id, unnest(list_distinct(list_transform(string_split(username, ','), lambda x: lower(trim(x))))) AS name FROM numbered),
 keyed AS (SELECT id, timestamp, 'i|' || trim(ip_address) AS key FROM numbered WHERE trim(ip_address) NOT IN ('', '-') UNION ALL SELECT id, timestamp, 'u|' || name FROM named JOIN numbered USING (id) WHERE name NOT IN ('', '-')),
 near AS (SELECT id, CASE WHEN epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) <= 300000000 THEN lag(id) OVER w END AS prior FROM keyed WINDOW w AS (PARTITION BY key ORDER BY timestamp, id)),
 both_ways AS (SELECT id AS a, prior AS b FROM near WHERE prior IS NOT NULL UNION SELECT prior, id FROM near WHERE prior IS NOT NULL),
 reach AS (SELECT id, id AS other FROM numbered UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON r.other = b.a),
 grouped AS (SELECT n.*, g.incident FROM numbered n JOIN (SELECT id, min(other) AS incident FROM reach GROUP BY 1) g USING (id)),
 chain AS (SELECT incident, string_agg(alert_type, '|' ORDER BY first) AS attack_chain, string_agg(alert_type, '|' ORDER BY alert_type) AS alert_types, count(*) AS types FROM (SELECT incident, alert_type, min(id) AS first FROM grouped GROUP BY ALL) GROUP BY 1),
 who AS (SELECT incident, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (name NOT IN ('', '-')), '') AS usernames, coalesce(bool_or(name IN ('admin', 'root', 'administrator')), false) AS privileged FROM grouped JOIN named USING (id) GROUP BY 1),
 total AS (SELECT incident, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS alert_count, string_agg(DISTINCT trim(ip_address), '|' ORDER BY trim(ip_address)) AS source_ips, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank, round(avg(confidence), 9) AS sure FROM grouped GROUP BY 1),
 scored AS (SELECT *, CASE rank WHEN 4 THEN 90 WHEN 3 THEN 70 WHEN 2 THEN 40 ELSE 20 END AS base_score, CASE WHEN alert_count >= 2 THEN 10 END AS multiple_alert_bonus, CASE WHEN types >= 2 THEN 10 END AS multiple_attack_type_bonus,
  CASE WHEN alert_count > types THEN 5 END AS repeated_activity_bonus, CASE WHEN privileged THEN 5 END AS privileged_user_bonus, CASE WHEN sure >= 0.85 THEN 3 END AS confidence_bonus FROM total JOIN chain USING (incident) JOIN who USING (incident))"""

_FINAL = "CAST(least(100, " + " + ".join(f"coalesce({c}, 0)" for c in _BONUSES) + ") AS BIGINT)"
_RISK = f"""SELECT CASE WHEN types = 1 THEN attack_chain ELSE 'CORRELATED_ACTIVITY' END AS incident_type, CASE rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, first_seen, last_seen, alert_count, source_ips, usernames, attack_chain, alert_types, {_FINAL} AS risk_score FROM scored"""


def _over(event_type: str, window_s: int) -> str:
    """Only what the watermark has passed at the end of the stream."""
    named = " AND username <> '-'" if event_type == "LOGIN_SUCCESS" else ""
    return f"WHERE epoch_us(timestamp) + {window_s * 1_000_000} <= (SELECT epoch_ms(max(timestamp)) FROM e WHERE event_type = '{event_type}'{named}) * 1000 - {2 * DAY * 1_000_000}"


ORACLES = {
    "parse_classify": f"{_LINES} SELECT line_no, outcome, source FROM p",
    "parse_entries": f"{_LINES} SELECT line_no, source, timestamp, username, ip_address, status, event_type, method, path, status_code FROM p WHERE outcome = 'parsed'",
    "sql_entries": f"{_LINES} SELECT line_no, source, timestamp, username, ip_address, status, event_type, method, path, status_code FROM p WHERE outcome = 'parsed'",
    "source_entries": f"{_LINES} SELECT source, timestamp, username, ip_address, status, event_type, method, path, status_code FROM p WHERE outcome = 'parsed' AND source IN ('linux', 'apache') AND timestamp >= '2024-01-10 00:00:00' AND timestamp < '2024-01-24 12:00:00'",
    "sql_web_alerts": f"{_E} " + " UNION ALL ".join(f"SELECT line_no, pattern, round(confidence, 6) AS confidence, risk_score FROM ({_bank(b)})" for b in (detectors.SQLI_BANK, detectors.XSS_BANK)),
    "parse_stats": f"""{_LINES} SELECT count(*) AS total_lines, count(*) FILTER (outcome = 'parsed') AS parsed_lines, count(*) FILTER (outcome = 'malformed') AS malformed_lines, count(*) FILTER (outcome = 'unsupported') AS unsupported_lines,
 count(*) FILTER (outcome = 'parsed' AND source = 'linux') AS linux_lines, count(*) FILTER (outcome = 'parsed' AND source = 'windows') AS windows_lines, count(*) FILTER (outcome = 'parsed' AND source = 'apache') AS apache_lines FROM p""",
    "statistics": f"""{_E} SELECT count(*) AS total, count(*) FILTER (source = 'linux') AS linux, count(*) FILTER (source = 'windows') AS windows, count(*) FILTER (source = 'apache') AS apache,
 count(*) FILTER (event_type = 'LOGIN_SUCCESS') AS successful_logins, count(*) FILTER (event_type = 'LOGIN_FAILED') AS failed_logins, count(*) FILTER (event_type = 'HTTP_REQUEST') AS http_requests,
 count(DISTINCT CASE WHEN username <> '-' THEN username END) AS unique_users, count(DISTINCT ip_address) AS unique_ips FROM e""",
    "top_user": f"{_E} {_TOP.format(c='username')}",
    "top_ip": f"{_E} {_TOP.format(c='ip_address')}",
    "sqli_alerts": f"{_E} SELECT line_no, pattern, severity, username, round(confidence, 6) AS confidence, risk_score, indicators FROM ({_bank(detectors.SQLI_BANK)})",
    "xss_alerts": f"{_E} SELECT line_no, pattern, severity, username, round(confidence, 6) AS confidence, risk_score, indicators FROM ({_bank(detectors.XSS_BANK)})",
    "brute_force": f"WITH RECURSIVE e AS ({ENTRIES_SQL}), {_FORCE[0]} {_FORCE[1]}",
    "password_spray": f"WITH RECURSIVE e AS ({ENTRIES_SQL}), {_SPRAY[0]} {_SPRAY[1]}",
    "impossible_travel": f"{_E}, {_TRAVEL} {_TRAVEL_ROWS}",
    "stream_brute_force": f"WITH RECURSIVE e AS ({ENTRIES_SQL}), {_FORCE[0]} SELECT * FROM ({_FORCE[1]}) {_over('LOGIN_FAILED', 3 * DAY)}",
    "stream_password_spray": f"WITH RECURSIVE e AS ({ENTRIES_SQL}), {_SPRAY[0]} SELECT * FROM ({_SPRAY[1]}) {_over('LOGIN_FAILED', 3 * DAY)}",
    "stream_impossible_travel": f"{_E}, {_TRAVEL} SELECT * FROM ({_TRAVEL_ROWS}) {_over('LOGIN_SUCCESS', 0)}",
    "insider_scores": f"{_E}, {_INSIDER} SELECT * FROM score",
    "insider_threat": f"{_E}, {_INSIDER} SELECT * FROM insider",
    "features_ip": f"{_E} {_FEATURES.format(c='ip_address', w='')}",
    "features_user": f"{_E} {_FEATURES.format(c='username', w="WHERE username <> '-'")}",
    "alert_counts": f"{_ALERTS} SELECT alert_type, severity, count(*) AS n FROM alerts GROUP BY ALL",
    "alert_severities": f"{_ALERTS} SELECT count(*) FILTER (severity = 'CRITICAL') AS \"CRITICAL\", count(*) FILTER (severity = 'HIGH') AS \"HIGH\", count(*) FILTER (severity = 'MEDIUM') AS \"MEDIUM\", count(*) FILTER (severity = 'LOW') AS \"LOW\" FROM alerts",
    "incident_risk": f"{_INCIDENTS} {_RISK}",
    "large_incident_risk": f"""SELECT incident_type, severity, first_seen, last_seen, alert_count, attack_chain, risk_score, CASE WHEN source_ips = '' THEN 0 ELSE len(string_split(source_ips, '|')) END AS n_source_ips,
 CASE WHEN usernames = '' THEN 0 ELSE len(string_split(usernames, '|')) END AS n_usernames FROM ({_INCIDENTS} {_RISK})""",
    "attack_types": f"{_ALERTS} SELECT alert_type, count(*) AS n FROM alerts GROUP BY 1",
    "web_evidence": f"{_E} " + " UNION ALL ".join(f"SELECT line_no, alert_type, pattern, request, {_NORMAL} AS normalized_request, indicators AS matched_indicators FROM ({_bank(b)})" for b in (detectors.SQLI_BANK, detectors.XSS_BANK)),
    "brute_force_evidence": f'WITH RECURSIVE e AS ({ENTRIES_SQL}), {_FORCE[0]} SELECT username, ip_address, attempts, 3::BIGINT AS threshold, {3 * DAY}::BIGINT AS window_seconds, timestamp AS start_time, "end" AS end_time FROM ({_FORCE[1]})',
    "password_spray_evidence": f"""WITH RECURSIVE e AS ({ENTRIES_SQL}), {_SPRAY[0]} SELECT ip_address, unique_users, replace(users, ',', '|') AS users, 3::BIGINT AS threshold, {3 * DAY}::BIGINT AS window_seconds, timestamp AS start_time, "end" AS end_time FROM ({_SPRAY[1]})""",
    "impossible_travel_evidence": f"""{_E}, {_TRAVEL} SELECT username, line_no, i0 AS previous_ip, ip_address AS current_ip, previous_location, current_location, distance_km, s AS elapsed_seconds, required_speed_kmh, 900::DOUBLE AS configured_speed_threshold FROM travel""",
    "insider_threat_evidence": f"""{_E}, {_INSIDER} SELECT username, line_no, score, 50::BIGINT AS threshold,
 concat_ws('|', CASE WHEN username = 'admin' THEN 'privileged_account' END, CASE WHEN unusual_hours > 0 THEN 'unusual_hour' END, CASE WHEN events >= 20 THEN 'high_activity_volume' END, CASE WHEN sensitive > 0 THEN 'sensitive_resource_access' END, CASE WHEN majority >= 2 AND ips > 1 THEN 'unusual_source_ip' END) AS signals,
 events AS event_count, username = 'admin' AS privileged, unusual_hours AS unusual_hour_count, sensitive AS sensitive_access_count, majority_ip, coalesce(unusual_ips, '') AS unusual_ips
 FROM (SELECT username, line_no, unusual_ips FROM insider) JOIN (SELECT * FROM score) USING (username) JOIN (SELECT username, majority, ips FROM m) USING (username)""",
    "risk_breakdown": f"""{_INCIDENTS} SELECT first_seen, last_seen, alert_count, source_ips, usernames, attack_chain, {', '.join(f"{c}::BIGINT AS {c}" for c in _BONUSES)}, {_FINAL} AS final_score, CASE WHEN confidence_bonus > 0 THEN round(sure::DECIMAL(18, 9), 3)::DOUBLE END AS average_alert_confidence FROM scored""",
}
