"""From lines to reports in one call."""

import json
import logging
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrylog import reporting
from quarrylog.config import AnalyzerConfig, AnomalyConfig, BruteForceConfig, block
from quarrylog.diagnostics import get_logger, setup_logging
from quarrylog.exceptions import LogFileError, ReportGenerationError
from quarrylog.service import AnalysisService, DetectorSpec, analyze_file, analyze_lines
from quarrylog.operators import correlation, detectors, parsing
from quarrylog.sources.logs import from_lines, read_lines

CONFIG = AnalyzerConfig(default_log_year=2026)
LINES = [f"Mar 03 10:00:{2 + 5 * k:02d} gate sshd[5]: Failed password for admin from 9.8.7.6 port {k + 1}" for k in range(5)] + [
    '9.8.7.5 - - [03/Mar/2026:10:30:00 +0000] "GET /find?q=1+union+select+2 HTTP/1.1" 200 5',
    '9.8.7.4 - - [03/Mar/2026:11:30:00 +0000] "GET /find?q=%3Cscript%3E HTTP/1.1" 500 5',
    "what is this",
    "",
]


def test_lines_to_incidents(spark):
    result = analyze_lines(spark, LINES, CONFIG)
    got = [(r["incident_type"], r["severity"], r["risk_score"]) for r in result.incidents.collect()]
    assert got == [("SQL_INJECTION", "CRITICAL", 93), ("BRUTE_FORCE", "HIGH", 78), ("XSS", "HIGH", 73)]
    assert [r["alert_type"] for r in result.alerts.collect()] == ["BRUTE_FORCE", "SQL_INJECTION", "XSS"]
    assert result.parse_stats.first()["unsupported_lines"] == 2 and result.statistics.first()["failed_logins"] == 5
    s = reporting.summary(result).first()
    assert (s["total_alerts"], s["critical_alerts"], s["highest_risk_score"], s["highest_risk_severity"], s["top_threats"]) == (3, 1, 93, "CRITICAL", ["BRUTE_FORCE", "SQL_INJECTION", "XSS"])
    assert reporting.severity_counts(result.incidents).first().asDict() == {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 0, "LOW": 0}


def test_flags_and_own_detectors(spark):
    off = replace(CONFIG, brute_force=replace(CONFIG.brute_force, enabled=False), xss=replace(CONFIG.xss, enabled=False))
    assert [r["alert_type"] for r in analyze_lines(spark, LINES, off).alerts.collect()] == ["SQL_INJECTION"]
    own = DetectorSpec("own", lambda entries, c: entries.where("status_code = 500").selectExpr("'BROKEN' as alert_type", "'odd' as severity", "timestamp", "username", "ip_address", "0D as confidence", "1 as risk_score", "line_no", "source", "'' as description", "'{}' as evidence"), lambda c: True)
    (got,) = AnalysisService(CONFIG, [own]).analyze_lines(spark, LINES).incidents.collect()
    assert (got["incident_type"], got["severity"], got["risk_score"]) == ("BROKEN", "MEDIUM", 40)
    assert AnalysisService(CONFIG, []).analyze_lines(spark, LINES).incidents.count() == 0
    assert block(off, BruteForceConfig).enabled is False and block(None, AnomalyConfig).n_estimators == 100


def test_reports(spark, tmp_path):
    result = analyze_lines(spark, LINES, CONFIG)
    paths = reporting.write_reports(result, str(tmp_path / "reports"))
    assert sorted(paths) == ["alerts_csv", "alerts_json", "incidents_csv", "incidents_json", "report_json", "summary"]
    csv = spark.read.option("header", True).option("escape", '"').csv(paths["alerts_csv"]).collect()
    assert len(csv) == 3 and tuple(csv[0].asDict()) == reporting.ALERT_COLUMNS
    assert {json.loads(r["evidence"]).get("pattern") for r in csv} == {None, "UNION SELECT", "<script"}
    incidents = spark.read.option("header", True).csv(paths["incidents_csv"]).orderBy("first_seen").collect()
    assert tuple(incidents[0].asDict()) == reporting.INCIDENT_COLUMNS and incidents[0]["usernames"] == "admin" and incidents[0]["first_seen"] == "2026-03-03 10:00:02"
    assert spark.read.json(paths["report_json"]).first()["summary"]["total_incidents"] == 3
    assert "highest_risk_score: 93" in [r["value"] for r in spark.read.text(paths["summary"]).collect()]
    assert reporting.write_reports(result, str(tmp_path / "none"), ["unknown"]) == {}
    (tmp_path / "file").write_text("")
    with pytest.raises(ReportGenerationError):
        reporting.write_reports(result, str(tmp_path / "file"), ["csv"])


def test_files(spark, tmp_path):
    with pytest.raises(LogFileError):
        analyze_file(spark, str(tmp_path / "none.log"), CONFIG)
    with pytest.raises(LogFileError):
        analyze_file(spark, str(tmp_path), CONFIG)
    (tmp_path / "b.log").write_text("\n".join(f"b{k}" for k in range(50)))
    (tmp_path / "a.log").write_text("a0\n\n  \na3\n")
    got = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in got] == [(0, "a0"), (3, "a3"), *((4 + k, f"b{k}") for k in range(50))]
    (tmp_path / "whole.log").write_text("\n".join(LINES))
    assert analyze_file(spark, str(tmp_path / "whole.log"), CONFIG).incidents.count() == 3


def test_own_formats_and_places(spark):
    """A format and a table of addresses of one's own, through the whole analysis."""

    def entry(text, year):
        part = lambda k: F.regexp_extract(text, r"^VPN (\S+ \S+) (\S+) (\S+)$", k)
        return F.when(part(1) != "", F.struct(F.try_to_timestamp(part(1)).cast("timestamp_ntz").alias("timestamp"), part(2).alias("username"), part(3).alias("ip_address"), F.lit(True).alias("ok"), F.lit("").alias("request"), F.lit("").alias("method"), F.lit(None).cast("int").alias("status_code")))

    vpn = parsing.Format("vpn", lambda c: c.startswith("VPN "), entry)
    places = spark.createDataFrame([("1.1.1.1", "Oslo", 59.9, 10.7, "NO"), ("2.2.2.2", "Lima", -12.0, -77.0, "PE")], "ip string, city string, lat double, lon double, country string")
    lines = ["VPN 2026-03-01 10:00:00 amy 1.1.1.1", "VPN 2026-03-01 11:00:00 amy 2.2.2.2", "VPN broken", *LINES[:2]]
    result = AnalysisService(CONFIG, formats=[vpn, *parsing.FORMATS], places=places).analyze_lines(spark, lines)
    stats = result.parse_stats.first()
    assert (stats["vpn_lines"], stats["linux_lines"], stats["malformed_lines"]) == (2, 2, 1)
    (alert,) = result.alerts.collect()
    assert (alert["alert_type"], alert["username"], alert["source"]) == ("IMPOSSIBLE_TRAVEL", "amy", "vpn")
    assert json.loads(alert["evidence"])["current_location"] == "Lima, PE"
    assert AnalysisService(CONFIG).analyze_lines(spark, lines).parse_stats.first()["unsupported_lines"] == 3


def test_own_reader_statistics_correlation_and_score(spark):
    service = AnalysisService(
        CONFIG, read=lambda spark, path: from_lines(spark, LINES), statistics=lambda e: e.groupBy("source").count(),
        correlate=lambda alerts, c: correlation.correlate(alerts.where("alert_type <> 'XSS'"), c), score=lambda incidents, c: correlation.score(incidents, c).withColumn("risk_score", F.lit(7)),
    )
    result = service.analyze_file(spark, "anywhere")
    assert result.input_file == "anywhere" and {r["source"]: r["count"] for r in result.statistics.collect()} == {"linux": 5, "apache": 2}
    assert [(r["incident_type"], r["risk_score"]) for r in correlation.by_first_seen(result.incidents).collect()] == [("BRUTE_FORCE", 7), ("SQL_INJECTION", 7)]


def test_lines_with_stats_and_formats_alone(spark):
    entries, stats = parsing.parse_logs_with_stats(from_lines(spark, LINES), config=CONFIG)
    assert entries.count() == 7 and stats.first()["parsed_lines"] == 7 and "raw_message" in entries.columns
    only = parsing.parse(from_lines(spark, LINES), config=CONFIG, formats=parsing.FORMATS[2:])
    assert only.where("outcome = 'parsed'").count() == 2 and detectors.statistics(only.where("outcome = 'parsed'")).first()["http_requests"] == 2


def test_diagnostics_log(spark, caplog):
    log = setup_logging("warning")
    assert log.level == logging.WARNING and setup_logging("nonsense").level == logging.INFO and len(log.handlers) == 1 and not log.propagate
    log.propagate = True
    setup_logging(verbose=True).propagate = True
    with caplog.at_level(logging.DEBUG):
        analyze_lines(spark, LINES[:1], CONFIG)
    log.propagate = False
    assert any("detectors: brute_force" in m for m in caplog.messages) and get_logger("x").name == "quarrylog.x"
