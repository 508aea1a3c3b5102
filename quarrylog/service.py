"""From lines to incidents in one call: parse, count, detect, deduplicate, correlate, score."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig
from quarrylog.diagnostics import get_logger
from quarrylog.operators import anomaly, correlation, detectors, parsing
from quarrylog.plans.lineage import cut
from quarrylog.sources import logs

log = get_logger("service")


@dataclass(frozen=True)
class DetectorSpec:
    """A detector by name: its alerts (columns ``detectors.ALERT``), and whether the configuration wants it."""

    name: str
    detect: Callable[[DataFrame, AnalyzerConfig], DataFrame]
    is_enabled: Callable[[AnalyzerConfig], bool]


def _web(entries: DataFrame, c: AnalyzerConfig) -> DataFrame:
    banks = [bank for bank, wanted in ((detectors.SQLI_BANK, c.sql_injection.enabled), (detectors.XSS_BANK, c.xss.enabled)) if wanted]
    return detectors.web_alerts(entries, banks)


def detectors_with(places: DataFrame | None = None) -> tuple[DetectorSpec, ...]:
    """The rules in the order of their alerts, then the forest. Both web rules share one pass, which normalizes requests once.

    ``places``: addresses with their place (ip, city, lat, lon, country), one row an address; the built-in ones if none are given.
    """

    def travel(entries: DataFrame, c: AnalyzerConfig) -> DataFrame:
        return detectors.impossible_travel(entries, places if places is not None else logs.places(entries.sparkSession), c)

    return (
        DetectorSpec("brute_force", detectors.brute_force, lambda c: c.brute_force.enabled),
        DetectorSpec("password_spray", detectors.password_spray, lambda c: c.password_spray.enabled),
        DetectorSpec("web", _web, lambda c: c.sql_injection.enabled or c.xss.enabled),
        DetectorSpec("impossible_travel", travel, lambda c: c.impossible_travel.enabled),
        DetectorSpec("insider_threat", detectors.insider_threat, lambda c: c.insider_threat.enabled),
        DetectorSpec("anomaly", anomaly.anomalies, lambda c: c.anomaly.enabled),
    )


DETECTORS = detectors_with()


@dataclass(frozen=True)
class AnalysisResult:
    """What an analysis gives. alerts and incidents are written once; parse_stats and statistics have one row each."""

    input_file: str
    analyzed_at: datetime
    duration_seconds: float
    entries: DataFrame
    parse_stats: DataFrame
    statistics: DataFrame
    alerts: DataFrame
    incidents: DataFrame


def find_alerts(entries: DataFrame, config: AnalyzerConfig | None = None, specs: Sequence[DetectorSpec] = DETECTORS) -> DataFrame:
    """The alerts of all wanted detectors without repeats, with alert_id, and seq, the detector's place."""
    config = config or AnalyzerConfig()
    wanted = [(k, s) for k, s in enumerate(specs) if s.is_enabled(config)]
    log.debug("detectors: %s", ", ".join(s.name for _, s in wanted))
    parts = [s.detect(entries, config).select(*detectors.ALERT, F.lit(k).alias("seq")) for k, s in wanted]
    if not parts:
        return correlation.deduplicate(detectors.web_alerts(entries, ()))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return correlation.deduplicate(out)


class AnalysisService:
    """Runs the analysis under a configuration, with any of its parts replaced by one's own.

    ``formats`` are the log formats in the order in which they claim lines, ``places`` a table of addresses (see
    ``detectors_with``), ``specs`` the detectors (``places`` then has no effect). The rest are functions: ``read`` (session, path) to lines,
    ``parse`` (lines, configuration, formats) to classified lines, ``statistics`` of entries, ``correlate`` (alerts, configuration) to incidents and ``score``
    (incidents, configuration) to scored ones.
    """

    def __init__(
        self, config: AnalyzerConfig | None = None, specs: Sequence[DetectorSpec] | None = None, *, formats: Sequence[parsing.Format] = parsing.FORMATS, places: DataFrame | None = None,
        read: Callable[[SparkSession, str], DataFrame] = logs.read_log_file, parse: Callable[[DataFrame, AnalyzerConfig, Sequence[parsing.Format]], DataFrame] = lambda lines, c, formats: parsing.parse(lines, None, c, formats),
        statistics: Callable[[DataFrame], DataFrame] = detectors.statistics, correlate: Callable[[DataFrame, AnalyzerConfig], DataFrame] = correlation.correlate, score: Callable[[DataFrame, AnalyzerConfig], DataFrame] = correlation.score,
    ) -> None:
        self.config, self.formats = config or AnalyzerConfig(), tuple(formats)
        self.specs = tuple(specs) if specs is not None else detectors_with(places)
        self.read, self.parse, self.statistics, self.correlate, self.score = read, parse, statistics, correlate, score

    def analyze_file(self, spark: SparkSession, path: str) -> AnalysisResult:
        """One log file; ``LogFileError`` if there is none."""
        return self.analyze(self.read(spark, path), path)

    def analyze_lines(self, spark: SparkSession, lines: Iterable[str | None], input_file: str = "<memory>") -> AnalysisResult:
        return self.analyze(logs.from_lines(spark, lines), input_file)

    def analyze(self, lines: DataFrame, input_file: str = "<table>") -> AnalysisResult:
        """``lines``: line_no and value, of any size. The parsed lines are written once, as every detector reads them."""
        began, at = time.perf_counter(), datetime.now(UTC).replace(tzinfo=None)
        log.info("analyzing %s", input_file)
        parsed = cut(self.parse(lines, self.config, self.formats))
        entries = parsed.where("outcome = 'parsed'").withColumnRenamed("value", "raw_message").drop("outcome")
        alerts = cut(find_alerts(entries, self.config, self.specs))
        log.debug("alerts of %s are found after %.1f s", input_file, time.perf_counter() - began)
        incidents = cut(self.score(self.correlate(alerts, self.config), self.config))
        took = time.perf_counter() - began
        log.info("analyzed %s in %.1f s", input_file, took)
        return AnalysisResult(input_file, at, took, entries, parsing.parse_stats(parsed, self.formats), self.statistics(entries), alerts.orderBy("seq", "line_no"), correlation.by_risk(incidents))


def analyze_file(spark: SparkSession, path: str, config: AnalyzerConfig | None = None) -> AnalysisResult:
    return AnalysisService(config).analyze_file(spark, path)


def analyze_lines(spark: SparkSession, lines: Iterable[str | None], config: AnalyzerConfig | None = None) -> AnalysisResult:
    return AnalysisService(config).analyze_lines(spark, lines)
