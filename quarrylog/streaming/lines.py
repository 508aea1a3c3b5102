"""Log lines as a stream: parsing, web alerts and running counts, with state that the watermark bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig
from quarrylog.functions.text import normalize_line
from quarrylog.operators import correlation, detectors, parsing
from quarrylog.streaming.state import event_time


def read_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``(line_no, value)`` of the text files that come into a folder, without blank lines.

    A stream knows no line numbers: line_no is a hash of the file and the line, which tells lines of one time apart in an
    order that does not depend on when they came. Equal lines of one file share it.
    """
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    df = reader.format("text").load(folder).select(F.col("_metadata.file_path").alias("f"), F.explode(F.array(normalize_line(F.col("value")))).alias("value"))
    return df.where("value <> ''").select(F.xxhash64("f", "value").alias("line_no"), "value")


def entries(lines: DataFrame, config: AnalyzerConfig | None = None, formats: Sequence[parsing.Format] = parsing.FORMATS) -> DataFrame:
    """The entries of a stream of lines, which may be unbounded: nothing is held."""
    return parsing.parse_logs(lines, None, config, formats)


def web_alerts(found: DataFrame, delay: str = "10 minutes", banks: Sequence[tuple] = (detectors.SQLI_BANK, detectors.XSS_BANK)) -> DataFrame:
    """Alerts of both web rules with alert_id, each once within the watermark's delay; in append mode."""
    alerts = event_time(detectors.web_alerts(found, banks), delay)
    return correlation.with_id(alerts.select(*detectors.ALERT, "event_time")).dropDuplicatesWithinWatermark(["alert_id"])


def running_parse_stats(parsed: DataFrame) -> DataFrame:
    """``(source, outcome, n)`` of all rows of ``parsing.parse`` so far, in update or complete mode; a row for each source and outcome."""
    return parsed.groupBy(F.coalesce("source", F.lit("")).alias("source"), "outcome").agg(F.count("*").alias("n"))


def running_counts(found: DataFrame, span: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of each span of time, source and event type, in update or append mode; users and addresses are estimated.

    A span's counts leave the state once the watermark has passed it. Distinct users leave out "-", as in ``statistics``;
    exact distinct counts would need all of them as state.
    """
    df = event_time(found, delay)
    by = df.groupBy(F.window("event_time", span).alias("w"), "source", "event_type")
    counts = by.agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("username") != "-", F.col("username"))).alias("users"), F.approx_count_distinct("ip_address").alias("ips"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "event_type", "n", "users", "ips")


def running_alert_counts(alerts: DataFrame) -> DataFrame:
    """``(alert_type, severity, n)`` so far, in update or complete mode; a row for each type and severity."""
    return alerts.groupBy("alert_type", F.upper("severity").alias("severity")).agg(F.count("*").alias("n"))
