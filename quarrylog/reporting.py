"""Reports as tables: each is a DataFrame and is written by Spark as a folder of part files, whatever its size."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.exceptions import ReportGenerationError
from quarrylog.operators.correlation import SEVERITIES
from quarrylog.service import AnalysisResult

KINDS = ("json", "csv", "summary")
#: The columns of the tables.
ALERT_COLUMNS = ("alert_id", "alert_type", "severity", "timestamp", "username", "ip_address", "source", "description", "confidence", "risk_score", "evidence")
INCIDENT_COLUMNS = ("incident_id", "incident_type", "severity", "risk_score", "first_seen", "last_seen", "source_ips", "usernames", "alert_count", "description")


def iso(c: str) -> Column:
    """A time as text, with a fraction only where there is one."""
    return F.col(c).cast("string").alias(c)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """The alerts as flat rows; evidence is JSON."""
    return alerts.select(*[iso(c) if c == "timestamp" else F.col(c) for c in ALERT_COLUMNS])


def incident_rows(incidents: DataFrame) -> DataFrame:
    """The incidents as flat rows; lists are joined by "; "."""
    shown = {"first_seen": iso("first_seen"), "last_seen": iso("last_seen")} | {c: F.array_join(c, "; ").alias(c) for c in ("source_ips", "usernames")}
    return incidents.select(*[shown.get(c, F.col(c)) for c in INCIDENT_COLUMNS])


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: how many rows have each of the four severities, in any case."""
    return found.agg(*[F.count_if(F.upper("severity") == s).alias(s) for s in SEVERITIES[::-1]])


def attack_type_counts(alerts: DataFrame) -> DataFrame:
    """``(alert_type, n)``, the most frequent first, then by name; alerts without a type are left out."""
    return alerts.where("alert_type <> ''").groupBy("alert_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "alert_type")


def summary(result: AnalysisResult, top: int = 5) -> DataFrame:
    """One row: totals, severities, the most frequent attack types and the incident of the highest risk."""
    count = lambda s: F.count_if(F.upper("severity") == s)
    alerts = result.alerts.agg(F.count("*").alias("total_alerts"), *[count(s).alias(f"{s.lower()}_alerts") for s in SEVERITIES[::-1]])
    first = F.max(F.struct("risk_score", -F.unix_micros(F.col("first_seen").cast("timestamp")), "incident_id", "severity"))
    incidents = result.incidents.agg(F.count("*").alias("total_incidents"), *[count(s).alias(f"{s.lower()}_incidents") for s in SEVERITIES[::-1]], first.alias("m"))
    incidents = incidents.withColumn("highest_risk_score", F.coalesce("m.risk_score", F.lit(0))).withColumn("highest_risk_incident", F.col("m.incident_id")).withColumn("highest_risk_severity", F.col("m.severity")).drop("m")
    types = attack_type_counts(result.alerts).limit(top).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "alert_type"))), lambda x: x["alert_type"]).alias("top_threats"))
    stats = result.statistics.select(F.col("total").alias("total_events"))
    head = stats.select(F.lit(result.input_file).alias("input_file"), F.lit(str(result.analyzed_at)).alias("analyzed_at"), F.lit(round(result.duration_seconds, 4)).alias("duration_seconds"), "total_events")
    for part in (alerts, incidents, types):  # one row each
        head = head.withColumn("__one", F.lit(1)).join(part.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return head


def report_document(result: AnalysisResult) -> DataFrame:
    """One row of structs: analysis, statistics and summary. Alerts and incidents are tables of their own beside it."""
    one = lambda df, name: df.select(F.lit(1).alias("__one"), F.struct(*df.columns).alias(name))
    out = one(result.parse_stats, "analysis").join(one(result.statistics, "statistics"), "__one").join(one(summary(result), "summary"), "__one")
    return out.drop("__one")


def summary_lines(result: AnalysisResult) -> DataFrame:
    """The summary as lines of text (value), in order."""
    s = summary(result)
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.array_join(c, ", ") if c == "top_threats" else F.col(c).cast("string"), F.lit("N/A"))) for c in s.columns]
    return s.select(F.explode(F.array(*shown)).alias("value"))


def write_reports(result: AnalysisResult, folder: str, kinds: Sequence[str] | str | None = None) -> dict[str, str]:
    """Writes the reports of ``kinds`` (None or "all": all; unknown ones are ignored) and returns their folders by name.

    A ``ReportGenerationError`` tells of a folder that can't be written.
    """
    wanted = KINDS if kinds is None or kinds == "all" or "all" in kinds else kinds
    tables = []
    if "json" in wanted:
        tables += [("report_json", report_document(result).write.mode("overwrite").format("json")), ("alerts_json", alert_rows(result.alerts).write.mode("overwrite").format("json")), ("incidents_json", result.incidents.write.mode("overwrite").format("json"))]
    if "csv" in wanted:
        quoted = {"header": True, "escape": '"', "emptyValue": ""}
        tables += [("alerts_csv", alert_rows(result.alerts).write.mode("overwrite").format("csv").options(**quoted)), ("incidents_csv", incident_rows(result.incidents).write.mode("overwrite").format("csv").options(**quoted))]
    if "summary" in wanted:
        tables.append(("summary", summary_lines(result).write.mode("overwrite").format("text")))
    paths = {name: f"{folder}/{name}" for name, _ in tables}
    for name, writer in tables:
        try:
            writer.save(paths[name])
        except (Py4JJavaError, PySparkException) as error:
            raise ReportGenerationError(f"Unable to write {name}: {error}") from error
    return paths
