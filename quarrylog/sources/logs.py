"""Reading log lines, and log tables derived from ``events`` by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylog.exceptions import LogFileError
from quarrylog.functions.text import normalize_line

#: Addresses with a known place (ip, city, latitude, longitude, country).
PLACES = (
    ("203.0.113.10", "Mumbai", 19.0760, 72.8777, "IN"),
    ("203.0.113.20", "Pune", 18.5204, 73.8567, "IN"),
    ("203.0.113.30", "Delhi", 28.6139, 77.2090, "IN"),
    ("203.0.113.40", "Bengaluru", 12.9716, 77.5946, "IN"),
    ("198.51.100.10", "London", 51.5074, -0.1278, "GB"),
    ("198.51.100.50", "New York", 40.7128, -74.0060, "US"),
    ("198.51.100.60", "Singapore", 1.3521, 103.8198, "SG"),
    ("192.0.2.10", "Mumbai", 19.0760, 72.8777, "IN"),
    ("192.0.2.50", "New York", 40.7128, -74.0060, "US"),
)
_IPS = [p[0] for p in PLACES] + ["10.0.0.7", "10.0.0.8"]
_PATHS = ["/products", "/search?q=1+UNION+SELECT+name", "/a?x=%3Cscript%3Ealert(1)", "/admin/users", "/item?id=1%27+OR+%271%27=%271", "/scripts/app.js", "/img?s=%3Cimg+onerror%3Dx"]


def _pick(n: str, values: list[str]) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in enumerate(values))
    return f"CASE ({n}) % {len(values)} {cases} END"


ENTRIES_SQL = f"""SELECT event_id AS line_no, ts AS timestamp,
 CASE WHEN event_type IN ('view', 'click') THEN '-' WHEN user_id % 10 = 0 THEN 'admin' ELSE concat('user', CAST(user_id % 40 AS STRING)) END AS username,
 {_pick('user_id + event_id % 3', _IPS)} AS ip_address,
 CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
 CASE WHEN event_type IN ('error', 'signup') THEN CASE event_id % 2 WHEN 0 THEN 'linux' ELSE 'windows' END ELSE 'apache' END AS source,
 CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'signup' THEN 'LOGIN_SUCCESS' ELSE 'HTTP_REQUEST' END AS event_type,
 CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE {_pick('event_id', _PATHS)} END AS request,
 CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE CASE event_id % 4 WHEN 0 THEN 404 ELSE 200 END END AS status_code
 FROM events"""


def log_entries(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    events = spark.read.parquet(path := f"{sf_dir}/events.parquet")
    if stream:
        events = spark.readStream.schema(events.schema).parquet(path.removesuffix("t") + "[t]")  # a stream reads folders or patterns
    return spark.sql(ENTRIES_SQL.replace("FROM events", "FROM {events}"), events=events)


def read_log_file(spark: SparkSession, path: str) -> DataFrame:
    """``read_lines`` of one file; a ``LogFileError`` if there is none at ``path`` or it is a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise LogFileError(f"Log file not found: {path}")
    if not files.getFileStatus(at).isFile():
        raise LogFileError(f"Path is not a file: {path}")
    return read_lines(spark, path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line_no, value)`` of text files without their blank lines; line_no counts all lines from 0, by file name, then place.

    Lines are counted in each split first (a row for each split), so the files are read twice and never sorted.
    """
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("id"))
    splits = df.groupBy("f", "s").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("f", "s", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    lines = df.join(splits, ["f", "s"]).select((F.col("past") + F.col("id") - F.col("low")).alias("line_no"), F.explode(F.array(normalize_line(F.col("value")))).alias("value"))
    return lines.where("value <> ''")


def from_lines(spark: SparkSession, lines: Iterable[str | None]) -> DataFrame:
    """``(line_no, value)`` of lines in memory, blank ones included."""
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLACES), "ip string, city string, lat double, lon double, country string")
