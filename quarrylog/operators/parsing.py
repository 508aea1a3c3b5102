"""Classifying and parsing lines: SSH authentication, Windows authentication, web access.

Each format runs one regular expression over a line: its groups are put between separators and split. The entry of a line
leaves through a generator, so that filters on it don't push the expressions below and run them again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig
from quarrylog.exceptions import ParseError
from quarrylog.functions.text import normalize_line
from quarrylog.plans.lineage import cut

#: The grammars, in the order in which formats claim a line.
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
LINUX_HINT = r"(?U)sshd\[\d+\]:"
WINDOWS_HINT = r"(?U)EVENT_ID=\d+"
APACHE_HINT = rf'(?U)^{IP}\s+\S+\s+\S+\s+\[[^\]]+\]\s+"'
LINUX = (
    r"(?Us)^(\w+\s+\d+\s+\d+:\d+:\d+)\s+\S+\s+sshd\[\d+\]:\s+"
    rf"(?:(Accepted|Failed)\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+({IP})\s+port\s+\d+|Invalid\s+user\s+(\S+)\s+from\s+({IP})).*"
)
WINDOWS = rf"(?Us)^(\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?)\s+EVENT_ID=(\d+)\s+USER=(\S+)\s+IP=({IP}).*"
ZONE = r"(?:[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z)"
APACHE = rf'(?Us)^({IP})\s+\S+\s+\S+\s+\[([^\]]+?)\s+{ZONE}\]\s+"([A-Z]+)\s+([^\n]+?)\s+HTTP/\d(?:\.\d)?"\s+(\d{{3}}).*'
#: Stands between fields; like Python, lines count the four information separators as white space.
MARK, SPACES = "\x1f", "\x1c\x1d\x1e\x1f"
OWN = ("value", "source", "timestamp", "username", "ip_address", "request", "method", "path", "status_code", "outcome", "status", "event_type")


def _entry(text: Column, pattern: str, groups: str, fields: Callable[[list[Column]], dict[str, Column]]) -> Column:
    """The struct of a line's fields, null where the pattern does not match; ``fields`` gets the matched groups."""
    order = ("timestamp", "username", "ip_address", "ok", "request", "method", "status_code")
    n = groups.count(MARK) + 1
    blank = {"username": F.lit("-"), "request": F.lit(""), "method": F.lit(""), "status_code": F.lit(None)}
    types = {"timestamp": "timestamp_ntz", "ok": "boolean", "status_code": "int"}

    def build(p: Column) -> Column:
        found = blank | fields([F.get(p, F.lit(k)) for k in range(n)])
        return F.when(F.size(p) == n, F.struct(*[found[c].cast(types.get(c, "string")).alias(c) for c in order]))

    parts = F.split(F.regexp_replace(F.translate(text, SPACES, "    "), pattern, groups), MARK)
    return F.get(F.transform(F.array(parts), build), F.lit(0))


def linux_entry(text: Column, year: int = 2026) -> Column:
    """The fields of an SSH line as a struct; its timestamp is null where the stamp is no date of that year."""

    def fields(g: list[Column]) -> dict[str, Column]:
        stamp = F.concat(F.lit(f"{year} "), F.regexp_replace(g[0], r"(?U)\s+", " "))
        return {"timestamp": F.try_to_timestamp(stamp, F.lit("yyyy MMM d H:m:s")), "ok": g[1] == "Accepted", "username": g[2], "ip_address": g[3]}

    return _entry(text, LINUX, MARK.join(("$1", "$2", "$3$5", "$4$6")), fields)


def windows_entry(text: Column, year: int = 2026) -> Column:
    """The fields of a Windows line as a struct; ok is null for events other than logins."""

    def fields(g: list[Column]) -> dict[str, Column]:
        return {"timestamp": g[0].try_cast("timestamp_ntz"), "ok": F.when(g[1] == "4624", True).when(g[1] == "4625", False), "username": g[2], "ip_address": g[3]}

    return _entry(text, WINDOWS, MARK.join(("$1", "$2", "$3", "$4")), fields)


def apache_entry(text: Column, year: int = 2026) -> Column:
    """The fields of an access line as a struct; the zone must be there and is not applied."""

    def fields(g: list[Column]) -> dict[str, Column]:
        code = g[4].try_cast("int")
        return {"timestamp": F.try_to_timestamp(g[1], F.lit("d/MMM/yyyy:H:m:s")), "ok": code < 400, "ip_address": g[0], "request": g[3], "method": g[2], "status_code": code}

    return _entry(text, APACHE, MARK.join(("$1", "$2", "$3", "$4", "$5")), fields)


@dataclass(frozen=True)
class Format:
    """A log format: which lines it claims, and the struct of their fields (null: malformed)."""

    source: str
    claims: Callable[[Column], Column]
    entry: Callable[[Column, int], Column]


FORMATS = (
    Format("linux", lambda c: c.contains("sshd[") & c.rlike(LINUX_HINT), linux_entry),
    Format("windows", lambda c: c.contains("EVENT_ID=") & c.rlike(WINDOWS_HINT), windows_entry),
    Format("apache", lambda c: c.rlike(APACHE_HINT), apache_entry),
)


def parse(lines: DataFrame, year: int | None = None, config: AnalyzerConfig | None = None, formats: Sequence[Format] = FORMATS) -> DataFrame:
    """``lines`` (value and others, such as line_no) with outcome (parsed, malformed, unsupported) and the fields of an entry.

    The first format that claims a line has it; a claimed line that does not parse is malformed. Blank and null lines are
    unsupported. ``year`` goes before the configuration's. Columns of ``lines`` with the names of fields are replaced.
    """
    if "value" not in lines.columns:
        raise ParseError("lines need a column value")
    year = year if year is not None else (config or AnalyzerConfig()).default_log_year
    rest = [c for c in lines.columns if c not in OWN]
    df = lines.select(*rest, normalize_line(F.col("value")).alias("value"))
    source, entry = F.lit(None).cast("string"), None
    for f in formats[::-1]:
        source = F.when(f.claims(F.col("value")), f.source).otherwise(source)
    df = df.select(*rest, "value", source.alias("source"))
    for f in formats:
        made = f.entry(F.col("value"), year)
        entry = F.when(F.col("source") == f.source, made) if entry is None else entry.when(F.col("source") == f.source, made)
    df = df.select(*rest, "value", "source", F.explode(F.array(entry)).alias("e"))
    apache = F.col("source") == "apache"
    whole = F.col("e.timestamp").isNotNull() & F.col("e.ok").isNotNull()
    return df.select(
        *rest,
        "value",
        "source",
        *[F.col(f"e.{c}") for c in ("timestamp", "username", "ip_address", "request", "method")],
        F.col("e.request").alias("path"),
        "e.status_code",
        F.when(F.col("source").isNull(), "unsupported").when(whole, "parsed").otherwise("malformed").alias("outcome"),
        F.when(F.col("e.ok"), "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(apache, "HTTP_REQUEST").when(F.col("e.ok"), "LOGIN_SUCCESS").otherwise("LOGIN_FAILED").alias("event_type"),
    )


def parse_logs(lines: DataFrame, year: int | None = None, config: AnalyzerConfig | None = None, formats: Sequence[Format] = FORMATS) -> DataFrame:
    """The entries of the lines that parse; raw_message is the normalized line."""
    return parse(lines, year, config, formats).where("outcome = 'parsed'").drop("outcome").withColumnRenamed("value", "raw_message")


def parse_logs_with_stats(lines: DataFrame, year: int | None = None, config: AnalyzerConfig | None = None, formats: Sequence[Format] = FORMATS) -> tuple[DataFrame, DataFrame]:
    """``parse_logs`` and ``parse_stats`` of the same lines, which are parsed once and written."""
    parsed = cut(parse(lines, year, config, formats))
    return parsed.where("outcome = 'parsed'").drop("outcome").withColumnRenamed("value", "raw_message"), parse_stats(parsed, formats)


def parse_stats(parsed: DataFrame, formats: Sequence[Format] = FORMATS) -> DataFrame:
    """One row of counts over the rows of ``parse``; parsed lines by format."""
    count = lambda c: F.count_if(c).cast("long")
    is_parsed = F.col("outcome") == "parsed"
    return parsed.agg(
        F.count("*").alias("total_lines"), count(is_parsed).alias("parsed_lines"), count(F.col("outcome") == "malformed").alias("malformed_lines"), count(F.col("outcome") == "unsupported").alias("unsupported_lines"),
        *[count(is_parsed & (F.col("source") == f.source)).alias(f"{f.source}_lines") for f in formats],
    )
