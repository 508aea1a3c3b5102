"""Log files as a data source: byte ranges are read where filters on time and format leave something to find.

    register(spark)
    index_logs(spark, "/shared/logs", "/shared/logs.index")
    spark.read.format("quarrylog").option("index", "/shared/logs.index").load("/shared/logs").where("timestamp >= '2026-06-26' and source = 'linux'")

Rows are those of ``parse_logs`` over ``read_lines``. Filters on ``timestamp`` and ``source`` are pushed down: with an index, ranges without
such lines are not read; in all others lines of other formats and times are dropped before they become rows.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quarrylog.config import AnalyzerConfig
from quarrylog.exceptions import LogFileError
from quarrylog.operators import parsing

SCHEMA = "line_no long, raw_message string, source string, timestamp timestamp_ntz, username string, ip_address string, request string, method string, path string, status_code int, status string, event_type string"
#: Bytes of a range where there is no index, of one read, and rows of a batch.
BLOCK, CHUNK, ROWS = 64 << 20, 1 << 20, 4096
#: Compressed files have no byte ranges.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".xz", ".deflate")
#: The months in log stamps.
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
TO_SPACE = {ord(c): " " for c in parsing.SPACES}
TO_NUL = {ord(c): "\0" for c in parsing.SPACES}
HINTS = [(s, re.compile(p.replace("(?U)", ""))) for s, p in (("linux", parsing.LINUX_HINT), ("windows", parsing.WINDOWS_HINT), ("apache", parsing.APACHE_HINT))]
LINUX, WINDOWS, APACHE = (re.compile(p.replace("(?Us)", "(?s)")) for p in (parsing.LINUX, parsing.WINDOWS, parsing.APACHE))
STAMPS = {
    "linux": re.compile(r"(?a)(?P<mon>\w{3}) (?P<d>\d+) (?P<h>\d+):(?P<m>\d+):(?P<s>\d+)"),
    "windows": re.compile(r"(?a)(?P<y>\d{4})-(?P<mon>\d\d)-(?P<d>\d\d)T(?P<h>\d\d):(?P<m>\d\d):(?P<s>\d\d)(?:\.(?P<f>\d+))?"),
    "apache": re.compile(r"(?a)(?P<d>\d+)/(?P<mon>\w{3})/(?P<y>\d{4}):(?P<h>\d+):(?P<m>\d+):(?P<s>\d+)"),
}


def stamp_of(source: str, text: str, year: int) -> datetime | None:
    """The time of a stamp; None where it is no time of the calendar. Fractions are cut to microseconds."""
    if (m := STAMPS[source].fullmatch(text)) is None:
        return None
    g = m.groupdict()
    month = int(g["mon"]) if source == "windows" else MONTHS.get(g["mon"].lower(), 0)
    micros = int(((g.get("f") or "") + "000000")[:6])
    try:
        return datetime(int(g.get("y") or year), month, int(g["d"]), int(g["h"]), int(g["m"]), int(g["s"]), micros)
    except (ValueError, OverflowError):
        return None


def claimed_by(line: str) -> str | None:
    """The format that claims a normalized line."""
    seen = line.translate(TO_NUL)  # these four are no white space to the hints
    return next((source for source, hint in HINTS if hint.search(seen)), None)


def entry_of(line: str, source: str, year: int) -> tuple | None:
    """The fields of ``SCHEMA`` behind line_no of a normalized line that ``source`` claims; None where it is malformed."""
    text, user, request, method, code = line.translate(TO_SPACE), "-", "", "", None
    if source == "linux":
        if (m := LINUX.match(text)) is None:
            return None
        stamp, user, ip = re.sub(r"\s+", " ", m[1]), m[3] or m[5], m[4] or m[6]
        ok = m[2] == "Accepted"
    elif source == "windows":
        if (m := WINDOWS.match(text)) is None or m[2] not in ("4624", "4625"):
            return None
        stamp, user, ip, ok = m[1], m[3], m[4], m[2] == "4624"
    else:
        if (m := APACHE.match(text)) is None or not m[5].isascii():
            return None
        ip, stamp, method, request, code = m[1], m[2], m[3], m[4], int(m[5])
        ok = code < 400
    if (at := stamp_of(source, stamp, year)) is None:
        return None
    kind = "HTTP_REQUEST" if source == "apache" else "LOGIN_SUCCESS" if ok else "LOGIN_FAILED"
    return line, source, at, user, ip, request, method, request, code, "SUCCESS" if ok else "FAILED", kind


def lines_between(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The lines of ``f`` whose first byte lies from ``start`` to before ``stop``, with that place and their ends (LF, CR or both), a piece of the file at a time."""
    at = max(start - 1, 0)
    f.seek(at)
    skip, rest = start > 0, b""
    while True:
        data = f.read(max(CHUNK, len(rest)))  # the pieces of a very long line double
        pieces = (rest + data).splitlines(keepends=True)
        rest = pieces.pop() if data and pieces and not pieces[-1].endswith(b"\n") else b""  # a CR may be half an end
        for piece in pieces:
            if at >= stop:
                return
            if not skip:
                yield at, piece
            skip, at = False, at + len(piece)
        if not data or (at >= stop and not skip):
            return


@dataclass
class Range(InputPartition):
    """Lines that begin in some bytes of a file, the first of them with the number ``line_no`` (None: numbered by their place in bytes)."""

    path: str
    start: int
    stop: int
    line_no: int | None
    before: int  # bytes of the files before this one


#: Columns whose filters are pushed down, and what the filters ask of a value.
TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v, IsNotNull: lambda x, v: True,
}


def may_hold(kind: type, value, low: datetime, high: datetime) -> bool:
    """Whether a range with times from ``low`` to ``high`` may hold one that passes."""
    if kind in (GreaterThan, GreaterThanOrEqual):
        return TESTS[kind](high, value)
    if kind in (LessThan, LessThanOrEqual):
        return TESTS[kind](low, value)
    if kind is In:
        return any(low <= v <= high for v in value)
    return kind is IsNotNull or low <= value <= high


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not (path := options.get("path")):
            raise LogFileError("no path of log files is given")
        self.path, self.index = path, options.get("index")
        self.block, self.year = int(options.get("block", BLOCK)), int(options.get("year", AnalyzerConfig().default_log_year))
        if self.block < 1:
            raise LogFileError("a block needs a byte at least")
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of timestamp and source with values; all others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if type(f) in TESTS and len(f.attribute) == 1 else None
            wanted = {"timestamp": datetime, "source": str}.get(column)
            values = () if type(f) is IsNotNull else f.value if type(f) is In else (f.value,) if type(f) in TESTS else ()
            plain = column == "timestamp" or type(f) in (EqualTo, In, IsNotNull)
            if wanted and plain and all(isinstance(v, wanted) and getattr(v, "tzinfo", None) is None for v in values):
                self.pushed.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        return all(TESTS[kind](value, v) for c, kind, v in self.pushed if c == column)

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        if self.index:
            return self._indexed(files)
        out, before = [], 0
        for path, size in files:
            out += [Range(path, at, min(at + self.block, size), None, before) for at in range(0, size, self.block)]
            before += size
        return out

    def _indexed(self, files: list[tuple[str, int]]) -> list[Range]:
        """Ranges of the index that may hold lines that pass. An index of other files than those that are there is an error."""
        store, inside, _ = _opened(self.index)
        rows = pyarrow.parquet.read_table(inside, filesystem=store).to_pylist()
        known = {_plain(unquote(r["file"])): r["size"] for r in rows}
        there = {_plain(path): (path, size) for path, size in files if size}
        if known != {name: size for name, (_, size) in there.items()}:
            raise LogFileError(f"the index {self.index} is not of the files that lie in {self.path} now: run index_logs again")
        times = [(kind, v) for c, kind, v in self.pushed if c == "timestamp"]
        found = [r for r in rows if r["low"] is not None and any(self._passes("source", s) for s in r["sources"]) and all(may_hold(k, v, r["low"], r["high"]) for k, v in times)]
        # Spark's ranges hold the line that begins right at their end, not one at their beginning
        return [Range(there[_plain(unquote(r["file"]))][0], r["start"] + 1 if r["start"] else 0, r["start"] + r["length"] + 1, r["line_no"], 0) for r in found]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range is left
            return
        store, inside, _ = _opened(partition.path)
        rows: list[tuple] = []
        with store.open_input_file(inside) as f:
            for k, (place, piece) in enumerate(lines_between(f, partition.start, partition.stop)):
                number = partition.before + place if partition.line_no is None else partition.line_no + k
                line = piece.decode("utf-8", "replace").strip().lstrip("\ufeff")
                source = claimed_by(line)
                if source is None or not self._passes("source", source):
                    continue
                entry = entry_of(line, source, self.year)
                if entry is not None and self._passes("timestamp", entry[2]):
                    rows.append((number, *entry))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), TYPES.values(), strict=True)], names=list(TYPES))


TYPES = {n: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}[t] for n, t in (c.split() for c in SCHEMA.split(", "))}


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The store of a path, the path inside it, and what stands before it. Without a scheme it lies in a local or mounted folder."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(re.sub("^file:(//(?=/))?", "", path)), ""
    path = path.rstrip("/")
    store, inside = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store, inside, path.removesuffix(inside)


def _plain(path: str) -> str:
    """What two spellings of a path have in common."""
    return posixpath.normpath("/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).lstrip("/"))


def _files(path: str) -> list[tuple[str, int]]:
    """The files under a path by name, with their sizes; as Spark does, hidden ones are left out."""
    store, inside, scheme = _opened(path)
    root = store.get_file_info(inside)
    if root.type == pyarrow.fs.FileType.NotFound:
        raise LogFileError(f"Log file not found: {path}")
    found = [root] if root.is_file else store.get_file_info(pyarrow.fs.FileSelector(inside))
    shown = sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    if packed := [path for path, _ in shown if path.endswith(PACKED)]:
        raise LogFileError(f"compressed files have no byte ranges, read_lines reads them: {packed[0]}")
    return shown


class LogSource(DataSource):
    """``spark.read.format("quarrylog")``. Options: ``path``, ``index`` (of ``index_logs``), ``year`` of stamps without one, ``block`` (bytes of a range, without an index).

    ``path`` is a file or the files right in a folder, in a store that Arrow reads by ranges. With an index line_no counts lines as ``read_lines`` does; without one it
    is the place of the line in bytes, over all files by name: as distinct, and in the same order.
    """

    @classmethod
    def name(cls) -> str:
        return "quarrylog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and turns its push-down of filters on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def index_logs(spark: SparkSession, path: str, index: str, year: int | None = None) -> None:
    """Writes what each range of the files holds: its lines and the number of the first, its formats, its first and last time. One file, a row for each range.

    The ranges are those that Spark reads the text in, the lines are parsed in the JVM, and only a row for each range is shuffled.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")).alias("range"))
    parsed = F.col("outcome") == "parsed"
    ranges = parsing.parse(lines, year).groupBy("range").agg(
        F.count("*").alias("n"), F.min(F.when(parsed, F.col("timestamp"))).alias("low"), F.max(F.when(parsed, F.col("timestamp"))).alias("high"),
        F.collect_set(F.when(parsed, F.col("source"))).alias("sources"),
    )
    before = Window.orderBy("range.file", "range.start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranges.select("range.*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("line_no"), "n", "low", "high", "sources")
    numbered.coalesce(1).write.mode("overwrite").parquet(index)
