"""The library's functions for SQL texts: temporary SQL functions, which the optimizer expands where they are called.

``register`` defines, in a session: ``normalize_line(line)``, ``log_format(line)``, ``parse_log_line(line, year)`` (a struct;
``LATERAL VIEW inline(array(it))`` over a subquery makes columns of it and parses a line once), ``url_decoded(request)``, ``html_unescape(text)``, ``normalize_request(request)``,
``sqli_match(request)`` and ``xss_match(request)`` (struct of pattern, confidence, risk_score; null if none matches),
``haversine_km(lat1, lon1, lat2, lon2)`` and ``unusual_hour(at, start, end)``. ``register_views`` names an analysis's tables. No
Python runs in any of them. Grammars and pattern banks are those of ``operators``; nulls give what the column functions give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.config import AnalyzerConfig
from quarrylog.functions.text import BARE, ENTITY, NAMES, ODD
from quarrylog.operators import detectors, parsing

ENTRY = "outcome: STRING, source: STRING, timestamp: TIMESTAMP_NTZ, username: STRING, ip_address: STRING, status: STRING, event_type: STRING, request: STRING, method: STRING, path: STRING, status_code: INT"


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _format(v: str) -> str:
    linux, windows, apache = map(quoted, (parsing.LINUX_HINT, parsing.WINDOWS_HINT, parsing.APACHE_HINT))
    return f"CASE WHEN contains({v}, 'sshd[') AND {v} RLIKE {linux} THEN 'linux' WHEN contains({v}, 'EVENT_ID=') AND {v} RLIKE {windows} THEN 'windows' WHEN {v} RLIKE {apache} THEN 'apache' END"


def _groups(v: str, pattern: str, *groups: str) -> str:
    """The groups of a line as an array; of another size where the pattern doesn't match."""
    return f"split(regexp_replace(translate({v}, {quoted(parsing.SPACES)}, '    '), {quoted(pattern)}, {quoted(parsing.MARK.join(groups))}), {quoted(parsing.MARK)})"


def _entry() -> str:
    """Step by step over an array of one element, so that each step's values are computed once."""
    steps = (
        ("v", f"named_struct('v', v, 'f', {_format('v')})"),
        ("x", f"""named_struct('f', x.f, 'p', CASE x.f WHEN 'linux' THEN {_groups('x.v', parsing.LINUX, '$1', '$2', '$3$5', '$4$6')} WHEN 'windows' THEN {_groups('x.v', parsing.WINDOWS, '$1', '$2', '$3', '$4')}
 WHEN 'apache' THEN {_groups('x.v', parsing.APACHE, '$1', '$2', '$3', '$4', '$5')} END)"""),
        ("x", "named_struct('f', x.f, 'p', CASE WHEN size(x.p) = CASE x.f WHEN 'apache' THEN 5 ELSE 4 END THEN x.p END)"),
        ("x", f"""named_struct('f', x.f, 'p', x.p, 'at', CASE x.f WHEN 'linux' THEN CAST(try_to_timestamp(concat(CAST(year AS STRING), ' ', regexp_replace(get(x.p, 0), {quoted('(?U)' + chr(92) + 's+')}, ' ')), 'yyyy MMM d H:m:s') AS TIMESTAMP_NTZ)
 WHEN 'windows' THEN try_cast(get(x.p, 0) AS TIMESTAMP_NTZ) WHEN 'apache' THEN CAST(try_to_timestamp(get(x.p, 1), 'd/MMM/yyyy:H:m:s') AS TIMESTAMP_NTZ) END,
 'ok', CASE x.f WHEN 'linux' THEN get(x.p, 1) = 'Accepted' WHEN 'windows' THEN CASE get(x.p, 1) WHEN '4624' THEN true WHEN '4625' THEN false END WHEN 'apache' THEN try_cast(get(x.p, 4) AS INT) < 400 END)"""),
        ("x", """named_struct('outcome', CASE WHEN x.f IS NULL THEN 'unsupported' WHEN x.at IS NOT NULL AND x.ok IS NOT NULL THEN 'parsed' ELSE 'malformed' END, 'source', x.f, 'timestamp', x.at,
 'username', CASE WHEN x.p IS NOT NULL THEN CASE WHEN x.f = 'apache' THEN '-' ELSE get(x.p, 2) END END, 'ip_address', get(x.p, CASE WHEN x.f = 'apache' THEN 0 ELSE 3 END), 'status', CASE WHEN x.ok THEN 'SUCCESS' ELSE 'FAILED' END,
 'event_type', CASE WHEN x.f = 'apache' THEN 'HTTP_REQUEST' WHEN x.ok THEN 'LOGIN_SUCCESS' ELSE 'LOGIN_FAILED' END, 'request', CASE WHEN x.p IS NOT NULL THEN CASE WHEN x.f = 'apache' THEN get(x.p, 3) ELSE '' END END,
 'method', CASE WHEN x.p IS NOT NULL THEN CASE WHEN x.f = 'apache' THEN get(x.p, 2) ELSE '' END END, 'path', CASE WHEN x.p IS NOT NULL THEN CASE WHEN x.f = 'apache' THEN get(x.p, 3) ELSE '' END END,
 'status_code', CASE WHEN x.f = 'apache' THEN try_cast(get(x.p, 4) AS INT) END)"""),
    )
    made = "array(normalize_line(line))"
    for name, step in steps:
        made = f"transform({made}, {name} -> {step})"
    return f"get({made}, 0)"


def _reference(piece: str) -> str:
    """What stands behind an ampersand, with the reference at its beginning undone."""
    text = lambda name: f"try_element_at(try_element_at(from_json({quoted(NAMES)}, 'map<string,map<string,string>>'), substring({name}, 1, 1)), {name})"
    found = lambda pattern: f"regexp_extract({piece}, {quoted(pattern)}, 0)"
    whole, bare, number = found(r"^[^\t\n\f <&#;]{1,32};"), found(f"^(?:{BARE})"), found(r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?")
    steps = (
        ("x", f"named_struct('whole', {whole}, 'bare', {bare}, 'number', {number})"),
        ("x", f"named_struct('number', x.number, 'digits', regexp_replace(x.number, '^#[xX]?0*|;$', ''), 'name', CASE WHEN {text('x.whole')} IS NOT NULL THEN x.whole ELSE nullif(x.bare, '') END)"),
        ("x", "named_struct('number', x.number, 'name', x.name, 'value', CASE WHEN length(x.digits) > 8 THEN 1114112L ELSE coalesce(CAST(nullif(CASE WHEN substring(x.number, 2, 1) IN ('x', 'X') THEN conv(x.digits, 16, 10) ELSE x.digits END, '') AS BIGINT), 0L) END)"),
        ("x", f"""CASE WHEN x.number <> '' THEN concat(coalesce(try_element_at(from_json({quoted(ODD)}, 'map<string,string>'), CAST(x.value AS STRING)), CASE WHEN x.value BETWEEN 55296 AND 57343 OR x.value > 1114111 THEN '�' ELSE decode(unhex(lpad(hex(x.value), 8, '0')), 'UTF-32') END), substr({piece}, length(x.number) + 1))
 WHEN x.name IS NOT NULL THEN concat({text('x.name')}, substr({piece}, length(x.name) + 1)) ELSE concat('&', {piece}) END"""),
    )
    made = "array(1)"
    for name, step in steps:
        made = f"transform({made}, {name} -> {step})"
    return f"get({made}, 0)"


def _match(bank: tuple) -> str:
    """The surest pattern, of equals the riskiest, then the first listed."""
    best = sorted(bank[2], key=lambda p: (-p[2], -p[3]))
    cases = " ".join(f"WHEN q RLIKE {quoted('(?U)' + p)} THEN named_struct('pattern', {quoted(n)}, 'confidence', {c!r}D, 'risk_score', {r})" for n, p, c, r in best)
    return f"get(transform(array(normalize_request(request)), q -> CASE {cases} END), 0)"


def _functions() -> list[tuple[str, str, str]]:
    """(signature, type, body), each after those that it calls."""
    spaces, ends = quoted(r"(?U)[\s\x1c-\x1f]+"), quoted(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")
    decoded = "coalesce(request, '')"
    for _ in range(2):
        decoded = f"try_url_decode(regexp_replace({decoded}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"
    pieces = "split(text, '&', -1)"
    undone = f"concat(get({pieces}, 0), array_join(transform(slice({pieces}, 2, size({pieces})), piece -> {_reference('piece')}), ''))"
    hit = "STRUCT<pattern: STRING, confidence: DOUBLE, risk_score: INT>"
    half = lambda a, b: f"pow(sin(radians({b} - {a}) / 2), 2)"
    return [
        ("normalize_line(line STRING)", "STRING", f"regexp_replace(regexp_replace(coalesce(line, ''), {ends}, ''), {quoted('^' + chr(92) + 'uFEFF+')}, '')"),
        ("log_format(line STRING)", "STRING", _format("line")),
        ("parse_log_line(line STRING, year INT)", f"STRUCT<{ENTRY}>", _entry()),
        ("url_decoded(request STRING)", "STRING", decoded),
        ("html_unescape(text STRING)", "STRING", f"CASE WHEN text RLIKE {quoted(ENTITY)} THEN {undone} ELSE text END"),
        ("normalize_request(request STRING)", "STRING", f"trim(regexp_replace(lower(html_unescape(url_decoded(request))), {spaces}, ' '))"),
        ("sqli_match(request STRING)", hit, _match(detectors.SQLI_BANK)),
        ("xss_match(request STRING)", hit, _match(detectors.XSS_BANK)),
        ("haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)", "DOUBLE", f"2 * 6371.0D * asin(sqrt({half('lat1', 'lat2')} + cos(radians(lat1)) * cos(radians(lat2)) * {half('lon1', 'lon2')}))"),
        ("unusual_hour(at TIMESTAMP_NTZ, start INT, until INT)", "BOOLEAN", "CASE WHEN start <= until THEN hour(at) >= start AND hour(at) < until ELSE hour(at) >= start OR hour(at) < until END"),
    ]


def register(spark: SparkSession) -> list[str]:
    """Defines (or defines anew) the functions in the session; their names."""
    made = _functions()
    for signature, kind, body in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in made]


def register_views(spark: SparkSession, lines: DataFrame, config: AnalyzerConfig | None = None) -> list[str]:
    """Names the tables of ``lines`` (line_no, value) for SQL: parsed_lines, log_entries, parse_stats, log_statistics, web_alerts, insider_scores, entity_features.

    Views are plans, not results: a query's filters and columns reach the lines.
    """
    parsed = parsing.parse(lines, config=config)
    entries = parsing.parse_logs(lines, config=config)
    tables = {
        "parsed_lines": parsed, "log_entries": entries, "parse_stats": parsing.parse_stats(parsed), "log_statistics": detectors.statistics(entries), "web_alerts": detectors.web_alerts(entries),
        "insider_scores": detectors.insider_scores(entries, config), "entity_features": detectors.entity_features(entries, config=config),
    }
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return list(tables)
