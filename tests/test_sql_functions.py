"""The functions for SQL texts give what the column functions give, and leave nothing but expressions in the plan."""

import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from quarrylog.functions import sql, text
from quarrylog.operators import detectors, parsing
from quarrylog.queries import SQL_ENTRIES, SQL_WEB, log_lines
from quarrylog.sources.logs import from_lines, log_entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def nodes_of(df):
    """The operators of a plan of one branch, from the top."""
    node, out = df._jdf.queryExecution().sparkPlan(), []
    while node is not None:
        out.append(node)
        node = node.children().head() if node.children().size() else None
    return out


def test_lines(spark, names):
    odd = [None, "", "  ﻿ ", "Jun 26 09:01:20 h sshd[1]: Failed password for \x1f from 1.2.3.4 port 1", "sshd[", "EVENT_ID=x", "Feb 30 10:00:00 h sshd[9]: Invalid user x from 10.0.0.1", '1.2.3.4 - - [26/Jun/2026:09:01:14 +0000] "GET /a HTTP/1.1" 200 1']
    lines = log_lines(spark, SF).select("line_no", "value").union(from_lines(spark, odd))
    fields = ["outcome", "source", "timestamp", "username", "ip_address", "status", "event_type", "request", "method", "path", "status_code"]
    mine = spark.sql("SELECT line_no, e.* FROM (SELECT line_no, parse_log_line(value, 2024) AS entry FROM {lines}) LATERAL VIEW inline(array(entry)) e", lines=lines)
    theirs = parsing.parse(lines, 2024).select("line_no", *fields)
    assert mine.columns == theirs.columns and mine.count() == theirs.count()
    assert mine.exceptAll(theirs).count() == 0
    formats = spark.sql("SELECT log_format(normalize_line(value)) AS f, count(*) AS n FROM {lines} GROUP BY 1", lines=lines)
    assert formats.exceptAll(theirs.groupBy("source").count()).count() == 0


def test_texts(spark, names):
    rng = random.Random(5)
    bits = ["&amp;", "&lt", "&#60;", "&#x3C", "&notit;", "&nosuch;", "&", "%3C", "%26lt%3B", "+", " ", "UNION SELECT", "<script", "' OR 1=1", "&#128;", "&#0;", "&#xD800;", "&#1114112;", "%", "%zz", "&#99999999999;", "\t\n", "É", "\x1c"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(9))) for _ in range(3000)] + [f"&{n}x" for n in html5] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    for name, column in (("html_unescape", text.html_unescape), ("url_decoded", text.url_decoded), ("normalize_request", text.normalize_request), ("normalize_line", text.normalize_line)):
        assert spark.sql(f"SELECT r, {name}(r) AS mine FROM {{df}}", df=df).where(~F.col("mine").eqNullSafe(column(F.col("r")))).count() == 0, name


def test_rules_places_and_hours(spark, names):
    entries = log_entries(spark, SF)
    mine = spark.sql(SQL_WEB, entries=entries).select("line_no", "pattern", "risk_score")
    theirs = detectors.web_alerts(entries).select("line_no", "pattern", F.col("risk_score").cast("long"))
    assert mine.count() == theirs.count() > 0 and mine.exceptAll(theirs).count() == 0
    none = spark.sql("SELECT sqli_match(NULL) IS NULL AND xss_match('') IS NULL AND normalize_request(NULL) = '' AND haversine_km(NULL, 1, 2, 3) IS NULL").first()[0]
    assert none
    assert round(spark.sql("SELECT haversine_km(19.0760, 72.8777, 40.7128, -74.0060)").first()[0], 2) == 12538.02
    hours = spark.sql("SELECT h, a, b, unusual_hour(make_timestamp_ntz(2024, 1, 1, h, 0, 0), a, b) AS mine, make_timestamp_ntz(2024, 1, 1, h, 0, 0) AS at FROM range(24) t(h0), LATERAL (SELECT CAST(h0 AS INT) AS h), VALUES (0, 5), (22, 5), (7, 7) v(a, b)")
    for a, b in ((0, 5), (22, 5), (7, 7)):
        assert hours.where(f"a = {a}").where(F.col("mine") != detectors.unusual_hour("at", a, b)).count() == 0


def test_plans(spark, names):
    """Lines are parsed where they are read, once: no join, no shuffle, no Python, and no filter that parses them before."""
    for df in (spark.sql(SQL_ENTRIES, lines=log_lines(spark, SF)), spark.sql(SQL_WEB, entries=log_entries(spark, SF))):
        nodes = [n.getClass().getSimpleName() for n in nodes_of(df)]
        assert "GenerateExec" in nodes and not any(w in n for n in nodes for w in ("Join", "Exchange", "Python", "Arrow"))
        below = nodes[nodes.index("GenerateExec") :]
        assert below.count("FilterExec") == (1 if df.columns[1] == "pattern" else 0)  # the SQL text's own, on event_type


def test_views(spark):
    lines = from_lines(spark, [f"Jun 26 09:01:{k:02d} h sshd[{k}]: Failed password for u{k % 3} from 1.2.3.4 port 1" for k in range(30)] + ['1.2.3.4 - - [26/Jun/2026:09:01:14 +0000] "GET /?q=1+union+select+2 HTTP/1.1" 200 1', "what"])
    made = sql.register_views(spark, lines)
    assert spark.sql("SELECT total_lines, parsed_lines, unsupported_lines FROM parse_stats").first() == (32, 31, 1)
    assert spark.sql("SELECT failed_logins, http_requests, unique_users FROM log_statistics").first() == (30, 1, 3)
    assert spark.sql("SELECT alert_type, count(*) FROM web_alerts GROUP BY 1").collect() == [("SQL_INJECTION", 1)]
    assert spark.sql("SELECT e.entity, sum(e.failed) FROM entity_features e JOIN log_entries l ON e.entity_id = l.ip_address AND l.line_no = 0 GROUP BY 1").collect() == [("ip_address", 30.0)]
    assert spark.sql("SELECT count(*) FROM insider_scores").first()[0] == 3
    for name in made:
        spark.catalog.dropTempView(name)
