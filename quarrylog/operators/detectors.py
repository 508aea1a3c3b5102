"""Statistics and rule detectors over log entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, AnomalyConfig, BruteForceConfig, ImpossibleTravelConfig, InsiderThreatConfig, PasswordSprayConfig, block
from quarrylog.functions.text import folded, haversine_km, html_unescape, url_decoded
from quarrylog.operators.bursts import SECOND, greedy_bursts
from quarrylog.plans.ordered import ordered

#: Fixed values: (name, pattern, confidence, risk), in the order in which an alert names those that match.
SQLI = (
    ("UNION SELECT", r"\bunion(?:\s+all)?\s+select\b", 0.95, 92),
    ("OR 1=1", r"\bor\s+1\s*=\s*1\b", 0.95, 90),
    ("OR '1'='1'", r"\bor\s+'1'\s*=\s*'1'", 0.95, 90),
    ("AND 1=1", r"\band\s+1\s*=\s*1\b", 0.90, 88),
    ("quote-OR tautology", r"'\s*or\s+'[^']*'\s*=\s*'", 0.90, 88),
    ("information_schema", r"\binformation_schema\b", 0.92, 90),
    ("DROP TABLE", r"\bdrop\s+table\b", 0.93, 95),
    ("INSERT INTO", r"\binsert\s+into\b", 0.85, 85),
    ("UPDATE SET", r"\bupdate\b.+\bset\b", 0.85, 85),
    ("DELETE FROM", r"\bdelete\s+from\b", 0.88, 88),
    ("SLEEP(", r"\bsleep\s*\(", 0.92, 90),
    ("WAITFOR DELAY", r"\bwaitfor\s+delay\b", 0.92, 90),
    ("PG_SLEEP(", r"\bpg_sleep\s*\(", 0.92, 90),
)
XSS = (
    ("<script", r"<\s*script\b", 0.95, 85),
    ("javascript:", r"\bjavascript\s*:", 0.93, 82),
    ("onerror=", r"\bonerror\s*=", 0.92, 80),
    ("onload=", r"\bonload\s*=", 0.92, 80),
    ("onclick=", r"\bonclick\s*=", 0.90, 78),
    ("onmouseover=", r"\bonmouseover\s*=", 0.90, 78),
    ("<svg", r"<\s*svg\b", 0.88, 75),
    ("<img", r"<\s*img\b", 0.80, 72),
)
#: (alert type, severity, patterns)
SQLI_BANK = ("SQL_INJECTION", "CRITICAL", SQLI)
XSS_BANK = ("XSS", "HIGH", XSS)
ALERT = ("alert_type", "severity", "timestamp", "username", "ip_address", "confidence", "risk_score", "line_no", "source", "description", "evidence")


def _evidence(**fields: Column) -> Column:
    """The fields as JSON, nulls included."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("evidence")


def _stamp(c: str) -> Column:
    return F.col(c).cast("string")


def request_text(entries: DataFrame) -> Column:
    """The request, or the path where that is empty; '' if both are."""
    path = F.col("path") if "path" in entries.columns else F.lit("")
    return F.coalesce(F.nullif("request", F.lit("")), path, F.lit(""))


def unusual_hour(c: str, start: int, end: int) -> Column:
    """Whether the hour lies in [start, end), past midnight where start is the later one; never where they are equal."""
    hour = F.hour(c)
    return F.lit(False) if start == end else hour.between(start, end - 1) if start < end else (hour >= start) | (hour < end)


def statistics(entries: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c).cast("long")
    return entries.agg(
        F.count("*").alias("total"), *[count(F.col("source") == s).alias(s) for s in ("linux", "windows", "apache")],
        *[count(F.col("event_type") == t).alias(n) for t, n in (("LOGIN_SUCCESS", "successful_logins"), ("LOGIN_FAILED", "failed_logins"), ("HTTP_REQUEST", "http_requests"))],
        F.count_distinct(F.when(F.col("username") != "-", F.col("username"))).alias("unique_users"), F.count_distinct("ip_address").alias("unique_ips"),
    )


def top_value(entries: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; of equals the first seen; "-" and 0 for no entries."""
    by = entries.groupBy(column).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    top = by.agg(F.max(F.struct("n", -F.col("first"), F.col(column).alias("value"))).alias("m"))
    return top.select(F.coalesce("m.value", F.lit("-")).alias("value"), F.coalesce("m.n", F.lit(0)).alias("n"))


def web_alerts(entries: DataFrame, banks: Sequence[tuple] = (SQLI_BANK, XSS_BANK)) -> DataFrame:
    """An alert for each request and bank of which some pattern matches: the surest one, then the riskiest, then the first listed.

    Requests are normalized once for all banks; what leaves a generator isn't computed again by the filters above it.
    """
    if not banks:
        return web_alerts(entries, [SQLI_BANK]).limit(0)
    keep = ["timestamp", "username", "ip_address", "line_no", "source"]
    df = entries.where("event_type = 'HTTP_REQUEST'").select(*keep, request_text(entries).alias("request")).where("request <> ''")
    df = df.select(*keep, "request", F.explode(F.array(url_decoded(F.col("request")))).alias("u"))
    df = df.select(*keep, "request", F.explode(F.array(folded(html_unescape(F.col("u"))))).alias("normalized"))
    each = []
    for alert_type, severity, bank in banks:
        some = "|".join(f"(?:{p})" for _, p, _, _ in bank)
        found = [F.when(F.col("normalized").rlike("(?U)" + p), F.struct(F.lit(c).alias("confidence"), F.lit(r).alias("risk_score"), F.lit(-k).alias("k"), F.lit(n).alias("pattern"))) for k, (n, p, c, r) in enumerate(bank)]
        each.append(F.when(F.col("normalized").rlike("(?U)" + some), F.struct(F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"), F.array_compact(F.array(*found)).alias("hits"))))
    df = df.select(*keep, "request", "normalized", F.explode(F.array_compact(F.array(*each))).alias("a"))
    df = df.select("a.alert_type", "a.severity", *keep, "request", "normalized", F.array_max("a.hits").alias("best"), F.transform("a.hits", lambda h: h["pattern"]).alias("names"))
    evidence = _evidence(pattern=F.col("best.pattern"), request=F.col("request"), normalized_request=F.col("normalized"), matched_indicators=F.col("names"))
    user, source = F.coalesce(F.nullif("username", F.lit("")), F.lit("-")), F.coalesce(F.nullif("source", F.lit("")), F.lit("apache"))
    about = F.concat("alert_type", F.lit(" pattern in request: "), "best.pattern").alias("description")
    return df.select("alert_type", "severity", "timestamp", user.alias("username"), "ip_address", "best.confidence", "best.risk_score", "line_no", source.alias("source"), about, evidence, "best.pattern")


def _graded(df: DataFrame, alert_type: str, threshold: int, window_s: int, user: Column, **more: Column) -> DataFrame:
    over = F.greatest(F.lit(0), F.col("n") - threshold)
    evidence = _evidence(**more, threshold=F.lit(threshold), window_seconds=F.lit(window_s), start_time=_stamp("timestamp"), end_time=_stamp("end"))
    source = F.when(F.size("seen") == 1, F.get("seen", F.lit(0))).otherwise("mixed").alias("source")
    about = F.concat(F.lit(f"{alert_type}: "), F.col("n").cast("string"), F.lit(" within "), F.lit(str(window_s)), F.lit(" s by "), user, F.lit(" from "), "ip_address")
    return df.select(F.lit(alert_type).alias("alert_type"), F.lit("HIGH").alias("severity"), "timestamp", user.alias("username"), "ip_address", F.least(F.lit(0.99), 0.85 + 0.02 * over).alias("confidence"), F.least(F.lit(95), 70 + 2 * over).alias("risk_score"), "line_no", source, about.alias("description"), evidence, "n", "end")


FAILED = "event_type = 'LOGIN_FAILED' and username <> '' and ip_address <> ''"


def brute_force(entries: DataFrame, config: AnalyzerConfig | BruteForceConfig | None = None) -> DataFrame:
    """Bursts of failed logins of one user from one address."""
    c = block(config, BruteForceConfig)
    return brute_force_alerts(greedy_bursts(entries.where(FAILED), ["username", "ip_address"], c.failed_attempt_threshold, c.window_seconds), c)


def brute_force_alerts(found: DataFrame, c: BruteForceConfig) -> DataFrame:
    """Bursts by user and address as alerts."""
    return _graded(found, "BRUTE_FORCE", c.failed_attempt_threshold, c.window_seconds, F.col("username"), attempts=F.col("n"))


def password_spray(entries: DataFrame, config: AnalyzerConfig | PasswordSprayConfig | None = None) -> DataFrame:
    """Bursts of failed logins of many users from one address; the alert names the users, sorted, with commas between."""
    c = block(config, PasswordSprayConfig)
    return password_spray_alerts(greedy_bursts(entries.where(FAILED), ["ip_address"], c.unique_user_threshold, c.window_seconds, "username"), c)


def password_spray_alerts(found: DataFrame, c: PasswordSprayConfig) -> DataFrame:
    """Bursts of distinct users by address as alerts."""
    return _graded(found, "PASSWORD_SPRAY", c.unique_user_threshold, c.window_seconds, F.array_join("members", ","), unique_users=F.col("n"), users=F.col("members"))


LOGINS = "event_type = 'LOGIN_SUCCESS' and username not in ('', '-')"


def logins_at(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Successful logins of named users with the place of their address (nulls if unknown)."""
    return entries.where(LOGINS).join(places, F.trim("ip_address") == F.col("ip"), "left")


def impossible_travel(entries: DataFrame, places: DataFrame, config: AnalyzerConfig | ImpossibleTravelConfig | None = None) -> DataFrame:
    """Consecutive logins of a user whose places lie too far apart for the time between; an unknown address breaks the pair."""
    here = logins_at(entries, places).select("username", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"), "timestamp", "line_no", "source", "ip_address", "city", "country", "lat", "lon")
    here = ordered(here, ["username"], ["t", "line_no"], counted=entries.where(LOGINS)).previous("p", "ip_address", "t", "city", "country", "lat", "lon").rows
    return travel_alerts(here, float(block(config, ImpossibleTravelConfig).max_plausible_speed_kmh))


def travel_alerts(pairs: DataFrame, most: float) -> DataFrame:
    """Logins with the one before as struct p: an alert where another city is reached at over ``most`` km/h."""
    df = pairs.where("p.ip_address <> ip_address and p.city <> city")
    df = df.withColumn("km", haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))).withColumn("s", (F.col("t") - F.col("p.t")) / SECOND)
    df = df.withColumn("speed", F.when(F.col("s") <= 0, F.lit(float("inf"))).otherwise(F.col("km") / (F.col("s") / 3600))).where(F.col("speed") > most)
    ratio = F.col("speed") / most if most > 0 else F.lit(1.0)
    evidence = _evidence(
        previous_ip=F.col("p.ip_address"), current_ip=F.col("ip_address"), previous_location=F.concat_ws(", ", "p.city", "p.country"), current_location=F.concat_ws(", ", "city", "country"),
        distance_km=F.round("km", 2), elapsed_seconds=F.col("s"), required_speed_kmh=F.when(F.col("s") > 0, F.round("speed", 2)), configured_speed_threshold=F.lit(most),
    )
    about = F.concat("username", F.lit(" seen in "), "p.city", F.lit(" and then in "), "city").alias("description")
    return df.select(F.lit("IMPOSSIBLE_TRAVEL").alias("alert_type"), F.lit("HIGH").alias("severity"), "timestamp", "username", "ip_address", F.least(F.lit(0.99), 0.75 + F.least(ratio, F.lit(5.0)) * 0.04).alias("confidence"), F.least(F.lit(95), 70 + (F.least(ratio, F.lit(10.0)) * 2).cast("int")).alias("risk_score"), "line_no", "source", about, evidence, "km")


def insider_scores(entries: DataFrame, config: AnalyzerConfig | InsiderThreatConfig | None = None) -> DataFrame:
    """A row for each user: counts, the majority address (of equals the first seen), the signals and their score."""
    c = block(config, InsiderThreatConfig)
    df = entries.where("username not in ('', '-')")
    request = F.lower(request_text(entries))
    hit = (F.col("event_type") == "HTTP_REQUEST") & F.exists(F.array(*[F.lit(p.lower()) for p in c.sensitive_path_prefixes]).cast("array<string>"), lambda p: F.startswith(request, p))
    by_ip = df.where("ip_address <> ''").groupBy("username", "ip_address").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "line_no")).alias("first"))
    by_ip = by_ip.groupBy(F.col("username").alias("u")).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "ip_address")).alias("top"), F.count("*").alias("ips"))
    last = lambda cond: F.max(F.when(cond, F.struct("timestamp", "line_no", "ip_address", "source")))
    unusual = unusual_hour("timestamp", c.unusual_hour_start, c.unusual_hour_end)
    users = df.groupBy("username").agg(F.count("*").alias("events"), F.count_if(unusual).alias("unusual_hours"), F.count_if(hit).alias("sensitive"), F.coalesce(last(hit), last(unusual), last(F.lit(True))).alias("anchor"))
    users = users.join(by_ip, F.col("username") == F.col("u"), "left").drop("u")
    privileged = [u.lower() for u in c.privileged_users]
    signals = (
        ("privileged_account", F.lower("username").isin(*privileged), c.score_privileged), ("unusual_hour", F.col("unusual_hours") > 0, c.score_unusual_hour), ("high_activity_volume", F.col("events") >= c.activity_threshold, c.score_high_activity),
        ("sensitive_resource_access", F.col("sensitive") > 0, c.score_sensitive_resource), ("unusual_source_ip", F.coalesce((F.col("top.n") <= -2) & (F.col("ips") > 1), F.lit(False)), c.score_unusual_ip),
    )
    score = sum((F.when(cond, n).otherwise(0) for _, cond, n in signals), F.lit(0))
    return users.select("username", "events", "unusual_hours", "sensitive", score.alias("score"), "anchor", F.array_compact(F.array(*[F.when(cond, name) for name, cond, _ in signals])).alias("signals"), F.col("top.ip_address").alias("majority_ip"))


def insider_threat(entries: DataFrame, config: AnalyzerConfig | InsiderThreatConfig | None = None) -> DataFrame:
    """Alerts on users whose score reaches the threshold. Their other addresses are listed in the evidence, for these users only."""
    threshold = block(config, InsiderThreatConfig).alert_score_threshold
    df = insider_scores(entries, config).where(F.col("score") >= threshold)
    others = entries.where("ip_address <> ''").select(F.col("username").alias("u"), "ip_address").join(df.select(F.col("username").alias("u"), "majority_ip"), "u").where("ip_address <> majority_ip")
    others = others.groupBy("u").agg(F.sort_array(F.collect_set("ip_address")).alias("unusual_ips"))
    df = df.join(others, F.col("username") == F.col("u"), "left").withColumn("unusual_ips", F.coalesce("unusual_ips", F.array().cast("array<string>")))
    evidence = _evidence(
        score=F.col("score"), threshold=F.lit(threshold), signals=F.col("signals"), event_count=F.col("events"), privileged=F.array_contains("signals", "privileged_account"), unusual_hour_count=F.col("unusual_hours"),
        sensitive_access_count=F.col("sensitive"), majority_ip=F.col("majority_ip"), unusual_ips=F.col("unusual_ips"),
    )
    about = F.concat(F.lit("Signals of "), "username", F.lit(": "), F.array_join("signals", ", ")).alias("description")
    return df.select(
        F.lit("INSIDER_THREAT").alias("alert_type"), F.lit("MEDIUM").alias("severity"), F.col("anchor.timestamp").alias("timestamp"), "username", F.col("anchor.ip_address").alias("ip_address"),
        F.least(F.lit(0.95), 0.55 + F.col("score") / max(threshold, 1) * 0.2).alias("confidence"), F.least(F.lit(90), 40 + F.floor(F.col("score") / 2).cast("int")).alias("risk_score"),
        F.col("anchor.line_no").alias("line_no"), F.col("anchor.source").alias("source"), about, evidence, "majority_ip", "unusual_ips",
    )


def entity_features(entries: DataFrame, entities: Sequence[str] = ("ip_address", "username"), config: AnalyzerConfig | AnomalyConfig | None = None) -> DataFrame:
    """``(entity, entity_id, last_seen, seen_sources, ...)``: the twelve behaviour features of each address and each user, in one scan.

    Every row counts for its address and its user, once with its counts and the other of the two, once with its path and once with its source. These (entity,
    value) rows are summed before they are shuffled, so each distinct value leaves a task once and a hot entity is spread by its
    values; what is left to sum by entity is a row for each of its values. entity is the column's name.
    """
    c = block(config, AnomalyConfig)
    failed, ok, http = (F.col("event_type") == x for x in ("LOGIN_FAILED", "LOGIN_SUCCESS", "HTTP_REQUEST"))
    flags = {
        "total": F.lit(True), "failed": failed, "success": ok, "http": http, "http_errors": http & F.coalesce(F.col("status_code") >= 400, F.lit(False)),
        "auth": failed | ok, "unusual_hours": unusual_hour("timestamp", c.unusual_hour_start, c.unusual_hour_end),
    }
    named = lambda c, *none: F.when(~F.col(c).isin(*none), F.col(c))
    user, ip, path = named("username", "", "-"), named("ip_address", ""), F.nullif(request_text(entries), F.lit(""))
    df = entries.select(user.alias("user"), ip.alias("ip"), path.alias("path"), "source", "timestamp", *[F.coalesce(x, F.lit(False)).cast("long").alias(n) for n, x in flags.items()])
    one = lambda e, kind, value: F.struct(F.lit(e).alias("entity"), F.col({"ip_address": "ip", "username": "user"}[e]).alias("entity_id"), F.lit(kind).alias("kind"), value.alias("value"))
    other = {"ip_address": "user", "username": "ip"}
    rows = F.array(*[one(e, k, v) for e in entities for k, v in ((0, F.col(other[e])), (1, F.col("path")), (2, F.col("source")))])
    df = df.select("timestamp", *flags, F.inline(rows)).where("entity_id is not null")
    first = F.col("kind") == 0
    by_value = df.groupBy("entity", "entity_id", "kind", "value").agg(*[F.sum(F.when(first, F.col(n))).alias(n) for n in flags], F.max(F.when(first, F.col("timestamp"))).alias("last_seen"))
    has = lambda k: F.count_if((F.col("kind") == k) & F.col("value").isNotNull()).cast("double")
    seen = F.array_sort(F.collect_list(F.when((F.col("kind") == 2) & (F.col("value") != ""), F.col("value")))).alias("seen_sources")
    out = by_value.groupBy("entity", "entity_id").agg(*[F.sum(n).cast("double").alias(n) for n in flags], F.max("last_seen").alias("last_seen"), has(0).alias("others"), has(1).alias("paths"), has(2).alias("sources"), seen)
    by_ip, self = F.col("entity") == "ip_address", F.lit(1.0)
    out = out.withColumns({"users": F.when(by_ip, F.col("others")).otherwise(self), "ips": F.when(by_ip, self).otherwise(F.col("others")), "failed_ratio": F.col("failed") / F.col("total")})
    return out.select("entity", "entity_id", "last_seen", "seen_sources", *FEATURES)


#: The features in the order of their columns.
FEATURES = ("total", "failed", "success", "users", "ips", "paths", "http", "http_errors", "auth", "unusual_hours", "sources", "failed_ratio")


def features(entries: DataFrame, entity: str, config: AnalyzerConfig | AnomalyConfig | None = None) -> DataFrame:
    """The twelve behaviour features of each address or user."""
    return entity_features(entries, [entity], config).select("entity_id", *FEATURES)
