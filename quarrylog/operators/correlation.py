"""Alerts to incidents: dedup, chaining within gaps, connected components, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, CorrelationConfig, RiskScoringConfig, block
from quarrylog.operators.components import connected_components
from quarrylog.operators.detectors import ALERT
from quarrylog.plans.lineage import cut
from quarrylog.plans.ordered import ordered

#: Severities from the lowest; any other ranks below them all, and counts as MEDIUM where none of them is there.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: What tells alerts apart.
KEY = ("alert_type", "timestamp", "ip_address", "username", "evidence")


def deduplicate(alerts: DataFrame) -> DataFrame:
    """The first alert of each type, time, address, user and evidence, with an id that depends on them alone.

    First is the least ``seq`` (the detector's place; 0 where ``alerts`` has no such column), then the least line.
    """
    seq = F.col("seq") if "seq" in alerts.columns else F.lit(0)
    df = alerts.select(*ALERT, seq.cast("int").alias("seq"))
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", "line_no"))).where("__r = 1").drop("__r")
    return with_id(df)


def with_id(alerts: DataFrame) -> DataFrame:
    """Adds alert_id, a hash of what tells alerts apart."""
    return alerts.withColumn("alert_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY]), 256))


def address_of(c: str = "ip_address") -> Column:
    """The address without white space around it; null for "" and "-"."""
    return F.when(~F.trim(c).isin("", "-"), F.trim(c))


def users_of(c: str = "username") -> Column:
    """The users that an alert names, lower-cased, as an array."""
    users = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda u: F.lower(F.trim(u)))
    return F.array_distinct(F.filter(users, lambda u: ~u.isin("", "-")))


def memberships(alerts: DataFrame, config: AnalyzerConfig | CorrelationConfig | None = None) -> DataFrame:
    """``(alert_id, incident_id)``: alerts that chains of gaps up to the window link by address or user share an incident.

    Every alert of a chain is linked with the chain's first one, so paths are short whatever a chain's length. The id of an
    incident is the least of its alerts' ids. With correlation disabled each alert is an incident.
    """
    c = block(config, CorrelationConfig)
    if not c.enabled:
        return alerts.select("alert_id", F.col("alert_id").alias("incident_id"))
    groups = connected_components(links(keyed(alerts, c), c))
    return alerts.select("alert_id").join(groups, F.col("alert_id") == F.col("node"), "left").select("alert_id", F.coalesce("component", "alert_id").alias("incident_id"))


def keyed(alerts: DataFrame, c: CorrelationConfig) -> DataFrame:
    """``(alert_id, t, key)``: a row for each address and user by which an alert may be chained."""
    none = F.array().cast("array<string>")
    by_ip = F.array(F.concat(F.lit("i|"), address_of())) if c.correlate_by_ip else none
    by_user = F.transform(users_of(), lambda u: F.concat(F.lit("u|"), u)) if c.correlate_by_user else none
    return alerts.select("alert_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"), F.explode(F.array_compact(F.concat(by_ip, by_user))).alias("key"))


def links(at: DataFrame, c: CorrelationConfig) -> DataFrame:
    """``(alert_id, head)``: each alert of a chain, but for the first, with the first."""
    far = F.coalesce(F.col("t") - F.col("before.t") > c.window_seconds * 1_000_000, F.lit(True))
    heads = ordered(at, ["key"], ["t", "alert_id"]).previous("before", "t").latest("head", F.when(far, F.col("alert_id"))).rows
    return heads.where("head <> alert_id").select("alert_id", "head")


def correlate(alerts: DataFrame, config: AnalyzerConfig | CorrelationConfig | None = None, members: DataFrame | None = None) -> DataFrame:
    """A row for each incident, without its risk; ``members``: their memberships where these are known.

    Lists of addresses, users and alert ids stand in the row; ``large_incidents`` has counts instead, for incidents that no row can hold.
    attack_chain has the types by their first occurrence.
    """
    alerts = cut(alerts)
    df = _with_incident(alerts, members if members is not None else memberships(alerts, config))
    place = F.struct("timestamp", "seq", "line_no", "alert_id")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return _incident_rows(
        df,
        [F.collect_set(address_of()).alias("ips"), F.flatten(F.collect_set(users_of())).alias("users"), F.collect_list(place).alias("ids")],
        {"source_ips": merged("ips"), "usernames": merged("users"), "alert_ids": F.transform(F.array_sort(F.flatten(F.collect_list("ids"))), lambda x: x["alert_id"])},
    )


def large_incidents(alerts: DataFrame, config: AnalyzerConfig | None = None, members: DataFrame | None = None) -> DataFrame:
    """``incidents`` with n_source_ips and n_usernames in place of the lists, however many alerts an incident has.

    No row and no state grows with an incident. ``incident_values`` has the addresses and users as rows, ``memberships`` the alerts.
    """
    alerts = cut(alerts)
    members = cut(members if members is not None else memberships(alerts, config))
    privileged = [u.lower() for u in block(config, RiskScoringConfig).privileged_users]
    seen = F.coalesce(F.bool_or(F.exists(users_of(), lambda u: u.isin(*privileged))), F.lit(False))
    rows = _incident_rows(_with_incident(alerts, members), [seen.alias("seen")], {"privileged": F.bool_or("seen")})
    values = incident_values(alerts, members).groupBy(F.col("incident_id").alias("of")).agg(F.count_if(F.col("kind") == "ip_address").alias("ips"), F.count_if(F.col("kind") == "username").alias("users"))
    rows = rows.join(values, F.col("incident_id") == F.col("of"), "left").withColumns({"n_source_ips": F.coalesce("ips", F.lit(0)), "n_usernames": F.coalesce("users", F.lit(0))})
    return score(rows.drop("of", "ips", "users"), config)


def incident_values(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """``(incident_id, kind, value)``: each address and user of each incident once; kind is ip_address or username."""
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    by_ip = F.when(address_of().isNotNull(), F.array(pair("ip_address", address_of())))
    found = F.concat(F.coalesce(by_ip, F.array().cast("array<struct<kind:string,value:string>>")), F.transform(users_of(), lambda u: pair("username", u)))
    return alerts.join(members, "alert_id").select("incident_id", F.explode(found).alias("v")).select("incident_id", "v.*").distinct()


def _with_incident(alerts: DataFrame, members: DataFrame) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper("severity")), F.lit(0))
    return alerts.join(members, "alert_id").withColumn("rank", rank).withColumn("seq", F.coalesce("seq", F.lit(0)) if "seq" in alerts.columns else F.lit(0))


def _incident_rows(df: DataFrame, per_alert_type: list[Column], more: dict[str, Column]) -> DataFrame:
    """Alerts by incident and type, then by incident; ``more`` are columns made of those that ``per_alert_type`` adds to the first step."""
    sure = F.when(F.col("confidence") > 0, F.col("confidence"))
    place = F.struct("timestamp", "seq", "line_no", "alert_id")
    per_type = df.groupBy("incident_id", "alert_type").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.max("timestamp").alias("last_seen"), F.max("rank").alias("rank"), F.sum(sure).alias("sure"), F.count(sure).alias("n_sure"), *per_alert_type,
    )
    out = per_type.groupBy("incident_id").agg(
        F.sum("n").alias("alert_count"), F.max("n").alias("most"), F.max("rank").alias("rank"), F.min("first.timestamp").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.round(F.try_divide(F.sum("sure"), F.sum("n_sure")), 9).alias("confidence"), *[c.alias(name) for name, c in more.items()],
        F.transform(F.array_sort(F.collect_list(F.struct("first", "alert_type"))), lambda x: x["alert_type"]).alias("attack_chain"),
    )
    kind = F.when(F.size("attack_chain") == 1, F.get("attack_chain", F.lit(0))).otherwise("CORRELATED_ACTIVITY")
    severity = F.when(F.col("rank") == 0, "MEDIUM").otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(1), F.col("rank").cast("int"))))
    about = F.when(F.col("alert_count") == 1, F.concat(F.lit("One alert: "), F.get("attack_chain", F.lit(0)))).otherwise(
        F.concat(F.col("alert_count").cast("string"), F.lit(" alerts linked by address or user and time: "), F.array_join("attack_chain", ", "))
    )
    return out.select(
        "incident_id", kind.alias("incident_type"), severity.alias("severity"), "first_seen", "last_seen", "alert_count", *more, "attack_chain",
        F.array_sort("attack_chain").alias("alert_types"), about.alias("description"), F.col("confidence").alias("average_confidence"), (F.col("most") > 1).alias("repeated"),
    )


def score(incidents: DataFrame, config: AnalyzerConfig | RiskScoringConfig | None = None) -> DataFrame:
    """``incidents`` with risk_score (0 to 100) and risk_breakdown, JSON of the parts that count.

    Whether a privileged user takes part is read from ``privileged`` where there is no list of users.
    """
    c = block(config, RiskScoringConfig)
    bases = F.create_map(*[x for s, n in zip(SEVERITIES, (c.base_low, c.base_medium, c.base_high, c.base_critical), strict=True) for x in (F.lit(s), F.lit(n))])
    base = F.coalesce(F.try_element_at(bases, F.upper("severity")), F.lit(c.base_medium))
    if not c.enabled:
        parts = F.struct(base.alias("base_score"), base.alias("final_score"), F.lit("global_risk_scoring_disabled").alias("note"))
        return incidents.select("*", base.alias("risk_score"), F.to_json(parts).alias("risk_breakdown"))
    privileged = [u.lower() for u in c.privileged_users]
    sure = F.coalesce(F.col("average_confidence") >= c.high_confidence_threshold, F.lit(False))
    bonuses = {
        "multiple_alert_bonus": (F.col("alert_count") >= 2, c.multiple_alert_bonus),
        "multiple_attack_type_bonus": (F.size("alert_types") >= 2, c.multiple_attack_type_bonus),
        "repeated_activity_bonus": (F.col("repeated"), c.repeated_activity_bonus),
        "privileged_user_bonus": (F.exists("usernames", lambda u: u.isin(*privileged)) if "usernames" in incidents.columns else F.col("privileged"), c.privileged_user_bonus),
        "confidence_bonus": (sure, c.high_confidence_bonus),
    }
    total = base
    for cond, n in bonuses.values():
        total = total + F.when(cond, n).otherwise(0)
    df = incidents.select("*", base.alias("__base"), F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("risk_score"))
    parts = F.struct(
        F.col("__base").alias("base_score"), *[F.when(cond, n).alias(name) for name, (cond, n) in bonuses.items()],
        F.when(sure, F.round("average_confidence", 3)).alias("average_alert_confidence"), F.col("risk_score").alias("final_score"),
    )
    return df.select(*incidents.columns, "risk_score", F.to_json(parts).alias("risk_breakdown"))


def incidents(alerts: DataFrame, config: AnalyzerConfig | None = None) -> DataFrame:
    """Scored incidents, unordered; ``by_risk`` orders them."""
    return score(correlate(alerts, config), config)


def by_risk(found: DataFrame) -> DataFrame:
    """The riskiest incidents first, of equals the earlier ones."""
    return found.orderBy(F.desc("risk_score"), "first_seen", "incident_id")


def by_first_seen(found: DataFrame) -> DataFrame:
    """The earliest incidents first, as they are before scores are known."""
    return found.orderBy("first_seen", "incident_id")
