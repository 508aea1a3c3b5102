"""The isolation forest on activity with one entity that stands out."""

from datetime import datetime, timedelta

import numpy as np

from quarrylog.config import AnomalyConfig
from quarrylog.operators import anomaly

T0 = datetime(2026, 6, 26, 9)
ENTRY = "line_no long, timestamp timestamp_ntz, username string, ip_address string, status string, source string, event_type string, request string, status_code int"


def activity(spark, entities, noisy=True):
    rows = [(60 * e + k, T0 + timedelta(seconds=60 * e + k), f"u{e}", f"10.0.0.{e}", "SUCCESS", "linux", "LOGIN_SUCCESS", "", None) for e in range(entities) for k in range(2 + e % 3)]
    if noisy:
        rows += [(10_000 + k, T0 + timedelta(seconds=5 * k), f"x{k % 9}", "203.0.113.9", "FAILED", "windows", "LOGIN_FAILED", "", None) for k in range(80)]
    return spark.createDataFrame(rows, ENTRY)


def test_the_odd_address_scores_highest(spark):
    vectors = anomaly.entity_vectors(activity(spark, 60), with_users=False)
    got = {r["entity_id"]: r["score"] for r in anomaly.score(vectors).collect()}
    assert len(got) == 61 and max(got, key=got.get) == "203.0.113.9" and all(0 <= x <= 100 for x in got.values())
    again = {r["entity_id"]: r["score"] for r in anomaly.score(vectors.repartition(7)).collect()}
    assert again == got


def test_alerts_explain_what_stands_out(spark):
    got = anomaly.anomalies(activity(spark, 60), AnomalyConfig(alert_threshold=50.0)).collect()
    odd = next(r for r in got if r["ip_address"] == "203.0.113.9")
    assert odd["alert_type"] == "ANOMALOUS_BEHAVIOR" and odd["username"] == "-" and 20 <= odd["risk_score"] <= 85
    assert "failed logins: 80" in odd["description"] and '"failed_logins":80.0' in odd["evidence"]
    assert all(r["ip_address"] == "" for r in got if r["username"] != "-")


def test_too_few_entities_give_no_alerts(spark):
    assert anomaly.anomalies(activity(spark, 5, noisy=False)).count() == 0
    assert anomaly.anomalies(activity(spark, 5).limit(0)).count() == 0


def test_a_tree_isolates_the_outlier_first():
    x = np.r_[np.random.default_rng(1).normal(size=(255, 2)), [[50.0, 50.0]]]
    forest = [(256, *map(np.array, anomaly.grow(x, np.random.default_rng(k)))) for k in range(50)]
    assert anomaly.isolation(x, forest).argmax() == 255
