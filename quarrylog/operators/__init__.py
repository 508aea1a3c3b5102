"""The operators, each a function from tables to a table."""

from quarrylog.operators.anomaly import anomalies, entity_vectors
from quarrylog.operators.bursts import greedy_bursts
from quarrylog.operators.components import connected_components
from quarrylog.operators.correlation import by_first_seen, by_risk, correlate, deduplicate, incidents, memberships, score
from quarrylog.operators.detectors import brute_force, entity_features, features, impossible_travel, insider_scores, insider_threat, password_spray, statistics, top_value, web_alerts
from quarrylog.operators.parsing import FORMATS, Format, apache_entry, linux_entry, parse, parse_logs, parse_logs_with_stats, parse_stats, windows_entry

__all__ = [
    "FORMATS", "Format", "anomalies", "apache_entry", "brute_force", "by_first_seen", "by_risk", "connected_components", "correlate", "deduplicate", "entity_features", "entity_vectors", "features", "greedy_bursts",
    "impossible_travel", "incidents", "insider_scores", "insider_threat", "linux_entry", "memberships", "parse", "parse_logs", "parse_logs_with_stats", "parse_stats", "password_spray", "score", "statistics", "top_value", "web_alerts", "windows_entry",
]
