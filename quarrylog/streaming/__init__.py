"""The analysis over streams of lines and entries."""

from quarrylog.streaming.bursts import brute_force, password_spray, stream_bursts
from quarrylog.streaming.lines import entries, read_lines, running_alert_counts, running_counts, running_parse_stats, web_alerts
from quarrylog.streaming.travel import impossible_travel

__all__ = ["brute_force", "entries", "impossible_travel", "password_spray", "read_lines", "running_alert_counts", "running_counts", "running_parse_stats", "stream_bursts", "web_alerts"]
