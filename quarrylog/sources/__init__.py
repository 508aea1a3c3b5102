"""Where lines and places come from."""

from quarrylog.sources.logs import PLACES, from_lines, places, read_lines, read_log_file

__all__ = ["PLACES", "from_lines", "places", "read_lines", "read_log_file"]
