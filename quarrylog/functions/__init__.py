"""Column functions."""

from quarrylog.functions.text import folded, haversine_km, html_unescape, normalize_line, normalize_request, url_decode, url_decoded

__all__ = ["folded", "haversine_km", "html_unescape", "normalize_line", "normalize_request", "url_decode", "url_decoded"]
