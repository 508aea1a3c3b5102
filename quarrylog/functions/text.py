"""Column functions on log text."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that HTML knows without a semicolon, too; the table is Python's.
BARE = "|".join(sorted((re.escape(n) for n in html5 if not n.endswith(";")), key=len, reverse=True))
ENTITY = rf"&(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]{{0,31}};|{BARE})"


def _tables() -> tuple[str, str]:
    """The texts of names by their first letter, and of the numbers that don't stand for their own character, as JSON."""
    names: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        names.setdefault(name[0], {})[name] = text
    planes = [p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF)]
    odd = [n for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *planes) if html.unescape(f"&#{n};") != chr(n)]
    return json.dumps(names), json.dumps({str(n): html.unescape(f"&#{n};") for n in odd})


NAMES, ODD = _tables()


def normalize_line(c: Column) -> Column:
    """Without surrounding Unicode white space, then without leading byte-order marks; null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.regexp_replace(c, r"^\uFEFF+", "")


def url_decode(c: Column) -> Column:
    """Lenient form decoding: a stray percent sign stays as it is."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_decoded(c: Column, passes: int = 2) -> Column:
    c = F.coalesce(c, F.lit(""))
    for _ in range(max(1, passes)):
        c = url_decode(c)
    return c


def _reference(piece: Column) -> Column:
    """What stands behind an ampersand, with the reference at its beginning undone; with the ampersand where there is none."""
    names = F.from_json(F.lit(NAMES), "map<string,map<string,string>>")
    odd = F.from_json(F.lit(ODD), "map<string,string>")
    text = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    rest = lambda n: F.substr(piece, F.length(n) + 1)
    whole = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};", 0)
    bare = F.regexp_extract(piece, f"^(?:{BARE})", 0)
    number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    is_hex = F.substring(number, 2, 1).isin("x", "X")
    digits = F.regexp_replace(number, r"^#[xX]?0*|;$", "")
    value = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.coalesce(F.nullif(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits), F.lit("")).cast("long"), F.lit(0)))
    point = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    char = F.coalesce(F.try_element_at(odd, value.cast("string")), F.when(value.between(0xD800, 0xDFFF) | (value > 0x10FFFF), "\ufffd").otherwise(point))
    named = F.when(text(whole).isNotNull(), F.concat(text(whole), rest(whole))).when(bare != "", F.concat(text(bare), rest(bare)))
    return F.when(number != "", F.concat(char, rest(number))).otherwise(F.coalesce(named, F.concat(F.lit("&"), piece)))


def html_unescape(c: Column) -> Column:
    """All character references of HTML undone once, as Python's library does, in column expressions."""
    pieces = F.split(c, "&", -1)
    undone = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _reference), ""))
    return F.when(c.rlike(ENTITY), undone).otherwise(c)


def folded(c: Column) -> Column:
    """Lower-cased, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_request(c: Column, passes: int = 2) -> Column:
    """URL-decoded up to ``passes`` times, HTML references undone once, lower-cased, white space collapsed."""
    return folded(html_unescape(url_decoded(c, passes)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))
