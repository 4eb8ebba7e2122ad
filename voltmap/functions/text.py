"""String helpers shared by every layer: trimming, splitting, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltmap import constants as K

BLANKS = " \t\n\r\x0b\x0c "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values) -> Column:
    """Array literal of strings."""
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def plain_spaces(c: Column) -> Column:
    """Non-breaking and typographic spaces as plain ones."""
    return F.translate(c, "\u00a0\u2002\u2003\u2009\u202f\u3000", " " * 6)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def split_parts(c: Column, pattern: str = "[,;]") -> Column:
    """Comma/semicolon separated parts, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, pattern), lambda p: strip(p)), lambda p: p != "")


def first_where(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


def contains_any(c: Column, terms) -> Column:
    """True when any literal term occurs in `c`."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | c.contains(term)
    return hit


def join_non_empty(*parts: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, *[blank_to_null(p) for p in parts])


def merge_distinct(existing: Column, incoming: Column) -> Column:
    """Ordered distinct union: first occurrence wins its position."""
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(existing, nothing), F.coalesce(incoming, nothing)))


def split_locality(c: Column) -> Column:
    """'region, district, town' free text -> struct(region, district, city)."""
    parts = split_parts(F.coalesce(c, F.lit("")), ",")
    nothing = F.lit(None).cast("string")

    def at(items, index):
        return F.try_element_at(items, F.lit(index))

    has_region = F.coalesce(contains_any(F.lower(at(parts, 1)), K.REGION_MARKERS), F.lit(False))
    rest = F.when(has_region, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    has_district = F.coalesce(contains_any(F.lower(at(rest, 1)), K.DISTRICT_MARKERS), F.lit(False))
    tail = F.when(has_district, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.struct(
        F.when(has_region, at(parts, 1)).otherwise(nothing).alias("region"),
        F.when(has_district, at(rest, 1)).otherwise(nothing).alias("district"),
        at(tail, -1).alias("city"),
    )


def decode_entities(c: Column) -> Column:
    """HTML attribute entities; the ampersand is decoded last."""
    for entity, char in (
        ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def drop_parenthetical(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+\(.+\)$", ""))


def strip_fences(c: Column) -> Column:
    """Drop a surrounding ``` / ```json fence."""
    s = strip(c)
    bare = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return strip(F.when(s.startswith("```"), bare).otherwise(s))


# --- display formats ----------------------------------------------------------

def format_bytes(n: Column) -> Column:
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / F.lit(1024.0)))
        .otherwise(F.format_string("%.2f MB", n / F.lit(1048576.0)))
    )


def format_interval(seconds: Column) -> Column:
    def rounded(x):
        return F.floor(x + F.lit(0.5)).cast("string")

    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(rounded(seconds / F.lit(60.0)), F.lit("m")))
        .otherwise(F.concat(rounded(seconds / F.lit(3600.0)), F.lit("h")))
    )


def format_relative(ts: Column, as_of: Column) -> Column:
    """'5m ago' / 'in 2h' relative to `as_of`."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)
    size = F.abs(seconds)

    def shown(x, unit):
        n = F.floor(x + F.lit(0.5)).cast("string")
        return F.when(seconds >= 0, F.concat(n, F.lit(f"{unit} ago"))).otherwise(
            F.concat(F.lit("in "), n, F.lit(unit))
        )

    return (
        F.when(ts.isNull(), F.lit("—"))
        .when(size < 60, F.lit("just now"))
        .when(size < 3600, shown(size / 60, "m"))
        .when(size < 86400, shown(size / 3600, "h"))
        .otherwise(shown(size / 86400, "d"))
    )


def format_confidence(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))


def truncate(c: Column, n: int) -> Column:
    return (
        F.when(c.isNull() | (c == ""), F.lit("—"))
        .when(F.length(c) <= n, c)
        .otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))
    )


def percent_encode(c: Column) -> Column:
    """RFC 3986 percent encoding with nothing but letters, digits and -_.~ kept."""
    encoded = F.url_encode(c)
    for form, rfc in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(rfc))
    return encoded
