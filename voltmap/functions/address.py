"""Address normalization as pure Column expressions.

Everything that compares addresses goes through these functions, so the same
place written in different ways ends up with the same key.  A normalized text is
a lower-case string of tokens separated by single spaces; the ``*_of`` functions
take such a text, the others take the original.  Working on strings with regular
expressions keeps the whole chain inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions.text import col, empty_to_null, split_parts, strip


def token(*alternatives: str) -> str:
    """Pattern for one whole token of a normalized text."""
    return rf"(?<![^ ])(?:{'|'.join(alternatives)})(?= |$)"


def whole_word(pattern: str) -> str:
    """`pattern` between word edges.  Its literal first character comes first, so
    the scan skips quickly to places that can match."""
    return rf"{pattern[0]}(?<![\p{{L}}\p{{N}}_].){pattern[1:]}{K.NOT_BEFORE_WORD}"


_STREET, _HOUSE, _LOCALITY, _ADMIN = (
    token(*w) for w in (K.STREET_WORDS, K.HOUSE_WORDS, K.LOCALITY_WORDS, K.ADMIN_MARKERS)
)
_HOUSE_TOKEN = token(K.HOUSE_TOKEN)
_TYPE_THEN_NAME = rf"^(?:{'|'.join(K.STREET_WORDS)}) (.+)$"
_HOUSE_TAIL = rf"(?: (?:{K.HOUSE_TOKEN}))+$"


def normalize_text(c: Column | str) -> Column:
    """Case-folded text with abbreviations spelled out and noise removed."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    t = F.replace(F.translate(t, "ё№", "е "), F.lit("ß"), F.lit("ss"))
    # A text without the letters that an abbreviation begins with is not searched for it; the array
    # of one text gives each step's result a name.
    held = F.array(t)
    for pattern, full in K.ABBREVIATIONS:
        held = F.transform(held, _spell_out(pattern, full))
    return F.trim(F.regexp_replace(held[0], K.NON_ADDRESS_CHARS, " "))


def _spell_out(pattern: str, full: str):
    lead = re.match(r"\w+", pattern).group()
    return lambda t: F.when(t.contains(lead), F.regexp_replace(t, whole_word(pattern), f" {full} ")).otherwise(t)


def without_tokens(n: Column, *alternatives: str) -> Column:
    return F.trim(F.regexp_replace(n, rf"(?<![^ ])(?:{'|'.join(alternatives)})(?: |$)", ""))


def has_token(n: Column, words) -> Column:
    return n.rlike(token(*words))


def token_count(n: Column) -> Column:
    return F.when(n == "", 0).otherwise(F.regexp_count(n, F.lit(" ")) + 1)


def city_of(n: Column) -> Column:
    return empty_to_null(without_tokens(n, *K.LOCALITY_WORDS, *K.HOUSE_WORDS))


def street_of(n: Column) -> Column:
    """Street name without type words and trailing house tokens; may be ''."""
    named = without_tokens(n, *K.STREET_WORDS, *K.HOUSE_WORDS, *K.LOCALITY_WORDS)
    # Nothing but type words: one of them is the name itself ("ул Набережная").
    rest = without_tokens(n, *K.HOUSE_WORDS, *K.LOCALITY_WORDS, K.HOUSE_TOKEN)
    name = F.coalesce(
        empty_to_null(named),
        empty_to_null(F.regexp_extract(rest, _TYPE_THEN_NAME, 1)),
        F.regexp_extract(rest, "^[^ ]+$", 0),
    )
    return F.regexp_replace(name, _HOUSE_TAIL, "")


def building_of(n: Column) -> Column:
    return F.when(~n.isin(*K.NO_BUILDING), empty_to_null(F.regexp_extract(n, K.HOUSE_KEY, 1)))


def normalize_city(c: Column | str) -> Column:
    return city_of(normalize_text(c))


def normalize_street(c: Column | str) -> Column:
    return street_of(normalize_text(c))


def normalize_building(c: Column | str) -> Column:
    return building_of(normalize_text(c))


def trailing_part(address: Column) -> Column:
    """Last comma part when another part precedes it, else ''."""
    return F.regexp_extract(address, r"(?s)[^,;\s]\s*[,;][,;\s]*([^,;]+?)[,;\s]*$", 1)


def last_house(address: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(address, F.lit(K.HOUSE_KEY), F.lit(1)), F.lit(-1))


def split_address(c: Column | str) -> Column:
    """Free text -> struct(street, building): a trailing house-like comma part,
    else the last house number found anywhere."""
    address = col(c)
    last_part = trailing_part(address)
    by_comma = normalize_building(last_part).isNotNull()
    parts = split_parts(address)
    front = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
    house = last_house(address)
    after = F.try_element_at(F.split(address, K.HOUSE_KEY, -1), F.lit(-1))
    before = F.substr(address, F.lit(1), F.length(address) - F.length(after) - F.length(house))
    street = (
        F.when(by_comma, front)
        .when(house.isNull(), address)
        .otherwise(F.coalesce(empty_to_null(strip(before, " ,;")), address))
    )
    return F.struct(street.alias("street"), F.when(by_comma, last_part).otherwise(house).alias("building"))


def building_in(c: Column | str) -> Column:
    """Only the building of `split_address`."""
    return split_address(c)["building"]


def ranges_of(n: Column) -> Column:
    """All house numbers and number ranges, as array<struct<lo,hi>>."""

    def span(lo, hi):
        a = lo.cast("int")
        b = F.coalesce(hi.try_cast("int"), a)
        return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    return F.zip_with(
        F.regexp_extract_all(n, F.lit(K.HOUSE_SPAN), F.lit(1)),
        F.regexp_extract_all(n, F.lit(K.HOUSE_SPAN), F.lit(2)),
        span,
    )


def house_ranges(c: Column | str) -> Column:
    return ranges_of(normalize_text(c))


def covers(ranges: Column, house: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: (house >= r["lo"]) & (house <= r["hi"])), F.lit(False))


def first_house(ranges: Column) -> Column:
    return F.array_min(F.transform(ranges, lambda r: r["lo"]))


def looks_like_street(n: Column) -> Column:
    """A normalized part that names a street, by type word or by a house number."""
    return n.rlike(_STREET) | (n.contains(" ") & n.rlike(_HOUSE_TOKEN) & ~n.rlike(_LOCALITY))


def has_house_data(n: Column) -> Column:
    return (
        n.rlike(K.HOUSE_RANGE)
        | n.rlike(_HOUSE)
        | (n.rlike(_HOUSE_TOKEN[: -len("(?= |$)")] + "$") & n.rlike(_STREET))
    )


def office_street_part(c: Column | str) -> Column:
    """struct(street_text, building_text) of a full postal address.

    The last street-like part names the street, so region and town parts before
    it are ignored; a trailing house-like part is the building.
    """
    address = col(c)
    parts = split_parts(address)
    last_part = F.try_element_at(parts, F.lit(-1))
    tail = F.when(normalize_building(last_part).isNotNull(), last_part)
    front = F.when(
        normalize_building(last_part).isNotNull(),
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
    ).otherwise(parts)
    street_part = F.try_element_at(
        F.filter(front, lambda p: looks_like_street(normalize_text(p))), F.lit(-1)
    )
    return F.struct(
        F.coalesce(street_part, address).alias("street_text"), tail.alias("building_text")
    )


def split_office_address(c: Column | str) -> Column:
    part = office_street_part(c)
    found = split_address(part["street_text"])
    return F.struct(
        found["street"].alias("street"),
        F.coalesce(part["building_text"], found["building"]).alias("building"),
    )


def has_letters(c: Column, at_least: int = 2) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(K.ALPHA)) >= at_least, F.lit(False))


def street_signal_of(n: Column) -> Column:
    """A usable street name: letters, not just a type word, not a road distance."""
    return (
        has_letters(street_of(n), 3)
        & ~n.isin(*K.STREET_WORDS)
        & ~n.rlike(_ADMIN)
        & ~n.rlike(K.ROAD_DISTANCE)
    )
