"""Token automata and regex recovery for the city, street and building fields.

The automata take a normalized text and return struct(value, extra, confidence);
value is null when the field gives nothing usable.  The recovery helpers build
ordered candidate arrays; the first candidate that passes its checks wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import address as A
from voltmap.functions.text import blank_to_null, empty_to_null, split_parts, strip

_STRINGS = "array<string>"
_NOT_NAME = "|".join((K.HOUSE_TOKEN, *K.LOCALITY_WORDS, *K.STREET_WORDS, *K.HOUSE_WORDS))


def token_type(t: Column) -> Column:
    """RANGE, NUMBER, LOCALITY, STREET, HOUSE or PROPER, first fit wins."""
    return (
        F.when(t.rlike(rf"^{K.HOUSE_RANGE}$"), "RANGE")
        .when(t.rlike(r"^\d{1,4}(?:/\d{1,4})?[a-zа-я]?$"), "NUMBER")
        .when(t.isin(*K.LOCALITY_WORDS), "LOCALITY")
        .when(t.isin(*K.STREET_WORDS), "STREET")
        .when(t.isin(*K.HOUSE_WORDS), "HOUSE")
        .otherwise("PROPER")
    )


def typed_tokens(n: Column) -> Column:
    return F.transform(
        F.filter(F.split(n, " "), lambda t: t != ""),
        lambda t: F.struct(t.alias("text"), token_type(t).alias("type")),
    )


def _parsed(value: Column, extra: Column, confidence: Column, empty_confidence=0.0) -> Column:
    """Assemble a field result; without a value the confidence is `empty_confidence`."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.struct(
        value.alias("value"),
        F.when(value.isNotNull(), extra).alias("extra"),
        F.when(value.isNotNull(), unit).otherwise(empty_confidence).alias("confidence"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def city_automaton(n: Column) -> Column:
    """[locality word] name+ ; anything else costs confidence."""
    names = A.without_tokens(n, _NOT_NAME)
    first_name = F.regexp_instr(n, F.lit(rf"(?<![^ ])(?!(?:{_NOT_NAME})(?: |$))[^ ]"))
    lead = F.substr(n, F.lit(1), first_name - 1)
    prefixes = F.regexp_count(lead, F.lit(A.token(*K.LOCALITY_WORDS)))
    unexpected = A.token_count(n) - A.token_count(names) - prefixes
    glued = (prefixes == 0) & (A.token_count(names) > 2)
    confidence = (
        F.lit(1.0)
        - F.lit(K.CITY_PENALTY) * unexpected
        - F.when(glued, K.CITY_GLUED_PENALTY).otherwise(0.0)
    )
    return _parsed(empty_to_null(names), _none(), confidence)


def street_automaton(n: Column) -> Column:
    """[street word] name+ [house part]+ as a left fold over the typed tokens."""
    start = F.struct(
        F.lit("start").alias("state"),
        F.array().cast(_STRINGS).alias("name"),
        F.array().cast(_STRINGS).alias("house"),
        F.lit(0).alias("unexpected"),
    )

    def step(acc, tok):
        state, name, house, kind = acc["state"], acc["name"], acc["house"], tok["type"]
        named = F.size(name) > 0
        item = F.array(tok["text"])
        is_street, is_proper = kind == "STREET", kind == "PROPER"
        is_number, is_house = kind.isin("NUMBER", "RANGE"), kind == "HOUSE"
        type_as_name = is_street & (state == "name") & ~named
        name_grows = type_as_name | (is_proper & (state != "house"))
        to_house = (is_number | is_house) & (state != "start") & named
        misfit = (is_proper & (state == "house")) | ((is_number | is_house) & ~to_house)
        return F.struct(
            F.when(is_street | name_grows, F.lit("name"))
            .when(to_house, F.lit("house"))
            .otherwise(state)
            .alias("state"),
            F.when(name_grows, F.concat(name, item)).otherwise(name).alias("name"),
            F.when(to_house & is_number, F.concat(house, item)).otherwise(house).alias("house"),
            (acc["unexpected"] + misfit.cast("int")).alias("unexpected"),
        )

    def finish(acc):
        value = empty_to_null(F.array_join(acc["name"], " "))
        confidence = F.lit(1.0) - F.lit(K.STREET_PENALTY) * acc["unexpected"]
        return _parsed(value, empty_to_null(F.array_join(acc["house"], " ")), confidence)

    return F.aggregate(typed_tokens(n), start, step, finish)


def _is_absent(source: Column) -> Column:
    return F.lower(strip(F.coalesce(source, F.lit("")))).isin(*K.NO_BUILDING)


def house_tokens(n: Column) -> Column:
    pattern = A.token(K.HOUSE_TOKEN).replace("(?:", "(", 1)
    return F.array_join(F.regexp_extract_all(n, F.lit(pattern), F.lit(1)), " ")


def building_automaton(source: Column, n: Column) -> Column:
    """House numbers and ranges; an absent or 'no number' source is a sure null."""
    numbers = house_tokens(n)
    unexpected = (
        A.token_count(n)
        - A.token_count(numbers)
        - F.regexp_count(n, F.lit(A.token(*K.HOUSE_WORDS)))
    )
    confidence = F.lit(1.0) - F.lit(K.BUILDING_PENALTY) * unexpected
    value = F.when(~_is_absent(source), empty_to_null(numbers))
    return _parsed(value, _none(), confidence, F.when(_is_absent(source), 1.0).otherwise(0.0))


def parse_city(c: Column | str) -> Column:
    return city_automaton(A.normalize_text(c))


def parse_street(c: Column | str) -> Column:
    return street_automaton(A.normalize_text(c))


def parse_building(c: Column) -> Column:
    return building_automaton(c, A.normalize_text(c))


def building_value(c: Column) -> Column:
    """House numbers of a text joined by spaces, null when there are none."""
    return F.when(~_is_absent(c), empty_to_null(house_tokens(A.normalize_text(c))))


# --- regex recovery: candidate arrays ------------------------------------------------

def strip_house_tail(c: Column) -> Column:
    """Text before a prefixed house number, then before a trailing bare one."""
    anchored = K.TRAILING_HOUSE.replace("(.*?", "^(.*?", 1)
    head = F.try_element_at(F.split(c, K.HOUSE_WITH_PREFIX, 2), F.lit(1))
    return F.coalesce(empty_to_null(F.regexp_extract(head, anchored, 1)), head)


def _edges(c: Column) -> Column:
    return strip(c, K.EDGE_PUNCTUATION)


def _off_grid(c: Column) -> Column:
    return (
        c.rlike(K.CADASTRAL) | c.rlike(K.ROAD_DISTANCE) | A.normalize_text(c).rlike(K.ROAD_DISTANCE)
    )


def _scored(texts: Column, confidence: float) -> Column:
    """Candidates in order, each text once: what an address repeats is not looked at again."""
    return F.transform(
        F.array_compact(F.array_distinct(texts)),
        lambda t: F.struct(t.alias("text"), F.lit(confidence).alias("confidence")),
    )


def _last_parts_first(c: Column) -> Column:
    return F.reverse(split_parts(c))


def _or_empty(items: Column) -> Column:
    return F.coalesce(items, F.array().cast(_STRINGS))


def field_city_candidates(city: Column, district: Column) -> Column:
    """Parts of the city field, then of the district field, last part first."""
    fields = [_or_empty(F.when(~_off_grid(c), _last_parts_first(c))) for c in (city, district)]
    return _scored(F.concat(*fields), K.REGEX_CITY_FIELD)


def text_city_candidates(raw: Column) -> Column:
    """Parts before the street, then places with a type word, last first."""
    before_street = split_parts(F.try_element_at(F.split(raw, K.STREET_TYPE, 2), F.lit(1)))
    tagged = F.reverse(F.regexp_extract_all(raw, F.lit(K.LOCALITY), F.lit(1)))
    return F.concat(
        _scored(_or_empty(before_street), K.REGEX_CITY_FORWARD),
        _scored(_or_empty(tagged), K.REGEX_CITY_LOCALITY),
    )


def clean_city_candidates(candidates: Column) -> Column:
    """Add the cleaned name and its normalized forms to every candidate."""

    def clean(item):
        text = item["text"]
        name = F.coalesce(empty_to_null(F.regexp_extract(text, K.LOCALITY, 1)), text)
        return F.struct(
            text.alias("text"),
            A.normalize_text(text).alias("normalized"),
            _edges(strip_house_tail(F.regexp_replace(name, K.CITY_PREFIX, ""))).alias("value"),
            item["confidence"].alias("confidence"),
        )

    return F.transform(candidates, clean)


def pick_city(cleaned: Column) -> Column:
    def usable(item):
        n = item["normalized"]
        return (
            (n != "")
            & ~A.has_token(n, K.ADMIN_MARKERS)
            & ~item["text"].rlike(K.CADASTRAL)
            & ~item["text"].rlike(K.ROAD_DISTANCE)
            & ~n.rlike(K.ROAD_DISTANCE)
            & A.has_letters(item["value"])
            & A.normalize_city(item["value"]).isNotNull()
        )

    return F.try_element_at(F.filter(cleaned, usable), F.lit(1))


def typed_street_candidates(*texts: Column) -> Column:
    """'ул Ленина' and 'Красный проспект' forms found inside longer texts."""

    def forms(text):
        def form(pattern, type_group, name_group, type_first):
            kind = strip(F.regexp_extract(text, pattern, type_group), " .")
            name = _edges(strip_house_tail(F.regexp_extract(text, pattern, name_group)))
            both = F.concat_ws(" ", kind, name) if type_first else F.concat_ws(" ", name, kind)
            return F.when(text.rlike(pattern), both)

        return [form(K.STREET_TYPE, 1, 2, True), form(K.STREET_TYPE_TAIL, 2, 1, False)]

    return _scored(F.array(*[f for t in texts for f in forms(t)]), K.REGEX_STREET_TYPED)


def untyped_street_candidates(*texts: Column) -> Column:
    """Text before a house number, then comma parts that are no place or region."""

    def ordered(text):
        found = A.split_address(text)
        by_house = F.array(F.when(found["building"].isNotNull(), found["street"]))

        def part(p):
            n = A.normalize_text(p)
            only_number = F.coalesce(A.building_of(n) == n, F.lit(False))
            usable = ~only_number & ~A.has_token(n, K.LOCALITY_WORDS + K.ADMIN_MARKERS)
            return F.when(usable, strip_house_tail(p))

        candidates = F.concat(by_house, F.transform(_last_parts_first(text), part))
        return _or_empty(F.when(~A.normalize_text(text).rlike(K.ROAD_DISTANCE), candidates))

    return _scored(F.concat(*[ordered(t) for t in texts]), K.REGEX_STREET_UNTYPED)


def normalize_candidates(candidates: Column) -> Column:
    return F.transform(
        candidates,
        lambda item: F.struct(
            item["text"].alias("text"),
            A.normalize_text(item["text"]).alias("normalized"),
            item["confidence"].alias("confidence"),
        ),
    )


def pick_street(normalized: Column) -> Column:
    """First candidate (text, normalized, confidence) that is a usable street."""

    def usable(item):
        return (_edges(item["text"]) != "") & A.street_signal_of(item["normalized"])

    return F.try_element_at(F.filter(normalized, usable), F.lit(1))


def street_text(picked: Column) -> Column:
    return _edges(picked["text"])


def recovered_building(houses: Column, street: Column, extra_address: Column, raw: Column) -> Column:
    """House number from the best source that has one (evaluated lazily)."""

    def prefixed(c):
        return building_value(empty_to_null(F.regexp_extract(c, K.HOUSE_WITH_PREFIX, 1)))

    def trailing(c):
        return building_value(empty_to_null(F.regexp_extract(c, K.TRAILING_HOUSE, 2)))

    def anywhere(c):
        return F.when(~c.rlike(K.CADASTRAL), F.coalesce(building_value(c), prefixed(c), trailing(c)))

    def after_street(c):
        name = empty_to_null(F.regexp_extract(c, K.STREET_TYPE, 2))
        return F.coalesce(building_value(name), trailing(name), prefixed(c))

    return F.coalesce(
        anywhere(houses),
        *[after_street(c) for c in (street, extra_address, raw)],
        *[anywhere(c) for c in (street, extra_address)],
    )


def extra_address(extra: Column) -> Column:
    return F.coalesce(*[empty_to_null(F.try_element_at(extra, F.lit(k))) for k in K.EXTRA_ADDRESS_KEYS])


def extra_houses(extra: Column) -> Column:
    return empty_to_null(F.try_element_at(extra, F.lit("houses")))


def raw_location(region: Column, district: Column, city: Column, street: Column, extra: Column) -> Column:
    parts = [region, district, city, street, extra_houses(extra), extra_address(extra)]
    return F.concat_ws(", ", *[blank_to_null(p) for p in parts])
