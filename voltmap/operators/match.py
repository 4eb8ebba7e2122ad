"""Matching normalized events to an office registry.

Work is done on distinct event addresses, not on events: a thousand repeats of
one announcement are matched once.  Candidate offices come in three levels:
same city and street; else, for a known city, similar streets of that city;
else similar streets in similarly named cities.  Scoring joins offices through
three equi-joins (same building, covered house bucket, street-wide), so offices
of a busy street are never paired with every event on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import address as A
from voltmap.functions import rules as R
from voltmap.functions.hashing import content_id
from voltmap.functions.text import split_parts
from voltmap.operators.running import keep
from voltmap.operators.similarity import matching_ratio, similar_pairs
from voltmap.session import cut

HOUSE_BUCKET = 16
_ADDRESS = ["location_city", "location_street", "location_raw", "location_building"]


def office_profiles(offices: DataFrame) -> DataFrame:
    """office_id, name, o_city, o_street, o_building, house of every usable active office."""
    profiles = (
        offices.filter("is_active")
        .withColumn("_part", A.office_street_part("address"))
        .withColumn("_split", A.split_address(F.col("_part.street_text")))
        .withColumns(
            {
                "_cn": A.normalize_text("city"),
                "_sn": A.normalize_text("_split.street"),
                "_bn": A.normalize_text(F.coalesce("_part.building_text", "_split.building")),
            }
        )
        .select(
            F.col("id").alias("office_id"),
            F.col("name").alias("office_name"),
            A.city_of(F.col("_cn")).alias("o_city"),
            A.street_of(F.col("_sn")).alias("o_street"),
            A.building_of(F.col("_bn")).alias("o_building"),
        )
        .withColumn("house", A.first_house(A.ranges_of(F.coalesce("o_building", F.lit("")))))
    )
    return keep(profiles, (F.col("o_city") != "") & (F.col("o_street") != ""))


def address_id() -> Column:
    return content_id(*[F.col(c) for c in _ADDRESS])


def event_streets(events: DataFrame) -> DataFrame:
    """One row per (distinct address, street named in it).

    Columns: address_id, city_key, building_key, street_key, pos, ranges,
    has_house_data.  The building counts as house data of the first street.
    """
    addresses = (
        events.select(*_ADDRESS)
        .distinct()
        .withColumns(
            {"_cn": A.normalize_text("location_city"), "_bn": A.normalize_text("location_building")}
        )
        .select(
            address_id().alias("address_id"),
            A.city_of(F.col("_cn")).alias("city_key"),
            A.building_of(F.col("_bn")).alias("building_key"),
            F.concat(
                *[
                    F.coalesce(split_parts(F.col(c)), F.array().cast("array<string>"))
                    for c in ("location_street", "location_raw")
                ]
            ).alias("segments"),
        )
    )
    segments = addresses.select(
        "address_id", "city_key", "building_key", F.posexplode("segments").alias("pos", "segment")
    ).withColumn("n", A.normalize_text("segment"))
    named = keep(segments, A.looks_like_street(F.col("n"))).withColumn(
        "street_key", A.street_of(F.col("n"))
    )
    segments = (
        keep(named, (F.col("street_key") != "") & ~F.col("street_key").eqNullSafe(F.col("city_key")))
        .withColumn("has_house_data", A.has_house_data(F.col("n")))
        .withColumn("ranges", F.when(F.col("has_house_data"), A.ranges_of(F.col("n"))))
    )
    streets = segments.groupBy("address_id", "city_key", "building_key", "street_key").agg(
        F.min("pos").alias("pos"),
        F.bool_or("has_house_data").alias("has_house_data"),
        F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"),
    )
    is_first = F.col("pos") == F.min("pos").over(Window.partitionBy("address_id"))
    takes_building = is_first & F.col("building_key").isNotNull()
    return (
        streets.withColumn("_takes", takes_building)
        .withColumn("has_house_data", F.col("has_house_data") | F.col("_takes"))
        .withColumn(
            "ranges",
            F.when(F.col("_takes"), F.concat("ranges", A.ranges_of(F.col("building_key")))).otherwise(
                F.col("ranges")
            ),
        )
        .drop("_takes")
    )


def _level_one(streets: DataFrame, groups: DataFrame) -> DataFrame:
    """(address_id, o_city, o_street, city_score): office streets named by the address."""
    named = streets.filter("city_key IS NOT NULL").join(
        groups,
        (F.col("city_key") == F.col("o_city")) & (F.col("street_key") == F.col("o_street")),
    )
    single_owner = groups.groupBy("o_street").agg(
        F.min("o_city").alias("o_city"), F.max("o_city").alias("_other")
    ).filter("o_city = _other").drop("_other")
    cityless = streets.filter("city_key IS NULL").join(
        single_owner, F.col("street_key") == F.col("o_street")
    )
    keep = ["address_id", "o_city", "o_street"]
    return (
        named.select(*keep, F.lit(1.0).alias("city_score"))
        .unionByName(cityless.select(*keep, F.lit(K.CITY_CUTOFF).alias("city_score")))
        .distinct()
    )


def _score_level_one(streets: DataFrame, found: DataFrame) -> DataFrame:
    """Score every street of an address against the office streets it names."""
    pairs = found.join(streets, "address_id")
    a, b = F.length("street_key"), F.length("o_street")
    within = (F.col("street_key") == F.col("o_street")) | F.col("street_key").contains(
        F.col("o_street")
    ) | F.col("o_street").contains(F.col("street_key"))
    possible = ~within & (F.least(a, b) * 2 / (a + b) >= K.STREET_CUTOFF)
    ratios = (
        pairs.filter(possible)
        .select("street_key", "o_street")
        .distinct()
        .withColumn("ratio", matching_ratio("street_key", "o_street"))
    )
    score = (
        F.when(F.col("street_key") == F.col("o_street"), 1.0)
        .when(within, K.CONTAINMENT_SCORE)
        .otherwise(F.coalesce("ratio", F.lit(0.0)))
    )
    return pairs.join(ratios, ["street_key", "o_street"], "left").withColumn("street_score", score)


def candidates(streets: DataFrame, offices: DataFrame) -> DataFrame:
    """Streets of addresses with the office streets they may mean, scored."""
    groups = offices.select("o_city", "o_street").distinct()
    cities = offices.select("o_city").distinct()
    first = cut(_level_one(streets, groups))
    level_one = _score_level_one(streets, first)

    rest = cut(streets.join(first.select("address_id").distinct(), "address_id", "left_anti"))
    in_city = rest.join(cities, F.col("city_key") == F.col("o_city"), "left_semi")
    city_pairs = similar_pairs(
        in_city.select(F.col("city_key").alias("block"), F.col("street_key").alias("l")),
        groups.select(F.col("o_city").alias("block"), F.col("o_street").alias("r")),
        K.STREET_CUTOFF,
    )
    level_two = in_city.join(
        city_pairs, (F.col("city_key") == F.col("block")) & (F.col("street_key") == F.col("l"))
    ).select(
        *streets.columns, F.col("block").alias("o_city"), F.col("r").alias("o_street"),
        F.lit(1.0).alias("city_score"), F.col("score").alias("street_score"),
    )

    elsewhere = rest.join(cities, F.col("city_key") == F.col("o_city"), "left_anti")
    street_pairs = similar_pairs(
        elsewhere.select(F.lit("").alias("block"), F.col("street_key").alias("l")),
        groups.select(F.lit("").alias("block"), F.col("o_street").alias("r")),
        K.STREET_CUTOFF,
    ).drop("block")
    named_cities = similar_pairs(
        elsewhere.filter("city_key IS NOT NULL").select(
            F.lit("").alias("block"), F.col("city_key").alias("l")
        ),
        cities.select(F.lit("").alias("block"), F.col("o_city").alias("r")),
        K.CITY_CUTOFF,
    ).select(F.col("l").alias("city_key"), F.col("r").alias("o_city"), F.col("score").alias("city_score"))
    # A cityless address may mean any city that has the street.
    with_city = elsewhere.join(named_cities, "city_key").select(*streets.columns, "o_city", "city_score")
    on_street = with_city.join(street_pairs, F.col("street_key") == F.col("l")).withColumnRenamed(
        "r", "o_street"
    ).join(groups, ["o_city", "o_street"], "left_semi")
    cityless = (
        elsewhere.filter("city_key IS NULL")
        .join(street_pairs, F.col("street_key") == F.col("l"))
        .withColumnRenamed("r", "o_street")
        .join(groups, "o_street")
        .withColumn("city_score", F.lit(K.CITY_CUTOFF))
    )
    columns = [*streets.columns, "o_city", "o_street", "city_score", "street_score"]
    return (
        level_one.select(columns)
        .unionByName(level_two.select(columns))
        .unionByName(on_street.withColumnRenamed("score", "street_score").select(columns))
        .unionByName(cityless.withColumnRenamed("score", "street_score").select(columns))
        .filter(F.col("street_score") >= K.STREET_CUTOFF)
    )


def score_offices(cands: DataFrame, offices: DataFrame) -> DataFrame:
    """Best match per (address, office)."""
    exact_street = F.col("street_key") == F.col("o_street")
    exact_city = F.col("city_key").eqNullSafe(F.col("o_city"))
    place = ["o_city", "o_street"]
    staged = cands.withColumns({"exact_street": exact_street, "exact_city": exact_city})

    same_building = (
        staged.filter("exact_street AND building_key IS NOT NULL")
        .withColumn("o_building", F.col("building_key"))
        .join(offices, [*place, "o_building"])
        .withColumns(
            {
                "score": F.when(F.col("exact_city"), K.SCORE_EXACT).otherwise(K.SCORE_FUZZY_CITY_EXACT),
                "strategy": F.when(F.col("exact_city"), "exact_address").otherwise(
                    "fuzzy_city_exact_address"
                ),
                "detail": F.concat(F.lit("building="), F.col("building_key"), F.lit(" exact")),
            }
        )
    )
    buckets = F.array_distinct(
        F.flatten(
            F.transform(
                "ranges",
                lambda r: F.sequence(
                    F.floor(r["lo"] / F.lit(HOUSE_BUCKET)), F.floor(r["hi"] / F.lit(HOUSE_BUCKET))
                ),
            )
        )
    )
    fuzzy_score = F.lit(K.SCORE_RANGE_BASE) + F.lit(K.SCORE_RANGE_SLOPE) * F.col("street_score")
    range_score = F.when(
        F.col("exact_street") & F.col("exact_city"), K.SCORE_RANGE_CAP
    ).otherwise(F.round(F.least(fuzzy_score, F.lit(K.SCORE_RANGE_CAP)), 3))
    in_range = (
        staged.withColumn("bucket", F.explode(buckets))
        .join(
            offices.filter("house IS NOT NULL").withColumn(
                "bucket", F.floor(F.col("house") / F.lit(HOUSE_BUCKET))
            ),
            [*place, "bucket"],
        )
        .filter(A.covers(F.col("ranges"), F.col("house")))
        .withColumns(
            {
                "score": range_score,
                "strategy": F.when(F.col("exact_street"), "house_range").otherwise("fuzzy_house_range"),
                "detail": F.concat(
                    F.lit("house="), F.col("house").cast("string"), F.lit(" covered_by="),
                    F.to_json("ranges"),
                ),
            }
        )
    )
    street_wide = (
        staged.filter("exact_street AND exact_city AND NOT has_house_data")
        .join(offices, place)
        .withColumns(
            {
                "score": F.lit(K.SCORE_STREET_AREA),
                "strategy": F.lit("street_area"),
                "detail": F.lit("no house data in event; street-wide impact"),
            }
        )
    )
    explanation = F.array(
        F.format_string(
            "city_score=%.2f (%s -> %s)",
            F.col("city_score"), F.coalesce("city_key", F.lit("unknown")), F.col("o_city"),
        ),
        F.format_string(
            "street_score=%.2f (%s -> %s)", F.col("street_score"), F.col("street_key"), F.col("o_street")
        ),
        F.col("detail"),
    )
    columns = ["address_id", "office_id", "office_name", "score", "pos", "strategy", "explanation"]
    scored = [
        leg.withColumn("explanation", explanation).select(columns)
        for leg in (same_building, in_range, street_wide)
    ]
    everything = scored[0].unionByName(scored[1]).unionByName(scored[2])
    best = everything.groupBy("address_id", "office_id").agg(
        F.max_by(
            F.struct("office_name", "score", "strategy", "explanation"), F.struct("score", -F.col("pos"))
        ).alias("m")
    )
    return best.select("address_id", "office_id", "m.*")


def match(events: DataFrame, offices: DataFrame, now: Column) -> DataFrame:
    """(event, office) matches of events that are neither expired nor of type 'other'.

    Profiles and the first-level result feed many joins, so they are checkpointed
    once instead of being recomputed in each branch.
    """
    current = events.filter(
        (F.col("end_time").isNull() | (F.col("end_time") >= now)) & ~F.col("event_type").eqNullSafe("other")
    )
    profiles = cut(office_profiles(offices))
    scored = cut(candidates(cut(event_streets(current)), profiles))
    best = score_offices(scored, profiles)
    return (
        current.withColumn("address_id", address_id())
        .join(best, "address_id")
        .select(
            "event_id",
            "office_id",
            "office_name",
            "start_time",
            "end_time",
            R.impact_level(F.col("start_time"), F.col("end_time"), now).alias("impact_level"),
            F.col("strategy").alias("match_strategy"),
            F.col("score").alias("match_score"),
            F.col("explanation").alias("match_explanation"),
            "trace_id",
        )
    )


def to_impacts(matches: DataFrame, detected_at: Column) -> DataFrame:
    return matches.select(
        content_id(F.lit("impact"), F.col("office_id"), F.col("event_id")).alias("id"),
        "office_id",
        "event_id",
        F.col("start_time").alias("impact_start"),
        F.col("end_time").alias("impact_end"),
        "impact_level",
        "match_strategy",
        "match_score",
        "match_explanation",
        "trace_id",
        detected_at.alias("detected_at"),
    )


def to_notifications(
    impacts: DataFrame, offices: DataFrame, events: DataFrame, emitted_at: Column,
    channels: tuple[str, ...] = ("dashboard",),
) -> DataFrame:
    """One row per impact and channel; non-dashboard rows are an outbox ('pending')."""
    names = offices.select(F.col("id").alias("office_id"), F.col("name").alias("office_name"))
    facts = events.select(
        "event_id", "start_time", "end_time", "reason",
        F.coalesce("location_normalized", "location_raw").alias("location"),
    )
    level = R.coerce(F.col("impact_level"), K.IMPACT_LEVELS, "medium")
    dashboard = R.summary_text(
        F.col("office_name"), F.col("location"), F.col("start_time"), F.col("end_time"),
        F.col("match_strategy"),
    )
    alert = R.alert_text(
        F.col("office_name"), F.col("location"), F.col("reason"), F.col("start_time"),
        F.col("end_time"), level, F.col("match_strategy"), F.col("event_id"),
    )
    return (
        impacts.join(names, "office_id")
        .join(facts, "event_id")
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
        .select(
            content_id(F.lit("note"), F.col("office_id"), F.col("event_id"), F.col("channel")).alias("id"),
            "office_id",
            "event_id",
            "channel",
            F.when(F.col("channel") == "dashboard", "sent").otherwise("pending").alias("status"),
            level.alias("severity"),
            F.when(F.col("channel") == "dashboard", dashboard).otherwise(alert).alias("summary"),
            "trace_id",
            emitted_at.alias("emitted_at"),
        )
    )


def rebuild_impacts(
    events: DataFrame, offices: DataFrame, impacts: DataFrame, now: Column,
    future_days: int = K.RISK_HORIZON_DAYS, all_events: bool = False, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recompute the impacts of the events in the horizon.

    Returns (new impacts table, one-row report).
    """
    from voltmap.operators.upsert import replace_for_keys

    chosen = events
    if not all_events:
        horizon = now + F.expr(f"INTERVAL {future_days} DAYS")
        chosen = events.filter(R.is_active(F.col("start_time"), F.col("end_time"), now, horizon))
    if limit is not None:
        chosen = chosen.orderBy("start_time", "event_id").limit(max(0, limit))
    # The table and the report both read it: matched once.
    fresh = cut(to_impacts(match(chosen, offices, now), now))
    after = replace_for_keys(impacts, fresh, chosen.select("event_id"), ["event_id"])
    open_now = F.col("impact_end").isNull() | (F.col("impact_end") >= now)
    report = (
        chosen.agg(F.count("*").alias("events_rebuilt"))
        .join(fresh.agg(F.count("*").alias("impacts_inserted")))
        .join(impacts.agg(F.count_if(open_now).alias("active_or_future_before")))
        .join(after.agg(F.count_if(open_now).alias("active_or_future_after")))
    )
    return after, report
