"""Parsed records -> normalized events.

Three normalizers over the same input columns: the token automaton, the regex
recovery, and the threshold fallback that combines both.  Every one adds a
struct column, so callers decide what to keep; rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import address as A
from voltmap.functions import fields as P
from voltmap.functions.hashing import content_id
from voltmap.functions.text import blank_to_null, plain_spaces
from voltmap.operators.running import keep, prefix_totals

_RESULT = "struct<city:string,street:string,building:string,confidence:double>"


def _result(city: Column, street: Column, building: Column, confidence: Column) -> Column:
    return F.struct(
        city.alias("city"),
        street.alias("street"),
        building.alias("building"),
        confidence.cast("double").alias("confidence"),
    )


def address_confidence(city: Column, street: Column, building: Column, source: Column) -> Column:
    """The weakest field of an address counts; a building only where there is a text of one."""
    slots = F.least(city["confidence"], street["confidence"])
    slots = F.when(source.isNotNull(), F.least(slots, building["confidence"])).otherwise(slots)
    return F.when(city["value"].isNull(), slots * K.NO_CITY_FACTOR).otherwise(slots)


def address_result(building: Column, confidence: Column) -> Column:
    """The automaton's result: the city and street fields as they stand, and the building found."""
    return _result(
        blank_to_null(F.col("location_city")), blank_to_null(F.col("location_street")), building, confidence
    )


def with_automaton(parsed: DataFrame, out: str = "automaton") -> DataFrame:
    """Add the automaton result; null when there is no start time or street."""
    staged = (
        parsed.withColumns(
            {
                "_cn": A.normalize_text("location_city"),
                "_sn": A.normalize_text("location_street"),
                "_houses": P.extra_houses(F.col("extra")),
            }
        )
        .withColumns({"_city": P.city_automaton(F.col("_cn")), "_street": P.street_automaton(F.col("_sn"))})
        .withColumn("_source", F.coalesce(F.col("_houses"), F.col("_street.extra")))
        .withColumn("_bn", A.normalize_text("_source"))
        .withColumn("_building", P.building_automaton(F.col("_source"), F.col("_bn")))
    )
    confidence = address_confidence(F.col("_city"), F.col("_street"), F.col("_building"), F.col("_source"))
    usable = F.col("start_time").isNotNull() & F.col("_street.value").isNotNull()
    result = address_result(F.col("_building.value"), confidence)
    return staged.withColumn(out, F.when(usable, result)).drop(
        "_cn", "_sn", "_bn", "_houses", "_city", "_street", "_source", "_building"
    )


def with_regex(parsed: DataFrame, out: str = "regex", needed: Column | None = None) -> DataFrame:
    """Add the regex recovery result, evaluated only where `needed` holds.

    Candidates, their cleaned forms and the pick are separate columns, so each
    text is normalized once.
    """
    wanted = F.col("start_time").isNotNull()
    if needed is not None:
        wanted = wanted & needed
    field, addr, raw = F.col("_field"), F.col("_addr"), F.col("_raw")

    def pick(df, out_col, when, candidates, prepare, choose):
        return (
            df.withColumn(out_col, F.when(when, candidates))
            .withColumn(out_col, prepare(F.col(out_col)))
            .withColumn(out_col, choose(F.col(out_col)))
        )

    staged = parsed.withColumn("_wanted", wanted).withColumns(
        {
            "_raw": F.when(F.col("_wanted"), plain_spaces(location_raw())),
            "_addr": F.when(F.col("_wanted"), plain_spaces(P.extra_address(F.col("extra")))),
            "_field": F.when(F.col("_wanted"), plain_spaces(F.col("location_street"))),
        }
    )
    staged = pick(
        staged, "_s1", F.col("_wanted"), P.typed_street_candidates(field, addr, raw),
        P.normalize_candidates, P.pick_street,
    )
    staged = pick(
        staged, "_s2", F.col("_wanted") & F.col("_s1").isNull(),
        P.untyped_street_candidates(field, addr), P.normalize_candidates, P.pick_street,
    )
    staged = staged.withColumn("_s", F.coalesce("_s1", "_s2")).withColumn(
        "_found", F.col("_s").isNotNull()
    )
    staged = pick(
        staged, "_c1", F.col("_found"),
        P.field_city_candidates(
            plain_spaces(F.col("location_city")), plain_spaces(F.col("location_district"))
        ),
        P.clean_city_candidates, P.pick_city,
    )
    staged = pick(
        staged, "_c2", F.col("_found") & F.col("_c1").isNull(), P.text_city_candidates(raw),
        P.clean_city_candidates, P.pick_city,
    )
    staged = staged.withColumn("_c", F.coalesce("_c1", "_c2")).withColumn(
        "_b",
        F.when(
            F.col("_found"),
            P.recovered_building(P.extra_houses(F.col("extra")), field, addr, raw),
        ),
    )
    total = (
        F.col("_s.confidence")
        + F.coalesce(F.col("_c.confidence"), F.lit(0.0))
        + F.when(F.col("_b").isNotNull(), K.REGEX_BUILDING).otherwise(0.0)
    )
    capped = F.least(F.lit(K.REGEX_CONFIDENCE_CAP), total)
    confidence = F.when(F.col("_c").isNull(), capped * K.REGEX_NO_CITY_FACTOR).otherwise(capped)
    result = _result(
        F.col("_c.value"), P.street_text(F.col("_s")), F.col("_b"), F.round(confidence, 3)
    )
    return staged.withColumn(out, F.when(F.col("_found"), result)).drop(
        "_wanted", "_raw", "_addr", "_field", "_s1", "_s2", "_s", "_found", "_c1", "_c2", "_c", "_b"
    )


def location_raw() -> Column:
    return P.raw_location(
        F.col("location_region_code"),
        F.col("location_district"),
        F.col("location_city"),
        F.col("location_street"),
        F.col("extra"),
    )


def slot_count(result: Column) -> Column:
    def filled(name):
        return F.coalesce((result[name] != "").cast("int"), F.lit(0))

    return filled("city") + filled("street") + filled("building")


def with_fallback(
    parsed: DataFrame,
    threshold: float = K.FALLBACK_THRESHOLD,
    allow_fallback: Column | None = None,
) -> DataFrame:
    """Add `result` and `normalizer_path`.

    The automaton result stands when its confidence reaches `threshold`.  Below
    it the regex recovery is tried, and loses if it fills fewer address slots.
    """
    allowed = F.lit(True) if allow_fallback is None else allow_fallback
    sure = F.coalesce(F.col("automaton.confidence") >= threshold, F.lit(False))
    staged = with_regex(
        with_automaton(parsed).withColumn("_escalate", allowed & ~sure),
        needed=F.col("_escalate"),
    )
    takes_regex = F.col("regex").isNotNull() & (
        F.col("automaton").isNull()
        | (slot_count(F.col("regex")) >= slot_count(F.col("automaton")))
    )
    return (
        staged.withColumn("result", F.when(takes_regex, F.col("regex")).otherwise(F.col("automaton")))
        .withColumn(
            "normalizer_path",
            F.when(takes_regex, "regex_fallback")
            .when(F.col("automaton").isNotNull(), "automaton")
            .otherwise("none"),
        )
        .drop("_escalate")
    )


def with_canonical_key(df: DataFrame, city: Column, street: Column, building: Column, out: str) -> DataFrame:
    """`canonical_key` in stages: every text is normalized in a projection of its
    own, which keeps generated methods small enough to be compiled."""
    given = F.nullif(building, F.lit(""))
    recover = given.isNull() & (street != "")
    return (
        df.withColumns({"_city": city, "_street": street, "_given": given, "_recover": recover})
        .withColumn("_tail", F.when(F.col("_recover"), A.trailing_part(F.col("_street"))))
        .withColumns(
            {
                "_cn": A.normalize_text("_city"),
                "_sn": A.normalize_text("_street"),
                "_tn": A.normalize_text("_tail"),
            }
        )
        .withColumn(
            "_number",
            F.coalesce(
                F.col("_given"),
                F.when(
                    F.col("_recover"),
                    F.when(A.building_of(F.col("_tn")).isNotNull(), F.col("_tail")).otherwise(
                        A.last_house(F.col("_street"))
                    ),
                ),
            ),
        )
        .withColumn("_bn", A.normalize_text("_number"))
        .withColumn(
            out,
            F.nullif(
                F.concat_ws(
                    "|",
                    F.coalesce(A.city_of(F.col("_cn")), F.lit("")),
                    A.street_of(F.col("_sn")),
                    F.coalesce(A.building_of(F.col("_bn")), F.lit("")),
                ),
                F.lit("||"),
            ),
        )
        .drop("_city", "_street", "_given", "_recover", "_tail", "_cn", "_sn", "_tn", "_number", "_bn")
    )


def to_events(
    results: DataFrame, result: str = "result", extra: tuple[str, ...] = (), key: Column | None = None
) -> DataFrame:
    """Normalized event rows from a result struct column; rows without one drop out.

    Event ids derive from the parsed record id, so a rerun yields the same ids.  `key` is the
    canonical key of the result where it is known already.
    """
    r = F.col(result)
    kept = keep(results, r.isNotNull())
    if key is None:
        keyed = with_canonical_key(kept, r["city"], r["street"], r["building"], "location_normalized")
    else:
        keyed = kept.withColumn("location_normalized", key)
    return keyed.select(
        content_id(F.lit("event"), F.col("id")).alias("event_id"),
        F.col("id").alias("parsed_record_id"),
        F.lit("power_outage").alias("event_type"),
        "start_time",
        "end_time",
        location_raw().alias("location_raw"),
        "location_normalized",
        r["city"].alias("location_city"),
        r["street"].alias("location_street"),
        r["building"].alias("location_building"),
        "reason",
        F.array("raw_record_id").alias("sources"),
        r["confidence"].alias("confidence"),
        "trace_id",
        F.col("extracted_at").alias("normalized_at"),
        *extra,
    )


def from_entries(looked_up: DataFrame, allow_fallback: Column | None = None) -> DataFrame:
    """Events of records with the dictionary's `entry`, by the rule of `with_fallback`."""
    allowed = F.lit(True) if allow_fallback is None else allow_fallback
    timed = F.col("start_time").isNotNull()
    staged = looked_up.withColumns(
        {"automaton": F.when(timed, F.col("entry.automaton")), "regex": F.when(timed & allowed, F.col("entry.regex"))}
    )
    takes_regex = F.col("regex").isNotNull() & (
        F.col("automaton").isNull() | (slot_count(F.col("regex")) >= slot_count(F.col("automaton")))
    )
    staged = staged.withColumn("_takes", takes_regex).withColumns(
        {
            "result": F.when(F.col("_takes"), F.col("regex")).otherwise(F.col("automaton")),
            "normalizer_path": F.when(F.col("_takes"), "regex_fallback").otherwise("automaton"),
        }
    )
    key = F.when(F.col("_takes"), F.col("entry.regex_key")).otherwise(F.col("entry.automaton_key"))
    return to_events(staged, extra=("normalizer_path",), key=key)


def normalize(
    parsed: DataFrame,
    threshold: float = K.FALLBACK_THRESHOLD,
    allow_fallback: Column | None = None,
) -> DataFrame:
    """Events of parsed records; every distinct address is normalized once."""
    from voltmap.operators.dictionary import look_up

    return from_entries(look_up(parsed, threshold=threshold)[0], allow_fallback)


def normalize_by_automaton(parsed: DataFrame) -> DataFrame:
    """Events of the automaton alone, by the same dictionary."""
    from voltmap.operators.dictionary import look_up

    rows = look_up(parsed)[0].withColumn(
        "automaton", F.when(F.col("start_time").isNotNull(), F.col("entry.automaton"))
    )
    return to_events(rows, "automaton", key=F.col("entry.automaton_key"))


def normalize_with_cache(
    parsed: DataFrame, events: DataFrame, threshold: float = K.FALLBACK_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Split by what is already normalized.

    Returns (fresh events, sticky source additions).  A parsed record with a
    stored event keeps that event unchanged; only its raw record id is added to
    the event's sources, as one row per new source.
    """
    known = events.select(F.col("parsed_record_id").alias("id"), "event_id", "sources").filter(
        F.col("id").isNotNull()
    )
    fresh = normalize(parsed.join(known, "id", "left_anti"), threshold)
    additions = (
        parsed.join(known, "id")
        .filter(~F.array_contains(F.col("sources"), F.col("raw_record_id")))
        .select("event_id", F.col("raw_record_id").alias("source"), F.col("extracted_at").alias("seen_at"))
    )
    return fresh, additions


def normalization_on(enabled: bool = True) -> Column:
    """Whether a record's source is normalized: `normalization_enabled` of its profile, on by default."""
    value = F.lower(F.try_element_at(F.col("parser_profile"), F.lit("normalization_enabled")))
    own = F.when(value.isNotNull(), value.isin(*K.TRUE_WORDS))
    return F.coalesce(own, F.lit(True)) & F.lit(enabled)


def fallback_gates(
    parsed: DataFrame,
    raw_order: list[str],
    *,
    enabled: bool = True,
    max_per_raw: int | None = None,
    max_per_source: int | None = None,
    used: DataFrame | None = None,
) -> DataFrame:
    """Add `allow_fallback` per parsed record.

    Expects `parser_profile`, `source_id`, `raw_record_id` and `pos` (position in
    its payload).  `raw_order` orders the payloads of a source for the running
    budget.  The per-payload limit is a comparison on `pos`; the per-source
    budget is a prefix count taken over per-payload totals, so no task ever
    holds all records of a source.  `used` (source_id, used) is what earlier batches took of
    the budget; `budget_spent` gives it for the next one.
    """
    profile = F.col("parser_profile")

    def flag(key):
        value = F.lower(F.try_element_at(profile, F.lit(key)))
        return F.when(value.isNotNull(), value.isin(*K.TRUE_WORDS))

    on = F.coalesce(flag("fallback_enabled"), flag("regex_fallback_enabled"), F.lit(True)) & F.lit(enabled)
    own = F.try_element_at(profile, F.lit("fallback_limit"))
    own_limit = F.when(
        own.isNotNull(), F.greatest(F.coalesce(own.try_cast("int"), F.lit(0)), F.lit(0))
    )
    limit = F.least(own_limit, F.lit(max_per_raw).cast("int")) if max_per_raw is not None else own_limit
    per_raw = on & (limit.isNull() | (F.col("pos") < limit))
    gated = parsed.withColumn("_candidate", per_raw)
    if max_per_source is None:
        return gated.withColumnRenamed("_candidate", "allow_fallback")
    # A payload's candidates have positions 0..n-1, so its share of the budget is
    # budget - (candidates in earlier payloads), compared with `pos`.
    totals = gated.groupBy("source_id", "raw_record_id", *raw_order).agg(
        F.count_if("_candidate").alias("_n")
    )
    before = prefix_totals(totals, ["source_id"], [*raw_order, "raw_record_id"], "_n", "_used").select(
        "source_id", "raw_record_id", "_used"
    )
    if used is not None:
        earlier = used.select(F.col("source_id").alias("_source"), F.col("used").alias("_earlier"))
        before = before.join(earlier, F.col("source_id").eqNullSafe(F.col("_source")), "left").select(
            "source_id", "raw_record_id", (F.col("_used") + F.coalesce("_earlier", F.lit(0))).alias("_used")
        )
    joined = gated.alias("g").join(
        before.alias("b"),
        F.col("g.source_id").eqNullSafe(F.col("b.source_id"))
        & (F.col("g.raw_record_id") == F.col("b.raw_record_id")),
    ).select("g.*", "b._used")
    return joined.withColumn(
        "allow_fallback", F.col("_candidate") & (F.col("_used") + F.col("pos") < max_per_source)
    ).drop("_candidate", "_used")


def budget_spent(gated: DataFrame, used: DataFrame) -> DataFrame:
    """(source_id, used) after the records that `fallback_gates` allowed, for the sources among them."""
    taken = gated.filter("allow_fallback").groupBy("source_id").agg(F.count("*").alias("_taken"))
    earlier = used.select(F.col("source_id").alias("_source"), "used")
    return taken.join(earlier, F.col("source_id").eqNullSafe(F.col("_source")), "left").select(
        "source_id", (F.col("_taken") + F.coalesce("used", F.lit(0))).alias("used")
    )
