"""Office registries, labelled cases and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import fields as P
from voltmap.functions import rules as R
from voltmap.functions.hashing import content_id
from voltmap.functions.text import (
    blank_to_null, collapse_spaces, decode_entities, drop_parenthetical, empty_to_null, strip,
    strip_fences,
)

_OFFICE = (
    "struct<name:string,city:string,address:string,region:string,is_active:boolean,"
    "latitude:double,longitude:double,extra:map<string,string>>"
)
_BRANCH = "id:string,type:string,name:string,address:string,active:boolean,latitude:double,longitude:double"
_OPTIONS = (
    f"struct<resultsMap:struct<data:array<struct<{_BRANCH}>>>,"
    "results:struct<data:array<struct<id:string,name:string,address:string,phone:string>>>>"
)


def missing_columns(columns) -> list[str]:
    return sorted(set(K.OFFICE_REQUIRED_COLUMNS) - set(columns))


def read_offices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV (UTF-8, BOM allowed), quoted fields may span lines."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return clean_office_rows(df)


def clean_office_rows(df: DataFrame) -> DataFrame:
    """Text columns of an office file -> typed rows; bad numbers become null."""

    def optional(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    active = empty_to_null(optional("is_active"))
    return df.select(
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in K.OFFICE_REQUIRED_COLUMNS],
        F.when(active.isNull(), True).otherwise(F.lower(strip(active)).isin(*K.TRUE_WORDS)).alias("is_active"),
        optional("latitude").try_cast("double").alias("latitude"),
        optional("longitude").try_cast("double").alias("longitude"),
    )


def read_offices_json(spark: SparkSession, path: str) -> DataFrame:
    """{"offices": [...]} documents."""
    df = spark.read.schema(f"offices array<{_OFFICE}>").option("multiLine", True).json(path)
    return df.select(F.explode("offices").alias("o")).select("o.*")


def valid_offices(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with all required texts, quarantined rows)."""
    ok = F.lit(True)
    for c in K.OFFICE_REQUIRED_COLUMNS:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return rows.filter(ok), rows.filter(~ok)


def attribute_json(html: Column, attribute: str = "data-module-options", needs: str = "&quot;resultsMap&quot;") -> Column:
    """First attribute value containing `needs`, entity-decoded."""
    values = F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"'), F.lit(1))
    return decode_entities(F.try_element_at(F.filter(values, lambda v: v.contains(needs)), F.lit(1)))


def branch_offices(pages: DataFrame, bank: str, default_name: str) -> DataFrame:
    """Directory pages (city, region, html) -> office rows; details fill gaps by id.

    Branches and details of a page meet by an aggregation over (page, id), so a page of any
    number of branches takes a time in proportion to it, and its html is dropped at once.
    """
    parsed = pages.select("city", "region", F.from_json(attribute_json(F.col("html")), _OPTIONS).alias("_o")).select(
        F.sha2(F.to_json(F.struct("_o", "city", "region")), 256).alias("_page"), "city", "region", "_o"
    )
    rows = parsed.select("_page", "city", "region", F.posexplode("_o.resultsMap.data").alias("_at", "m")).filter(
        F.col("m.type") == "office"
    )
    # A later detail with the same id wins, as in a map built front to back.
    details = parsed.select("_page", F.posexplode("_o.results.data").alias("_at", "d")).filter("d.id IS NOT NULL")
    last = details.groupBy("_page", F.col("d.id").alias("_id")).agg(F.max_by("d", "_at").alias("_f"))
    rows = rows.join(last, (rows["_page"] == last["_page"]) & (F.col("m.id") == F.col("_id")), "left")
    name = collapse_spaces(
        F.coalesce(empty_to_null(F.col("m.name")), empty_to_null(F.col("_f.name")), F.lit(default_name))
    )
    out = rows.select(
        F.concat(F.lit(f"{bank} — "), name).alias("name"),
        drop_parenthetical(F.col("city")).alias("city"),
        collapse_spaces(
            F.coalesce(empty_to_null(F.col("m.address")), F.col("_f.address"))
        ).alias("address"),
        "region",
        F.coalesce(F.col("m.active"), F.lit(True)).alias("is_active"),
        F.col("m.latitude").alias("latitude"),
        F.col("m.longitude").alias("longitude"),
        F.col("m.id").alias("office_id"),
    )
    return valid_offices(out)[0]


def distinct_offices(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First office per case-insensitive (name, city, address)."""
    from voltmap.operators.running import earliest_per_key

    key = F.lower(F.concat_ws("|", "name", "city", "address"))
    return earliest_per_key(rows.withColumn("_k", key), ["_k"], order).drop("_k")


def distinct_cities(rows: DataFrame, regions, order: list[Column]) -> DataFrame:
    """Discovered cities of the wanted regions, last one per id."""
    from voltmap.operators.running import latest_per_key

    return latest_per_key(rows.filter(F.col("area_name").isin(*regions)), ["id"], order)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled normalization cases as parsed records plus expectations."""
    case_schema = (
        "name string, parsed struct<external_id:string,start_time:string,end_time:string,"
        "location_city:string,location_district:string,location_street:string,"
        "location_region_code:string,reason:string,extra:map<string,string>>, "
        "expected struct<event_type:string,canonical_key:string,min_confidence:double>"
    )
    df = spark.read.schema(case_schema).option("multiLine", True).json(path)
    return df.select(
        "name",
        F.col("name").alias("id"),
        F.col("name").alias("raw_record_id"),
        F.lit(None).cast("string").alias("source_id"),
        "parsed.external_id",
        R.iso_timestamp(F.col("parsed.start_time")).alias("start_time"),
        R.iso_timestamp(F.col("parsed.end_time")).alias("end_time"),
        "parsed.location_city", "parsed.location_district", "parsed.location_street",
        "parsed.location_region_code", "parsed.reason",
        F.coalesce("parsed.extra", F.create_map().cast("map<string,string>")).alias("extra"),
        F.lit("case").alias("trace_id"),
        R.iso_timestamp(F.col("parsed.start_time")).alias("extracted_at"),
        F.col("expected.event_type").alias("expected_event_type"),
        F.col("expected.canonical_key").alias("expected_canonical_key"),
        F.coalesce("expected.min_confidence", F.lit(0.0)).alias("min_confidence"),
    )


_REPLY = (
    "struct<event_type:string,start_time:string,end_time:string,location:struct<raw:string,city:string,"
    "street:string,building:string>,reason:string,confidence:string>"
)


def reply_events(replies: DataFrame) -> DataFrame:
    """Model replies (column `reply`) joined with their parsed records -> event columns.

    The reply's fields win, the parsed record fills gaps; replies that are no
    JSON object or leave no start time give no row.
    """
    from voltmap.operators.normalize import with_canonical_key
    from voltmap.operators.running import keep

    content = strip_fences(F.get_json_object("reply", "$.choices[0].message.content"))
    rows = replies.withColumn("_content", content).withColumn("_e", F.from_json("_content", _REPLY))
    start = F.coalesce(R.iso_timestamp(F.col("_e.start_time")), F.col("start_time"))
    city = F.coalesce(blank_to_null(F.col("_e.location.city")), F.col("location_city"))
    street = F.coalesce(blank_to_null(F.col("_e.location.street")), F.col("location_street"))
    number = F.coalesce(F.col("_e.confidence").try_cast("double"), F.lit(0.0))
    plain = P.raw_location(
        F.col("location_region_code"), F.col("location_district"), F.col("location_city"),
        F.col("location_street"),
        F.map_filter("extra", lambda k, v: k == "houses"),
    )
    staged = keep(rows, F.col("_content").startswith("{") & F.col("_e").isNotNull()).withColumns(
        {"_start": start, "_city": city, "_street": street,
         "_building": blank_to_null(F.col("_e.location.building"))}
    )
    keyed = with_canonical_key(
        staged.filter(F.col("_start").isNotNull()).withColumnsRenamed(
            {"_city": "r_city", "_street": "r_street", "_building": "r_building"}
        ),
        F.col("r_city"), F.col("r_street"), F.col("r_building"), "location_normalized",
    )
    return keyed.select(
        "id",
        R.coerce(F.col("_e.event_type"), K.EVENT_TYPES, "power_outage").alias("event_type"),
        F.col("_start").alias("start_time"),
        F.coalesce(R.iso_timestamp(F.col("_e.end_time")), F.col("end_time")).alias("end_time"),
        F.coalesce(empty_to_null(F.col("_e.location.raw")), plain).alias("location_raw"),
        "location_normalized",
        F.col("r_city").alias("location_city"),
        F.col("r_street").alias("location_street"),
        F.col("r_building").alias("location_building"),
        F.coalesce(blank_to_null(F.col("_e.reason")), F.col("reason")).alias("reason"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("confidence"),
    )


def reply_usage(reply: Column) -> Column:
    """Token counts of a reply, zeros when absent; a missing total is the sum."""

    def count(name):
        return F.coalesce(F.get_json_object(reply, f"$.usage.{name}").try_cast("int"), F.lit(0))

    prompt, completion = count("prompt_tokens"), count("completion_tokens")
    return F.struct(
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.coalesce(F.nullif(count("total_tokens"), F.lit(0)), prompt + completion).alias("total_tokens"),
    )
