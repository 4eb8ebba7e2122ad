"""Content hashes: ids that stay the same when a job is rerun or retried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltmap.functions.text import col, empty_to_null


def content_hash(c: Column | str) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(col(c).cast("binary"), 256)


def content_id(*parts: Column) -> Column:
    """Deterministic id of a tuple; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def _sorted_map_json(extra: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra))))


def parsed_fingerprint() -> Column:
    """Key of a parsed record: (source, external id) when known, else its content."""
    external = empty_to_null(F.col("external_id"))
    by_id = F.to_json(
        F.struct(F.col("external_id"), F.col("source_id")), {"ignoreNullFields": "false"}
    )
    by_content = F.to_json(
        F.struct(
            F.col("location_city").alias("city"),
            F.col("location_district").alias("district"),
            F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"),
            _sorted_map_json(F.col("extra")).alias("extra"),
            F.col("reason"),
            F.col("location_region_code").alias("region"),
            F.col("source_id"),
            F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
            F.col("location_street").alias("street"),
        ),
        {"ignoreNullFields": "false"},
    )
    known = F.col("source_id").isNotNull() & external.isNotNull()
    return content_hash(F.when(known, by_id).otherwise(by_content))


def input_hash(task_type: Column, payload: Column) -> Column:
    """Hash of a task's type and payload with sorted keys."""
    return content_hash(
        F.to_json(F.struct(_sorted_map_json(payload).alias("payload"), task_type.alias("task_type")))
    )
