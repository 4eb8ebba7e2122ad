"""One explicit schema per table (DDL strings; timestamps are UTC)."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "sources": (
        "id string, name string, url string, source_type string, poll_interval_seconds int, "
        "is_active boolean, parser_profile map<string,string>, created_at timestamp"
    ),
    "raw_records": (
        "id string, source_id string, source_url string, source_type string, raw_content string, "
        "content_hash string, fetched_at timestamp, trace_id string"
    ),
    "parsed_records": (
        "id string, raw_record_id string, source_id string, external_id string, "
        "start_time timestamp, end_time timestamp, location_city string, location_district string, "
        "location_street string, location_region_code string, reason string, "
        "extra map<string,string>, trace_id string, extracted_at timestamp"
    ),
    "normalized_events": (
        "event_id string, parsed_record_id string, event_type string, start_time timestamp, "
        "end_time timestamp, location_raw string, location_normalized string, location_city string, "
        "location_street string, location_building string, reason string, sources array<string>, "
        "confidence double, trace_id string, normalized_at timestamp"
    ),
    "dedup_events": (
        "id string, incoming_event_id string, existing_event_id string, strategy string, "
        "trace_id string, created_at timestamp"
    ),
    "offices": (
        "id string, name string, city string, address string, region string, is_active boolean, "
        "latitude double, longitude double, extra map<string,string>, created_at timestamp"
    ),
    "office_impacts": (
        "id string, office_id string, event_id string, impact_start timestamp, impact_end timestamp, "
        "impact_level string, match_strategy string, match_score double, "
        "match_explanation array<string>, trace_id string, detected_at timestamp"
    ),
    "event_logs": (
        "id string, event_type string, severity string, message string, source string, "
        "task_id string, trace_id string, payload map<string,string>, created_at timestamp"
    ),
    "queue_depth_snapshots": "id string, pending int, running int, failed int, created_at timestamp",
    "notifications": (
        "id string, office_id string, event_id string, channel string, status string, "
        "severity string, summary string, trace_id string, emitted_at timestamp"
    ),
    "tasks": (
        "id string, task_type string, input_hash string, status string, attempt int, "
        "max_attempts int, payload map<string,string>, error string, trace_id string, "
        "started_at timestamp, completed_at timestamp, duration_ms int, next_run_at timestamp, "
        "normalizer_path string, created_at timestamp, updated_at timestamp"
    ),
    "llm_calls": (
        "id string, task_id string, model string, prompt_tokens int, completion_tokens int, "
        "total_tokens int, duration_ms int, status string, trace_id string, created_at timestamp"
    ),
}

# Natural keys that the upsert operators keep unique.
UNIQUE_KEYS = {
    "raw_records": ["content_hash"],
    "parsed_records": ["fingerprint"],
    "offices": ["name", "city", "address"],
    "office_impacts": ["office_id", "event_id"],
    "notifications": ["office_id", "event_id", "channel"],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def tables() -> tuple[str, ...]:
    return tuple(_DDL)
