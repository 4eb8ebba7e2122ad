import datetime as dt
import tempfile

from pyspark.sql import functions as F

from voltmap.streaming import streams as S

T0 = dt.datetime(2026, 5, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, batches, ddl, build, mode="append"):
    """Feed one file per batch through `build` and return the emitted rows."""
    src, chk, out = (tempfile.mkdtemp(prefix="voltmap-") for _ in range(3))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(spark.createDataFrame([], ddl).schema).option(
        "maxFilesPerTrigger", 1
    ).parquet(f"{src}/*")
    q = (
        build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_distinct_payloads(spark):
    rows = run(
        spark, [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]],
        "content_hash string, fetched_at timestamp", S.distinct_payloads,
    )
    assert sorted(r.content_hash for r in rows) == ["a", "b", "c"]


EVENT_DDL = (
    "event_id string, parsed_record_id string, event_type string, start_time timestamp, end_time timestamp, location_raw string, "
    "location_normalized string, location_city string, location_street string, location_building string, reason string, "
    "confidence double, trace_id string, normalized_at timestamp"
)


def event(i, s, f, reason=None, confidence=0.5):
    return (i, i, "power_outage", at(s), at(f) if f is not None else None, "raw", "k", "c", "s", "b", reason, confidence, "t", at(s))


def test_merged_windows(spark):
    first = [event("e1", 0, 60, "why", 0.4), event("e2", 75, None, None, 0.9), event("e3", 91, 95)]
    late = [event("far", 60 * 24 * 20, None)]
    rows = run(spark, [first, late, [event("far2", 60 * 24 * 40, None)]], EVENT_DDL, S.merged_windows)
    got = {r.event_id: (r.members, r.start_time, r.end_time, r.reason, r.confidence) for r in rows}
    assert got["e1"] == (2, at(0), at(60), "why", 0.9)
    assert got["e3"][0] == 1


def test_source_budget(spark):
    rows = run(
        spark, [[("2", "s", at(1), "r", 1), ("1", "s", at(0), "r", 0), ("3", "s", at(1), "r", 2)], [("4", "s", at(2), "r", 0), ("5", "x", at(2), "r", 0)]],
        "id string, source_id string, fetched_at timestamp, raw_record_id string, pos int", lambda df: S.source_budget(df, 2),
    )
    assert {r.id for r in rows if r.allow_fallback} == {"1", "2", "5"}


def test_silence_alerts(spark):
    ddl = "kind string, source_id string, t timestamp, every int, active boolean"

    def tick(m):
        return ("clock", None, at(m), None, None)

    def fetch(s, m):
        return ("fetch", s, at(m), None, None)

    batches = [
        [("roster", s, at(0), 60, s != "off") for s in ("a", "never", "off")] + [fetch("a", 0), fetch("off", 0), tick(0)],
        [tick(10)], [tick(11)],  # every source is silent: only the clock goes on
        [fetch("a", 12), tick(12)], [tick(13)],
        [fetch("a", 12), tick(30)], [tick(31)], [tick(32)],
    ]

    def build(df):
        return S.silence_alerts(
            df.filter("kind = 'fetch'").selectExpr("source_id", "t AS fetched_at"),
            df.filter("kind = 'roster'").selectExpr("source_id", "t AS changed_at", "every AS poll_interval_seconds", "active AS is_active"),
            df.filter("kind = 'clock'").selectExpr("t AS at"), delay="1 minute",
        )

    rows = run(spark, batches, ddl, build)
    kinds = {s: [r.event_type for r in rows if r.source_id == s] for s in ("a", "never", "off")}
    assert kinds["never"] == ["parser.silent"] and kinds["off"] == []
    assert sorted(kinds["a"]) == ["parser.recovered", "parser.silent", "parser.silent"]


def test_rolling_timings(spark):
    rows = [("done", at(5), 10), ("done", at(50), 30), ("failed", at(70), 20), ("running", at(75), 99)]
    tasks = spark.createDataFrame([("x", *r) for r in rows], "task_type string, status string, completed_at timestamp, duration_ms int")
    got = {r.window_start: (r["count"], r.avg_ms, r.max_ms) for r in S.rolling_timings(tasks, hours=2).collect()}
    assert got == {at(-60): (2, 20.0, 30), at(0): (3, 20.0, 30), at(60): (1, 20.0, 20)}
