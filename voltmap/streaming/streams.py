"""Structured Streaming forms of dedup, merge, health and metrics.

All take streaming DataFrames with event times; the caller starts the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltmap import constants as K
from voltmap.operators.analytics import latch_difference
from voltmap.operators.dedup import address_group, merge_aggregates, merged_columns, type_key
from voltmap.session import cut
from voltmap.streaming.store import Store


def distinct_payloads(raw: DataFrame, delay: str = "7 days") -> DataFrame:
    """First arrival per content hash within the watermark.

    For feeds without a store.  Rows behind the watermark are dropped here; `ingest` tests
    every payload against the stored ones instead and drops none.
    """
    return raw.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def merged_windows(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Merged outage windows per address as sessions with a per-row gap.

    A session stays open until the latest end plus the tolerance, which is the same rule as
    the batch islands, and the members merge by the same aggregates.  It runs on batch
    frames too.  On streams a row behind the watermark finds its session closed; `ingest`
    merges every row into the stored events instead.
    """
    length = F.greatest(
        F.unix_micros(F.coalesce("end_time", "start_time")) - F.unix_micros("start_time"), F.lit(0)
    )
    gap = F.concat((length + F.lit(K.DEDUP_TOLERANCE_SECONDS * 1_000_000)).cast("string"), F.lit(" microseconds"))
    keyed = events.withColumns({"group_key": address_group(), "type_group": type_key(), "_gap": gap})
    return (
        keyed.withWatermark("start_time", delay)
        .groupBy(F.session_window("start_time", F.col("_gap")), "group_key", "type_group")
        .agg(*merge_aggregates())
        .select("group_key", "type_group", *merged_columns())
    )


def silence_alerts(
    fetches: DataFrame, roster: DataFrame, clock: DataFrame, multiplier: float = K.SILENT_MULTIPLIER,
    delay: str = "10 minutes",
) -> DataFrame:
    """Alert once per silence, recover once, then arm again.

    `fetches` has source_id and fetched_at.  `roster` has a row per source when it is added or
    changed: source_id, changed_at, poll_interval_seconds, is_active; a source that never
    fetches falls silent counted from its first row.  `clock` has a column `at` (a rate source,
    say): time goes on with it even when every source is silent.  State per source is five
    numbers; rows up to `delay` late still count.
    """
    null = F.lit(None)
    rows = (
        fetches.select("source_id", F.col("fetched_at").alias("at"), null.cast("int").alias("every"), null.cast("boolean").alias("active"))
        .unionByName(roster.select("source_id", F.col("changed_at").alias("at"), F.col("poll_interval_seconds").alias("every"), F.col("is_active").alias("active")))
        .unionByName(clock.select(F.lit("").alias("source_id"), "at", null.cast("int").alias("every"), null.cast("boolean").alias("active")))
    )

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, every, active, alerted = state.get if state.exists else (0, 0, False, False)
        out = []
        now = state.getCurrentWatermarkMs()
        for frame in frames:
            for at, interval, on in frame.sort_values("at")[["at", "every", "active"]].itertuples(index=False):
                ms = int(at.value // 1_000_000)
                if pd.isna(on):
                    last = max(last, ms)
                    if alerted:
                        out.append(("parser.recovered", "INFO", last))
                    alerted = False
                else:
                    last, every, active = last or ms, int(interval), bool(on)
        if key[0] == "":
            return
        due = last + int(every * multiplier * 1000)
        if active and every and not alerted and due <= now:
            out.append(("parser.silent", "WARNING", last))
            alerted = True
        state.update((last, every, active, alerted))
        if active and every and not alerted:
            state.setTimeoutTimestamp(max(due, now + 1))
        yield pd.DataFrame(
            [(key[0], kind, level, at) for kind, level, at in out],
            columns=["source_id", "event_type", "severity", "last_fetch_ms"],
        )

    return rows.withWatermark("at", delay).groupBy("source_id").applyInPandasWithState(
        step,
        "source_id string, event_type string, severity string, last_fetch_ms long",
        "last long, every long, active boolean, alerted boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def source_budget(parsed: DataFrame, budget: int) -> DataFrame:
    """Running per-source allowance across micro-batches.

    Adds `allow_fallback` for the first `budget` records of each source, in the order of
    fetched_at, raw_record_id and pos within a batch; the state is one counter.
    For feeds without a store: the rows of a source and batch meet in one task; `ingest` counts by slices.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["fetched_at", "raw_record_id", "pos"])
        allowed = [used + i < budget for i in range(len(rows))]
        state.update((min(budget, used + len(rows)),))
        yield pd.DataFrame({"id": rows["id"], "source_id": key[0], "allow_fallback": allowed})

    return parsed.select("id", "source_id", "fetched_at", "raw_record_id", "pos").groupBy("source_id").applyInPandasWithState(
        step, "id string, source_id string, allow_fallback boolean", "used long", "append",
        GroupStateTimeout.NoTimeout,
    )


def queue_changes(log: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Queue state changes per minute; a running sum over them is the depth."""
    return (
        log.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 minute"))
        .agg(F.sum("change").alias("change"))
        .select(F.col("window.start").alias("minute"), "change")
    )


def rolling_timings(tasks: DataFrame, hours: int = 24, slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count, mean and maximum duration per stage over a sliding window.

    Slides are totalled first; only the totals go into the overlapping windows.
    """
    totals = (
        tasks.filter(F.col("status").isin("done", "failed") & F.col("duration_ms").isNotNull())
        .withWatermark("completed_at", delay)
        .groupBy(F.window("completed_at", slide), "task_type")
        .agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("most"))
    )
    return (
        totals.groupBy(F.window(F.window_time("window"), f"{hours} hours", slide), "task_type")
        .agg(
            F.sum("n").alias("count"), (F.sum("total") / F.sum("n")).alias("avg_ms"), F.max("most").alias("max_ms")
        )
        .select(F.col("window.start").alias("window_start"), "task_type", "count", "avg_ms", "max_ms")
    )


def silence_tick(store: Store, silent: DataFrame, number: int | None = None) -> DataFrame:
    """One look at the silent sources: alerts and recoveries against the latch of the look before.

    The latch (sources alerted and not yet recovered) is kept in `store`, so looks may
    come from different runs; a look repeated under its number gives the same changes.
    """
    b = store.batch(number)
    schema = store.spark.createDataFrame([], "id string").schema
    changes = cut(latch_difference(b.current("alerted", schema), silent))
    kinds = {k: changes.filter(F.col("event_type") == f"parser.{k}").select("id") for k in ("silent", "recovered")}
    b.put("alerted", kinds["silent"], ["id"], gone=kinds["recovered"])
    b.append("parser_events", changes)
    b.commit()
    return changes
