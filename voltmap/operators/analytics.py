"""Operational analytics over the domain tables.  All are one-pass aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import rules as R
from voltmap.operators.percentile import nearest_rank


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.filter(R.not_system_failure(F.col("status"), F.col("error"))).groupBy("status").agg(
        F.count("*").alias("n")
    )


def stage_matrix(tasks: DataFrame) -> DataFrame:
    kept = tasks.filter(R.not_system_failure(F.col("status"), F.col("error")))
    return kept.groupBy("task_type").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "failed")]
    )


def stage_timings(tasks: DataFrame, since: Column | None = None) -> DataFrame:
    rows = tasks.filter(F.col("duration_ms").isNotNull() & F.col("status").isin("done", "failed"))
    if since is not None:
        rows = rows.filter(F.col("completed_at") >= since)
    base = rows.groupBy("task_type").agg(
        F.count("*").alias("count"),
        F.floor(F.avg("duration_ms")).alias("avg_ms"),
        F.max("duration_ms").cast("long").alias("max_ms"),
    )
    ranks = nearest_rank(rows, ["task_type"], "duration_ms", {"p50_ms": 0.50, "p95_ms": 0.95})
    return base.join(ranks, "task_type").orderBy("task_type")


def last_fetch(raw: DataFrame) -> DataFrame:
    return raw.filter("source_id IS NOT NULL").groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch")
    )


def raw_per_source(raw: DataFrame, since: Column) -> DataFrame:
    return (
        raw.filter((F.col("fetched_at") >= since) & F.col("source_id").isNotNull())
        .groupBy("source_id")
        .agg(F.count("*").alias("n"))
    )


def success_rates(tasks: DataFrame, since: Column, id_pattern: str = r"^[0-9a-fA-F-]{32,36}$") -> DataFrame:
    """Done share of fetch tasks per source id found in the payload."""
    source = F.try_element_at("payload", F.lit("source_id"))
    return (
        tasks.filter((F.col("task_type") == "fetch_source") & (F.col("updated_at") >= since))
        .withColumn("source_id", source)
        .filter(F.col("source_id").rlike(id_pattern))
        .groupBy("source_id")
        .agg(F.avg(F.when(F.col("status") == "done", 1.0).otherwise(0.0)).alias("success_rate"))
    )


def pipeline_metrics(
    tasks: DataFrame, calls: DataFrame, since: Column, prompt_price: float, completion_price: float
) -> DataFrame:
    """The metrics view of one time window as rows part, name, value.

    Stage timings, totals and costs of model calls, and the mix of normalizer paths, all since
    the same time.
    """
    def long(df, part, names, key=None):
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
        label = F.lit(part) if key is None else F.concat(F.lit(f"{part}."), F.col(key))
        return df.select(label.alias("part"), F.inline(pairs))

    timings = stage_timings(tasks, since)
    totals = call_totals(calls.filter(F.col("created_at") >= since), prompt_price, completion_price)
    mix = path_mix(tasks, since)
    return (
        long(timings, "stage", [c for c in timings.columns if c != "task_type"], "task_type")
        .unionByName(long(totals, "calls", totals.columns))
        .unionByName(long(mix, "paths", mix.columns))
    )


def silent_sources(
    sources: DataFrame, raw: DataFrame, as_of: Column, multiplier: float = K.SILENT_MULTIPLIER
) -> DataFrame:
    """Active sources without a fetch for longer than multiplier * interval."""
    seen = sources.filter("is_active").join(
        last_fetch(raw), F.col("id") == F.col("source_id"), "left"
    )
    quiet = R.seconds_between(as_of, F.col("last_fetch"))
    return seen.filter(
        F.col("last_fetch").isNull() | (quiet > F.col("poll_interval_seconds") * multiplier)
    ).select(
        "id", "name", "url", "poll_interval_seconds", F.col("last_fetch").alias("last_fetched_at"),
        F.floor(quiet).cast("long").alias("silent_for_seconds"),
    )


def silence_transitions(
    sources: DataFrame, raw: DataFrame, as_of: Column, multiplier: float = K.SILENT_MULTIPLIER
) -> DataFrame:
    """Batch twin of the silence alerts up to `as_of`: when each active source fell silent and recovered.

    A source that never fetched falls silent counted from its creation.
    """
    order = Window.partitionBy("source_id").orderBy("fetched_at")
    fetches = raw.select("source_id", "fetched_at").distinct().withColumn("next", F.lead("fetched_at").over(order))
    active = sources.filter("is_active").select(
        F.col("id").alias("source_id"), "created_at",
        (F.col("poll_interval_seconds") * multiplier).alias("limit"),
    )
    joined = active.join(fetches, "source_id", "left").withColumn("since", F.coalesce("fetched_at", "created_at"))
    quiet = R.seconds_between(F.coalesce("next", as_of), F.col("since")) > F.col("limit")
    fell = F.timestamp_micros((F.unix_micros("since") + F.col("limit") * 1_000_000).cast("long"))
    silent = F.struct(fell.alias("at"), F.lit("parser.silent").alias("event_type"))
    back = F.struct(F.col("next").alias("at"), F.lit("parser.recovered").alias("event_type"))
    both = F.when(F.col("next").isNull(), F.array(silent)).otherwise(F.array(silent, back))
    return joined.filter(quiet).select("source_id", F.explode(both).alias("e")).select("source_id", "e.*")


def latch_difference(alerted: DataFrame, silent: DataFrame) -> DataFrame:
    """What changed since the last look (columns id): newly silent and recovered sources."""
    now, before = (df.select("id").distinct() for df in (silent, alerted))
    return (
        now.join(before, "id", "left_anti").withColumn("event_type", F.lit("parser.silent"))
        .unionByName(before.join(now, "id", "left_anti").withColumn("event_type", F.lit("parser.recovered")))
    )


def source_health(
    sources: DataFrame, raw: DataFrame, tasks: DataFrame, as_of: Column, hours: int = 24,
    id_pattern: str = r"^[0-9a-fA-F-]{32,36}$",
) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    per_raw = raw.filter("source_id IS NOT NULL").groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch"),
        F.count_if(F.col("fetched_at") >= since).alias("records_in_window"),
    )
    joined = (
        sources.withColumn("source_id", F.col("id"))
        .join(per_raw, "source_id", "left")
        .join(success_rates(tasks, since, id_pattern), "source_id", "left")
        .withColumn("records_in_window", F.coalesce("records_in_window", F.lit(0)))
    )
    status = R.source_status(F.col("is_active"), F.col("last_fetch"), F.col("records_in_window"))
    return joined.withColumn("status", status).drop("source_id")


def confidence_histogram(events: DataFrame) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.0))
    return events.agg(
        F.count_if(c >= 0.8).alias("high"),
        F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if(c < 0.5).alias("low"),
        F.count("*").alias("total"),
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias("average_confidence"),
    )


def normalization_quality(events: DataFrame, parsed: DataFrame, as_of: Column) -> DataFrame:
    """Buckets and average confidence over all events, parsed in 30 days."""
    recent = parsed.agg(F.count_if(R.since(F.col("extracted_at"), as_of, 24 * 30)).alias("parsed_total"))
    return confidence_histogram(events).withColumnRenamed("total", "normalized_count").join(recent)


def call_totals(calls: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Token and duration totals of successful calls, error count, cost."""
    ok = F.col("status") == "ok"

    def total(c):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))

    sums = calls.agg(
        F.count_if(ok).alias("calls_ok"),
        F.count_if(F.col("status") == "error").alias("calls_error"),
        *[total(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.coalesce(F.floor(F.avg(F.when(ok, F.col("duration_ms")))), F.lit(0)).alias("avg_duration_ms"),
        F.coalesce(F.max(F.when(ok, F.col("duration_ms"))).cast("long"), F.lit(0)).alias("max_duration_ms"),
    )
    cost = R.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), prompt_price, completion_price)
    return sums.withColumn("_c", cost).select(
        *sums.columns, F.col("_c.prompt").alias("prompt_cost"),
        F.col("_c.completion").alias("completion_cost"), F.col("_c.total").alias("total_cost"),
    )


def rolling_totals(tasks: DataFrame, hours: int) -> DataFrame:
    """Rows and summed duration per stage over every window of `hours`, by the hour.

    Hours are totalled first; only the totals go into the overlapping windows.
    """
    hourly = tasks.groupBy(F.date_trunc("hour", "completed_at").alias("hour"), "task_type").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")
    )
    starts = F.sequence(
        F.col("hour") - F.expr(f"INTERVAL {hours - 1} HOURS"), F.col("hour"), F.expr("INTERVAL 1 HOUR")
    )
    return hourly.withColumn("window_start", F.explode(starts)).groupBy("window_start", "task_type").agg(
        F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms")
    )


def path_mix(tasks: DataFrame, since: Column | None = None) -> DataFrame:
    rows = tasks.filter((F.col("task_type") == "normalize_event") & F.col("normalizer_path").isNotNull())
    if since is not None:
        rows = rows.filter(F.col("completed_at") >= since)
    counts = rows.agg(
        *[F.count_if(F.col("normalizer_path") == p).alias(p) for p in K.NORMALIZER_PATHS]
    )
    total = sum((F.col(p) for p in K.NORMALIZER_PATHS[1:]), F.col(K.NORMALIZER_PATHS[0]))
    return counts.withColumn(
        "automaton_share", F.when(total > 0, F.round(F.col("automaton") / total, 3)).otherwise(0.0)
    )


def queue_snapshot(tasks: DataFrame, as_of: Column) -> DataFrame:
    return tasks.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "failed")]
    ).withColumn("created_at", as_of)


def queue_backlog(snapshots: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """24 h of samples in time order; the current counts when there are none."""
    columns = ["created_at", "pending", "running", "failed"]
    recent = snapshots.filter(R.since(F.col("created_at"), as_of, 24)).select(columns)
    none = recent.agg((F.count("*") == 0).alias("_empty"))
    kept = tasks.filter(R.not_system_failure(F.col("status"), F.col("error")))
    current = queue_snapshot(kept, as_of).join(none).filter("_empty").select(columns)
    return recent.unionByName(current).orderBy("created_at")


def queue_depth_series(log: DataFrame) -> DataFrame:
    """Queue depth at each minute with changes, from a log of +1 / -1 state changes.

    Minutes are summed first; the running total goes over minutes, not rows.
    """
    minutes = log.groupBy(F.window("created_at", "1 minute").start.alias("minute")).agg(
        F.sum("change").alias("change")
    )
    days = minutes.withColumn("day", F.to_date("minute"))
    per_day = days.groupBy("day").agg(F.sum("change").alias("_d"))
    carry = per_day.select(
        "day",
        F.coalesce(
            F.sum("_d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_carry"),
    )
    inner = F.sum("change").over(Window.partitionBy("day").orderBy("minute"))
    return days.withColumn("_in", inner).join(carry, "day").select(
        "minute", (F.col("_in") + F.col("_carry")).alias("depth")
    )


def risk_offices(impacts: DataFrame, now: Column, until: Column | None = None) -> DataFrame:
    active = R.is_active(
        F.col("impact_start"), F.col("impact_end"), now, until if until is not None else now
    )
    return impacts.filter(active).agg(F.countDistinct("office_id").alias("offices_at_risk"))


def task_lifecycle(log: DataFrame) -> DataFrame:
    """Latest start and run time per task from its status log (task_id, status, at)."""
    done = F.col("status").isin("done", "failed")
    last = log.groupBy("task_id").agg(
        F.max(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(done, F.col("at"))).alias("completed_at"),
    )
    finished = F.col("completed_at") >= F.col("started_at")
    return last.withColumn(
        "duration_ms",
        F.when(finished, F.floor(R.seconds_between(F.col("completed_at"), F.col("started_at")) * 1000)),
    )


def retry_schedule(tasks: DataFrame, as_of: Column) -> DataFrame:
    """One row: due now, active, dead-lettered, seconds to the next pending task."""
    pending = F.col("status") == "pending"
    later = pending & (F.col("next_run_at") > as_of)
    return tasks.agg(
        F.count_if(pending & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of))).alias("due"),
        F.count_if(F.col("status").isin("pending", "running")).alias("active"),
        F.count_if(F.col("status") == "failed").alias("dead_letter"),
        R.seconds_between(F.min(F.when(later, F.col("next_run_at"))), as_of).alias("next_due_seconds"),
    )


def kpi_counts(df: DataFrame, ts: str, as_of: Column, prefix: str) -> DataFrame:
    """Rows in the last 24 h and in the 24 h before, with the change."""
    counts = df.agg(
        F.count_if(R.since(F.col(ts), as_of, 24)).alias("current"),
        F.count_if(R.since(F.col(ts), as_of, 48) & ~R.since(F.col(ts), as_of, 24)).alias("previous"),
    )
    d = R.delta(F.col("current"), F.col("previous"))
    return counts.withColumn("_d", d).select(
        F.lit(prefix).alias("kpi"), "current", "previous",
        F.col("_d.pct").alias("pct"), F.col("_d.label").alias("label"), F.col("_d.status").alias("status"),
    )


def dashboard_summary(
    sources: DataFrame, raw: DataFrame, parsed: DataFrame, tasks: DataFrame, impacts: DataFrame,
    dedup_events: DataFrame, as_of: Column,
) -> DataFrame:
    """The six dashboard KPIs, one row each."""
    horizon = as_of + F.expr(f"INTERVAL {K.RISK_HORIZON_DAYS} DAYS")
    failed = (F.col("status") == "failed") & R.not_system_failure(F.col("status"), F.col("error"))

    def single(counted, kpi, column, status):
        n = F.col(column)
        return counted.select(
            F.lit(kpi).alias("kpi"), n.alias("current"), F.lit(None).cast("long").alias("previous"),
            F.lit(None).cast("double").alias("pct"),
            F.lit("active now" if kpi == "offices_at_risk" else None).cast("string").alias("label"),
            status(n).alias("status"),
        )

    rows = [
        kpi_counts(raw, "fetched_at", as_of, "raw_records_today"),
        kpi_counts(parsed, "extracted_at", as_of, "parsed_outages"),
        single(sources.agg(F.count_if("is_active").alias("n")), "active_sources", "n",
               lambda n: F.when(n > 0, "success").otherwise("warning")),
        single(dedup_events.agg(F.count_if(R.since(F.col("created_at"), as_of, 24)).alias("n")),
               "duplicates_skipped", "n", lambda n: F.when(n > 0, "success").otherwise("neutral")),
        single(tasks.agg(F.count_if(failed).alias("n")), "failed_tasks", "n",
               lambda n: F.when(n > 0, "error").otherwise("success")),
        single(risk_offices(impacts, as_of, horizon), "offices_at_risk", "offices_at_risk",
               lambda n: F.when(n > 0, "warning").otherwise("success")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pipeline_status(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Seven pipeline stages with counts, 24 h timings and status."""
    spark = tasks.sparkSession
    stages = spark.createDataFrame(
        [(i, *s) for i, s in enumerate(K.PIPELINE_STAGES)], "ord int, key string, label string, task_type string"
    )
    timings = stage_timings(tasks, as_of - F.expr("INTERVAL 24 HOURS"))
    joined = stages.join(stage_matrix(tasks), "task_type", "left").join(timings, "task_type", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("failed", "running", "pending", "done")}
    status = R.stage_status(counts["failed"], counts["running"], counts["pending"], counts["done"])
    return joined.select(
        "ord", "key", "label",
        status.alias("status"),
        F.round(F.col("count") / (24 * 60), 3).alias("throughput"),
        (counts["pending"] + counts["running"]).alias("queue_size"),
        F.col("avg_ms").cast("double").alias("latency_ms"),
        counts["failed"].alias("retry_count"),
        counts["done"].cast("string").alias("metric_value"),
    ).orderBy("ord")


def pipeline_overall(status: DataFrame) -> DataFrame:
    """One row: failed if any stage is, else running, else pending, else healthy."""
    def any_is(name):
        return F.count_if(F.col("status") == name) > 0

    return status.agg(
        F.when(any_is("failed"), "failed").when(any_is("running"), "running").when(any_is("pending"), "pending")
        .otherwise("healthy").alias("overall")
    )


def stage_share(tasks: DataFrame) -> DataFrame:
    """Queued tasks (pending or running) per stage and their share of the whole queue."""
    matrix = stage_matrix(tasks).select("task_type", (F.col("pending") + F.col("running")).alias("queued"))
    total = F.sum("queued").over(Window.partitionBy())  # one row per stage
    return matrix.withColumn("share", F.when(total > 0, F.round(F.col("queued") / total, 4)))


def threat_share(offices: DataFrame) -> DataFrame:
    """All offices and the percentage of them that is not ok."""
    share = F.round(F.lit(100.0) * F.count_if(F.col("status") != "ok") / F.count("*"), 1)
    return offices.agg(F.count("*").alias("all"), share.alias("threat_pct"))


def lookup(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Which of many keys are known, in one join; every wanted row stays."""
    there = known.select(key).distinct().withColumn("known", F.lit(True))
    return wanted.join(there, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def activity_feed(
    raw: DataFrame, parsed: DataFrame, impacts: DataFrame, notifications: DataFrame,
    tasks: DataFrame, offices: DataFrame, limit: int = 30,
) -> DataFrame:
    """The newest items over five kinds."""
    names = offices.select(F.col("id").alias("office_id"), F.col("name").alias("office_name"))

    def items(df, prefix, kind, severity, source, message, ts):
        return df.select(
            F.concat(F.lit(prefix + "-"), F.col("id").cast("string")).alias("id"),
            F.lit(kind).alias("type"), severity.alias("severity"), source.alias("source"),
            message.alias("message"), F.col(ts).alias("at"),
        )

    size = F.length(F.coalesce("raw_content", F.lit(""))).cast("string")
    place = F.trim(F.concat(
        F.lit("Parsed outage @ "), F.coalesce("location_city", F.lit("unknown")), F.lit(" "),
        F.coalesce("location_street", F.lit("")),
    ))
    feeds = [
        items(raw, "raw", "RawFetched", F.lit("info"),
              F.coalesce("source_id", "source_url"),
              F.concat(F.lit("Fetched "), size, F.lit(" bytes from "), F.col("source_type")), "fetched_at"),
        items(parsed, "parsed", "RawParsed", F.lit("success"),
              F.col("source_id"), place, "extracted_at"),
        items(impacts.join(names, "office_id"), "impact", "OfficeImpactDetected",
              F.when(F.col("impact_level") == "high", "error").otherwise("warning"), F.col("office_name"),
              F.concat(F.col("office_name"), F.lit(": "), F.col("match_strategy"), F.lit(" match")), "detected_at"),
        items(notifications.join(names, "office_id"), "notification", "NotificationEmitted",
              F.when(F.col("status") == "sent", "success").otherwise("warning"), F.col("office_name"),
              F.col("summary"), "emitted_at"),
        items(tasks.filter((F.col("status") == "failed") & R.not_system_failure(F.col("status"), F.col("error"))),
              "task", "TaskFailed", F.lit("error"), F.col("task_type"),
              F.coalesce(F.nullif("error", F.lit("")), F.lit("task failed")), "updated_at"),
    ]
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def trace_timeline(log: DataFrame) -> DataFrame:
    """Span of each trace: first and last entry, entries, errors, final event."""
    return log.groupBy("trace_id").agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("ended_at"),
        F.count("*").alias("entries"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.max_by("event_type", F.struct("created_at", "id")).alias("last_event"),
    )


def evaluate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quality of normalizer results against expectations: (rates, failures).

    Expects event_type, key, confidence (null when not normalized), the
    expected_* columns and min_confidence.
    """
    has = F.col("event_type").isNotNull()
    checked = results.withColumns(
        {
            "normalized": has,
            "type_ok": has & (F.col("event_type") == F.col("expected_event_type")),
            "address_ok": has & F.col("key").eqNullSafe(F.col("expected_canonical_key")),
            "confidence_ok": has & (F.col("confidence") >= F.col("min_confidence")),
        }
    )
    sums = checked.agg(
        F.count("*").alias("total"),
        *[F.count_if(c).alias(c) for c in ("normalized", "type_ok", "address_ok", "confidence_ok")],
    )
    total = F.col("total")
    rates = sums.select(
        "total", "normalized",
        R.rate(F.col("normalized"), total).alias("normalization_rate"),
        R.rate(F.col("type_ok"), total).alias("event_type_accuracy"),
        R.rate(F.col("address_ok"), total).alias("address_accuracy"),
        R.rate(F.col("confidence_ok"), total).alias("confidence_pass_rate"),
    )
    failures = checked.filter(~(F.col("type_ok") & F.col("address_ok") & F.col("confidence_ok")))
    return rates, failures


def evaluate_normalizer(cases: DataFrame, threshold: float = K.FALLBACK_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Normalizes labelled cases (`documents.read_cases`) and rates the results: (rates, failures).

    Failures carry the expected and the actual values, and whether there was a result at all.
    """
    from voltmap.operators.normalize import normalize

    got = normalize(cases, threshold).select(
        F.col("parsed_record_id").alias("id"), "event_type", F.col("location_normalized").alias("key"), "confidence"
    )
    expected = cases.select("id", "name", "expected_event_type", "expected_canonical_key", "min_confidence")
    rates, failures = evaluate(expected.join(got, "id", "left"))
    return rates, failures.select(
        "name", F.when(~F.col("normalized"), "no result").otherwise("other values").alias("reason"),
        "expected_event_type", "event_type", "expected_canonical_key", "key", "min_confidence", "confidence",
    )


def compare_normalizers(results: DataFrame) -> DataFrame:
    """Automaton alone against automaton plus regex recovery, one row of counts.

    Expects auto_key and combined_key (null = no result) and normalizer_path.
    """
    a, c = F.col("auto_key"), F.col("combined_key")
    sums = results.agg(
        F.count("*").alias("total"),
        F.count(a).alias("automaton_normalized"),
        F.count(c).alias("combined_normalized"),
        F.count_if(F.col("normalizer_path") == "regex_fallback").alias("regex_path"),
        F.count_if(a.isNull() & c.isNotNull()).alias("added_by_regex"),
        F.count_if(a.isNotNull() & c.isNotNull() & (a != c)).alias("changed_key"),
    )
    return sums.withColumns(
        {
            "automaton_rate": R.rate(F.col("automaton_normalized"), F.col("total")),
            "combined_rate": R.rate(F.col("combined_normalized"), F.col("total")),
        }
    )


def change_samples(results: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n added and first n changed results."""
    a, c = F.col("auto_key"), F.col("combined_key")

    def first(cond, kind):
        return results.filter(cond).orderBy(*order).limit(n).withColumn("kind", F.lit(kind))

    return first(a.isNull() & c.isNotNull(), "added").unionByName(
        first(a.isNotNull() & c.isNotNull() & (a != c), "changed")
    )


def gate(counts: DataFrame, minimums: dict[str, int], exact: dict[str, int] | None = None) -> DataFrame:
    """Data-quality gate over a one-row frame of counts: check, value, threshold, ok."""
    exact = exact or {}
    checks = [
        F.struct(F.lit(name).alias("check"), F.col(name).cast("long").alias("value"),
                 F.lit(t).cast("long").alias("threshold"), (F.col(name) >= t).alias("ok"))
        for name, t in minimums.items()
    ] + [
        F.struct(F.lit(name).alias("check"), F.col(name).cast("long").alias("value"),
                 F.lit(t).cast("long").alias("threshold"), (F.col(name) == t).alias("ok"))
        for name, t in exact.items()
    ]
    return counts.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(
        parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti"
    )


# --- threat map --------------------------------------------------------------------

def map_impacts(
    offices: DataFrame, impacts: DataFrame, events: DataFrame, parsed: DataFrame, raw: DataFrame,
    sources: DataFrame, as_of: Column,
) -> DataFrame:
    """One row per office and relevant impact with lineage; offices without stay."""
    until = as_of + F.expr(f"INTERVAL {K.RISK_HORIZON_DAYS} DAYS")
    active = impacts.filter(R.is_active(F.col("impact_start"), F.col("impact_end"), as_of, until))
    e = events.select("event_id", "parsed_record_id", "event_type", "reason", "location_raw", "location_normalized")
    p = parsed.select(F.col("id").alias("parsed_record_id"), "raw_record_id", "external_id")
    r = raw.select(F.col("id").alias("raw_record_id"), "source_id", "source_url", "fetched_at")
    s = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("url").alias("_source_page")
    )
    o = offices.select(F.col("id").alias("office_id"), "name", "city", "address", "region", "latitude", "longitude")

    def follow(rows, table, key):
        # Rows without the key match nothing: they are dealt by office, not all to one task.
        apart = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col("office_id")))
        return rows.withColumn("_k", apart).join(table.withColumnRenamed(key, "_k"), "_k", "left").drop("_k")

    rows = o.join(active.withColumnRenamed("id", "impact_id"), "office_id", "left")
    for table, key in ((e, "event_id"), (p, "parsed_record_id"), (r, "raw_record_id"), (s, "source_id")):
        rows = follow(rows, table, key)
    outage = F.coalesce(
        R.means_outage(F.col("event_type"), F.col("reason"), F.col("location_raw"), F.col("location_normalized")),
        F.lit(False),
    )
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.col("_source_page"))
    staged = rows.withColumns({"severity": R.severity(F.col("impact_level")), "_outage": outage, "source_url": url})
    return staged.withColumns(
        {
            "status": F.when(F.col("impact_id").isNull(), "ok")
            .when(F.col("severity").isin("high", "critical") | F.col("_outage"), "critical")
            .otherwise("risk"),
            "reason_text": R.reason_text(F.col("event_type"), F.col("reason"), F.col("_outage")),
            "source_record_url": R.record_url(F.col("source_url"), F.col("external_id")),
        }
    ).drop("_outage", "_source_page")


def map_offices(rows: DataFrame) -> DataFrame:
    """Offices with status and the number of relevant impacts.

    The impacts themselves stay rows (`map_impacts`, ordered by
    `impact_order`), since one office may have any number of them.
    """
    rank = R.rank_of(F.col("status"), K.STATUS_RANK)
    office = ["office_id", "name", "city", "address", "region", "latitude", "longitude"]
    return rows.groupBy(*office).agg(
        F.max_by("status", rank).alias("status"), F.count("impact_id").alias("active_impacts"),
        F.max(R.rank_of(F.col("severity"), K.SEVERITY_RANK)).alias("severity_rank"),
    )


def ranked_impacts(rows: DataFrame) -> DataFrame:
    """The impacts of `map_impacts` with their place in their office's list, worst and earliest first."""
    listed = rows.filter("impact_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("office_id").orderBy(*impact_order(), "impact_id"))
    return listed.withColumn("place", place)


def by_name(rows: DataFrame, group: list[str], name: str, language: str = "ru", out: str = "place") -> DataFrame:
    """Rows with their place by name inside their group, in the order of a language's dictionary.

    There ё stands with е, and case decides only between names that are equal otherwise.
    """
    order = Window.partitionBy(*group).orderBy(F.collate(F.col(name), language), F.col(name))
    return rows.withColumn(out, F.row_number().over(order))


def impact_order() -> list[Column]:
    return [
        R.rank_of(F.col("status"), K.STATUS_RANK).desc(),
        R.rank_of(F.col("severity"), K.SEVERITY_RANK).desc(),
        F.col("impact_start"),
    ]


def map_totals(offices: DataFrame) -> DataFrame:
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    return offices.agg(
        F.count("*").alias("all"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "risk", "critical")],
        F.count_if(missing).alias("missing_coordinates"),
        F.count_if(F.col("active_impacts") > 0).alias("threats"),
    )


def threat_list(offices: DataFrame) -> DataFrame:
    threatened = offices.filter((F.col("status") != "ok") | (F.col("active_impacts") > 0))
    rank = F.when(F.col("status") == "critical", 3).when(F.col("status") == "risk", 2).otherwise(1)
    return threatened.withColumn("rank", rank).orderBy(F.desc("rank"), "city", "address")


def severities_present(rows: DataFrame) -> DataFrame:
    order = {s: i for i, s in enumerate(K.SEVERITY_ORDER)}
    return (
        rows.filter("impact_id IS NOT NULL")
        .select("severity")
        .distinct()
        .withColumn("ord", R.rank_of(F.col("severity"), order))
        .orderBy("ord")
    )


def search_offices(
    offices: DataFrame, rows: DataFrame, status: str = "all", severity: str = "all", text: str = ""
) -> DataFrame:
    """Map search: status filter, any impact of a severity, text over four columns."""
    out = offices
    if status == "problem":
        out = out.filter("status <> 'ok'")
    elif status != "all":
        out = out.filter(F.col("status") == status)
    if severity != "all":
        hit = rows.filter((F.col("severity") == severity) & F.col("impact_id").isNotNull())
        out = out.join(hit.select("office_id").distinct(), "office_id", "left_semi")
    q = text.strip().lower()
    if q:
        found = F.lit(False)
        for c in ("name", "address", "city", "region"):
            found = found | F.lower(c).contains(q)
        out = out.filter(found)
    return out


def current_depth(points: DataFrame) -> DataFrame:
    """Pending plus running of the last backlog point."""
    return points.agg(
        F.coalesce(F.max_by(F.col("pending") + F.col("running"), "created_at"), F.lit(0)).alias("depth")
    )


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
