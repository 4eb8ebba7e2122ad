"""Registered queries: every operator over whole tables, with a SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import rules as R
from voltmap.functions import text as X
from voltmap.functions.hashing import content_hash, input_hash, parsed_fingerprint
from voltmap.operators import analytics as N
from voltmap.operators import dedup, match, normalize, upsert
from voltmap.operators.running import earliest_per_key, prefix_totals
from voltmap.plans import bindings as B
from voltmap.plans.bindings import Tables, ts
from voltmap.sources import documents, payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return build

    return register


def shown(c: str, alias: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias or c)


def sql_ts(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


E_DAY, O_DAY, S_DAY = B.AS_OF_EVENTS, B.AS_OF_ORDERS, B.AS_OF_SHIP

# --- tasks, queue, calls -----------------------------------------------------------


@query("task_status_counts", "SELECT status, count(*) AS n FROM shown GROUP BY 1", (B.SHOWN_TASKS,))
def _(t):
    return N.status_counts(t.tasks())


@query(
    "task_stage_matrix",
    "SELECT task_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, "
    "count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM shown GROUP BY 1",
    (B.SHOWN_TASKS,),
)
def _(t):
    return N.stage_matrix(t.tasks())


_TIMINGS = """timed AS (SELECT * FROM tasks WHERE duration_ms IS NOT NULL AND status IN ('done', 'failed') {since}),
 ranked AS (SELECT task_type, duration_ms, row_number() OVER (PARTITION BY task_type ORDER BY duration_ms) AS rn,
  count(*) OVER (PARTITION BY task_type) AS n FROM timed),
 timings AS (SELECT task_type, max(n) AS count, CAST(floor(avg(duration_ms)) AS BIGINT) AS avg_ms,
  CAST(max(duration_ms) AS BIGINT) AS max_ms,
  CAST(max(duration_ms) FILTER (rn = round_even(0.5 * (n - 1), 0) + 1) AS BIGINT) AS p50_ms,
  CAST(max(duration_ms) FILTER (rn = round_even(0.95 * (n - 1), 0) + 1) AS BIGINT) AS p95_ms
  FROM ranked GROUP BY task_type)"""


@query("stage_timings", "SELECT * FROM timings", (B.TASKS, _TIMINGS.format(since="")))
def _(t):
    return N.stage_timings(t.tasks())


@query(
    "pipeline_status",
    """SELECT ord, key, label,
 CASE WHEN failed > 0 AND failed >= (done + running) / 4.0 THEN 'failed' WHEN running > 0 THEN 'running'
  WHEN pending > 0 THEN 'pending' WHEN done > 0 THEN 'healthy' ELSE 'pending' END AS status,
 round(count / 1440.0, 3) AS throughput, pending + running AS queue_size, CAST(avg_ms AS DOUBLE) AS latency_ms,
 failed AS retry_count, CAST(done AS VARCHAR) AS metric_value
FROM (SELECT s.*, t.count, t.avg_ms, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running,
  coalesce(done, 0) AS done, coalesce(failed, 0) AS failed
 FROM (VALUES (0,'scheduler','Scheduler','fetch_source'),(1,'collector','Collector','fetch_source'),
 (2,'parser','Parser','parse_content'),(3,'normalizer','Regex Normalizer','normalize_event'),
 (4,'dedup','Dedup Engine','deduplicate_event'),(5,'matcher','Office Matcher','match_offices'),
 (6,'notifier','Notifier','emit_event')) s(ord, key, label, task_type)
 LEFT JOIN (SELECT task_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM shown GROUP BY 1) m
  ON s.task_type = m.task_type
 LEFT JOIN timings t ON s.task_type = t.task_type)""",
    (B.SHOWN_TASKS, _TIMINGS.format(since=f"AND completed_at >= TIMESTAMP '{E_DAY}' - INTERVAL 24 HOUR")),
)
def _(t):
    return N.pipeline_status(t.tasks(), ts(E_DAY))


@query(
    "normalizer_path_mix",
    "SELECT *, round(automaton / (automaton + regex_fallback + llm_fallback + none), 3) AS automaton_share FROM ("
    "SELECT count(*) FILTER (normalizer_path = 'automaton') AS automaton, "
    "count(*) FILTER (normalizer_path = 'regex_fallback') AS regex_fallback, "
    "count(*) FILTER (normalizer_path = 'llm_fallback') AS llm_fallback, "
    "count(*) FILTER (normalizer_path = 'none') AS none FROM tasks WHERE task_type = 'normalize_event')",
    (B.TASKS,),
)
def _(t):
    return N.path_mix(t.tasks())


@query(
    "call_totals",
    """SELECT *, round(prompt_tokens / 1000.0 * 0.2, 4) AS prompt_cost, round(completion_tokens / 1000.0 * 0.6, 4) AS completion_cost,
 round(prompt_tokens / 1000.0 * 0.2 + completion_tokens / 1000.0 * 0.6, 4) AS total_cost FROM (SELECT
 count(*) FILTER (event_id % 9 <> 0) AS calls_ok, count(*) FILTER (event_id % 9 = 0) AS calls_error,
 CAST(sum(event_id % 700) FILTER (event_id % 9 <> 0) AS BIGINT) AS prompt_tokens,
 CAST(sum(user_id % 300) FILTER (event_id % 9 <> 0) AS BIGINT) AS completion_tokens,
 CAST(sum(event_id % 700 + user_id % 300) FILTER (event_id % 9 <> 0) AS BIGINT) AS total_tokens,
 CAST(floor(avg(CAST(round(value * 10) AS INT)) FILTER (event_id % 9 <> 0)) AS BIGINT) AS avg_duration_ms,
 CAST(max(CAST(round(value * 10) AS INT)) FILTER (event_id % 9 <> 0) AS BIGINT) AS max_duration_ms FROM events)""",
)
def _(t):
    return N.call_totals(t.calls(), 0.20, 0.60)


@query(
    "recent_calls",
    f"SELECT event_id AS id, {sql_ts('ts', 'created_at')}, round((event_id % 700) / 1000.0 * 0.2 + (user_id % 300) / 1000.0 * 0.6, 4) "
    "AS cost FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
)
def _(t):
    cost = R.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), 0.20, 0.60)["total"]
    newest = N.page(t.calls(), [F.desc("created_at"), F.desc("id")], 20)
    return newest.select("id", shown("created_at"), cost.alias("cost"))


@query(
    "queue_snapshot",
    "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, "
    "count(*) FILTER (status = 'failed') AS failed FROM tasks",
    (B.TASKS,),
)
def _(t):
    return N.queue_snapshot(t.tasks(), ts(E_DAY)).drop("created_at")


@query(
    "queue_backlog",
    f"SELECT {sql_ts('ts', 'created_at')}, event_id % 40 AS pending, event_id % 9 AS running, event_id % 4 AS failed "
    f"FROM events WHERE ts >= TIMESTAMP '{E_DAY}' - INTERVAL 24 HOUR",
)
def _(t):
    samples = t.read("events").selectExpr(
        "CAST(ts AS timestamp) AS created_at", "event_id % 40 AS pending", "event_id % 9 AS running", "event_id % 4 AS failed"
    )
    return N.queue_backlog(samples, t.tasks(), ts(E_DAY)).select(shown("created_at"), "pending", "running", "failed")


@query(
    "current_queue_depth",
    "SELECT arg_max(event_id % 40 + event_id % 9, ts) AS depth FROM events",
)
def _(t):
    return N.current_depth(
        t.read("events").selectExpr("ts AS created_at", "event_id % 40 AS pending", "event_id % 9 AS running")
    )


@query(
    "queue_depth_series",
    f"SELECT {sql_ts('m', 'minute')}, CAST(sum(c) OVER (ORDER BY m) AS BIGINT) AS depth FROM ("
    "SELECT date_trunc('minute', ts) AS m, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS c FROM events GROUP BY 1)",
)
def _(t):
    return N.queue_depth_series(t.logs()).select(shown("minute"), "depth")


@query(
    "retry_schedule",
    f"""SELECT count(*) FILTER (status = 'pending' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{E_DAY}')) AS due,
 count(*) FILTER (status IN ('pending', 'running')) AS active, count(*) FILTER (status = 'failed') AS dead_letter,
 round((epoch_us(min(next_run_at) FILTER (status = 'pending' AND next_run_at > TIMESTAMP '{E_DAY}'))
  - epoch_us(TIMESTAMP '{E_DAY}')) / 1e6, 3) AS next_due_seconds FROM tasks""",
    (B.TASKS,),
)
def _(t):
    return N.retry_schedule(t.tasks(), ts(E_DAY)).withColumn("next_due_seconds", F.round("next_due_seconds", 3))


@query(
    "retry_backoff",
    "SELECT attempt, least(CAST(pow(2, attempt) AS INT), 600) AS backoff, attempt >= 5 AS dead, count(*) AS n FROM tasks GROUP BY ALL",
    (B.TASKS,),
)
def _(t):
    return t.tasks().select(
        F.col("attempt").cast("long").alias("attempt"), R.backoff_seconds(F.col("attempt")).alias("backoff"),
        (F.col("attempt") >= K.MAX_ATTEMPTS).alias("dead"),
    ).groupBy("attempt", "backoff", "dead").agg(F.count("*").alias("n"))


@query(
    "task_lifecycle",
    """SELECT CAST(user_id AS VARCHAR) AS task_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS started_at,
 strftime(c, '%Y-%m-%d %H:%M:%S') AS completed_at,
 CASE WHEN c >= s THEN CAST(floor((epoch_us(c) - epoch_us(s)) / 1e6 * 1000) AS BIGINT) END AS duration_ms FROM (
 SELECT user_id, max(ts) FILTER (event_type = 'click') AS s, max(ts) FILTER (event_type IN ('purchase', 'error')) AS c
 FROM events GROUP BY 1)""",
)
def _(t):
    log = t.read("events").selectExpr(
        "CAST(user_id AS string) AS task_id", "CAST(ts AS timestamp) AS at",
        "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status",
    )
    return N.task_lifecycle(log).select("task_id", shown("started_at"), shown("completed_at"), "duration_ms")


@query(
    "requeue_incomplete",
    "SELECT CASE WHEN status IN ('pending', 'running') THEN 'pending' ELSE status END AS status, "
    "CASE WHEN status IN ('pending', 'running') THEN 'restart' ELSE error END AS error, count(*) AS n, "
    "count(*) FILTER (status IN ('pending', 'running')) AS rewritten FROM tasks GROUP BY 1, 2",
    (B.TASKS,),
)
def _(t):
    tasks = t.tasks().withColumn("started_at", F.col("created_at"))
    out = upsert.rewrite_incomplete(tasks, "pending", "restart", ts(E_DAY))
    return out.groupBy("status", "error").agg(F.count("*").alias("n"), F.count_if("_rewritten").alias("rewritten"))


@query(
    "task_listing",
    f"""SELECT id, task_type, status, {sql_ts('updated_at')},
 CASE WHEN status = 'pending' AND attempt > 0 THEN strftime(next_run_at, '%Y-%m-%d %H:%M:%S') END AS next_retry_at,
 CAST(source_id AS VARCHAR) AS source_id FROM shown ORDER BY shown.updated_at DESC, id DESC LIMIT 100""",
    (B.SHOWN_TASKS,),
)
def _(t):
    rows = t.tasks().filter(R.not_system_failure(F.col("status"), F.col("error")))
    retry = F.when((F.col("status") == "pending") & (F.col("attempt") > 0), F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss"))
    return N.page(rows, [F.desc("updated_at"), F.desc("id")], 100).select(
        "id", "task_type", "status", shown("updated_at"), retry.alias("next_retry_at"),
        F.try_element_at("payload", F.lit("source_id")).alias("source_id"),
    )


@query(
    "trace_timeline",
    f"SELECT CAST(user_id AS VARCHAR) AS trace_id, {sql_ts('min(ts)', 'started_at')}, {sql_ts('max(ts)', 'ended_at')}, count(*) AS entries, "
    "count(*) FILTER (event_id % 4 = 0) AS errors, arg_max(event_type, ts) AS last_event FROM events GROUP BY 1",
)
def _(t):
    return N.trace_timeline(t.logs()).select(
        "trace_id", shown("started_at"), shown("ended_at"), "entries", "errors", "last_event"
    )


@query(
    "warning_logs",
    "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'ERROR' ELSE 'WARNING' END AS severity FROM events "
    "WHERE event_id % 4 IN (0, 1) ORDER BY ts DESC, event_id DESC LIMIT 8",
)
def _(t):
    rows = t.logs().filter(F.col("severity").isin("WARNING", "ERROR"))
    return N.page(rows, [F.desc("created_at"), F.desc("id")], 8).select("id", "severity")


@query(
    "rolling_metrics",
    f"SELECT {sql_ts('w', 'window_start')}, task_type, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM ("
    "SELECT task_type, duration_ms, unnest(generate_series(date_trunc('hour', completed_at) - INTERVAL 23 HOUR, "
    "date_trunc('hour', completed_at), INTERVAL 1 HOUR)) AS w FROM tasks) GROUP BY ALL",
    (B.TASKS,),
)
def _(t):
    return N.rolling_totals(t.tasks(), 24).select(shown("window_start"), "task_type", "n", "total_ms")


# --- sources and raw records ---------------------------------------------------------


@query("sources_active", f"SELECT id, name, {sql_ts('created_at')} FROM sources WHERE is_active", (B.SOURCES,))
def _(t):
    return t.sources().filter("is_active").orderBy("created_at").select("id", "name", shown("created_at"))


@query(
    "source_counts",
    "SELECT count(*) AS sources, count(*) FILTER (is_active) AS active FROM sources", (B.SOURCES,),
)
def _(t):
    return t.sources().agg(F.count("*").alias("sources"), F.count_if("is_active").alias("active"))


@query(
    "raw_listing",
    f"SELECT id, source_id, {sql_ts('fetched_at')}, length(raw_content) AS size FROM raw ORDER BY raw.fetched_at DESC, id DESC LIMIT 50 OFFSET 50",
    (B.RAW,),
)
def _(t):
    return N.page(t.raw(), [F.desc("fetched_at"), F.desc("id")], 50, 50).select(
        "id", "source_id", shown("fetched_at"), F.length("raw_content").cast("long").alias("size")
    )


@query(
    "raw_per_source_since",
    f"SELECT source_id, count(*) AS n FROM raw WHERE fetched_at >= TIMESTAMP '{S_DAY}' - INTERVAL 2400 HOUR GROUP BY 1", (B.RAW,),
)
def _(t):
    return N.raw_per_source(t.raw(), ts(S_DAY) - F.expr("INTERVAL 2400 HOURS"))


@query("last_fetch_per_source", f"SELECT source_id, {sql_ts('max(fetched_at)', 'last_fetch')} FROM raw GROUP BY 1", (B.RAW,))
def _(t):
    return N.last_fetch(t.raw()).select("source_id", shown("last_fetch"))


@query(
    "silent_sources",
    f"""SELECT s.id, {sql_ts('last', 'last_fetched_at')}, CAST(floor(epoch(TIMESTAMP '{S_DAY}' - last)) AS BIGINT) AS silent_for_seconds
FROM sources s LEFT JOIN (SELECT source_id, max(fetched_at) AS last FROM raw WHERE fetched_at < TIMESTAMP '{S_DAY}' GROUP BY 1) r ON s.id = r.source_id
WHERE is_active AND (last IS NULL OR epoch(TIMESTAMP '{S_DAY}' - last) > poll_interval_seconds * 3)""",
    (B.SOURCES, B.RAW),
)
def _(t):
    raw = t.raw().filter(F.col("fetched_at") < ts(S_DAY))
    return N.silent_sources(t.sources(), raw, ts(S_DAY)).select("id", shown("last_fetched_at"), "silent_for_seconds")


@query(
    "source_success_rates",
    f"SELECT CAST(source_id AS VARCHAR) AS source_id, round(avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM tasks "
    f"WHERE task_type = 'fetch_source' AND updated_at >= TIMESTAMP '{E_DAY}' - INTERVAL 240 HOUR AND source_id IS NOT NULL GROUP BY 1",
    (B.TASKS,),
)
def _(t):
    return N.success_rates(t.tasks(), ts(E_DAY) - F.expr("INTERVAL 240 HOURS"), r"^\d+$").withColumn(
        "success_rate", F.round("success_rate", 6)
    )


@query(
    "source_health",
    f"""SELECT s.id, {sql_ts('last_fetch')}, coalesce(n, 0) AS records_in_window, round(success_rate, 6) AS success_rate,
 CASE WHEN NOT is_active THEN 'inactive' WHEN last_fetch IS NULL THEN 'pending' WHEN coalesce(n, 0) = 0 THEN 'warning' ELSE 'healthy' END AS status
FROM sources s
LEFT JOIN (SELECT source_id, max(fetched_at) AS last_fetch, count(*) FILTER (fetched_at >= TIMESTAMP '{S_DAY}' - INTERVAL 24 HOUR) AS n FROM raw GROUP BY 1) r ON s.id = r.source_id
LEFT JOIN (SELECT CAST(source_id AS VARCHAR) AS sid, avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END) AS success_rate FROM tasks
 WHERE task_type = 'fetch_source' AND updated_at >= TIMESTAMP '{S_DAY}' - INTERVAL 24 HOUR AND source_id IS NOT NULL GROUP BY 1) x ON s.id = x.sid""",
    (B.SOURCES, B.RAW, B.TASKS),
)
def _(t):
    return N.source_health(t.sources(), t.raw(), t.tasks(), ts(S_DAY), 24, r"^\d+$").select(
        "id", shown("last_fetch"), "records_in_window", F.round("success_rate", 6).alias("success_rate"), "status"
    )


@query(
    "crawl_frontier",
    """SELECT id AS source_id, page, url || '&date_start=01.06.1998&date_end=' ||
 strftime(DATE '1998-06-01' + least(s_suppkey % 20, 14)::INT, '%d.%m.%Y') || '&p=' || page AS url FROM (
 SELECT *, unnest(generate_series(1, greatest(1, least(s_suppkey % 14, 10)))) AS page FROM sources WHERE is_active)""",
    (B.SOURCES,),
)
def _(t):
    return payloads.crawl_frontier(t.sources(), ts(O_DAY), max_pages=10, max_days=14).select("source_id", F.col("page").cast("long").alias("page"), "url")


@query(
    "raw_content_dedup",
    "SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents WHERE text NOT IN "
    "(SELECT text FROM documents WHERE source = 'src0') GROUP BY text",
)
def _(t):
    docs = t.read("documents").select(
        F.col("doc_id").alias("id"), content_hash("text").alias("content_hash"), F.lit(0).alias("fetched_at"), "source"
    )
    return dedup.new_payloads(docs, docs.filter("source = 'src0'")).select("id", "content_hash")


@query(
    "raw_reparse_ids",
    "SELECT d.doc_id AS id FROM documents d WHERE d.text IN (SELECT text FROM documents WHERE source = 'src0')",
)
def _(t):
    stored = t.read("documents").select(F.col("doc_id").alias("id"), content_hash("text").alias("content_hash"))
    incoming = t.read("documents").filter("source = 'src0'").select(content_hash("text").alias("content_hash"))
    return dedup.repeated_payloads(incoming, stored)


@query(
    "parsed_per_source",
    "SELECT s.name, count(*) AS n FROM parsed p JOIN sources s ON CAST(p.o_custkey AS VARCHAR) = s.id GROUP BY 1",
    (B.PARSED, B.SOURCES),
)
def _(t):
    names = t.sources().select(F.col("id").alias("source_id"), "name")
    return t.parsed().join(names, "source_id").groupBy("name").agg(F.count("*").alias("n"))


@query(
    "parsed_listing",
    f"SELECT CAST(k AS VARCHAR) AS id, {sql_ts('start_time')} FROM parsed WHERE r ILIKE '%ERIC%' AND t <> 5 "
    "ORDER BY parsed.start_time DESC NULLS LAST, extracted_at DESC, k DESC LIMIT 50",
    (B.PARSED,),
)
def _(t):
    rows = t.parsed().filter(F.col("location_city").ilike("%eric%"))
    order = [F.desc_nulls_last("start_time"), F.desc("extracted_at"), F.col("id").cast("long").desc()]
    return N.page(rows, order, 50).select("id", shown("start_time"))


@query(
    "orphan_impacts",
    "SELECT id, office_id FROM impacts WHERE office_id NOT IN (SELECT id FROM offices WHERE is_active)",
    (B.IMPACTS, B.OFFICES),
)
def _(t):
    return N.orphans(t.impacts(), t.offices().filter("is_active"), "office_id", "id").select("id", "office_id")


# --- payload parsing (round trips) -----------------------------------------------------

_RAW_ORDERS = """ordered AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority FROM orders
 WHERE o_orderdate BETWEEN DATE '1998-06-01' AND DATE '1998-06-01' + 400)"""


def _json_raw(t: Tables, items) -> DataFrame:
    return t.dealt("orders", "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("source_id"),
        F.to_json(F.array(items)).alias("raw_content"), F.lit("t").alias("trace_id"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
        F.create_map(F.lit("date_filter_days"), F.lit("400")).alias("parser_profile"),
    )


@query(
    "parse_format_one",
    f"""SELECT CAST(k AS VARCHAR) AS external_id, {sql_ts("o_orderdate + to_hours(CAST(k % 24 AS INT)) - INTERVAL 7 HOUR", 'start_time')},
 CASE WHEN k % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 23 HOUR + INTERVAL 30 MINUTE - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS end_time,
 'г Город' || (k % 9) AS location_city, o_orderpriority AS reason FROM ordered""",
    (_RAW_ORDERS,),
)
def _(t):
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("date_start"),
        F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":00")).alias("time_start"),
        F.when(F.col("o_orderkey") % 3 != 0, "23:30").otherwise("").alias("time_finish"),
        F.concat(F.lit(" г Город"), (F.col("o_orderkey") % 9).cast("string")).alias("gorod"),
        F.concat(F.col("o_orderpriority"), F.lit("\r\n")).alias("res"),
    )
    return payloads.parse_format_one(_json_raw(t, item), ts(O_DAY)).select(
        "external_id", shown("start_time"), shown("end_time"), "location_city", "reason"
    )


@query(
    "parse_format_two",
    f"""SELECT CAST(k AS VARCHAR) AS raw_record_id, {sql_ts("o_orderdate + INTERVAL 9 HOUR - CASE WHEN k % 2 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 3 HOUR END", 'start_time')},
 CASE WHEN k % 4 <> 0 THEN CAST(k % 97 AS VARCHAR) END AS houses FROM ordered""",
    ("""ordered AS (SELECT o_orderkey AS k, o_orderdate FROM orders
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-06-01' + 400)""",),
)
def _(t):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'09:00:00")
    item = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, stamp).otherwise(F.concat(stamp, F.lit("+03:00"))).alias("shutdownDate"),
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 97).cast("string")).otherwise(" ").alias("commaSeparatedHouses"),
        F.lit("").alias("city"),
    )
    return payloads.parse_format_two(_json_raw(t, item), ts(O_DAY)).select(
        "raw_record_id", shown("start_time"), F.try_element_at("extra", F.lit("houses")).alias("houses")
    )


def _html(k):
    """A page with the outage of an order as the one row of its table."""
    def p(css, label, value):
        return F.concat(F.lit(f'<p class="{css}"><label>{label}</label> '), value, F.lit("</p>"))

    return F.concat(
        F.lit('<table class="x shuthown_table"><tr><th>h</th></tr><tr><td id="row-'), k.cast("string"), F.lit('">'),
        p("t1", "Где:", F.concat(F.lit("Томская обл, Томский р-н, деревня "), F.col("o_orderpriority"))),
        p("t2", "Адрес:", F.concat(F.lit("ул Мира, "), (k % 97).cast("string"))),
        p("t3", "Дата:", F.date_format("o_orderdate", "dd.MM.yyyy")),
        p("t3", "Время:", F.when(k % 5 == 0, "всю ночь").when(k % 5 == 1, "с 22:00 до 3:15").otherwise("с 9:05 до 16:00")),
        p("t4", "Причина:", F.lit("ремонт")), p("t5", "Что:", F.lit("ТП-1")), F.lit("</td></tr></table>"),
    )


def _html_raw(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.dealt("orders", "o_orderkey").select(
        k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("source_id"), _html(k).alias("raw_content"),
        F.lit("t").alias("trace_id"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
        F.create_map(F.lit("date_filter_days"), F.lit("400")).alias("parser_profile"),
    )


@query(
    "parse_format_three",
    """SELECT 'row-' || k AS external_id, 'деревня ' || o_orderpriority AS location_city, 'Томский р-н' AS location_district,
 'ул Мира, ' || (k % 97) AS location_street,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate + INTERVAL 125 MINUTE, '%Y-%m-%d %H:%M:%S') END AS start_time,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate + INTERVAL 1215 MINUTE, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS end_time FROM ordered""",
    (_RAW_ORDERS,),
)
def _(t):
    return payloads.parse_format_three(_html_raw(t), ts(O_DAY)).select(
        "external_id", "location_city", "location_district", "location_street", shown("start_time"), shown("end_time")
    )


@query(
    "parse_dispatch",
    """SELECT CAST(k AS VARCHAR) AS raw_record_id, CASE WHEN f = 3 THEN 'no parser registered for: unknown' WHEN f = 4 THEN 'no parser registered for: '
  WHEN k % 7 = 3 THEN 'malformed payload for: format_' || CASE f WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END END AS error,
 CASE WHEN f < 3 AND k % 7 <> 3 THEN CASE f WHEN 0 THEN CAST(k AS VARCHAR) WHEN 2 THEN 'row-' || k END END AS external_id,
 CASE WHEN f < 3 AND k % 7 <> 3 THEN CASE WHEN f = 1 THEN strftime(d + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
  WHEN f = 0 THEN strftime(d + to_hours(CAST(k % 24 AS INT)) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')
  WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN strftime(d + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(d + INTERVAL 125 MINUTE, '%Y-%m-%d %H:%M:%S') END END AS start_time
FROM (SELECT o_orderkey AS k, o_orderdate AS d, CASE WHEN s.id IS NULL THEN 4 ELSE o_custkey % 4 END AS f
 FROM orders LEFT JOIN sources s ON CAST(o_custkey AS VARCHAR) = s.id)
WHERE f > 2 OR k % 7 = 3 OR CAST(d AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-06-01' + 400""",
    (B.SOURCES,),
)
def _(t):
    """Payloads of all formats, known and unknown, some of them cut short, in one pass."""
    k, f = F.col("o_orderkey"), F.col("o_custkey") % 4
    one = F.struct(
        k.cast("string").alias("id"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("date_start"),
        F.concat((k % 24).cast("string"), F.lit(":00")).alias("time_start"),
    )
    two = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'09:00:00").alias("shutdownDate"))
    whole = F.when(f == 0, F.to_json(F.array(one))).when(f == 1, F.to_json(F.array(two))).otherwise(_html(k))
    raw = t.dealt("orders", "o_orderkey").select(
        k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("source_id"),
        F.when(k % 7 == 3, F.substr(whole, F.lit(1), F.length(whole) - 8)).otherwise(whole).alias("raw_content"),
        F.lit("t").alias("trace_id"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
    )
    profiled = payloads.with_profile(raw, t.sources(), override={"date_filter_days": "400"})
    return payloads.dispatch(profiled, ts(O_DAY)).select("raw_record_id", "error", "external_id", shown("start_time"))


@query(
    "reply_usage",
    """SELECT conv_id, turn, length(text) AS prompt_tokens, turn * 3 AS completion_tokens, length(text) + turn * 3 AS total_tokens FROM conversations""",
)
def _(t):
    reply = F.to_json(F.struct(F.struct(F.length("text").alias("prompt_tokens"), (F.col("turn") * 3).alias("completion_tokens")).alias("usage")))
    return t.read("conversations").withColumn("u", documents.reply_usage(reply)).select(
        "conv_id", "turn", *[F.col(f"u.{c}").cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    )


@query(
    "reply_events",
    """SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN 'maintenance' ELSE 'power_outage' END AS event_type,
 r || '|' || p || '|' || h AS location_normalized, least(1.0, (k % 15) / 10.0) AS confidence, 'reply ' || k AS reason
FROM parsed""",
    (B.PARSED,),
)
def _(t):
    k = F.col("id").cast("long")
    clean = t.parsed().join(
        t.places().select(F.col("c_custkey").cast("string").alias("source_id"), "r", "p"), "source_id"
    )
    body = F.to_json(
        F.struct(
            F.when(k % 3 == 0, "maintenance").otherwise("nonsense").alias("event_type"),
            F.struct(
                F.concat(F.lit("г. "), F.col("r")).alias("city"), F.concat(F.lit("ул. "), F.col("p")).alias("street"),
                (k % 97 + 1).cast("string").alias("building"),
            ).alias("location"),
            F.concat(F.lit("reply "), F.col("id")).alias("reason"),
            ((k % 15) / F.lit(10.0)).alias("confidence"),
        )
    )
    content = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return documents.reply_events(clean.withColumn("reply", reply)).select(
        "id", "event_type", "location_normalized", "confidence", "reason"
    )


@query(
    "branch_offices",
    """SELECT 'Bank — ' || s_name AS name, 'Town ' || s_nationkey AS city, 'addr ' || s_suppkey AS address,
 s_suppkey % 3 <> 0 AS is_active, CAST(s_suppkey AS VARCHAR) AS office_id FROM supplier""",
)
def _(t):
    name, key = F.col("s_name"), F.col("s_suppkey")
    data = F.struct(
        F.struct(
            F.array(
                F.struct(key.cast("string").alias("id"), F.lit("office").alias("type"), name.alias("name"),
                         (key % 3 != 0).alias("active")),
                F.struct(key.cast("string").alias("id"), F.lit("atm").alias("type"), name.alias("name"), F.lit(True).alias("active")),
            ).alias("data")
        ).alias("resultsMap"),
        F.struct(
            F.array(
                F.struct(key.cast("string").alias("id"), F.lit("early").alias("address")),
                F.struct(key.cast("string").alias("id"), F.concat(F.lit("addr  "), key.cast("string")).alias("address")),
            ).alias("data")
        ).alias("results"),
    )
    encoded = F.replace(F.replace(F.to_json(data), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit('<div data-module-options="{}"></div><div data-module-options="'), encoded, F.lit('"></div>'))
    pages = t.read("supplier").select(
        html.alias("html"), F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"), F.lit(" (region)")).alias("city"),
        F.lit("r").alias("region"),
    )
    return documents.branch_offices(pages, "Bank", "office").select("name", "city", "address", "is_active", "office_id")


@query(
    "office_file_rows",
    """SELECT s_name AS name, s_suppkey % 4 IN (0, 3) AS is_active, CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey AS DOUBLE) END AS latitude,
 s_suppkey % 6 <> 5 AS valid FROM supplier""",
)
def _(t):
    texts = t.read("supplier").selectExpr(
        "concat('  ', s_name) AS name", "'c' AS city", "CASE WHEN s_suppkey % 6 = 5 THEN ' ' ELSE 'a' END AS address", "'r' AS region",
        "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'no' WHEN 2 THEN '0' ELSE ' Yes' END AS is_active",
        "CASE s_suppkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN CAST(s_suppkey AS string) END AS latitude",
    )
    good, bad = documents.valid_offices(documents.clean_office_rows(texts))
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.select("name", "is_active", "latitude", "valid")


@query(
    "office_dedup",
    "SELECT lower(c_mktsegment) AS k, min(c_custkey) AS id, c_nationkey AS city FROM customer GROUP BY 1, 3",
)
def _(t):
    rows = t.read("customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"),
        F.col("c_nationkey").cast("string").alias("city"), F.lit("a").alias("address"), F.col("c_custkey").alias("id"),
    )
    return documents.distinct_offices(rows, [F.col("id")]).select(
        F.lower("name").alias("k"), "id", F.col("city").cast("int").alias("city")
    )


# --- normalization --------------------------------------------------------------------

_KEY = "r || '|' || p || '|' || CASE WHEN t = 4 THEN '' ELSE CAST(h AS VARCHAR) END"


@query(
    "normalize_events",
    f"""SELECT CAST(k AS VARCHAR) AS id, {_KEY} AS location_normalized,
 CASE WHEN t = 5 THEN 'regex_fallback' ELSE 'automaton' END AS path, CASE WHEN t = 5 THEN 0.92 ELSE 1.0 END AS confidence FROM parsed""",
    (B.PARSED,),
)
def _(t):
    return normalize.normalize(t.parsed()).select(
        F.col("parsed_record_id").alias("id"), "location_normalized", F.col("normalizer_path").alias("path"),
        F.round("confidence", 3).alias("confidence"),
    )


@query(
    "automaton_events",
    f"SELECT CAST(k AS VARCHAR) AS id, {_KEY} AS location_normalized FROM parsed WHERE t <> 5", (B.PARSED,),
)
def _(t):
    return normalize.normalize_by_automaton(t.parsed()).select(
        F.col("parsed_record_id").alias("id"), "location_normalized"
    )


@query(
    "canonical_keys",
    # A range left in the street gives its last number when no building is given; no text, no key.
    "SELECT DISTINCT CASE WHEN t <> 5 THEN r || '|' || p || '|' || CASE t WHEN 4 THEN '' WHEN 3 THEN CAST(h + 4 AS VARCHAR) ELSE CAST(h AS VARCHAR) END END AS key "
    "FROM parsed", (B.PARSED,),
)
def _(t):
    houses = F.try_element_at("extra", F.lit("houses")).alias("houses")
    rows = t.parsed().select("location_city", "location_street", houses).distinct()
    return normalize.with_canonical_key(
        rows, F.col("location_city"), F.col("location_street"), F.col("houses"), "key"
    ).select("key").distinct()


@query(
    "normalize_cached",
    """SELECT 'fresh' AS kind, CAST(k AS VARCHAR) AS id FROM parsed WHERE k % 3 <> 0 UNION ALL
 SELECT 'sticky', 'e' || k FROM parsed WHERE k % 3 = 0 AND k % 2 = 0""",
    (B.PARSED,),
)
def _(t):
    parsed = t.parsed()
    stored = t.read("orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS string) END AS parsed_record_id",
        "concat('e', o_orderkey) AS event_id",
        "array(CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE concat('raw-', o_custkey) END) AS sources",
    )
    fresh, additions = normalize.normalize_with_cache(parsed, stored)
    return fresh.select(F.lit("fresh").alias("kind"), F.col("parsed_record_id").alias("id")).unionByName(
        additions.select(F.lit("sticky").alias("kind"), F.col("event_id").alias("id"))
    )


@query(
    "fallback_gates",
    """SELECT source_id, count(*) FILTER (pos < 4 AND used + pos < 10) AS allowed, count(*) AS n FROM (
 SELECT l_suppkey AS source_id, l_linenumber - 1 AS pos, b.used FROM lineitem JOIN (
  SELECT l_suppkey AS s, l_orderkey AS o, coalesce(sum(c) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
   SELECT l_suppkey, l_orderkey, count(*) FILTER (l_linenumber - 1 < 4) AS c FROM lineitem GROUP BY 1, 2)) b
  ON l_suppkey = b.s AND l_orderkey = b.o) GROUP BY 1""",
)
def _(t):
    rows = t.read("lineitem").selectExpr(
        "l_suppkey AS source_id", "l_orderkey AS raw_record_id", "l_orderkey AS arrival",
        "l_linenumber - 1 AS pos", "CAST(map() AS map<string,string>) AS parser_profile",
    )
    gated = normalize.fallback_gates(rows, ["arrival"], max_per_raw=4, max_per_source=10)
    return gated.groupBy("source_id").agg(F.count_if("allow_fallback").alias("allowed"), F.count("*").alias("n"))


@query(
    "quality_evaluation",
    """SELECT total, normalized, round(normalized / total, 4) AS normalization_rate, round(normalized / total, 4) AS event_type_accuracy,
 round(a / total, 4) AS address_accuracy, round(c / total, 4) AS confidence_pass_rate FROM (SELECT count(*) AS total,
 count(*) FILTER (quality = 1) AS normalized, count(*) FILTER (quality = 1 AND toxic = 0) AS a,
 count(*) FILTER (quality = 1 AND (n_chars % 100) / 100.0 >= 0.5) AS c FROM labels JOIN documents USING (doc_id))""",
)
def _(t):
    rows = t.read("labels").join(t.read("documents"), "doc_id").select(
        F.when(F.col("quality") == 1, "power_outage").alias("event_type"), F.lit("power_outage").alias("expected_event_type"),
        F.col("toxic").cast("string").alias("key"), F.lit("0").alias("expected_canonical_key"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("confidence"), F.lit(0.5).alias("min_confidence"),
    )
    return N.evaluate(rows)[0]


@query(
    "normalizer_comparison",
    """SELECT count(*) AS total, count(*) FILTER (t <> 5) AS automaton_normalized, count(*) AS combined_normalized,
 count(*) FILTER (t = 5) AS regex_path, count(*) FILTER (t = 5) AS added_by_regex, 0 AS changed_key,
 round(count(*) FILTER (t <> 5) / count(*), 4) AS automaton_rate, 1.0 AS combined_rate FROM parsed""",
    (B.PARSED,),
)
def _(t):
    both = normalize.with_fallback(t.parsed())
    # The combined key is the automaton's own where its result stands.
    taken = F.when(F.col("normalizer_path") == "regex_fallback", F.col("result"))
    for r, out, other in ((F.col("automaton"), "auto_key", F.lit(None)), (taken, "combined_key", F.col("auto_key"))):
        both = both.withColumn("_r", r)
        c = F.col("_r")
        both = normalize.with_canonical_key(both, c["city"], c["street"], c["building"], out).withColumn(
            out, F.when(c.isNotNull(), F.col(out)).otherwise(other)
        )
    return N.compare_normalizers(both.select("auto_key", "combined_key", "normalizer_path"))


# --- dedup -------------------------------------------------------------------------------


@query(
    "dedup_events_merged",
    """SELECT arg_min(event_id, k) AS event_id, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS start_time,
 strftime(max(end_time), '%Y-%m-%d %H:%M:%S') AS end_time, max(confidence) AS confidence, count(*) AS members,
 count(DISTINCT source) AS sources FROM placed GROUP BY user_id, type_group, island""",
    (B.OUTAGES,),
)
def _(t):
    merged, sources, _audit = dedup.deduplicate(t.outage_events())
    counts = sources.groupBy("event_id").agg(F.count("*").alias("sources"))
    return merged.join(counts, "event_id").select(
        "event_id", shown("start_time"), shown("end_time"), "confidence", "members", "sources"
    )


@query(
    "dedup_audit",
    """SELECT p.event_id AS incoming_event_id, f.event_id AS existing_event_id,
 CASE WHEN p.start_time = f.start_time AND p.end_time IS NOT DISTINCT FROM f.end_time THEN 'exact_window' ELSE 'overlap_window' END AS strategy
FROM placed p JOIN (SELECT user_id, type_group, island, arg_min(k, k) AS fk FROM placed GROUP BY ALL) g
 ON p.user_id = g.user_id AND p.type_group = g.type_group AND p.island = g.island
JOIN placed f ON f.k = g.fk WHERE p.k <> f.k""",
    (B.OUTAGES,),
)
def _(t):
    return dedup.deduplicate(t.outage_events())[2].select("incoming_event_id", "existing_event_id", "strategy")


@query(
    "dedup_reasons",
    """SELECT CAST(user_id AS VARCHAR) AS address, count(*) AS events, count(*) FILTER (has) AS with_reason FROM (
 SELECT user_id, count(reason) > 0 AS has FROM placed GROUP BY user_id, type_group, island) GROUP BY 1""",
    (B.OUTAGES,),
)
def _(t):
    merged = dedup.merge_events(dedup.with_island(t.outage_events()))
    return merged.groupBy(F.col("location_building").alias("address")).agg(
        F.count("*").alias("events"), F.count("reason").alias("with_reason")
    )


# --- matching ----------------------------------------------------------------------------

_MATCH = f"""ev AS (SELECT *, CASE WHEN t = 5 THEN NULL ELSE r END AS city FROM parsed
  WHERE end_time IS NULL OR end_time >= TIMESTAMP '{O_DAY}'),
 act AS (SELECT * FROM offices WHERE is_active),
 owners AS (SELECT p, count(DISTINCT r) AS cities FROM act GROUP BY 1),
 alike AS (SELECT a.p AS ep, b.p AS op, CASE WHEN a.p = b.p THEN 1.0 ELSE 0.93 END AS s FROM (SELECT DISTINCT p FROM ev) a
  JOIN (SELECT DISTINCT p FROM act) b ON contains(a.p, b.p) OR contains(b.p, a.p)),
 leveled AS (SELECT ev.*, CASE WHEN city IS NULL THEN coalesce(w.cities, 0) = 1
   ELSE EXISTS (SELECT 1 FROM act o WHERE o.r = ev.city AND o.p = ev.p) END AS level_one
  FROM ev LEFT JOIN owners w ON ev.p = w.p),
 pairs AS (SELECT e.*, o.id AS office_id, o.h AS oh, s.s, coalesce(e.city = o.r, FALSE) AS same_city
  FROM leveled e JOIN alike s ON e.p = s.ep JOIN act o ON o.p = s.op AND (e.city IS NULL OR e.city = o.r)
  WHERE NOT e.level_one OR s.s = 1.0),
 scored AS (SELECT *, CASE
   WHEN t NOT IN (3, 4) AND s = 1.0 AND oh = h THEN CASE WHEN same_city THEN 1.0 ELSE 0.96 END
   WHEN t <> 4 AND oh BETWEEN h AND CASE WHEN t = 3 THEN h + 4 ELSE h END THEN
    CASE WHEN s = 1.0 AND same_city THEN 0.92 ELSE round(least(0.84 + 0.06 * s, 0.92), 3) END
   WHEN t = 4 AND s = 1.0 AND same_city THEN 0.68 END AS score FROM pairs),
 matches AS (SELECT k, office_id, start_time, end_time, CAST(score AS DOUBLE) AS score,
  CASE WHEN score = 1.0 THEN 'exact_address' WHEN score = 0.96 THEN 'fuzzy_city_exact_address' WHEN score = 0.68 THEN 'street_area'
   WHEN s = 1.0 THEN 'house_range' ELSE 'fuzzy_house_range' END AS strategy,
  CASE WHEN start_time <= TIMESTAMP '{O_DAY}' OR epoch(start_time - TIMESTAMP '{O_DAY}') <= 86400 THEN 'high'
   WHEN epoch(start_time - TIMESTAMP '{O_DAY}') <= 259200 THEN 'medium' ELSE 'low' END AS level
  FROM scored WHERE score IS NOT NULL)"""


@query(
    "office_matches",
    "SELECT CAST(k AS VARCHAR) AS event_id, office_id, strategy, score, level FROM matches",
    (B.PARSED, B.OFFICES, _MATCH),
)
def _(t):
    return match.match(t.match_events(), t.offices(), ts(O_DAY)).select(
        "event_id", "office_id", F.col("match_strategy").alias("strategy"), F.col("match_score").alias("score"),
        F.col("impact_level").alias("level"),
    )


@query(
    "office_profiles",
    "SELECT id AS office_id, r AS o_city, p AS o_street, CAST(h AS VARCHAR) AS o_building, h AS house FROM offices WHERE is_active",
    (B.OFFICES,),
)
def _(t):
    return match.office_profiles(t.offices()).drop("office_name").withColumn("house", F.col("house").cast("long"))


@query(
    "rebuild_impacts",
    f"""SELECT (SELECT count(*) FROM parsed WHERE start_time <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY AND (end_time IS NULL OR end_time >= TIMESTAMP '{O_DAY}')) AS events_rebuilt,
 (SELECT count(*) FROM matches WHERE start_time <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY) AS impacts_inserted,
 (SELECT count(*) FROM impacts WHERE impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}') AS active_or_future_before,
 (SELECT count(*) FROM impacts WHERE (impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}') AND k NOT IN (SELECT k FROM parsed
  WHERE start_time <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY AND (end_time IS NULL OR end_time >= TIMESTAMP '{O_DAY}')))
 + (SELECT count(*) FROM matches WHERE start_time <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY) AS active_or_future_after""",
    (B.PARSED, B.OFFICES, _MATCH, B.IMPACTS),
)
def _(t):
    impacts = t.impacts().withColumn("match_explanation", F.array().cast("array<string>"))
    _after, report = match.rebuild_impacts(t.match_events(), t.offices(), impacts, ts(O_DAY))
    return report


@query(
    "notification_outbox",
    """SELECT i.id AS impact, c.channel, CASE WHEN c.channel = 'dashboard' THEN 'sent' ELSE 'pending' END AS status,
 CASE WHEN severity = 'high' THEN 'high' ELSE 'medium' END AS severity, o.name AS office
FROM impacts i JOIN offices o ON i.office_id = o.id, (VALUES ('dashboard'), ('telegram')) c(channel)""",
    (B.IMPACTS, B.OFFICES),
)
def _(t):
    events = t.impacts().select(
        "event_id", F.col("impact_start").alias("start_time"), F.col("impact_end").alias("end_time"),
        F.lit(None).cast("string").alias("reason"), F.lit("x").alias("location_normalized"), F.lit("y").alias("location_raw"),
    )
    out = match.to_notifications(t.impacts(), t.offices(), events, ts(O_DAY), ("dashboard", "telegram"))
    office = F.coalesce(
        F.nullif(F.regexp_extract("summary", "^(.*): отключение", 1), F.lit("")), F.regexp_extract("summary", "Офис: (.*)", 1)
    )
    return out.select(F.col("event_id").alias("impact"), "channel", "status", "severity", office.alias("office"))


# --- upserts -----------------------------------------------------------------------------


@query(
    "upsert_parsed",
    """SELECT CASE WHEN o % 2 = 0 THEN 'old-' || o ELSE 'new-' || first END AS id, 'fp-' || o AS fingerprint,
 CASE WHEN last IS NULL THEN 'stored' ELSE 'line ' || last END AS reason FROM (
 SELECT o_orderkey AS o, min(l_linenumber) AS first, max(l_linenumber) AS last FROM orders LEFT JOIN
 (SELECT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1) WHERE o % 2 = 0 OR last IS NOT NULL
 UNION ALL SELECT 'gone-' || o_orderkey, 'other-' || o_orderkey, 'stored' FROM orders WHERE o_orderkey % 2 <> 0""",
)
def _(t):
    target = t.read("orders").selectExpr(
        "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'old-' ELSE 'gone-' END, o_orderkey) AS id",
        "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'fp-' ELSE 'other-' END, o_orderkey) AS fingerprint", "'stored' AS reason",
    )
    incoming = t.read("lineitem").selectExpr(
        "concat('new-', l_linenumber) AS id", "concat('fp-', l_orderkey) AS fingerprint",
        "concat('line ', l_linenumber) AS reason", "l_linenumber AS pos",
    )
    return upsert.upsert_parsed(target, incoming, ["pos"])


@query(
    "upsert_offices",
    """SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS id,
 CASE WHEN c_custkey % 3 = 0 THEN 'R2' ELSE 'R1' END AS region, c_custkey % 5 <> 0 AS is_active FROM customer
 WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
)
def _(t):
    base = t.read("customer").selectExpr(
        "c_name AS name", "'c' AS city", "'a' AS address", "c_custkey % 5 <> 0 AS is_active", "c_custkey AS k", "CAST(NULL AS timestamp) AS created_at"
    )
    target = base.filter("k % 2 = 0").selectExpr("'old' AS id", "name", "city", "address", "'R1' AS region", "is_active", "created_at")
    incoming = base.filter("k % 3 = 0").selectExpr("'new' AS id", "name", "city", "address", "'R2' AS region", "k")
    out = upsert.upsert_offices(target.drop("is_active"), incoming.withColumn("created_at", F.lit(None).cast("timestamp")), ["k"])
    return out.join(base.select("name", "is_active"), "name").select("name", "id", "region", "is_active")


@query(
    "office_import_counts",
    """SELECT received, inserted, valid - inserted AS updated, received - valid AS skipped FROM (SELECT sum(n) AS received, sum(v) AS valid,
 count(*) FILTER (v > 0 AND s IS NULL) AS inserted FROM (
 SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS v FROM lineitem GROUP BY 1) LEFT JOIN (SELECT s_suppkey AS s FROM supplier) ON s = l_partkey)""",
)
def _(t):
    target = t.read("supplier").selectExpr("CAST(s_suppkey AS string) AS name", "'c' AS city", "'a' AS address")
    incoming = t.read("lineitem").selectExpr(
        "CAST(l_partkey AS string) AS name", "'c' AS city", "'a' AS address", "CASE WHEN l_returnflag = 'N' THEN '' ELSE 'r' END AS region"
    )
    return upsert.office_import_counts(target, incoming)


@query(
    "upsert_impacts",
    """SELECT office_id, CAST(k AS VARCHAR) AS event_id, CASE WHEN k % 2 = 0 THEN 'low' ELSE severity END AS impact_level,
 CASE WHEN k % 2 = 0 AND 0.5 >= match_score THEN 'incoming' ELSE match_strategy END AS match_strategy,
 CASE WHEN k % 2 = 0 AND 0.5 >= match_score THEN 0.5 ELSE match_score END AS match_score FROM impacts""",
    (B.IMPACTS,),
)
def _(t):
    level = R.severity(F.col("impact_level"))
    target = t.impacts().withColumn("impact_level", level).select(
        "id", "office_id", "event_id", "impact_level", "match_strategy", "match_score"
    )
    incoming = target.filter("event_id % 2 = 0").select(
        F.lit("new").alias("id"), "office_id", "event_id", F.lit("low").alias("impact_level"),
        F.lit("incoming").alias("match_strategy"), F.lit(0.5).alias("match_score"),
    )
    return upsert.upsert_impacts(target, incoming).drop("id")


@query(
    "replace_impacts",
    "SELECT match_strategy, count(*) AS n FROM impacts WHERE k % 4 <> 0 GROUP BY 1 UNION ALL SELECT 'fresh', count(*) FROM impacts WHERE k % 8 = 0",
    (B.IMPACTS,),
)
def _(t):
    target = t.impacts().select("event_id", "match_strategy")
    touched = target.filter("event_id % 4 = 0")
    fresh = target.filter("event_id % 8 = 0").withColumn("match_strategy", F.lit("fresh"))
    return upsert.replace_for_keys(target, fresh, touched, ["event_id"]).groupBy("match_strategy").agg(F.count("*").alias("n"))


@query(
    "upsert_notifications",
    "SELECT CASE WHEN k % 2 = 0 THEN 'old' ELSE 'new' END AS id, CAST(k AS VARCHAR) AS event_id, CASE WHEN k % 3 = 0 OR k % 2 = 1 THEN 'sent' ELSE 'failed' END AS status FROM impacts "
    "WHERE k % 2 = 0 OR k % 3 = 0",
    (B.IMPACTS,),
)
def _(t):
    base = t.impacts().select("office_id", "event_id", F.lit("dashboard").alias("channel"))
    target = base.filter("event_id % 2 = 0").withColumns({"id": F.lit("old"), "status": F.lit("failed")})
    incoming = base.filter("event_id % 3 = 0").withColumns({"id": F.lit("new"), "status": F.lit("sent")})
    return upsert.upsert_notifications(target, incoming).select("id", "event_id", "status")


# --- map, dashboards, quality ---------------------------------------------------------------

_MAP = f"""rel AS (SELECT o.id AS office_id, o.city, o.address, o.latitude, i.* EXCLUDE (office_id),
 CASE WHEN i.id IS NULL THEN 'ok' WHEN severity = 'high' OR event_type = 'power_outage' THEN 'critical' ELSE 'risk' END AS status
 FROM offices o LEFT JOIN impacts i ON i.office_id = o.id AND impact_start <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY
 AND (impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}')),
 by_office AS (SELECT office_id, city, address, latitude, count(id) AS active_impacts,
  CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'risk' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'risk' ELSE 'ok' END AS status
  FROM rel GROUP BY ALL)"""


def _map_rows(t: Tables) -> DataFrame:
    return N.map_impacts(
        t.offices(), t.impacts(), t.impact_events(), t.impact_parsed(), t.impact_raw(), t.sources(), ts(O_DAY)
    )


@query(
    "map_offices", "SELECT office_id, status, active_impacts FROM by_office", (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.map_offices(_map_rows(t)).select("office_id", "status", "active_impacts")


@query(
    "map_impacts",
    """SELECT rel.office_id, rel.id AS impact_id, severity, status,
 CASE event_type WHEN 'infrastructure_failure' THEN 'Аварийное отключение электроэнергии' WHEN 'maintenance' THEN 'Плановое отключение электроэнергии'
  WHEN 'power_outage' THEN 'Плановое отключение электроэнергии' ELSE 'Возможное влияние на работу офиса' END ||
 CASE WHEN reason IS NULL OR reason = '' THEN '' WHEN reason = 'Ленинский РЭС' THEN '. Участок: ' || reason
  WHEN reason = 'Repair' THEN ': ' || reason ELSE '. Детали источника: ' || reason END AS reason_text,
 raw.id AS raw_record_id, sources.name AS source_name, raw.source_url AS source_record_url
FROM rel LEFT JOIN (SELECT CAST(o_orderkey * 8 + 1 AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS source_id,
 'http://grid.example/item/' || o_custkey AS source_url FROM orders) raw ON CAST(rel.parsed_id AS VARCHAR) = raw.id
 LEFT JOIN sources ON raw.source_id = sources.id""",
    (B.IMPACTS, B.OFFICES, _MAP, B.SOURCES),
)
def _(t):
    rows = _map_rows(t)
    has = F.col("impact_id").isNotNull()
    return rows.select(
        "office_id", "impact_id", F.when(has, F.col("severity")).alias("severity"), "status",
        "reason_text", F.when(F.col("fetched_at").isNotNull(), F.col("raw_record_id")).alias("raw_record_id"),
        "source_name", "source_record_url",
    )


@query(
    "map_totals",
    """SELECT count(*) AS "all", count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'risk') AS risk,
 count(*) FILTER (status = 'critical') AS critical, count(*) FILTER (latitude IS NULL) AS missing_coordinates,
 count(*) FILTER (active_impacts > 0) AS threats FROM by_office""",
    (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.map_totals(N.map_offices(_map_rows(t)))


@query(
    "threat_list",
    "SELECT office_id, CASE status WHEN 'critical' THEN 3 WHEN 'risk' THEN 2 ELSE 1 END AS rank FROM by_office WHERE status <> 'ok' OR active_impacts > 0",
    (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.threat_list(N.map_offices(_map_rows(t))).select("office_id", "rank")


@query(
    "severities_present", "SELECT DISTINCT severity FROM rel WHERE id IS NOT NULL", (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.severities_present(_map_rows(t)).select("severity")


@query(
    "office_search",
    "SELECT office_id, status FROM by_office WHERE status <> 'ok' AND lower(city) LIKE '%asia%' AND office_id IN (SELECT office_id FROM rel WHERE severity = 'medium')",
    (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    rows = _map_rows(t)
    return N.search_offices(N.map_offices(rows), rows, "problem", "medium", " ASIA ").select("office_id", "status")


@query(
    "offices_at_risk",
    f"SELECT count(DISTINCT office_id) AS offices_at_risk FROM impacts WHERE impact_start <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY "
    f"AND (impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}')",
    (B.IMPACTS,),
)
def _(t):
    return N.risk_offices(t.impacts(), ts(O_DAY), ts(O_DAY) + F.expr("INTERVAL 7 DAYS"))


@query(
    "impact_listing",
    f"SELECT i.id, o.name AS office_name, {sql_ts('detected_at')} FROM impacts i JOIN offices o ON i.office_id = o.id ORDER BY i.detected_at DESC, i.k DESC LIMIT 100",
    (B.IMPACTS, B.OFFICES),
)
def _(t):
    names = t.offices().select(F.col("id").alias("office_id"), F.col("name").alias("office_name"))
    rows = t.impacts().join(names, "office_id")
    return N.page(rows, [F.desc("detected_at"), F.col("id").cast("long").desc()], 100).select(
        "id", "office_name", shown("detected_at")
    )


@query(
    "active_impact_report",
    f"SELECT o.name, i.id, severity, event_type, reason FROM impacts i JOIN offices o ON i.office_id = o.id "
    f"WHERE impact_start <= TIMESTAMP '{O_DAY}' AND (impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}')",
    (B.IMPACTS, B.OFFICES),
)
def _(t):
    now = ts(O_DAY)
    rows = t.impacts().filter(R.is_active(F.col("impact_start"), F.col("impact_end"), now, now))
    names = t.offices().select(F.col("id").alias("office_id"), "name")
    events = t.impact_events().select("event_id", "event_type", "reason")
    return rows.join(names, "office_id").join(events, "event_id", "left").select(
        "name", "id", R.severity(F.col("impact_level")).alias("severity"), "event_type", "reason"
    )


@query("region_counts", "SELECT region, count(*) AS n FROM offices GROUP BY 1", (B.OFFICES,))
def _(t):
    return t.offices().groupBy("region").agg(F.count("*").alias("n"))


@query(
    "confidence_histogram",
    "SELECT count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low, count(*) AS total, round(avg(c), 3) AS average_confidence "
    "FROM (SELECT CAST(event_id % 10 AS DOUBLE) / 10 AS c FROM events)",
)
def _(t):
    return N.confidence_histogram(t.outage_events())


@query(
    "normalization_quality",
    f"""SELECT h.*, p AS parsed_total FROM (SELECT count(*) FILTER (c >= 0.8) AS high,
 count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low, count(*) AS normalized_count,
 round(avg(c), 3) AS average_confidence FROM (SELECT CAST(event_id % 10 AS DOUBLE) / 10 AS c FROM events)) h,
 (SELECT count(*) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '{O_DAY}' - INTERVAL 720 HOUR)""",
)
def _(t):
    parsed = t.read("orders").select(F.col("o_orderdate").cast("timestamp").alias("extracted_at"))
    return N.normalization_quality(t.outage_events(), parsed, ts(O_DAY))


def _kpi_sql(name, table, col, day):
    return f"""SELECT '{name}' AS kpi, c AS current, v AS previous, CASE WHEN v <> 0 THEN round((c - v) / v * 100.0, 1) END AS pct,
 CASE WHEN v = 0 THEN 'neutral' WHEN c >= v THEN 'success' ELSE 'warning' END AS status FROM (SELECT
 count(*) FILTER ({col} >= TIMESTAMP '{day}' - INTERVAL 24 HOUR) AS c,
 count(*) FILTER ({col} >= TIMESTAMP '{day}' - INTERVAL 48 HOUR AND {col} < TIMESTAMP '{day}' - INTERVAL 24 HOUR) AS v FROM {table})"""


@query(
    "dashboard_summary",
    _kpi_sql("raw_records_today", "lineitem", "l_shipdate", O_DAY) + " UNION ALL " + _kpi_sql("parsed_outages", "orders", "o_orderdate", O_DAY)
    + f""" UNION ALL SELECT 'active_sources', (SELECT count(*) FROM sources WHERE is_active), NULL, NULL, 'success'
 UNION ALL SELECT 'duplicates_skipped', n, NULL, NULL, CASE WHEN n > 0 THEN 'success' ELSE 'neutral' END FROM (SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{O_DAY}' - INTERVAL 24 HOUR)
 UNION ALL SELECT 'failed_tasks', n, NULL, NULL, CASE WHEN n > 0 THEN 'error' ELSE 'success' END FROM (SELECT count(*) AS n FROM shown WHERE status = 'failed')
 UNION ALL SELECT 'offices_at_risk', n, NULL, NULL, CASE WHEN n > 0 THEN 'warning' ELSE 'success' END FROM (SELECT count(DISTINCT office_id) AS n FROM impacts
 WHERE impact_start <= TIMESTAMP '{O_DAY}' + INTERVAL 7 DAY AND (impact_end IS NULL OR impact_end >= TIMESTAMP '{O_DAY}'))""",
    (B.SOURCES, B.SHOWN_TASKS, B.IMPACTS),
)
def _(t):
    parsed = t.read("orders").select(F.col("o_orderdate").cast("timestamp").alias("extracted_at"))
    audit = t.read("events").select(F.col("ts").cast("timestamp").alias("created_at"))
    return N.dashboard_summary(
        t.sources(), t.raw(), parsed, t.tasks(), t.impacts(), audit, ts(O_DAY)
    ).drop("label")


@query(
    "activity_feed",
    f"""SELECT id, type, severity, {sql_ts('u.happened', 'happened_at')} FROM (
 (SELECT 'raw-' || id AS id, 'RawFetched' AS type, 'info' AS severity, fetched_at AS happened FROM raw) UNION ALL
 (SELECT 'parsed-' || k, 'RawParsed', 'success', extracted_at FROM parsed) UNION ALL
 (SELECT 'impact-' || i.id, 'OfficeImpactDetected', CASE WHEN severity = 'high' THEN 'error' ELSE 'warning' END, detected_at FROM impacts i JOIN offices o ON i.office_id = o.id) UNION ALL
 (SELECT 'notification-' || i.id, 'NotificationEmitted', 'success', impact_start FROM impacts i JOIN offices o ON i.office_id = o.id) UNION ALL
 (SELECT 'task-' || id, 'TaskFailed', 'error', updated_at FROM shown WHERE status = 'failed')) u
ORDER BY u.happened DESC, id DESC LIMIT 30""",
    (B.RAW, B.PARSED, B.IMPACTS, B.OFFICES, B.SHOWN_TASKS),
)
def _(t):
    notes = t.impacts().select(
        "id", "office_id", F.lit("sent").alias("status"), F.lit("s").alias("summary"), F.col("impact_start").alias("emitted_at")
    )
    return N.activity_feed(t.raw(), t.parsed(), t.impacts(), notes, t.tasks(), t.offices()).select(
        "id", "type", "severity", shown("at", "happened_at")
    )


@query(
    "data_quality_gate",
    """SELECT 'raw_records' AS "check", count(*) AS value, 1 AS threshold, count(*) >= 1 AS ok FROM lineitem UNION ALL
 SELECT 'offices', count(*), 50, count(*) >= 50 FROM supplier UNION ALL
 SELECT 'failed_tasks', count(*), 0, count(*) = 0 FROM shown WHERE status = 'failed'""",
    (B.SHOWN_TASKS,),
)
def _(t):
    failed = t.tasks().agg(
        F.count_if((F.col("status") == "failed") & R.not_system_failure(F.col("status"), F.col("error"))).alias("failed_tasks")
    )
    counts = t.raw().agg(F.count("*").alias("raw_records")).join(
        t.read("supplier").agg(F.count("*").alias("offices"))
    ).join(failed)
    return N.gate(counts, {"raw_records": 1, "offices": 50}, {"failed_tasks": 0})


@query(
    "duplicate_keys",
    "SELECT source_url, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) > 1", (B.RAW,),
)
def _(t):
    return N.duplicate_keys(t.raw(), ["source_url"])


@query(
    "running_totals",
    "SELECT event_id AS id, CAST(coalesce(sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM events",
)
def _(t):
    rows = t.read("events").selectExpr("event_type", "ts", "event_id AS id", "event_id % 7 AS n")
    return prefix_totals(rows, ["event_type"], ["ts", "id"], "n", "used").select("id", "used")


@query(
    "display_formats",
    f"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) END AS size,
 CASE WHEN length(source) <= 6 THEN source ELSE source[1:5] || '…' END AS short FROM documents""",
)
def _(t):
    return t.read("documents").select(
        "doc_id", X.format_bytes(F.col("n_chars")).alias("size"), X.truncate(F.col("source"), 6).alias("short")
    )


@query(
    "source_record_urls",
    "SELECT page_id, CASE WHEN regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) LIKE '%example.com%' THEN regexp_replace(url, '#.*$', '') || '#id%20' || page_id ELSE url END AS link FROM pages",
)
def _(t):
    ext = F.concat(F.lit("id "), F.col("page_id").cast("string"))
    return t.read("pages").select("page_id", R.record_url(F.col("url"), ext, "example.com").alias("link"))


# --- merging into stored events, repeated records -------------------------------------------


@query(
    "merge_incoming_events",
    """SELECT CAST(user_id AS VARCHAR) AS address, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS start_time,
 strftime(max(end_time), '%Y-%m-%d %H:%M:%S') AS end_time, max(confidence) AS confidence, count(*) AS members,
 count(DISTINCT source) AS sources FROM placed GROUP BY user_id, type_group, island""",
    (B.OUTAGES,),
)
def _(t):
    events = t.outage_events()
    early = F.col("event_id").cast("long") % 2 == 0
    stored, stored_sources, _audit = dedup.deduplicate(events.filter(early))
    merged, sources, _audit = dedup.merge_into(stored, stored_sources, events.filter(~early))
    counts = sources.groupBy("event_id").agg(F.count("*").alias("sources"))
    return merged.join(counts, "event_id").select(
        F.col("location_building").alias("address"), shown("start_time"), shown("end_time"), "confidence", "members",
        "sources",
    )


_RECORDS = """reports AS (SELECT event_id AS k, event_id // 3 AS record, user_id, ts AS s,
  ts + to_minutes(CAST(floor(value) AS INT)) AS e FROM events),
 units AS (SELECT record, arg_min(user_id, k) AS user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM reports GROUP BY 1),
 opened AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, record
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM units),
 united AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, record
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened)"""


@query(
    "repeated_records",
    """SELECT CAST(user_id AS VARCHAR) AS address, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS start_time,
 strftime(max(e), '%Y-%m-%d %H:%M:%S') AS end_time, CAST(sum(n) AS BIGINT) AS members FROM united GROUP BY user_id, island""",
    (_RECORDS,),
)
def _(t):
    reports = t.read("events").selectExpr(
        "lpad(CAST(event_id AS string), 12, '0') AS event_id", "CAST(event_id div 3 AS string) AS parsed_record_id",
        "CAST(NULL AS string) AS event_type", "CAST(ts AS timestamp) AS start_time",
        "CAST(ts AS timestamp) + make_interval(0, 0, 0, 0, 0, CAST(floor(value) AS int)) AS end_time",
        "CAST(user_id AS string) AS location_raw", "CAST(user_id AS string) AS location_normalized",
        "'city' AS location_city", "'street' AS location_street", "CAST(user_id AS string) AS location_building",
        "CAST(NULL AS string) AS reason", "array('s') AS sources", "0.5D AS confidence", "'t' AS trace_id",
        "timestamp '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) AS normalized_at",
    )
    return dedup.deduplicate(reports)[0].select(
        F.substring_index("group_key", ":", -1).alias("address"), shown("start_time"), shown("end_time"), "members"
    )


# --- payloads at the edges, hashes, windows, texts --------------------------------------------


@query(
    "merged_windows",
    """SELECT CAST(user_id AS VARCHAR) AS address, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS start_time,
 strftime(max(end_time), '%Y-%m-%d %H:%M:%S') AS end_time, count(*) AS members FROM placed GROUP BY user_id, type_group, island""",
    (B.OUTAGES,),
)
def _(t):
    from voltmap.streaming import streams

    return streams.merged_windows(t.outage_events()).select(
        F.col("location_building").alias("address"), shown("start_time"), shown("end_time"), "members"
    )


@query(
    "payload_edge_cases",
    """SELECT CAST(o_orderkey AS VARCHAR) AS raw_record_id, strftime(o_orderdate + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 7 HOUR
 WHEN 1 THEN INTERVAL 7 HOUR WHEN 2 THEN INTERVAL 10 HOUR ELSE INTERVAL 3 HOUR END, '%Y-%m-%d %H:%M:%S') AS start_time FROM orders""",
)
def _(t):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = (
        F.when(k % 4 == 0, F.concat(day, F.lit(" 10:00:00+03:00"))).when(k % 4 == 1, F.concat(day, F.lit("T10:00:00+03")))
        .when(k % 4 == 2, F.concat(day, F.lit("T10:00:00Z"))).otherwise(F.concat(day, F.lit(" 10:00:00")))
    )
    item = F.to_json(F.struct(F.lit("c").alias("city"), stamp.alias("shutdownDate")))
    raw = t.dealt("orders", "o_orderkey").select(
        k.cast("string").alias("id"), F.lit("s").alias("source_id"), F.lit("t").alias("trace_id"),
        F.concat(F.lit("\n\t ["), item, F.lit(", 7, null]")).alias("raw_content"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
        F.create_map(F.lit("date_filter_days"), F.lit("100000")).alias("parser_profile"),
    )
    return payloads.parse_format_two(raw, ts("1900-01-01 00:00:00")).select("raw_record_id", shown("start_time"))


@query(
    "parsed_fingerprints",
    """SELECT CAST(k AS VARCHAR) AS id, sha256('{"external_id":"' || k || '","source_id":"' || o_custkey || '"}') AS fingerprint FROM parsed""",
    (B.PARSED,),
)
def _(t):
    return t.parsed().select("id", parsed_fingerprint().alias("fingerprint"))


@query(
    "content_fingerprints",
    """SELECT doc_id AS id, sha256('{"city":"' || lang || '","district":null,"end_time":null,"extra":"{\\"a\\":\\"1\\",\\"b\\":\\"' || n_chars
 || '\\"}","reason":null,"region":null,"source_id":null,"start_time":"2020-01-01T00:00:00.000000","street":"' || source || '"}') AS fingerprint FROM documents""",
)
def _(t):
    null = F.lit(None).cast("string")
    rows = t.read("documents").select(
        F.col("doc_id").alias("id"), null.alias("external_id"), null.alias("source_id"), F.col("lang").alias("location_city"),
        null.alias("location_district"), F.lit(None).cast("timestamp").alias("end_time"), null.alias("reason"),
        F.create_map(F.lit("b"), F.col("n_chars").cast("string"), F.lit("a"), F.lit("1")).alias("extra"),
        null.alias("location_region_code"), ts("2020-01-01 00:00:00").alias("start_time"), F.col("source").alias("location_street"),
    )
    return rows.select("id", parsed_fingerprint().alias("fingerprint"))


@query(
    "task_input_hashes",
    """SELECT id, sha256('{' || CASE WHEN source_id IS NULL THEN '' ELSE '"payload":"{\\"source_id\\":\\"' || source_id || '\\"}",' END
 || '"task_type":"' || task_type || '"}') AS input_hash FROM tasks""",
    (B.TASKS,),
)
def _(t):
    return t.tasks().select("id", input_hash(F.col("task_type"), F.col("payload")).alias("input_hash"))


@query(
    "window_relations",
    """SELECT event_id AS id, s <= coalesce(f, b) + INTERVAL 15 MINUTE AND b <= coalesce(e, s) + INTERVAL 15 MINUTE AS overlap,
 abs(epoch(s - b)) <= 900 AND CASE WHEN e IS NULL OR f IS NULL THEN e IS NULL AND f IS NULL ELSE abs(epoch(e - f)) <= 900 END AS close FROM (
 SELECT event_id, ts AS s, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 30 MINUTE END AS e, ts + to_minutes(CAST(event_id % 60 AS INT)) AS b,
 CASE WHEN event_id % 3 <> 0 THEN ts + to_minutes(CAST(event_id % 90 + 20 AS INT)) END AS f FROM events)""",
)
def _(t):
    rows = t.read("events").selectExpr(
        "event_id AS id", "CAST(ts AS timestamp) AS s",
        "CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS timestamp) + INTERVAL 30 MINUTES END AS e",
        "CAST(ts AS timestamp) + make_interval(0, 0, 0, 0, 0, CAST(event_id % 60 AS int)) AS b",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS timestamp) + make_interval(0, 0, 0, 0, 0, CAST(event_id % 90 + 20 AS int)) END AS f",
    )
    four = [F.col(c) for c in "sebf"]
    return rows.select("id", R.windows_overlap(*four).alias("overlap"), R.windows_close(*four).alias("close"))


@query(
    "relative_times",
    f"""SELECT id, CASE WHEN z < 60 THEN 'just now' WHEN z < 3600 THEN CAST(floor(z / 60 + 0.5) AS BIGINT) || 'm ago'
 WHEN z < 86400 THEN CAST(floor(z / 3600 + 0.5) AS BIGINT) || 'h ago' ELSE CAST(floor(z / 86400 + 0.5) AS BIGINT) || 'd ago' END AS ago,
 CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN CAST(floor(n / 60.0 + 0.5) AS BIGINT) || 'm' ELSE CAST(floor(n / 3600.0 + 0.5) AS BIGINT) || 'h' END AS every,
 (id % 101) || '%' AS sure FROM (SELECT event_id AS id, epoch(TIMESTAMP '{E_DAY}' + INTERVAL 400 DAY - ts) AS z, event_id % 9000 AS n FROM events)""",
)
def _(t):
    now = ts(E_DAY) + F.expr("INTERVAL 400 DAYS")
    k = F.col("event_id")
    return t.read("events").select(
        k.alias("id"), X.format_relative(F.col("ts").cast("timestamp"), now).alias("ago"),
        X.format_interval(k % 9000).alias("every"), X.format_confidence((k % 101) / F.lit(100.0)).alias("sure"),
    )


@query(
    "alert_texts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, concat_ws(chr(10), 'Отключение электроэнергии', '', 'Офис: ' || o_clerk_, 'Локация: loc ' || o_custkey,
 'Причина: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'не указана' ELSE o_orderpriority END,
 'Начало: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00',
 'Окончание: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'не указано' ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' END,
 'Уровень: high', 'Матчинг: ' || o_orderstatus, 'Event ID: ' || o_orderkey) AS alert,
 o_clerk_ || ': отключение затрагивает loc ' || o_custkey || '. Окно: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00 - '
 || CASE WHEN o_orderkey % 2 = 0 THEN 'без окончания' ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' END
 || '. Матчинг: ' || o_orderstatus || '.' AS summary FROM (SELECT *, 'office ' || o_custkey AS o_clerk_ FROM orders)""",
)
def _(t):
    k = F.col("o_orderkey")
    office, place = (F.concat(F.lit(x), F.col("o_custkey").cast("string")) for x in ("office ", "loc "))
    start = F.col("o_orderdate").cast("timestamp")
    end = F.when(k % 2 != 0, start + F.expr("INTERVAL 1 DAY"))
    reason = F.when(k % 3 != 0, F.col("o_orderpriority"))
    return t.read("orders").select(
        k.cast("string").alias("id"),
        R.alert_text(office, place, reason, start, end, F.lit("high"), F.col("o_orderstatus"), k.cast("string")).alias("alert"),
        R.summary_text(office, place, start, end, F.col("o_orderstatus")).alias("summary"),
    )


@query(
    "newest_cities",
    "SELECT c_custkey // 7 AS id, max(c_custkey) AS pos FROM customer WHERE c_nationkey IN (0, 2, 3, 11, 24) GROUP BY 1",
)
def _(t):
    rows = t.read("customer").selectExpr(
        "c_custkey DIV 7 AS id", "CAST(c_nationkey AS string) AS area_name", "c_custkey AS pos"
    )
    return documents.distinct_cities(rows, ["0", "2", "3", "11", "24"], [F.col("pos")]).select("id", "pos")


@query(
    "change_samples",
    """(SELECT 'added' AS kind, event_id AS id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1 ORDER BY event_id LIMIT 25) UNION ALL
 (SELECT 'changed', event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 1 AND event_id % 5 = 0 ORDER BY event_id LIMIT 25)""",
)
def _(t):
    rows = t.read("events").selectExpr(
        "event_id AS id", "CASE WHEN event_id % 3 <> 0 THEN 'a' END AS auto_key",
        "CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'b' ELSE 'a' END END AS combined_key",
    )
    return N.change_samples(rows, 25, [F.col("id")]).select("kind", "id")


@query(
    "silence_transitions",
    """SELECT source_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, event_type FROM (
 SELECT s.id AS source_id, f.seen + to_seconds(3 * s.poll_interval_seconds) AS moment, 'parser.silent' AS event_type FROM sources s JOIN gaps f ON f.k = s.id
  WHERE s.is_active AND epoch(coalesce(f.nxt, TIMESTAMP '2010-01-01 00:00:00') - f.seen) > 3 * s.poll_interval_seconds
 UNION ALL SELECT s.id, f.nxt, 'parser.recovered' FROM sources s JOIN gaps f ON f.k = s.id
  WHERE s.is_active AND f.nxt IS NOT NULL AND epoch(f.nxt - f.seen) > 3 * s.poll_interval_seconds
 UNION ALL SELECT id, created_at + to_seconds(3 * poll_interval_seconds), 'parser.silent' FROM sources
  WHERE is_active AND id NOT IN (SELECT k FROM gaps) AND created_at + to_seconds(3 * poll_interval_seconds) < TIMESTAMP '2010-01-01 00:00:00')""",
    (B.SOURCES, "gaps AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, l_shipdate AS seen, lead(l_shipdate) OVER (PARTITION BY l_suppkey "
     "ORDER BY l_shipdate) AS nxt FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem))"),
)
def _(t):
    found = N.silence_transitions(t.sources(), t.raw().filter(F.col("fetched_at") <= ts("2010-01-01 00:00:00")), ts("2010-01-01 00:00:00"))
    return found.select("source_id", shown("at", "moment"), "event_type")


@query(
    "pipeline_overall",
    """SELECT CASE WHEN bool_or(failed > 0 AND failed >= (done + running) / 4.0) THEN 'failed' WHEN bool_or(running > 0) THEN 'running'
 WHEN bool_or(pending > 0 OR done = 0) THEN 'pending' ELSE 'healthy' END AS overall FROM (SELECT t.task_type, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running,
 coalesce(done, 0) AS done, coalesce(failed, 0) AS failed FROM (VALUES ('fetch_source'),('parse_content'),('normalize_event'),('deduplicate_event'),('match_offices'),('emit_event')) t(task_type)
 LEFT JOIN (SELECT task_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM shown GROUP BY 1) m ON m.task_type = t.task_type)""",
    (B.SHOWN_TASKS,),
)
def _(t):
    return N.pipeline_overall(N.pipeline_status(t.tasks(), ts(E_DAY)))


@query(
    "queue_stage_share",
    """SELECT task_type, count(*) FILTER (status IN ('pending', 'running')) AS queued,
 round(count(*) FILTER (status IN ('pending', 'running')) / sum(count(*) FILTER (status IN ('pending', 'running'))) OVER (), 4) AS share FROM shown GROUP BY 1""",
    (B.SHOWN_TASKS,),
)
def _(t):
    return N.stage_share(t.tasks())


@query(
    "threat_share",
    "SELECT count(*) AS \"all\", round(100.0 * count(*) FILTER (status <> 'ok') / count(*), 1) AS threat_pct FROM by_office",
    (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.threat_share(N.map_offices(_map_rows(t)))


@query(
    "many_key_lookup",
    "SELECT s_suppkey, c_custkey IS NOT NULL AS known FROM supplier LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON s_suppkey = c_custkey",
)
def _(t):
    wanted = t.read("supplier").select("s_suppkey")
    known = t.read("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"))
    return N.lookup(wanted, known, "s_suppkey").select("s_suppkey", "known")
