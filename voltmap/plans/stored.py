"""Registered queries over stores, files and the whole ingest chain, and over the rarer rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltmap.operators import analytics as N
from voltmap.operators import normalize, similarity, upsert
from voltmap.plans import bindings as B
from voltmap.plans.bindings import Tables, ts
from voltmap.plans.catalog import E_DAY, O_DAY, S_DAY, _MAP, _TIMINGS, _map_rows, query, shown
from voltmap.session import shared_folder
from voltmap.sources import documents, payloads
from voltmap.streaming import ingest, streams
from voltmap.streaming.store import Store


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- stores


@query(
    "keyed_store_rows",
    """WITH versions AS (SELECT o_custkey AS k, CAST(year(o_orderdate) - 1992 AS BIGINT) AS batch, max(o_orderkey) AS v,
  bool_or(o_orderstatus = 'P') AS gone FROM orders GROUP BY 1, 2),
 last AS (SELECT k, arg_max(v, batch) AS v, arg_max(gone, batch) AS gone FROM versions GROUP BY 1)
SELECT k, v FROM last WHERE NOT gone""",
)
def _(t):
    """A year of orders per batch: a customer's last year stands, or removes the customer."""
    store = Store(t.spark, _folder(t, "keyed"), buckets=8, fanout=3, levels=2)
    dated = t.read("orders").withColumn("batch", F.year("o_orderdate") - 1992)
    rows = dated.groupBy(F.col("o_custkey").alias("k"), "batch").agg(
        F.max("o_orderkey").alias("v"), F.bool_or(F.col("o_orderstatus") == "P").alias("gone")
    )
    for number in range(11):
        b = store.batch(number)
        own = rows.filter(F.col("batch") == number)
        b.put("orders", own.filter("NOT gone").select("k", "v"), ["k"], gone=own.filter("gone"))
        b.commit()
    return store.last().current("orders")


@query("replace_registry", "SELECT 'offices' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def _(t):
    """A new registry takes the place of the old one; impacts and notifications go with that."""
    store = Store(t.spark, _folder(t, "registry"), buckets=8)
    b = store.batch()
    b.replace("offices", t.offices())
    b.put("office_impacts", t.impacts(), ["id"])
    b.append("notifications", t.impacts().select("id", "office_id"))
    b.commit()
    upsert.replace_registry(store.batch(), t.read("customer").selectExpr("CAST(c_custkey AS string) AS id", "c_name AS name"))
    now = store.last()
    kinds = {"offices": now.whole("offices"), "impacts": now.current("office_impacts"), "notifications": now.whole("notifications")}
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


_LOOKS = ("1996-01-01 00:00:00", "1998-09-01 00:00:00", "1998-10-15 00:00:00", S_DAY)


_SILENT = "looks(n, moment) AS (VALUES " + ", ".join(f"({n}, TIMESTAMP '{at}')" for n, at in enumerate(_LOOKS)) + """),
 last AS (SELECT n, s.id, max(fetched_at) AS last FROM looks CROSS JOIN sources s
  LEFT JOIN raw r ON r.source_id = s.id AND r.fetched_at < moment WHERE is_active GROUP BY 1, 2),
 silent AS (SELECT n, id FROM last JOIN looks USING (n) JOIN sources USING (id)
  WHERE last IS NULL OR epoch(moment - last) > poll_interval_seconds * 3)"""


@query(
    "silence_latch",
    """SELECT n AS look, id, 'parser.silent' AS event_type FROM silent s
 WHERE NOT EXISTS (SELECT 1 FROM silent p WHERE p.n = s.n - 1 AND p.id = s.id)
UNION ALL SELECT n + 1, id, 'parser.recovered' FROM silent p
 WHERE n < 3 AND NOT EXISTS (SELECT 1 FROM silent s WHERE s.n = p.n + 1 AND p.id = s.id)""",
    (B.SOURCES, B.RAW, _SILENT),
)
def _(t):
    """Alerts and recoveries of four looks; the latch is kept between them."""
    store, out = Store(t.spark, _folder(t, "latch"), buckets=8), None
    for n, at in enumerate(_LOOKS):
        raw = t.raw().filter(F.col("fetched_at") < ts(at))
        changes = streams.silence_tick(store, N.silent_sources(t.sources(), raw, ts(at)).select("id"), n)
        part = changes.select(F.lit(n).alias("look"), "id", "event_type")
        out = part if out is None else out.unionByName(part)
    return out


_CHAIN = B.PLACES + """, outages AS (SELECT o_orderkey AS k, lower(r) || '|' || p || '|' || (o_orderkey % 97 + 1) AS address, o_orderdate
  + to_hours(CAST(o_orderkey % 24 AS INT)) AS s, o_orderdate + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 5 AS INT)) AS e
  FROM orders JOIN places ON o_custkey = c_custkey WHERE o_custkey % 11 <> 0),
 flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY address ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM outages),
 placed AS (SELECT *, sum(opens) OVER (PARTITION BY address ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM flagged)"""


def _announced(t: Tables):
    """Orders as payloads of one announcement each: (part of the year, payload columns)."""
    rows = t.read("orders").join(t.places(), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    start = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 24) * 3_600_000_000)
    end = F.timestamp_micros(F.unix_micros(start) + (k % 5 + 1) * 3_600_000_000)
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    item = F.struct(
        F.concat(F.lit("город "), F.col("r")).alias("city"), F.concat(F.lit("улица "), F.col("p")).alias("street"),
        (k % 97 + 1).cast("string").alias("commaSeparatedHouses"), F.date_format(start, stamp).alias("shutdownDate"),
        F.date_format(end, stamp).alias("restoreDate"), k.cast("string").alias("type"),
    )
    broken = F.col("o_custkey") % 11 == 0
    text = F.to_json(F.array(item))
    return rows.select(
        (k % 2).alias("part"), k.cast("string").alias("id"), F.lit("s").alias("source_id"),
        F.when(broken, F.concat(text, F.lit(" oops"))).otherwise(text).alias("raw_content"), F.lit("t").alias("trace_id"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
    )


@query(
    "ingest_chain",
    "SELECT address, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(e), '%Y-%m-%d %H:%M:%S') AS end_time, "
    "count(*) AS members FROM placed GROUP BY address, island "
    "UNION ALL SELECT 'malformed payload for: format_two', NULL, NULL, count(*) FROM orders JOIN places ON o_custkey = c_custkey WHERE o_custkey % 11 = 0",
    (_CHAIN,),
)
def _(t):
    """All announcements in two batches through the whole chain."""
    store = Store(t.spark, _folder(t, "chain"), buckets=4)
    profile = F.create_map(F.lit("parser"), F.lit("format_two"), F.lit("date_filter_days"), F.lit("100000"))
    sources = t.spark.range(1).select(F.lit("s").alias("id"), profile.alias("parser_profile"))
    raw = _announced(t)
    for number in (0, 1):
        ingest.step(store.batch(number), raw.filter(F.col("part") == number).drop("part"), sources, ts("1900-01-01 00:00:00"))
    now = store.last()
    events = now.current("normalized_events").select(
        F.col("location_normalized").alias("address"), shown("start_time"), shown("end_time"), "members"
    )
    refused = now.whole("quarantine").groupBy(F.col("error").alias("address")).agg(F.count("*").alias("members"))
    null = F.lit(None).cast("string")
    return events.unionByName(refused.select("address", null.alias("start_time"), null.alias("end_time"), "members"))


# --- files


@query(
    "office_round_trip",
    """SELECT f AS file, s_name AS name, 'Town, "' || s_nationkey || '"' AS city, 'line' || chr(10) || s_suppkey AS address, s_suppkey % 3 <> 0 AS is_active,
 CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS latitude FROM supplier, (VALUES ('csv'), ('json')) v(f)""",
)
def _(t):
    """The registry written as CSV and as JSON documents, and read back."""
    offices = t.read("supplier").select(
        F.col("s_name").alias("name"), F.concat(F.lit('Town, "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("city"),
        F.concat(F.lit("line\n"), F.col("s_suppkey").cast("string")).alias("address"), F.lit("r").alias("region"), (F.col("s_suppkey") % 3 != 0).alias("is_active"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).cast("double").alias("latitude"), F.lit(1.5).alias("longitude"),
        F.create_map(F.lit("office_id"), F.col("s_suppkey").cast("string")).alias("extra"),
    )
    path = _folder(t, "offices")
    upsert.export_offices(offices, path)
    columns = ["name", "city", "address", "is_active", "latitude"]
    read = {"csv": documents.read_offices_csv(t.spark, f"{path}/csv"), "json": documents.read_offices_json(t.spark, f"{path}/json")}
    out = None
    for name, rows in read.items():
        part = rows.select(F.lit(name).alias("file"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "payload_files",
    """SELECT length(s_comment) AS n, sha256(s_comment) AS content_hash, length(s_comment) > 60 AS refused FROM (
 SELECT s_name || repeat('.', CAST(s_suppkey % 80 AS INT)) AS s_comment FROM supplier)""",
)
def _(t):
    """One payload file per supplier, read back; files over 60 bytes are refused and reported."""
    path = _folder(t, "payloads")
    name = F.concat("s_name", F.repeat(F.lit("."), (F.col("s_suppkey") % 80).cast("int")))
    texts = t.read("supplier").groupBy("s_suppkey").agg(F.array_join(F.collect_list(F.coalesce(name, F.lit(""))), "\x00").alias("value"))
    # Files of one row in one folder: a folder per supplier would have to be listed, and its path kept, one by one.
    texts.select("value").write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(path)
    stored, refused = payloads.read_raw(t.spark, path, "file", ts(S_DAY), max_bytes=61)
    kept = stored.select(F.regexp_replace("raw_content", "\x00$", "").alias("c"), F.lit(False).alias("refused"))
    whole = t.spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "\x00$", "").alias("c"))
    over = refused.select((F.col("length") - 1).alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    long = whole.filter(F.length("c") > 60).join(over, F.length("c") == F.col("n"), "left_semi").select("c", F.lit(True).alias("refused"))
    return kept.unionByName(long).select(F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("content_hash"), "refused")


_EVALUATED = """cases AS (SELECT k, t, r || '|' || p || '|' || CASE WHEN t = 4 THEN '' ELSE CAST(h AS VARCHAR) END AS key,
  k % 11 <> 0 AS got, CASE WHEN t = 5 THEN 0.92 ELSE 1.0 END AS confidence, CASE WHEN k % 5 = 0 THEN 0.95 ELSE 0.0 END AS least FROM parsed),
 judged AS (SELECT *, got AND k % 7 <> 0 AS address_ok, got AND confidence >= least AS confidence_ok FROM cases)"""


#: Labelled cases of a document, on average.
CASES = 2000


def _cases(t: Tables):
    """Parsed orders as labelled cases, written and read back as documents; some labels are wrong."""
    path = _folder(t, "cases")
    rows, k = t.parsed(), F.col("id").cast("long")
    house = F.when(k % 6 == 4, "").otherwise((k % 97 + 1).cast("string"))
    text = F.coalesce("location_street", F.element_at("extra", "address"))
    clean = t.read("orders").join(t.places(), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.lower("r").alias("r"), "p"
    )
    rows = rows.withColumn("text", text).join(clean, "id")
    stamp = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ssXXX")
    parsed = F.struct(
        "external_id", F.when(k % 11 != 0, stamp).alias("start_time"), "location_city", "location_street", "reason", "extra"
    )
    key = F.when(k % 7 != 0, F.concat_ws("|", "r", "p", house)).otherwise("wrong")
    expected = F.struct(
        F.lit("power_outage").alias("event_type"), key.alias("canonical_key"), F.when(k % 5 == 0, 0.95).alias("min_confidence")
    )
    case = F.struct(F.col("id").alias("name"), parsed.alias("parsed"), expected.alias("expected"))
    # A document is written and read as one value, so its cases are bounded, and their number grows with the orders.
    many = max(32, t.read("orders").count() // CASES)
    part = F.pmod(F.xxhash64("id"), F.lit(many))
    dealt = rows.select(part.alias("part"), case.alias("c")).groupBy("part").agg(F.collect_list("c").alias("cases"))
    dealt.select(F.to_json("cases").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return documents.read_cases(t.spark, path)


@query(
    "normalizer_rates",
    """SELECT count(*) AS total, count(*) FILTER (got) AS normalized, round(count(*) FILTER (got) / count(*), 4) AS normalization_rate,
 round(count(*) FILTER (got) / count(*), 4) AS event_type_accuracy, round(count(*) FILTER (address_ok) / count(*), 4) AS address_accuracy,
 round(count(*) FILTER (confidence_ok) / count(*), 4) AS confidence_pass_rate FROM judged""",
    (B.PARSED, _EVALUATED),
)
def _(t):
    return N.evaluate_normalizer(_cases(t))[0]


@query(
    "normalizer_failures",
    """SELECT CAST(k AS VARCHAR) AS name, CASE WHEN got THEN 'other values' ELSE 'no result' END AS reason,
 CASE WHEN k % 7 <> 0 THEN key ELSE 'wrong' END AS expected_key, CASE WHEN got THEN key END AS key, CAST(least AS DOUBLE) AS min_confidence,
 CAST(CASE WHEN got THEN confidence END AS DOUBLE) AS confidence FROM judged WHERE NOT (address_ok AND confidence_ok)""",
    (B.PARSED, _EVALUATED),
)
def _(t):
    return N.evaluate_normalizer(_cases(t))[1].select(
        "name", "reason", F.col("expected_canonical_key").alias("expected_key"), "key", "min_confidence",
        F.round("confidence", 3).alias("confidence"),
    )


# --- orders, metrics, names


@query(
    "names_in_russian_order",
    """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY
  CASE c_custkey % 4 WHEN 0 THEN 'елка' WHEN 1 THEN 'елка' WHEN 2 THEN 'жук' ELSE 'ель' END || ' ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS place
 FROM customer""",
)
def _(t):
    k = F.col("c_custkey")
    word = F.when(k % 4 == 0, "Ёлка").when(k % 4 == 1, "елка").when(k % 4 == 2, "Жук").otherwise("ель")
    rows = t.read("customer").select(
        "c_custkey", "c_nationkey", F.concat(word, F.lit(" "), F.lpad(k.cast("string"), 9, "0")).alias("name")
    )
    return N.by_name(rows, ["c_nationkey"], "name").select("c_custkey", "place")


@query(
    "impact_places",
    """SELECT office_id, id AS impact_id, row_number() OVER (PARTITION BY office_id ORDER BY
  CASE status WHEN 'critical' THEN 0 ELSE 1 END, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
  WHEN 'low' THEN 3 ELSE 4 END, impact_start, id) AS place FROM rel WHERE id IS NOT NULL""",
    (B.IMPACTS, B.OFFICES, _MAP),
)
def _(t):
    return N.ranked_impacts(_map_rows(t)).select("office_id", "impact_id", "place")


_SINCE = f"TIMESTAMP '{E_DAY}' - INTERVAL 240 HOUR"


@query(
    "pipeline_metrics",
    """SELECT 'stage.' || task_type AS part, u.name, CAST(u.value AS DOUBLE) AS value FROM timings, LATERAL (VALUES ('count', CAST(count AS DOUBLE)),
  ('avg_ms', avg_ms), ('max_ms', max_ms), ('p50_ms', p50_ms), ('p95_ms', p95_ms)) u(name, value)
 UNION ALL SELECT 'calls', u.name, CAST(u.value AS DOUBLE) FROM (SELECT count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS b,
  coalesce(sum(p) FILTER (ok), 0) AS c, coalesce(sum(q) FILTER (ok), 0) AS d, coalesce(floor(avg(ms) FILTER (ok)), 0) AS e, coalesce(max(ms) FILTER (ok), 0) AS f
  FROM (SELECT event_id % 9 <> 0 AS ok, event_id % 700 AS p, user_id % 300 AS q, CAST(round(value * 10) AS INT) AS ms FROM events
   WHERE ts >= """ + _SINCE + """)) x, LATERAL (VALUES ('calls_ok', CAST(a AS DOUBLE)), ('calls_error', b), ('prompt_tokens', c), ('completion_tokens', d),
  ('total_tokens', c + d), ('avg_duration_ms', e), ('max_duration_ms', f), ('prompt_cost', round(c / 1000.0 * 0.2, 4)),
  ('completion_cost', round(d / 1000.0 * 0.6, 4)), ('total_cost', round(c / 1000.0 * 0.2 + d / 1000.0 * 0.6, 4))) u(name, value)
 UNION ALL SELECT 'paths', u.name, CAST(u.value AS DOUBLE) FROM (SELECT count(*) FILTER (normalizer_path = 'automaton') AS a,
  count(*) FILTER (normalizer_path = 'regex_fallback') AS b, count(*) FILTER (normalizer_path = 'llm_fallback') AS c, count(*) FILTER (normalizer_path = 'none') AS d
  FROM tasks WHERE task_type = 'normalize_event' AND completed_at >= """ + _SINCE + """) x, LATERAL (VALUES ('automaton', CAST(a AS DOUBLE)), ('regex_fallback', b),
  ('llm_fallback', c), ('none', d), ('automaton_share', CASE WHEN a + b + c + d > 0 THEN round(a / (a + b + c + d), 3) ELSE 0.0 END)) u(name, value)""",
    (B.TASKS, _TIMINGS.format(since=f"AND completed_at >= {_SINCE}")),
)
def _(t):
    return N.pipeline_metrics(t.tasks(), t.calls(), ts(E_DAY) - F.expr("INTERVAL 240 HOURS"), 0.20, 0.60)


# Hashes have letters 0-9 and a-f only, so a z matches nothing and the ratio of a pair is known.
_EDITED = "CASE c_custkey % 4 WHEN 0 THEN m WHEN 1 THEN 'z' || substr(m, 2, 27) || 'zzzz' WHEN 2 THEN substr(m, 1, 26) || 'zzzzzz' ELSE substr(m, 3, 28) END"


@query(
    "similar_names",
    f"""SELECT c_custkey AS l, c_custkey AS r, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(2.0 * 27 / 64, 6) ELSE 0.93 END AS score
 FROM customer WHERE c_custkey % 4 <> 2""",
)
def _(t):
    """Misspelt names find their own: equal, contained, or by the ratio of matching blocks."""
    names = t.read("customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("m"))
    edited = names.select(F.col("c_custkey").alias("r_key"), F.expr(_EDITED).alias("r"))
    left = names.select(F.lit("").alias("block"), F.col("m").alias("l"))
    pairs = similarity.similar_pairs(left, edited.select(F.lit("").alias("block"), "r"), 0.84)
    return pairs.join(names.hint("merge"), F.col("l") == F.col("m")).join(edited.hint("merge"), "r").select(
        F.col("c_custkey").alias("l"), F.col("r_key").alias("r"), F.round("score", 6).alias("score")
    )


# --- recovery from free texts


@query(
    "recovered_addresses",
    """SELECT CAST(k AS VARCHAR) AS id, r || '|' || p || '|' || CASE WHEN f = 1 THEN '' ELSE CAST(h AS VARCHAR) END AS location_normalized,
 CAST(CASE f WHEN 0 THEN 0.81 WHEN 1 THEN 0.72 WHEN 2 THEN 0.81 WHEN 3 THEN 0.78 WHEN 5 THEN 0.95 ELSE 0.92 END AS DOUBLE) AS confidence,
 concat_ws(', ', CASE f WHEN 5 THEN 'г ' || rr END, CASE WHEN f < 3 THEN 'г. ' || rr END, CASE WHEN f = 7 THEN 'дом ' || h END,
  CASE WHEN f = 2 THEN CAST(h AS VARCHAR) END, CASE f WHEN 0 THEN p || ' ' || h WHEN 1 THEN p WHEN 2 THEN p
   WHEN 3 THEN rr || ' обл, г ' || rr || ', ' || p || ' ' || h WHEN 4 THEN 'г ' || rr || ', ' || p || ' проспект, ' || h
   WHEN 5 THEN 'проспект ' || p || ' ' || h WHEN 6 THEN 'с. ' || rr || ', пер ' || p || ', ' || h ELSE 'г ' || rr || ', ул ' || p END) AS location_raw
FROM (SELECT o_orderkey AS k, o_orderkey % 8 AS f, o_orderkey % 97 + 1 AS h, r AS rr, lower(r) AS r, p FROM orders JOIN places ON o_custkey = c_custkey)""",
    (B.PLACES,),
)
def _(t):
    """Addresses without a usable street field: typed and untyped streets, places and houses found in free texts."""
    rows = t.read("orders").join(t.places(), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumns({"f": F.col("o_orderkey") % 8, "h": (F.col("o_orderkey") % 97 + 1).cast("string")})
    parsed = rows.selectExpr(
        "CAST(o_orderkey AS string) AS id", "'raw' AS raw_record_id", "CAST(NULL AS string) AS source_id",
        "CAST(NULL AS string) AS external_id", "CAST(o_orderdate AS timestamp) AS start_time", "CAST(NULL AS timestamp) AS end_time",
        "CASE WHEN f < 3 THEN concat('г. ', r) END AS location_city", "CASE WHEN f = 5 THEN concat('г ', r) END AS location_district",
        "CASE WHEN f = 7 THEN concat('дом ', h) END AS location_street", "CAST(NULL AS string) AS location_region_code",
        "o_orderpriority AS reason",
        "map_filter(map('address', CASE f WHEN 0 THEN concat(p, ' ', h) WHEN 1 THEN p WHEN 2 THEN p "
        "WHEN 3 THEN concat(r, ' обл, г ', r, ', ', p, ' ', h) WHEN 4 THEN concat('г ', r, ', ', p, ' проспект, ', h) "
        "WHEN 5 THEN concat('проспект ', p, ' ', h) WHEN 6 THEN concat('с. ', r, ', пер ', p, ', ', h) "
        "ELSE concat('г ', r, ', ул ', p) END, 'houses', CASE WHEN f = 2 THEN h END), (k, v) -> v IS NOT NULL) AS extra",
        "'t' AS trace_id", "CAST(o_orderdate AS timestamp) AS extracted_at",
    )
    return normalize.normalize(parsed).select(
        F.col("parsed_record_id").alias("id"), "location_normalized", F.round("confidence", 3).alias("confidence"), "location_raw"
    )
