"""Domain tables derived from the shared test tables, in Spark and in SQL.

Each binding renames and computes columns of whole test tables; the SQL twin is
written from the clean parts (city, street, house), independent of the
normalization code it is used to check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmap.session import prepare

AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_ORDERS = "1998-06-01 00:00:00"
AS_OF_SHIP = "2001-08-01 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table dealt by key before CPU-bound work, however its files are cut."""
        return self.read(name).repartition(F.col(key))

    def tasks(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id",
            "CASE event_type WHEN 'signup' THEN 'fetch_source' WHEN 'view' THEN 'parse_content' "
            "WHEN 'click' THEN 'normalize_event' WHEN 'purchase' THEN 'match_offices' "
            "ELSE 'emit_event' END AS task_type",
            "CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' "
            "ELSE 'done' END AS status",
            "CAST(event_id % 6 AS int) AS attempt",
            "CASE WHEN event_id % 7 <> 0 THEN map('source_id', CAST(user_id AS string)) END AS payload",
            "CASE WHEN event_id % 20 = 0 THEN 'abandoned by previous pipeline process' "
            "WHEN event_id % 50 = 10 THEN NULL WHEN event_id % 10 = 0 THEN concat('boom ', event_id) END AS error",
            "CAST(user_id AS string) AS trace_id",
            "CASE WHEN event_id % 10 NOT IN (1, 2) THEN CAST(round(value * 1000) AS int) END AS duration_ms",
            "CAST(ts AS timestamp) + make_interval(0, 0, 0, 0, 0, 0, event_id % 90) AS completed_at",
            "CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS timestamp) + INTERVAL 2 DAYS END AS next_run_at",
            "CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 11 = 0 THEN 'none' "
            "WHEN event_id % 4 = 0 THEN 'regex_fallback' ELSE 'automaton' END END AS normalizer_path",
            "CAST(ts AS timestamp) AS created_at",
            "CAST(ts AS timestamp) AS updated_at",
        )

    def calls(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id",
            "CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status",
            "CAST(event_id % 700 AS int) AS prompt_tokens",
            "CAST(user_id % 300 AS int) AS completion_tokens",
            "CAST(event_id % 700 + user_id % 300 AS int) AS total_tokens",
            "CAST(round(value * 10) AS int) AS duration_ms",
            "CAST(ts AS timestamp) AS created_at",
        )

    def logs(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id",
            "event_type",
            "CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity",
            "CAST(user_id AS string) AS trace_id",
            "CAST(ts AS timestamp) AS created_at",
            "CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS int) AS change",
        )

    def sources(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "CAST(s_suppkey AS string) AS id",
            "s_name AS name",
            "concat('http://grid.example/list?r=', s_suppkey) AS url",
            "'json' AS source_type",
            "CAST(86400 * (1 + s_suppkey % 20) AS int) AS poll_interval_seconds",
            "s_suppkey % 7 <> 3 AS is_active",
            "map('parser', CASE s_suppkey % 4 WHEN 0 THEN 'format_one' WHEN 1 THEN 'format_two' "
            "WHEN 2 THEN 'format_three' ELSE 'unknown' END, 'date_filter_days', CAST(s_suppkey % 20 AS string), "
            "'max_pages', CAST(s_suppkey % 14 AS string), 'page_param', 'p', 'date_start', 'today', "
            "'date_end', 'today+window') AS parser_profile",
            "timestamp '2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(s_suppkey AS int)) AS created_at",
        )

    def raw(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "CAST(l_orderkey * 8 + l_linenumber AS string) AS id",
            "CAST(l_suppkey AS string) AS source_id",
            "concat('http://grid.example/item/', l_partkey) AS source_url",
            "'json' AS source_type",
            "concat(l_returnflag, repeat('x', CAST(l_quantity AS int))) AS raw_content",
            "CAST(l_shipdate AS timestamp) AS fetched_at",
        )

    def places(self) -> DataFrame:
        """customer key -> clean city and street."""
        region = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.read("customer")
            .join(region, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("part"), F.col("p_partkey") == F.col("c_custkey"))
            .select("c_custkey", F.col("r_name").alias("r"), F.col("p_name").alias("p"))
        )

    def parsed(self) -> DataFrame:
        rows = self.read("orders").join(self.places(), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.repartition("o_orderkey")
        rows = rows.withColumns({"h": F.expr("CAST(o_orderkey % 97 + 1 AS string)"), "t": F.expr("o_orderkey % 6")})
        empty = "CAST(map() AS map<string,string>)"
        return rows.selectExpr(
            "CAST(o_orderkey AS string) AS id",
            "concat('raw-', o_custkey) AS raw_record_id",
            "CAST(o_custkey AS string) AS source_id",
            "CAST(o_orderkey AS string) AS external_id",
            "CAST(o_orderdate AS timestamp) + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS int)) AS start_time",
            "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS timestamp) + "
            "make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 + 1 + o_orderkey % 12 AS int)) END AS end_time",
            "CASE t WHEN 0 THEN concat('г. ', r) WHEN 1 THEN concat('город ', r) WHEN 2 THEN r "
            "WHEN 3 THEN concat('г ', r) WHEN 4 THEN r END AS location_city",
            "CAST(NULL AS string) AS location_district",
            "CASE t WHEN 0 THEN concat('ул. ', p, ', д. ', h) WHEN 1 THEN concat('улица ', p) "
            "WHEN 2 THEN concat('пр-т ', p, ' ', h) "
            "WHEN 3 THEN concat(p, ' ул ', h, '-', CAST(o_orderkey % 97 + 5 AS string)) "
            "WHEN 4 THEN concat('пер. ', p) END AS location_street",
            "CAST(NULL AS string) AS location_region_code",
            "o_orderpriority AS reason",
            f"CASE t WHEN 1 THEN map('houses', h) WHEN 5 THEN map('address', concat('г. ', r, ', ул ', p, ', д ', h)) "
            f"ELSE {empty} END AS extra",
            "CAST(o_custkey AS string) AS trace_id",
            "CAST(o_orderdate AS timestamp) AS extracted_at",
        )

    def match_events(self) -> DataFrame:
        """Events with their address fields filled straight from the clean parts."""
        rows = self.parsed().withColumns({"_k": F.col("id").cast("long")}).withColumn("_t", F.col("_k") % 6)
        text = F.coalesce("location_street", F.element_at("extra", "address"))
        house = F.when(~F.col("_t").isin(3, 4), (F.col("_k") % 97 + 1).cast("string"))
        city_free = F.when(F.col("_t") == 5, F.regexp_extract(text, ", (ул [^,]+),", 1)).otherwise(text)
        return rows.select(
            F.col("id").alias("event_id"), F.col("id").alias("parsed_record_id"),
            F.lit("power_outage").alias("event_type"), "start_time", "end_time",
            city_free.alias("location_raw"), F.lit(None).cast("string").alias("location_normalized"),
            "location_city", city_free.alias("location_street"), house.alias("location_building"),
            "reason", "trace_id", F.col("extracted_at").alias("normalized_at"),
        )

    def offices(self) -> DataFrame:
        region = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = (
            self.read("supplier")
            .join(region, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("part"), F.col("p_partkey") == F.col("s_suppkey"))
        )
        h = "CAST(s_suppkey % 97 + 1 AS string)"
        return rows.selectExpr(
            "CAST(s_suppkey AS string) AS id",
            "s_name AS name",
            "concat('г ', r_name) AS city",
            f"CASE s_suppkey % 3 WHEN 0 THEN concat('ул. ', p_name, ', д. ', {h}) "
            f"WHEN 1 THEN concat(r_name, ' обл, г ', r_name, ', ул ', p_name, ', ', {h}) "
            f"ELSE concat(p_name, ' проспект, дом ', {h}) END AS address",
            "r_name AS region",
            "s_suppkey % 11 <> 5 AS is_active",
            "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS latitude",
            "s_acctbal AS longitude",
        )

    def outage_events(self) -> DataFrame:
        """`events` as outages: the user is the address, `value` minutes the length."""
        return self.read("events").selectExpr(
            "CAST(event_id AS string) AS event_id",
            "CAST(event_id AS string) AS parsed_record_id",
            "CASE event_type WHEN 'view' THEN 'maintenance' WHEN 'purchase' THEN 'infrastructure_failure' "
            "WHEN 'signup' THEN 'other' ELSE 'power_outage' END AS event_type",
            "CAST(ts AS timestamp) AS start_time",
            "CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS timestamp) + "
            "make_interval(0, 0, 0, 0, 0, CAST(floor(value) AS int)) END AS end_time",
            "concat('addr ', user_id) AS location_raw",
            "concat('city|street|', user_id) AS location_normalized",
            "'city' AS location_city", "'street' AS location_street",
            "CAST(user_id AS string) AS location_building",
            "CASE WHEN event_id % 3 = 0 THEN concat('r', event_id) END AS reason",
            "array(concat('raw-', event_id % 40)) AS sources",
            "CAST(event_id % 10 AS double) / 10 AS confidence",
            "CAST(user_id AS string) AS trace_id",
            "CAST(ts AS timestamp) AS normalized_at",
        )

    def impacts(self) -> DataFrame:
        """`orders` as impacts: the supplier-sized office key comes from the customer key."""
        n = self.read("supplier").select(F.count("*").alias("_n"))
        return self.read("orders").join(n).selectExpr(
            "CAST(o_orderkey AS string) AS id",
            "CAST(o_custkey % _n AS string) AS office_id",
            "CAST(o_orderkey AS string) AS event_id",
            "CAST(o_orderdate AS timestamp) AS impact_start",
            "CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderdate AS timestamp) + "
            "make_interval(0, 0, 0, CAST(o_orderkey % 9 AS int)) END AS impact_end",
            "CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'P' THEN 'MEDIUM ' ELSE 'strange' END AS impact_level",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'exact_address' ELSE 'street_area' END AS match_strategy",
            "CAST(o_orderkey % 100 AS double) / 100 AS match_score",
            "CAST(o_custkey AS string) AS trace_id",
            "CAST(o_orderdate AS timestamp) + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS int)) AS detected_at",
        )

    def impact_events(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CASE WHEN o_orderkey % 10 = 9 THEN concat('unknown-', o_orderkey) "
            "ELSE CAST(o_orderkey AS string) END AS event_id",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey * 8 + 1 AS string) END AS parsed_record_id",
            "CASE o_orderkey % 4 WHEN 0 THEN 'maintenance' WHEN 1 THEN 'other' "
            "WHEN 2 THEN 'infrastructure_failure' ELSE 'power_outage' END AS event_type",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Repair' WHEN '2-HIGH' THEN 'Ленинский РЭС' "
            "WHEN '3-MEDIUM' THEN '' ELSE o_orderpriority END AS reason",
            "'somewhere' AS location_raw",
            "'somewhere' AS location_normalized",
        )

    def impact_parsed(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_orderkey * 8 + 1 AS string) AS id",
            "CAST(o_orderkey * 8 + 1 AS string) AS raw_record_id",
            "CAST(o_custkey AS string) AS external_id",
        )

    def impact_raw(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "CAST(o_orderkey * 8 + 1 AS string) AS id",
            "CAST(o_custkey AS string) AS source_id",
            "concat('http://grid.example/item/', o_custkey) AS source_url",
            "CAST(o_orderdate AS timestamp) AS fetched_at",
        )


# --- SQL twins ----------------------------------------------------------------------

TASKS = """tasks AS (SELECT event_id AS id,
 CASE event_type WHEN 'signup' THEN 'fetch_source' WHEN 'view' THEN 'parse_content'
  WHEN 'click' THEN 'normalize_event' WHEN 'purchase' THEN 'match_offices' ELSE 'emit_event' END AS task_type,
 CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' ELSE 'done' END AS status,
 event_id % 6 AS attempt,
 CASE WHEN event_id % 7 <> 0 THEN user_id END AS source_id,
 CASE WHEN event_id % 20 = 0 THEN 'abandoned by previous pipeline process' WHEN event_id % 50 = 10 THEN NULL
  WHEN event_id % 10 = 0 THEN 'boom ' || event_id END AS error,
 CASE WHEN event_id % 10 NOT IN (1, 2) THEN CAST(round(value * 1000) AS INT) END AS duration_ms,
 ts + to_seconds(event_id % 90) AS completed_at,
 CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 2 DAY END AS next_run_at,
 CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 11 = 0 THEN 'none'
  WHEN event_id % 4 = 0 THEN 'regex_fallback' ELSE 'automaton' END END AS normalizer_path,
 ts AS created_at, ts AS updated_at, user_id FROM events)"""
SHOWN_TASKS = TASKS + (
    ", shown AS (SELECT * FROM tasks WHERE status <> 'failed' OR error IS NULL "
    "OR error <> 'abandoned by previous pipeline process')"
)
SOURCES = """sources AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
 'http://grid.example/list?r=' || s_suppkey AS url, 86400 * (1 + s_suppkey % 20) AS poll_interval_seconds,
 s_suppkey % 7 <> 3 AS is_active, s_suppkey,
 TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(s_suppkey AS INT)) AS created_at FROM supplier)"""
RAW = """raw AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS source_id,
 'http://grid.example/item/' || l_partkey AS source_url,
 l_returnflag || repeat('x', CAST(l_quantity AS INT)) AS raw_content, l_shipdate AS fetched_at FROM lineitem)"""
PLACES = """places AS (SELECT c_custkey, r_name AS r, p_name AS p FROM customer
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 JOIN part ON p_partkey = c_custkey)"""
PARSED = PLACES + """, parsed AS (SELECT o_orderkey AS k, o_custkey, lower(r) AS r, p, o_orderkey % 97 + 1 AS h,
 o_orderkey % 6 AS t, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS start_time,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 12 AS INT)) END AS end_time,
 o_orderpriority AS reason, o_orderdate AS extracted_at
 FROM orders JOIN places ON o_custkey = c_custkey)"""
OFFICES = """offices AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, lower(r_name) AS r, r_name AS region,
 p_name AS p, s_suppkey % 97 + 1 AS h, s_suppkey % 11 <> 5 AS is_active,
 CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS latitude, 'г ' || r_name AS city,
 CASE s_suppkey % 3 WHEN 0 THEN 'ул. ' || p_name || ', д. ' || (s_suppkey % 97 + 1)
  WHEN 1 THEN r_name || ' обл, г ' || r_name || ', ул ' || p_name || ', ' || (s_suppkey % 97 + 1)
  ELSE p_name || ' проспект, дом ' || (s_suppkey % 97 + 1) END AS address
 FROM supplier JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = s_suppkey)"""
OUTAGES = """outages AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS k, user_id,
 CASE WHEN event_type = 'signup' THEN 'other' ELSE 'outage' END AS type_group, ts AS start_time,
 CASE WHEN event_id % 5 <> 0 THEN ts + to_minutes(CAST(floor(value) AS INT)) END AS end_time,
 CASE WHEN event_id % 3 = 0 THEN 'r' || event_id END AS reason, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence,
 'raw-' || (event_id % 40) AS source FROM events),
 flagged AS (SELECT *, CASE WHEN start_time <= max(coalesce(end_time, start_time)) OVER (
   PARTITION BY user_id, type_group ORDER BY start_time, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM outages),
 placed AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, type_group ORDER BY start_time, k
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM flagged)"""
IMPACTS = """impacts AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
 CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS office_id, o_orderkey AS k,
 o_orderdate AS impact_start,
 CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 9 AS INT)) END AS impact_end,
 CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'P' THEN 'medium' ELSE 'unknown' END AS severity,
 CASE WHEN o_orderkey % 2 = 0 THEN 'exact_address' ELSE 'street_area' END AS match_strategy,
 CAST(o_orderkey % 100 AS DOUBLE) / 100 AS match_score,
 o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS detected_at,
 CASE WHEN o_orderkey % 10 <> 9 THEN CASE o_orderkey % 4 WHEN 0 THEN 'maintenance' WHEN 1 THEN 'other'
  WHEN 2 THEN 'infrastructure_failure' ELSE 'power_outage' END END AS event_type,
 CASE WHEN o_orderkey % 10 <> 9 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'Repair' WHEN '2-HIGH' THEN 'Ленинский РЭС'
  WHEN '3-MEDIUM' THEN '' ELSE o_orderpriority END END AS reason,
 CASE WHEN o_orderkey % 10 <> 9 AND o_orderkey % 3 <> 0 THEN o_orderkey * 8 + 1 END AS parsed_id FROM orders)"""
