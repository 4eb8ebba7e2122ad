"""Keyed, idempotent writes as pure operators: (target, incoming) -> new target.

Each is one full outer join on the key after the incoming batch has been reduced
to one row per key.  Physical replacement of the table is a separate step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmap.operators.running import earliest_per_key, latest_per_key


def upsert(
    target: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = (),
    rules: dict[str, Column] | None = None,
) -> DataFrame:
    """Full outer join on `keys`; incoming values win.

    Columns in `keep` retain the target's value where the row exists; `rules`
    gives an expression over `t.*` / `i.*` for matched rows.
    """
    rules = rules or {}
    t = target.withColumn("_t", F.lit(True)).alias("t")
    i = incoming.withColumn("_i", F.lit(True)).alias("i")
    in_t, in_i = F.col("t._t").isNotNull(), F.col("i._i").isNotNull()
    matches = F.lit(True)
    for k in keys:
        matches = matches & (F.col(f"t.{k}") == F.col(f"i.{k}"))

    def pick(c):
        if c in keys:
            return F.coalesce(f"t.{c}", f"i.{c}")
        if c not in incoming.columns:
            return F.col(f"t.{c}")
        matched = F.col(f"t.{c}") if c in keep else rules.get(c, F.col(f"i.{c}"))
        return F.when(in_t & in_i, matched).when(in_i, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}"))

    return t.join(i, matches, "full_outer").select(*[pick(c).alias(c) for c in target.columns])


def upsert_parsed(target: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """By fingerprint: payload overwritten, first id kept (also inside a batch)."""
    by = [F.col(c) for c in order]
    first = earliest_per_key(incoming.select("fingerprint", "id", *order), ["fingerprint"], by)
    last = latest_per_key(incoming, ["fingerprint"], by)
    batch = last.drop("id").join(first.select("fingerprint", "id"), "fingerprint")
    return upsert(target, batch.select(*target.columns), ["fingerprint"], keep=("id",))


def upsert_offices(target: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """By (name, city, address); only the columns present in `incoming` change."""
    keys = ["name", "city", "address"]
    valid = incoming.filter(" AND ".join(f"{k} <> ''" for k in [*keys, "region"]))
    batch = latest_per_key(valid, keys, [F.col(c) for c in order])
    return upsert(target, batch, keys, keep=("id", "created_at"))


def office_import_counts(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """received, inserted, updated, skipped; repeats inside a batch are updates."""
    keys = ["name", "city", "address"]
    ok = F.lit(True)
    for k in [*keys, "region"]:
        ok = ok & (F.coalesce(F.col(k), F.lit("")) != "")
    groups = (
        incoming.withColumn("_ok", ok)
        .groupBy(*keys)
        .agg(F.count("*").alias("_rows"), F.count_if("_ok").alias("_valid"))
    )
    known = target.select(*keys).distinct().withColumn("_known", F.lit(1))
    inserted = F.when((F.col("_valid") > 0) & F.col("_known").isNull(), 1).otherwise(0)
    totals = groups.join(known, keys, "left").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("received"),
        F.coalesce(F.sum(inserted), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum("_valid"), F.lit(0)).alias("_valid"),
    )
    return totals.select(
        "received", "inserted", (F.col("_valid") - F.col("inserted")).alias("updated"),
        (F.col("received") - F.col("_valid")).alias("skipped"),
    )


def upsert_impacts(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (office, event): times and level always; match details if not worse."""
    better = F.col("i.match_score") >= F.coalesce(F.col("t.match_score"), F.lit(0.0))
    details = ("match_strategy", "match_score", "match_explanation")
    rules = {c: F.when(better, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")) for c in details}
    return upsert(
        target, incoming, ["office_id", "event_id"], keep=("id",),
        rules={c: r for c, r in rules.items() if c in target.columns},
    )


def upsert_notifications(target: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(target, incoming, ["office_id", "event_id", "channel"], keep=("id",))


def replace_for_keys(
    target: DataFrame, incoming: DataFrame, touched: DataFrame, keys: list[str]
) -> DataFrame:
    """Delete the rows of all touched keys, then add the new ones."""
    return target.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(
        incoming.select(*target.columns)
    )


def seed_if_empty(target: DataFrame, defaults: DataFrame) -> DataFrame:
    return defaults if target.isEmpty() else target


def add_sources(sources: DataFrame, additions: DataFrame) -> DataFrame:
    """Long (event_id, source, seen_at) table plus new sightings; earliest is kept."""
    return sources.unionByName(additions).groupBy("event_id", "source").agg(
        F.min("seen_at").alias("seen_at")
    )


def rewrite_incomplete(tasks: DataFrame, status: str, reason: str, now: Column) -> DataFrame:
    """Move pending and running tasks to `status`; adds `_rewritten` for counting."""
    hit = F.col("status").isin("pending", "running")
    out = tasks.withColumn("_rewritten", hit)
    changes = {"status": F.lit(status), "error": F.lit(reason), "updated_at": now}
    if status == "pending":
        null_ts = F.lit(None).cast("timestamp")
        changes |= {
            "started_at": null_ts, "completed_at": null_ts,
            "duration_ms": F.lit(None).cast("int"), "next_run_at": now,
        }
    for c, value in changes.items():
        out = out.withColumn(c, F.when(F.col("_rewritten"), value).otherwise(F.col(c)))
    return out


def append(df: DataFrame, path: str, batch: str | int) -> bool:
    """Append-only tables: audit rows, event log, model calls, queue samples.

    Rows go to a folder of their batch, whose success marker tells that it is complete: a batch
    that is sent again adds nothing, one that broke off is written anew.  False: it was there.
    """
    from voltmap.sources.files import Files

    folder = f"{path}/batch={batch}"
    if Files(df.sparkSession, path).exists(f"{folder}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(folder)
    return True


def replace_registry(batch, offices: DataFrame, dependent: tuple[str, ...] = ("office_impacts", "notifications")) -> None:
    """All offices in place of the earlier ones; what hangs on those goes in the same commit.

    `batch` is one of a `streaming.store.Store`.  Until its commit readers see the old
    offices with their impacts and notifications, then the new ones without any.
    """
    batch.replace("offices", offices)
    for name in dependent:
        batch.clear(name)
    batch.commit()


_CSV = ("name", "city", "address", "region", "is_active", "latitude", "longitude")


def export_offices(offices: DataFrame, path: str, documents: int = 16) -> None:
    """Registry as JSON documents {"offices": [...]} and as a flat quoted CSV with header.

    A JSON document is read whole, so the registry is dealt over `documents` files.
    """
    columns = [*_CSV, *(["extra"] if "extra" in offices.columns else [])]
    dealt = offices.select(F.pmod(F.xxhash64("name", "city", "address"), F.lit(documents)).alias("part"), F.struct(*columns).alias("o"))
    whole = dealt.groupBy("part").agg(F.collect_list("o").alias("offices"))
    whole.select("part", F.to_json(F.struct("offices")).alias("value")).write.mode("overwrite").partitionBy("part").text(f"{path}/json")
    extras = [
        F.try_element_at("extra", F.lit(k)).alias(k) for k in ("source_url", "office_id") if "extra" in offices.columns
    ]
    offices.select(*_CSV, *extras).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def export_metadata(offices: DataFrame, candidate_cities: DataFrame, generated_at: Column) -> DataFrame:
    """One row about an export: cities tried, cities with offices, offices, regions."""
    regions = offices.groupBy("region").count().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "count")))).alias("regions")
    )
    return (
        offices.agg(
            F.count("*").alias("offices"), F.countDistinct("city").alias("cities_with_offices")
        )
        .join(candidate_cities.agg(F.count("*").alias("candidate_cities")))
        .join(regions)
        .withColumn("generated_at", generated_at)
    )
