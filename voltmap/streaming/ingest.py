"""The whole chain per micro-batch, from raw payloads to impacts, over a store of keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltmap.functions.hashing import content_hash, parsed_fingerprint
from voltmap.operators import dedup, dictionary
from voltmap.operators.normalize import budget_spent, fallback_gates, from_entries, normalization_on
from voltmap.session import cut, nothing
from voltmap.sources import payloads
from voltmap.streaming.store import BUCKETS, Batch, Store

EVENT_FIELDS = (
    "event_id string, parsed_record_id string, start_time timestamp, end_time timestamp, event_type string, "
    "location_raw string, location_normalized string, location_city string, location_street string, "
    "location_building string, confidence double, reason string, trace_id string, normalized_at timestamp, members long"
)
SOURCE_FIELDS = "event_id string, source string, seen_at timestamp"


def _schema(spark: SparkSession, fields: str) -> StructType:
    return spark.createDataFrame([], fields).schema


def store_payloads(b: Batch, arrived: DataFrame) -> DataFrame:
    """The arrived payloads whose content is not stored yet, now stored."""
    hashed = arrived.withColumn("content_hash", F.coalesce(content_hash("raw_content"), F.lit("")))
    stored = b.near("raw_records", hashed.select("content_hash"), hashed.select("content_hash").schema)
    return b.put("raw_records", dedup.new_payloads(hashed, stored), ["content_hash"], size=arrived.count())


def store_records(b: Batch, parsed: DataFrame) -> DataFrame:
    """Parsed records upserted by fingerprint: the newest content under the first id."""
    keyed = parsed.withColumn("fingerprint", parsed_fingerprint())
    rest = [c for c in keyed.columns if c != "fingerprint"]
    first = F.struct("extracted_at", "raw_record_id", "pos")
    known = b.near("parsed_records", keyed.select("fingerprint"), keyed.schema)
    # The stored ids meet the records in the aggregation, so rows move once.
    met = keyed.select("fingerprint", "id", F.struct(*rest).alias("r"), first.alias("first")).unionByName(
        known.select("fingerprint", F.col("id").alias("known_id")), allowMissingColumns=True
    )
    newest = met.groupBy("fingerprint").agg(
        F.max_by("r", "first").alias("r"), F.coalesce(F.max("known_id"), F.min_by("id", "first")).alias("id")
    )
    own = {"fingerprint": F.col("fingerprint"), "id": F.col("id")}
    rows = newest.filter("r IS NOT NULL").select(*[own.get(c, F.col(f"r.{c}").alias(c)) for c in keyed.columns])
    return b.put("parsed_records", rows, ["fingerprint"], size=parsed.count())


def gate(b: Batch, records: DataFrame, max_per_raw: int | None, max_per_source: int | None) -> DataFrame:
    """Records with `allow_fallback`; what they take of a source's budget counts for all later batches."""
    if max_per_source is None:
        return fallback_gates(records, ["extracted_at"], max_per_raw=max_per_raw)
    # A source without an id has a budget of its own.
    named = records.withColumn("source_id", F.coalesce("source_id", F.lit("")))
    used = cut(b.lookup("fallback_budget", named.select("source_id"), _schema(records.sparkSession, "source_id string, used long")))
    gated = cut(fallback_gates(named, ["extracted_at"], max_per_raw=max_per_raw, max_per_source=max_per_source, used=used))
    b.put("fallback_budget", budget_spent(gated, used), ["source_id"])
    return gated


def split_known(b: Batch, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without a stored event, sources that those with one add to it).

    A record that has an event is not normalized again: its event stays as it is and gets the
    payload as one more source.
    """
    spark = records.sparkSession
    wanted = records.select(F.col("id").alias("parsed_record_id"))
    fields = _schema(spark, "parsed_record_id string, event_id string")
    known = cut(b.near("record_events", wanted, fields).join(wanted, "parsed_record_id", "left_semi"))
    if known.isEmpty():
        return records, nothing(spark, _schema(spark, SOURCE_FIELDS))
    seen = records.join(
        known.withColumnRenamed("parsed_record_id", "_record"), F.col("id") == F.col("_record"), "left"
    ).drop("_record")
    seen = cut(seen)
    sticky = seen.filter("event_id IS NOT NULL").select(
        "event_id", F.col("raw_record_id").alias("source"), F.col("extracted_at").alias("seen_at")
    )
    return seen.filter("event_id IS NULL").drop("event_id"), sticky


def normalize(b: Batch, records: DataFrame) -> DataFrame:
    """Events of records; an address that any batch has seen is looked up, not normalized again."""
    texts = cut(dictionary.wordings(records))
    known = cut(b.lookup("addresses", texts.select("address_key"), _schema(records.sparkSession, dictionary.FIELDS)))
    found, fresh = dictionary.look_up(records, known, texts=texts)
    b.put("addresses", fresh, ["address_key"])
    return cut(from_entries(found, F.col("allow_fallback")).drop("normalizer_path"))


def store_events(b: Batch, incoming: DataFrame, sticky: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge incoming events into the stored ones of their addresses: (events now, ids no more).

    Events lie by address, so a batch reads the buckets of its own addresses only.
    """
    spark = incoming.sparkSession
    fields = _schema(spark, EVENT_FIELDS)
    placed = StructType([*fields.fields]).add("place", "string")
    hit = cut(b.lookup("normalized_events", incoming.select(dedup.address_group().alias("place")), placed))
    located = dedup.place_touched(hit.drop("place"), incoming)
    # A stored event that meets no other stays as it lies.
    still = F.col("stored") & F.col("alone")
    changed = located.filter(~still)
    was = cut(changed.filter("stored").select("event_id", "parsed_record_id", dedup.address_group().alias("place")))
    about = was.select("event_id").unionByName(sticky.select("event_id")).distinct()
    seen = cut(b.lookup("event_sources", about, _schema(spark, SOURCE_FIELDS)))
    merged, sources, audit = dedup.merge_placed(changed, seen.unionByName(sticky))
    out = merged.select(*fields.names, dedup.address_group().alias("place"))
    # Stored events that change share an island, and so do those that they go into.
    ids = merged.filter("NOT alone").select("event_id", "parsed_record_id", dedup.address_group().alias("place"))
    moved, size = was.join(ids, ["place", "event_id"], "left_anti"), out.count()
    b.put("normalized_events", out, ["place", "event_id"], ["place"], gone=moved, size=size)
    lost = was.join(ids, "event_id", "left_anti").select("event_id")
    gone = seen.join(lost, "event_id", "left_semi")
    b.put("event_sources", sources, ["event_id", "source"], ["event_id"], gone=gone, size=size)
    owners = ["parsed_record_id", "event_id"]
    had, now = (df.select(*owners).filter("parsed_record_id IS NOT NULL") for df in (was, out))
    kept = ids.select(*owners).filter("parsed_record_id IS NOT NULL")
    b.put("record_events", now, owners, ["parsed_record_id"], gone=had.join(kept, owners, "left_anti"), size=size)
    b.append("dedup_audit", audit)
    return out.drop("place").unionByName(located.filter(still).select(*fields.names)), lost


def step(
    b: Batch, batch: DataFrame, sources: DataFrame, now: Column,
    match_batch: Callable[[DataFrame], DataFrame] | None = None, enabled: bool = True,
    max_per_raw: int | None = None, max_per_source: int | None = None,
) -> None:
    """One batch of raw payloads through the whole chain, and its commit (see `ingest`)."""
    fresh = store_payloads(b, cut(batch))
    parsed, refused = payloads.split(cut(payloads.dispatch(payloads.with_profile(fresh, sources), now)))
    b.append("quarantine", refused)
    records = store_records(b, parsed)
    gated = gate(b, records.filter(normalization_on(enabled)), max_per_raw, max_per_source)
    new, sticky = split_known(b, gated)
    events, gone = store_events(b, normalize(b, new), sticky)
    if match_batch is not None:
        impacts = match_batch(events)
        touched = events.select("event_id").unionByName(gone)
        b.put("office_impacts", impacts, ["event_id"], gone=touched.join(impacts, "event_id", "left_anti"))
    b.commit()


def ingest(
    raw: DataFrame, sources: DataFrame, path: str, as_of: Column | None = None, buckets: int = BUCKETS, **options
):
    """Writer for the whole chain per micro-batch; no row is dropped for being late.

    New payloads (by content, against the stored ones) are parsed, malformed ones and those of
    unknown formats are quarantined; parsed records are upserted by fingerprint; records of
    sources that normalize (`normalization_enabled`, and `enabled` for all) pass the fallback
    gates, whose budget per source runs on over all batches; records that have a stored event only
    add their payload to its sources, the rest is normalized and merged into the stored events of
    the addresses it touches; impacts of touched events are replaced (`current_impacts` reads
    them).  All tables of a batch are committed together.  A replayed batch starts from the commit
    before it and keeps its first time (`as_of`, unless given), so it leaves the same rows.
    New tables get `buckets` buckets: as many as keep a bucket at the size of a few files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        b = Store(batch.sparkSession, path, buckets).batch(batch_id)
        step(b, batch, sources, b.time if as_of is None else as_of, **options)

    return raw.writeStream.foreachBatch(write)


def current_impacts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Impacts as of the last batch that touched their event."""
    return Store(spark, path).last().current("office_impacts", schema)
