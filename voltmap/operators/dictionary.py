"""Addresses normalized once per distinct wording, and joined back to the records that use it.

Announcements repeat the same addresses day after day.  An address is the tuple of its six
texts; the normalizers run over distinct tuples only, and over none that an earlier run has
left in the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions import address as A
from voltmap.functions import fields as P
from voltmap.session import cut, few

#: An address of more than one in so many rows is hot; there are fewer hot addresses than this.
HOT_SHARE = 1000

_TEXTS = ("location_region_code", "location_district", "location_city", "location_street")
ENTRY = "struct<automaton:{r},regex:{r},automaton_key:string,regex_key:string>".format(
    r="struct<city:string,street:string,building:string,confidence:double>"
)
#: Columns of a dictionary.
FIELDS = f"address_key string, entry {ENTRY}"


def _texts() -> dict[str, Column]:
    extra = F.col("extra")
    return {c: F.col(c) for c in _TEXTS} | {"houses": P.extra_houses(extra), "address": P.extra_address(extra)}


def address_key() -> Column:
    """Key of a record's address texts; a null and an empty text differ."""
    texts = F.struct(*[c.alias(name) for name, c in _texts().items()])
    return F.sha2(F.to_json(texts, {"ignoreNullFields": "false"}), 256)


def wordings(parsed: DataFrame) -> DataFrame:
    """Distinct addresses of records: address_key, rows, and their texts."""
    keyed = parsed.select(address_key().alias("address_key"), *[c.alias(name) for name, c in _texts().items()])
    # Rows of one key have the same texts, so any row of it will do.
    return keyed.groupBy("address_key").agg(
        F.count("*").alias("rows"), *[F.first(c).alias(c) for c in (*_TEXTS, "houses", "address")]
    )


def _by_text(rows: DataFrame, text: str, out: str, build) -> DataFrame:
    """`rows` with the column `out`, computed by `build` once per distinct value of `text`."""
    distinct = rows.select(F.col(text).alias("_text")).distinct()
    made = build(distinct).select("_text", F.struct("fields", "key").alias(out))
    return rows.join(cut(made), F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def _key_part(key: Column, i: int) -> Column:
    return F.split(F.coalesce(key, F.lit("||")), r"\|")[i]


def entries(texts: DataFrame, threshold: float = K.FALLBACK_THRESHOLD) -> DataFrame:
    """Dictionary rows of `wordings`: both normalizers' results and the keys of their addresses.

    City, street and building texts are parsed once each, however many addresses share them,
    and an address is put together from the parts.  The recovery, which looks at all texts of an
    address, runs where the automaton is missing or below `threshold`.
    """
    from voltmap.operators.normalize import (
        address_confidence, address_result, with_canonical_key, with_regex,
    )

    none, text = F.lit(None).cast("string"), F.col("_text")

    def cities(df):
        fields = P.city_automaton(F.col("_n"))
        return with_canonical_key(df.withColumn("_n", A.normalize_text("_text")).withColumn("fields", fields), text, F.lit(""), none, "key")

    def streets(df):
        fields = P.street_automaton(F.col("_n"))
        return with_canonical_key(df.withColumn("_n", A.normalize_text("_text")).withColumn("fields", fields), none, text, none, "key")

    def buildings(df):
        fields = P.building_automaton(text, F.col("_n"))
        df = df.withColumn("_n", A.normalize_text("_text")).withColumn("fields", fields)
        return with_canonical_key(df, none, F.lit(""), F.col("fields.value"), "key")

    rows = _by_text(texts, "location_city", "_city", cities)
    rows = _by_text(rows, "location_street", "_street", streets)
    rows = rows.withColumn("_source", F.coalesce("houses", "_street.fields.extra"))
    rows = _by_text(rows, "_source", "_building", buildings)
    city, street, building = (F.col(f"_{c}.fields") for c in ("city", "street", "building"))
    confidence = address_confidence(city, street, building, F.col("_source"))
    automaton = F.when(street["value"].isNotNull(), address_result(building["value"], confidence))
    number = F.when(
        F.coalesce(building["value"], F.lit("")) != "", _key_part(F.col("_building.key"), 2)
    ).otherwise(_key_part(F.col("_street.key"), 2))
    key = F.concat_ws("|", _key_part(F.col("_city.key"), 0), _key_part(F.col("_street.key"), 1), number)
    rows = cut(
        rows.select("address_key", *_TEXTS, "houses", "address", automaton.alias("automaton"), F.nullif(key, F.lit("||")).alias("_key"))
    )
    sure = F.coalesce(F.col("automaton.confidence") >= threshold, F.lit(False))
    given = F.map_filter(
        F.create_map(F.lit("houses"), F.col("houses"), F.lit(K.EXTRA_ADDRESS_KEYS[0]), F.col("address")),
        lambda _, v: v.isNotNull(),
    )
    doubtful = rows.filter(~sure).select(
        "address_key", *_TEXTS, given.alias("extra"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("start_time")
    )
    recovered = cut(with_regex(doubtful).select("address_key", "regex").filter("regex IS NOT NULL"))
    r = F.col("regex")
    recovered = with_canonical_key(recovered, r["city"], r["street"], r["building"], "regex_key")
    entry = F.struct(
        "automaton", "regex", F.when(F.col("automaton").isNotNull(), F.col("_key")).alias("automaton_key"), "regex_key"
    )
    return rows.join(recovered, "address_key", "left").select("address_key", entry.alias("entry"))


def look_up(
    parsed: DataFrame, known: DataFrame | None = None, threshold: float = K.FALLBACK_THRESHOLD,
    texts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records with the column `entry`, dictionary rows that were not known).

    Few addresses go to the records.  Among many, few rows may have one address or a third of them:
    hot addresses, at most HOT_SHARE - 1 of them, are broadcast, and their rows are spread where the
    others meet the dictionary.  `texts` are the checkpointed `wordings`, where the caller has them.
    """
    texts = cut(wordings(parsed)) if texts is None else texts
    unseen = texts if known is None else texts.join(known.select("address_key"), "address_key", "left_anti")
    fresh = cut(entries(unseen, threshold))
    every = fresh if known is None else fresh.unionByName(known.select("address_key", "entry"))
    if few(texts):
        keyed = parsed.withColumn("address_key", address_key())
        return keyed.join(F.broadcast(every), "address_key").drop("address_key"), fresh
    total = texts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = texts.filter(F.col("rows") * HOT_SHARE > total).filter(F.col("rows") > HOT_SHARE).select("address_key")
    keyed = parsed.withColumn("address_key", address_key())
    if hot.isEmpty():
        return keyed.join(every, "address_key").drop("address_key"), fresh
    hot_entries = every.join(F.broadcast(hot), "address_key", "left_semi").withColumnRenamed("entry", "_hot")
    marked = keyed.join(F.broadcast(hot_entries), "address_key", "left")
    # Rows that have their entry already go anywhere.
    spread = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("#"), F.spark_partition_id())).otherwise(F.col("address_key"))
    cold = every.join(F.broadcast(hot), "address_key", "left_anti").withColumnRenamed("address_key", "_meet")
    joined = marked.withColumn("_meet", spread).join(cold, "_meet", "left")
    return joined.withColumn("entry", F.coalesce("_hot", "entry")).drop("_hot", "_meet", "address_key"), fresh
