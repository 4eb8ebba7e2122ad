import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltmap import schemas
from voltmap.functions import fields as P
from voltmap.operators import normalize as N

T0 = dt.datetime(2026, 5, 15, 3)


def record(i, **kw):
    base = dict(
        id=str(i), raw_record_id=f"r{i}", source_id="s", external_id=None, start_time=T0,
        end_time=None, location_city="Томск", location_district=None, location_street="улица Кирова",
        location_region_code=None, reason=None, extra={"houses": "12"}, trace_id="t", extracted_at=T0,
    )
    base.update(kw)
    return tuple(base[f.name] for f in schemas.schema("parsed_records"))


def frame(spark, *records):
    return spark.createDataFrame(list(records), schemas.schema("parsed_records"))


def one(spark, value, expr):
    return tuple(spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first().r)


@pytest.mark.parametrize(
    "value,want", [("г. Томск", ("томск", None, 1.0)), (None, (None, None, 0.0))]
)
def test_city(spark, value, want):
    assert one(spark, value, P.parse_city("v")) == want


def test_city_glued(spark):
    assert one(spark, "Томская область Томский район Томск", P.parse_city("v"))[2] < 1.0


@pytest.mark.parametrize(
    "value,want",
    [
        ("улица Кирова, 12", ("кирова", "12", 1.0)),
        (None, (None, None, 0.0)),
        ("ул Набережная", ("набережная", None, 1.0)),
        ("ул Ленина 5 корпус 2", ("ленина", "5 2", 1.0)),
        ("12 ул Мира", ("мира", None, 0.85)),
        ("ул Мира 5 север", ("мира", "5", 0.85)),
    ],
)
def test_street(spark, value, want):
    assert one(spark, value, P.parse_street("v")) == want


@pytest.mark.parametrize(
    "value,want",
    [("б/н", (None, 1.0)), ("дом 12", ("12", 1.0)), ("22-26", ("22-26", 1.0)), (None, (None, 1.0)),
     ("север", (None, 0.0)), ("12 север", ("12", 0.8))],
)
def test_building(spark, value, want):
    got = one(spark, value, P.parse_building(F.col("v")))
    assert (got[0], got[2]) == want


def test_automaton(spark):
    df = frame(
        spark, record(1), record(2, location_street=None), record(3, start_time=None),
        record(4, location_city=None),
    )
    rows = {r.id: r.automaton for r in N.with_automaton(df).collect()}
    assert rows["1"].confidence == 1.0
    assert rows["2"] is None and rows["3"] is None
    assert rows["4"].confidence == 0.0
    events = N.to_events(N.with_automaton(df), "automaton").collect()
    assert {e.parsed_record_id: e.location_normalized for e in events}["1"] == "томск|кирова|12"


def test_regex(spark):
    glued = record(
        1, location_city="Красноярский край, Краснотуранский р-н, с Лебяжье",
        location_street="ул Ленина, д 13", extra={},
    )
    from_extra = record(
        2, location_city=None, location_street=None, extra={"address": "Томск, ул Учебная, д 3"}
    )
    road = record(3, location_city=None, location_street="автодорога км 12", extra={})
    rows = {r.id: r.regex for r in N.with_regex(frame(spark, glued, from_extra, road)).collect()}
    assert rows["1"][:3] == ("Лебяжье", "ул Ленина", "13")
    assert rows["1"].confidence == 0.95
    assert rows["2"][:3] == ("Томск", "ул Учебная", "3")
    assert rows["2"].confidence == 0.92
    assert rows["3"] is None


def test_fallback(spark):
    df = frame(
        spark, record(1),
        record(2, location_city=None, location_street=None, extra={"address": "Томск, ул Учебная, д 3"}),
        record(3, location_city=None, location_street=None, extra={}),
        record(4, location_city=None, extra={}, location_street="км 12 трассы"),
    )
    rows = {r.id: r for r in N.with_fallback(df).collect()}
    assert rows["1"].normalizer_path == "automaton"
    assert rows["2"].normalizer_path == "regex_fallback"
    assert rows["3"].normalizer_path == "none" and rows["3"].result is None
    assert rows["4"].normalizer_path == "automaton"
    keys = {e.parsed_record_id: e.location_normalized for e in N.normalize(df).collect()}
    assert keys["2"] == "томск|учебная|3"


def test_gates(spark):
    df = frame(spark, *[record(i, raw_record_id=f"r{i // 3}") for i in range(9)]).withColumns(
        {"pos": F.col("id").cast("int") % 3, "parser_profile": F.create_map().cast("map<string,string>")}
    )
    out = N.fallback_gates(df, ["extracted_at"], max_per_raw=2, max_per_source=3)
    got = {r.id for r in out.filter("allow_fallback").collect()}
    assert got == {"0", "1", "3"}


def test_the_dictionary_gives_what_the_rules_give_row_by_row(spark):
    cities = ["г. Томск", "Томск", None, "", "  ", "Томская область Томский район Томск", "деревня Лоскутово", "12"]
    streets = ["улица Кирова, 12", "Кирова", None, "", "ул Ленина 5 корпус 2", "12 ул Мира", "пер. Ёлочный 22-26", "5", "ул", "Мира, 7а", "Иркутский тракт 44/1 стр 2"]
    extras = [{}, {"houses": "5, 7"}, {"houses": ""}, {"houses": "б/н"}, {"address": "г Томск, ул Мира, д 5"}, {"houses": "9", "address": "Кирова, 3"}]
    rows = [
        record(i, location_city=c, location_street=s, extra=e, start_time=T0 if i % 9 else None, location_district=None if i % 2 else "Томский район")
        for i, (c, s, e) in enumerate((c, s, e) for c in cities for s in streets for e in extras)
    ]
    parsed = frame(spark, *rows, *rows[:40])
    columns = ["event_id", "location_normalized", "location_city", "location_street", "location_building", "confidence", "normalizer_path"]
    for allow in (None, F.length("id") < 3):
        want = N.to_events(N.with_fallback(parsed, allow_fallback=allow), extra=("normalizer_path",)).select(*columns)
        got = N.normalize(parsed, allow_fallback=allow).select(*columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    want = N.to_events(N.with_automaton(parsed), "automaton").select(*columns[:-1])
    assert sorted(map(str, N.normalize_by_automaton(parsed).select(*columns[:-1]).collect())) == sorted(map(str, want.collect()))


def test_hot_addresses_and_known_ones_are_looked_up(spark, monkeypatch):
    from voltmap.operators import dictionary as D

    monkeypatch.setattr(D, "HOT_SHARE", 5)
    rows = [record(i, location_street=f"улица Кирова, {i % 7}" if i % 3 else "улица Мира, 1") for i in range(60)]
    parsed = frame(spark, *rows)
    first, fresh = D.look_up(parsed.filter("id < 30"))
    assert fresh.count() == 8 and first.count() == 30
    every, more = D.look_up(parsed, fresh)
    assert more.count() == 0 and every.count() == 60
    got = {r.id: r.key for r in every.select("id", F.col("entry.automaton_key").alias("key")).collect()}
    assert all(got[str(i)] == ("томск|мира|12" if i % 3 == 0 else "томск|кирова|12") for i in range(60))


def test_abbreviations_are_searched_only_where_their_letters_stand(spark):
    from voltmap import constants as K
    from voltmap.functions import address as A

    texts = ["ул. Мира", "пр-кт Ленина, д. 5", "almond antique", "", None, "р-н б-р пгт", "г Омск 7к", "ШОССЕ Ёлка №3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")

    def searched(c):
        t = F.replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё№", "е "), F.lit("ß"), F.lit("ss"))
        for pattern, full in K.ABBREVIATIONS:
            t = F.regexp_replace(t, A.whole_word(pattern), f" {full} ")
        return F.trim(F.regexp_replace(t, K.NON_ADDRESS_CHARS, " "))

    made = rows.select(A.normalize_text("t").alias("a"), searched(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in made.collect())
    plan = rows.select(A.normalize_text("t"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(") >= len(K.ABBREVIATIONS)


def test_records_out_of_the_window_are_not_taken_apart(spark, monkeypatch):
    from voltmap.sources import payloads

    split_up, record, day = payloads.PARSERS["format_three"]

    def strict(rows, mine, out):
        far = F.col("_element.html").contains("01.01.2030")
        checked = F.when(far, F.raise_error(F.lit("taken apart")).cast("string"))
        return record(rows.withColumn("id", F.coalesce(checked, "id")), mine, out)

    monkeypatch.setitem(payloads.PARSERS, "format_three", (split_up, strict, day))
    page = '<table class="shuthown_table"><tr><td id="{d}"><p class="t3">{d}</p><p class="t2">ул Мира</p></td></tr></table>'
    rows = [(d, "s", page.format(d=d), "t", None, {"date_filter_days": "9"}) for d in ("02.06.1998", "01.01.2030")]
    raw = spark.createDataFrame(
        rows, "id string, source_id string, raw_content string, trace_id string, fetched_at timestamp, parser_profile map<string,string>"
    )
    got = payloads.parse_format_three(raw, F.lit("1998-06-01").cast("timestamp")).collect()
    assert [(r.external_id, r.location_street) for r in got] == [("02.06.1998", "ул Мира")]


def test_documents_of_cases_are_bounded(spark, tmp_path, monkeypatch):
    import os

    from voltmap.plans import bindings, stored
    from voltmap.session import shared_folder

    tables = {
        "region": "SELECT 0 AS r_regionkey, 'ASIA' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey",
        "customer": "SELECT id AS c_custkey, 0 AS c_nationkey FROM range(50)",
        "part": "SELECT id AS p_partkey, concat('plum ', id) AS p_name FROM range(50)",
        "orders": "SELECT id AS o_orderkey, id % 50 AS o_custkey, timestamp'1996-01-02' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(4000)",
    }
    for name, rows in tables.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(stored, "CASES", 20, raising=False)
    folder = shared_folder(spark).removeprefix("file:")
    known = set(os.listdir(folder))
    read = stored._cases(bindings.Tables(spark, str(tmp_path)))
    (path,) = [f"{folder}/{x}" for x in set(os.listdir(folder)) - known if x.startswith("cases-")]
    sizes = [r[0] for r in spark.read.option("wholetext", True).text(path).select(F.json_array_length("value")).collect()]
    assert sum(sizes) == read.count() == read.select("name").distinct().count() == 4000
    assert len(sizes) > 150 and max(sizes) <= 60
