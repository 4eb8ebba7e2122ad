"""Tables kept between batches, and the ingest chain on top of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voltmap.operators import upsert
from voltmap.streaming import ingest as I
from voltmap.streaming.store import Store

T0 = dt.datetime(2026, 5, 12)


def rows(spark, data, ddl="k string, v long"):
    return spark.createDataFrame(data, ddl)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_files_read_stay_bounded_and_rows_right(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3, fanout=3, levels=2)
    rng, model, read = random.Random(2), {}, []
    schema = rows(spark, []).schema
    for n in range(50):
        b = store.batch()
        assert b.number == n
        put = {f"k{rng.randrange(30)}": n for _ in range(3)}
        gone = {f"k{rng.randrange(30)}" for _ in range(2)} - set(put)
        wanted = rows(spark, [(k, 0) for k in put])
        if n:
            read.append(len(b.touched("t", wanted.select("k")).inputFiles()))
            if n % 10 == 0:
                assert pairs(b.lookup("t", wanted, schema)) == sorted((k, model[k]) for k in put if k in model)
        b.put("t", rows(spark, list(put.items())).coalesce(1), ["k"], gone=rows(spark, [(k, 0) for k in gone]))
        b.commit()
        model.update(put)
        for k in gone:
            model.pop(k, None)
    # At most fanout - 1 runs of each level in each of three buckets.
    assert max(read) <= 3 * 2 * 2 and max(read[25:]) <= max(read[:25])
    want = sorted(model.items())
    assert pairs(store.last().current("t")) == want
    # The last batch once more, from the commit before it.
    again = store.batch(49)
    again.put("t", rows(spark, list(put.items())), ["k"], gone=rows(spark, [(k, 0) for k in gone]))
    again.commit()
    assert pairs(store.last().current("t")) == want
    store.vacuum()
    assert store.commits() == [49] and pairs(store.last().current("t")) == want
    assert len(list((tmp_path / "t").glob("_run=*"))) <= 3 * 2 * 2


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    b = store.batch()
    b.put("impacts", rows(spark, [("a", 1), ("a", 2), ("b", 3)]), ["k"])
    b.append("log", rows(spark, [("x", 1)]))
    b.commit()
    broken = store.batch()
    broken.put("impacts", rows(spark, [("a", 9)]), ["k"], gone=rows(spark, [("b", 0)]))
    broken.append("log", rows(spark, [("y", 2)]))
    # No commit: a reader still sees the first batch, and so does the one that runs it again.
    last = store.last()
    assert pairs(last.current("impacts")) == [("a", 1), ("a", 2), ("b", 3)] and pairs(last.whole("log")) == [("x", 1)]
    for _ in range(2):
        b = store.batch(1)
        b.put("impacts", rows(spark, [("a", 9)]), ["k"], gone=rows(spark, [("b", 0)]))
        b.append("log", rows(spark, [("y", 2)]))
        b.commit()
        assert pairs(store.last().current("impacts")) == [("a", 9)]
        assert pairs(store.last().whole("log")) == [("x", 1), ("y", 2)]
    assert pairs(store.last().lookup("never", rows(spark, [("a", 1)]), rows(spark, []).schema)) == []


def test_a_replayed_batch_keeps_its_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = spark.range(1).select(store.batch(4).time).first()[0]
    store.files.write(f"{tmp_path}/_times/5", "2020-02-03 04:05:06+00:00")
    assert spark.range(1).select(store.batch(4).time).first()[0] == first
    assert spark.range(1).select(store.batch(5).time).first()[0] == dt.datetime(2020, 2, 3, 4, 5, 6)


def test_replace_registry_switches_all_tables_at_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), buckets=2)
    b = store.batch()
    b.replace("offices", rows(spark, [("old", 1)]))
    b.put("office_impacts", rows(spark, [("old", 5)]), ["k"])
    b.append("notifications", rows(spark, [("old", 7)]))
    b.commit()

    def seen():
        now = store.last()
        return pairs(now.whole("offices")), pairs(now.current("office_impacts")), pairs(now.whole("notifications"))

    before = seen()
    half = store.batch()
    monkeypatch.setattr(half, "clear", lambda name: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        upsert.replace_registry(half, rows(spark, [("new", 2)]))
    assert seen() == before
    upsert.replace_registry(store.batch(), rows(spark, [("new", 2)]))
    assert seen() == ([("new", 2)], [], [])


def test_append_of_a_batch_sent_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    assert upsert.append(rows(spark, [("a", 1)]), path, 1)
    assert upsert.append(rows(spark, [("b", 2)]), path, 2)
    assert not upsert.append(rows(spark, [("b", 2), ("c", 3)]), path, 2)
    (tmp_path / "log" / "batch=2" / "_SUCCESS").unlink()  # it broke off
    assert upsert.append(rows(spark, [("b", 2)]), path, 2)
    assert pairs(spark.read.parquet(path).select("k", "v")) == [("a", 1), ("b", 2)]


# --- the chain

RAW_DDL = "id string, source_id string, raw_content string, trace_id string, fetched_at timestamp"


def item(start, end=None, street="ул Мира", house="5", day="2026-05-12", city="Томск"):
    stop = f',"restoreDate":"{day}T{end}"' if end else ""
    return f'{{"city":"{city}","street":"{street}","commaSeparatedHouses":"{house}","shutdownDate":"{day}T{start}"{stop}}}'


def payload(i, *items, source="s1", at=T0):
    return (i, source, f"[{','.join(items)}]", "t", at)


def feed(spark, tmp_path, batches, sources, matched=None, run="a", **options):
    """Run the batches through `ingest`, one file each."""
    src, out = tmp_path / f"src-{run}", str(tmp_path / "out")
    for i, batch in enumerate(batches):
        if not (src / f"b{i}").exists():
            spark.createDataFrame(batch, RAW_DDL).coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(RAW_DDL).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    profiles = spark.createDataFrame(sources, "id string, parser_profile map<string,string>")
    checkpoint = str(tmp_path / f"chk-{len(list(tmp_path.glob('chk-*')))}")
    I.ingest(stream, profiles, out, F.lit(T0), match_batch=matched, buckets=2, **options).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination(600)
    return Store(spark, out).last()


def test_ingest_loses_nothing_and_is_idempotent(spark, tmp_path):
    batches = [
        [payload("r1", item("10:00:00", "11:00:00")), payload("r2", item("10:00:00"), source="nobody"),
         payload("r3", item("20:00:00"), source="muted"), payload("r5", item("16:00:00", "17:00:00")),
         ("r7", "s1", '[{"id":"1"} oops', "t", T0), ("r8", "s1", "<html>502</html>", "t", T0), ("r9", "s1", None, "t", T0)],
        # A repeated payload, and a late one that ties both outages together.
        [payload("r4", item("10:00:00", "11:00:00")), payload("r6", item("11:10:00", "15:50:00"))],
    ]
    sources = [("s1", {"parser": "format_two"}), ("muted", {"parser": "format_two", "normalization_enabled": "no"})]

    def matched(events):
        return events.select("event_id", F.col("members").alias("weight"))

    def go():
        now = feed(spark, tmp_path, batches, sources, matched)
        impacts = I.current_impacts(spark, str(tmp_path / "out"), None)
        return [df.collect() for df in (now.current("normalized_events"), now.current("event_sources"), impacts, now.whole("quarantine"))]

    events, seen, impacts, refused = go()
    assert [(e.location_normalized, e.start_time, e.end_time, e.members) for e in events] == [
        ("томск|мира|5", dt.datetime(2026, 5, 12, 3), dt.datetime(2026, 5, 12, 10), 3)
    ]
    assert {(s.event_id, s.source) for s in seen} == {(events[0].event_id, x) for x in ("r1", "r5", "r6")}
    assert [(i.event_id, i.weight) for i in impacts] == [(events[0].event_id, 3)]
    assert {(r.id, r.error) for r in refused} == {
        ("r2", "no parser registered for: "), *[(x, "malformed payload for: format_two") for x in ("r7", "r8", "r9")]
    }
    raw = {r.id for r in Store(spark, str(tmp_path / "out")).last().current("raw_records").collect()}
    assert raw >= {"r1", "r3", "r5", "r6"} and "r4" not in raw
    again = go()  # the same batches once more, from the start
    assert [sorted(map(str, x)) for x in again] == [sorted(map(str, x)) for x in (events, seen, impacts, refused)]


def test_a_reparsed_record_adds_a_source_and_normalizes_nothing(spark, tmp_path, monkeypatch):
    asked = []
    plain = I.normalize

    def counted(b, parsed):
        asked.append(sorted(r.location_street for r in parsed.select("location_street").collect()))
        return plain(b, parsed)

    monkeypatch.setattr(I, "normalize", counted)
    batches = [
        [payload("r1", item("10:00:00", "11:00:00"))],
        # The same record in another payload, with one that is new.
        [payload("r2", item("10:00:00", "11:00:00"), item("10:00:00", "11:00:00", street="ул Кирова"))],
    ]
    now = feed(spark, tmp_path, batches, [("s1", {"parser": "format_two"})])
    assert asked == [["ул Мира"], ["ул Кирова"]]
    events = {e.location_street: e for e in now.current("normalized_events").collect()}
    assert sorted(events) == ["ул Кирова", "ул Мира"] and {e.members for e in events.values()} == {1}
    seen = pairs(now.current("event_sources").select("event_id", "source"))
    assert {s for e, s in seen if e == events["ул Мира"].event_id} == {"r1", "r2"}


def test_the_budget_of_a_source_spans_payloads_and_batches(spark, tmp_path, monkeypatch):
    allowed = []

    def noted(b, parsed):
        allowed.extend((r.raw_record_id, r.pos) for r in parsed.filter("allow_fallback").select("raw_record_id", "pos").collect())
        return spark.createDataFrame([], I.EVENT_FIELDS.replace(", members long", "") + ", sources array<string>")

    monkeypatch.setattr(I, "normalize", noted)

    def some(i, n, minute, source="s1"):
        streets = [item("10:00:00", street=f"ул {i}{k}") for k in range(n)]
        return payload(i, *streets, source=source, at=T0 + dt.timedelta(minutes=minute))

    batches = [[some("p1", 2, 0), some("p2", 2, 1), some("q1", 1, 0, "s2")], [some("p3", 3, 2), some("q2", 4, 3, "s2")]]
    profiles = [(s, {"parser": "format_two"}) for s in ("s1", "s2")]
    now = feed(spark, tmp_path, batches, profiles, max_per_source=5)
    assert sorted(allowed) == [
        ("p1", 0), ("p1", 1), ("p2", 0), ("p2", 1), ("p3", 0), ("q1", 0), ("q2", 0), ("q2", 1), ("q2", 2), ("q2", 3)
    ]
    assert pairs(now.current("fallback_budget")) == [("s1", 5), ("s2", 5)]


def test_a_stored_event_that_meets_no_other_is_not_written_again(spark, tmp_path):
    batches = [
        [payload("r1", item("10:00:00", "11:00:00")), payload("r2", item("15:00:00", "16:00:00"))],
        [payload("r3", item("16:05:00", "17:00:00")), payload("r4", item("20:00:00", "21:00:00"))],
    ]
    now = feed(spark, tmp_path, batches, [("s1", {"parser": "format_two"})])
    events = {e.start_time.hour: e for e in now.current("normalized_events").collect()}
    assert {h: e.members for h, e in events.items()} == {3: 1, 8: 2, 13: 1}
    seen = pairs(now.current("event_sources").select("event_id", "source"))
    assert seen == sorted([(events[3].event_id, "r1"), (events[8].event_id, "r2"), (events[8].event_id, "r3"), (events[13].event_id, "r4")])
    second = spark.read.parquet(f"{tmp_path}/out/normalized_events/_run=3")
    assert {r.event_id for r in second.collect()} == {events[8].event_id, events[13].event_id}


def test_a_large_batch_is_written_where_its_rows_are(spark, tmp_path, monkeypatch):
    from voltmap.streaming import store as S

    monkeypatch.setattr(S, "FILE_ROWS", 1)
    store, model = Store(spark, str(tmp_path), buckets=2), {}
    for n in range(3):
        data = [(f"k{i}", i * n) for i in range(n, 40)]
        b = store.batch()
        b.put("t", rows(spark, data).repartition(3), ["k"], gone=rows(spark, [("k1", 0)]), size=40 if n else 0)
        b.commit()
        model = {k: v for k, v in (model | dict(data)).items() if k != "k1" or n == 0}
        model.pop("k1", None) if n else None
        files = len(list((tmp_path / "t" / f"_run={2 * n + 1}").glob("*/*.parquet")))
        assert files <= 2 if n == 0 else 2 < files <= 8
    assert pairs(store.last().current("t").filter("k <> 'k1'")) == sorted((k, v) for k, v in model.items() if k != "k1")
    keys, schema = rows(spark, [("k0", 0), ("k39", 0)]), rows(spark, []).schema
    assert pairs(store.last().lookup("t", keys, schema)) == [("k0", 0), ("k39", 78)]
    assert pairs(store.last().near("t", keys, schema)) == [("k0", 0), ("k39", 78)]


def test_payload_files_lie_in_one_folder(spark, tmp_path):
    import glob
    import hashlib

    from voltmap.plans.registered import QUERIES
    from voltmap.session import shared_folder

    rows = [(k, f"Supplier#{k:09d}") for k in (1, 2, 41, 42, 79)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in QUERIES["payload_files"](spark, str(tmp_path)).collect()}
    texts = [name + "." * (k % 80) for k, name in rows]
    assert got == {(len(x), hashlib.sha256(x.encode()).hexdigest(), len(x) > 60) for x in texts}
    assert not glob.glob(f"{shared_folder(spark).removeprefix('file:')}/payloads-*/*=*")
