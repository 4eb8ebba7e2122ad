import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from voltmap.operators import dedup, match as M
from voltmap.operators.similarity import similar_pairs

NOW = dt.datetime(2026, 5, 12, 12)


def run(spark, offices, events):
    o = spark.createDataFrame(
        [(str(i), f"o{i}", c, a, "r", True) for i, (c, a) in enumerate(offices)],
        "id string, name string, city string, address string, region string, is_active boolean",
    )
    e = spark.createDataFrame(
        [(str(i), "power_outage", NOW + dt.timedelta(hours=h), NOW + dt.timedelta(hours=h2), raw, c, s, b, "t")
         for i, (c, s, b, raw, h, h2) in enumerate(events)],
        "event_id string, event_type string, start_time timestamp, end_time timestamp, location_raw string, "
        "location_city string, location_street string, location_building string, trace_id string",
    )
    rows = M.match(e, o, F.lit(NOW)).collect()
    return {(r.event_id, r.office_id): (r.match_strategy, r.match_score, r.impact_level) for r in rows}


def test_matcher(spark):
    offices = [
        ("село Бичура", "улица Кирова, 12"),
        ("Богашево", "улица Киевская, 24"),
        ("Богашево", "улица Киевская, 40"),
        ("село Бичура", "улица Гагарина, 8"),
        ("Молчаново", "Томская обл, с Молчаново, ул Димитрова, д 70А"),
        ("Новосибирск", "улица Станиславского, 24"),
    ]
    events = [
        ("село Бичура", "улица Кирова", "12", "село Бичура, улица Кирова, 12", 2, 5),
        ("Богашево", "улица Киевская 22-26, улица Ключевская 2", None, "Богашево", 2, 5),
        ("село Бичура", "улица Гагарина", None, "", 2, 5),
        ("село Молчаново", "ул Димитрова", "70А", "", 2, 5),
        ("село Лучаново", "улица Заводская", None, "Томская обл, село Лучаново, улица Заводская", 2, 5),
        ("село Бичура", "улица Кирова", "12", "", -3, -1 / 60),
        ("Новосибирск", "ул Станиславскго 22-26", None, "", 2, 5),
        (None, "улица Киевская", "24", "", 2, 5),
        ("Богашовo", "улица Киевская", "24", "", 2, 5),
    ]
    got = run(spark, offices, events)
    assert got[("0", "0")] == ("exact_address", 1.0, "high")
    assert got[("1", "1")] == ("house_range", 0.92, "high")
    assert ("1", "2") not in got
    assert got[("2", "3")][:2] == ("street_area", 0.68)
    assert got[("3", "4")][:2] == ("exact_address", 1.0)
    assert not any(k[0] in ("4", "5") for k in got)
    assert got[("6", "5")][0] == "fuzzy_house_range" and got[("6", "5")][1] >= 0.84
    assert got[("7", "1")][:2] == ("fuzzy_city_exact_address", 0.96)


def test_similar_pairs_is_complete(spark):
    rng = random.Random(7)

    def word():
        return "".join(rng.choice("абвг ") for _ in range(rng.randint(1, 14))).strip() or "а"

    base = [word() for _ in range(60)]

    def damage(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(i, rng.choice("абвг"))
            elif len(w) > 1:
                w.pop(min(i, len(w) - 1))
        return "".join(w)

    left, right = set(base), {damage(w) for w in base} | {word() for _ in range(40)}
    want = {}
    for a in left:
        for b in right:
            s = 1.0 if a == b else 0.93 if a in b or b in a else SequenceMatcher(a=a, b=b).ratio()
            if s >= 0.84:
                want[(a, b)] = s
    l = spark.createDataFrame([("x", w) for w in left], "block string, l string")
    r = spark.createDataFrame([("x", w) for w in right], "block string, r string")
    got = {(x.l, x.r): x.score for x in similar_pairs(l, r, 0.84).collect()}
    assert got == want and len(want) > 50


def test_islands_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3):
        for _ in range(200):
            s = rng.randint(0, 400_000)
            rows.append((f"k{k}", s * 1_000_000, (s + rng.randint(0, 3000)) * 1_000_000))
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = {(r.k, r.s): r.island for r in dedup.islands(df, ["k"], "s", "e", 900).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        reach, island = None, None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k):
            if reach is None or s > reach + 900 * 1_000_000:
                island, reach = s, e
            reach = max(reach, e)
            want[(k, s)] = island
    assert got == want


def test_merge(spark):
    t = dt.datetime(2026, 5, 12)
    h = lambda x: t + dt.timedelta(hours=x)
    rows = [
        ("e1", "p1", "power_outage", h(3), h(9), "raw", "k|s|1", None, ["a", "b"], 0.9, h(0)),
        ("e2", "p2", "maintenance", h(8.8), h(12), "raw", "k|s|1", "why", ["b", "c"], 0.2, h(1)),
        ("e3", "p3", "other", h(4), None, "raw", "k|s|1", None, ["d"], 0.5, h(2)),
        ("e4", "p4", "power_outage", h(12.25), None, "raw", "k|s|1", None, ["e"], 0.1, h(3)),
        ("e5", "p5", "power_outage", h(12.6), h(13), "raw", "k|s|1", None, ["f"], 0.1, h(4)),
    ]
    df = spark.createDataFrame(
        rows,
        "event_id string, parsed_record_id string, event_type string, start_time timestamp, end_time timestamp,"
        "location_raw string, location_normalized string, reason string, sources array<string>, confidence double,"
        "normalized_at timestamp",
    ).selectExpr("*", "'' as location_city", "'' as location_street", "'' as location_building", "'t' as trace_id")
    merged, sources, audit = dedup.deduplicate(df)
    m = {r.event_id: r for r in merged.collect()}
    assert set(m) == {"e1", "e3", "e5"}
    assert (m["e1"].start_time, m["e1"].end_time) == (h(3), h(12))
    assert m["e1"].event_type == "power_outage" and m["e1"].reason == "why" and m["e1"].confidence == 0.9
    assert {(r.event_id, r.source) for r in sources.collect()} >= {("e1", x) for x in "abce"}
    assert {(r.incoming_event_id, r.strategy) for r in audit.collect()} == {
        ("e2", "overlap_window"), ("e4", "overlap_window")
    }


def test_similar_names_need_few_ratios(spark):
    import random

    from voltmap.operators import similarity

    rng = random.Random(4)
    parts = ["лес", "сад", "зар", "кам", "нов", "бел", "мир", "гор", "реч", "пол", "ная", "ова", "ский", "ное", "еч", "ин"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(300)]
    typos = [n[: len(n) // 2] + rng.choice("абвг") + n[len(n) // 2 + 1 :] for n in names[:100]]
    left = spark.createDataFrame([("", n) for n in set(names)], "block string, l string")
    right = spark.createDataFrame([("", n) for n in set(names + typos)], "block string, r string")
    got = {(r.l, r.r): r.score for r in similarity.similar_pairs(left, right, 0.84).collect()}

    def ratio(a, b):
        from difflib import SequenceMatcher

        if a == b:
            return 1.0
        return 0.93 if a in b or b in a else SequenceMatcher(a=a, b=b).ratio()

    want = {
        (a, b): ratio(a, b) for a in set(names) for b in set(names + typos) if ratio(a, b) >= 0.84
    }
    assert got == want
    candidates = similarity.fuzzy_candidates(left, right, 0.84).count()
    assert candidates <= len(set(names)) * len(set(names + typos)) * 0.02


def test_exploded_keys_of_similar_names_are_not_broadcast(spark):
    from voltmap.operators import similarity

    names = spark.range(50).select(F.lit("").alias("block"), F.md5(F.col("id").cast("string")).alias("l"))
    found = similarity.fuzzy_candidates(names, names.withColumnRenamed("l", "r"), 0.84)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0


def test_texts_of_similar_names_seldom_meet_by_chance(spark):
    from voltmap.operators import similarity

    def hashes(low, name):
        rows = spark.range(low, low + 400).select(F.lit("").alias("block"), F.md5(F.col("id").cast("string")).alias(name))
        return rows.withColumn("bits", F.lit(0).cast("long"))

    left, right = hashes(0, "l"), hashes(1000, "r")
    l_keys = similarity._segments(similarity._partners(left, "l", right, "r", 0.84), "l", 0.84)
    r_keys = similarity._substrings(similarity._partners(right, "r", left, "l", 0.84), "r", 0.84)
    assert l_keys.join(r_keys, "meet").count() <= 400 * 400 * 0.0005
    assert l_keys.count() + r_keys.count() <= 800 * 150


def test_similar_names_are_found_with_as_many_edits_as_may_be(spark):
    from difflib import SequenceMatcher

    from voltmap.operators import similarity

    rng, rows = random.Random(9), []
    for cutoff, letters, size in ((0.84, "0123456789abcdef", 32), (0.88, "абвгдежзик😀", 17), (0.95, "acgt", 90), (0.6, "xyz", 9)):
        for i in range(60):
            a = "".join(rng.choice(letters) for _ in range(size - i % 3))
            k = int(len(a) * (1 - cutoff))
            kept = [c for j, c in enumerate(a) if j not in set(rng.sample(range(len(a)), k))]
            # Other characters together, at the ends, or anywhere.
            spot = rng.randrange(len(kept) + 1)
            for j in range(k - i % 2):
                kept.insert((spot, rng.randrange(len(kept) + 1), 0, len(kept))[i % 4], rng.choice(letters + "zw"))
            rows.append((cutoff, f"{cutoff} {i % 7}", a, "".join(kept)))
    for cutoff in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == cutoff]
        left = spark.createDataFrame([r[1:3] for r in own], "block string, l string")
        right = spark.createDataFrame([(r[1], r[3]) for r in own], "block string, r string")
        got = {(r.block, r.l, r.r): r.score for r in similarity.similar_pairs(left, right, cutoff).collect() if r.score not in (0.93, 1.0)}
        want = {}
        for _, block, a, _ in own:
            for _, other, _, b in own:
                score = SequenceMatcher(a=a, b=b).ratio()
                if block == other and a not in b and b not in a and score >= cutoff:
                    want[(block, a, b)] = score
        assert got == want and want


def test_islands_in_one_pass_are_those_of_units(spark, monkeypatch):
    rng, rows = random.Random(7), []
    for i in range(300):
        start = None if i % 50 == 49 else dt.datetime(2026, 5, 1) + dt.timedelta(minutes=rng.randrange(6000))
        end = None if start is None or i % 7 == 0 else start + dt.timedelta(minutes=rng.randrange(90))
        # A record of three events at two addresses, one event that comes twice, one without any key.
        record = "shared" if i in (3, 80, 81) else None if i % 40 == 11 else f"p{i}"
        event = None if i == 51 else "e100" if i == 101 else f"e{i}"
        place = None if i % 30 == 29 or i == 51 else f"a{min(rng.randrange(12), 8)}"
        rows.append((event, record, start, end, "power_outage" if i % 9 else None, place, dt.datetime(2026, 5, 1) + dt.timedelta(seconds=i)))
    events = spark.createDataFrame(
        rows, "event_id string, parsed_record_id string, start_time timestamp, end_time timestamp, event_type string, "
        "location_normalized string, normalized_at timestamp"
    ).withColumn("location_raw", F.lit(None).cast("string"))
    want = ["event_id", "parsed_record_id", "start_time", "normalized_at", "group_key", "type_group", "island"]
    keyed = events.withColumns(
        {"unit": dedup.record_unit(), "start_us": F.unix_micros("start_time"), "end_us": F.unix_micros(F.coalesce("end_time", "start_time"))}
    )
    plain = sorted(map(str, dedup._by_units(keyed).select(*want).collect()))
    for most in (100_000, 40, 5):
        monkeypatch.setattr(dedup, "HOT_ROWS", most)
        placed = dedup.with_island(events).cache()
        assert sorted(map(str, placed.select(*want).collect())) == plain
        shared = placed.groupBy("group_key", "type_group", "island").agg(F.count("*").alias("n"), F.bool_or("alone").alias("a"))
        assert shared.filter("a AND n > 1").isEmpty()
        assert (placed.filter("alone").count() > 0) == (most > 5) or most == 5
        placed.unpersist()
