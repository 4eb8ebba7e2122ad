import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voltmap.functions import rules as R
from voltmap.functions import text as X
from voltmap.operators.percentile import nearest_rank
from voltmap.operators.running import prefix_totals


def one(spark, expr, **values):
    ddl = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'timestamp' if isinstance(v, dt.datetime) else 'date' if isinstance(v, dt.date) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(expr.alias("r")).first().r


def test_percentiles(spark):
    def p(values, pct):
        df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
        rows = nearest_rank(df, ["k"], "v", {"p": pct}).collect()
        return rows[0].p if rows else None

    assert p([], 0.5) is None
    assert p([42], 0.5) == 42
    assert p(range(11), 0.5) == 5
    assert p(range(21), 0.95) == 19
    assert p([1, 5, 10], 1.0) == 10
    rng = random.Random(1)
    wide = [rng.randint(-10**7, 10**7) for _ in range(3000)] + [7] * 2000
    assert p(wide, 0.5) == sorted(wide)[round(0.5 * (len(wide) - 1))]
    assert p(wide, 0.95) == sorted(wide)[round(0.95 * (len(wide) - 1))]


def test_prefix_totals_skewed(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else f"k{i % 5}", i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(6)
    got = {(r.k, r.i): r.before for r in prefix_totals(df, ["k"], ["i"], "n", "before").collect()}
    running = {}
    for k, i, n in rows:
        assert got[(k, i)] == running.get(k, 0)
        running[k] = running.get(k, 0) + n


def test_time_rules(spark):
    day = dt.date(2026, 5, 12)
    got = one(spark, R.time_range(F.col("d"), F.col("t")), d=day, t="с 22:00 до 3:15")
    assert (got.start, got.end) == (dt.datetime(2026, 5, 12, 15), dt.datetime(2026, 5, 12, 20, 15))
    got = one(spark, R.time_range(F.col("d"), F.col("t")), d=day, t="всю ночь")
    assert (got.start, got.end) == (None, None)
    iso = R.iso_timestamp(F.col("t"), "+07:00")
    assert one(spark, iso, t="2026-05-12T10:00:00") == dt.datetime(2026, 5, 12, 3)
    assert one(spark, iso, t="2026-05-12T10:00:00+03:00") == dt.datetime(2026, 5, 12, 7)
    assert one(spark, iso, t="soon") is None
    assert one(spark, R.local_timestamp(F.lit("1.5.2026"), F.lit("9:05")), t="") == dt.datetime(2026, 5, 1, 2, 5)
    assert one(spark, R.local_timestamp(F.lit("1.5.2026"), F.lit("noon")), t="") is None


@pytest.mark.parametrize("attempt,want", [(1, 2), (2, 4), (3, 8), (10, 600)])
def test_backoff(spark, attempt, want):
    assert one(spark, R.backoff_seconds(F.col("a")), a=attempt) == want


def test_texts(spark):
    assert tuple(one(spark, R.delta(F.lit(15), F.lit(10)), t="")) == (50.0, "+50.0% vs prev", "success")
    assert tuple(one(spark, R.delta(F.lit(5), F.lit(0)), t="")) == (None, None, "neutral")
    where = X.split_locality(F.col("t"))
    assert tuple(one(spark, where, t="Томская обл, Томский р-н, деревня Нелюбино")) == (
        "Томская обл", "Томский р-н", "деревня Нелюбино"
    )
    assert tuple(one(spark, where, t="г Томск, село Тимирязевское")) == (None, None, "село Тимирязевское")
    assert tuple(one(spark, where, t="Томский р-н, деревня X")) == (None, "Томский р-н", "деревня X")
    assert tuple(one(spark, where, t="")) == (None, None, None)
    assert one(spark, X.strip_fences(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, X.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, X.format_interval(F.col("n")), n=90) == "2m"
    assert one(spark, R.record_url(F.lit("http://rosseti-tomsk.ru/a#b"), F.col("t")), t="row 42") == (
        "http://rosseti-tomsk.ru/a#row%2042"
    )
    now = dt.datetime(2026, 5, 12, 12)
    assert one(spark, X.format_relative(F.col("a"), F.lit(now)), a=now - dt.timedelta(minutes=5)) == "5m ago"
    assert one(spark, X.merge_distinct(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), t="") == [
        "a", "b", "c"
    ]


def test_reasons(spark):
    def reason(kind, text):
        return one(spark, R.reason_text(F.lit(kind), F.col("t"), F.lit(False)), t=text)

    assert reason("maintenance", "Ленинский РЭС") == "Плановое отключение электроэнергии. Участок: Ленинский РЭС"
    assert reason("infrastructure_failure", "ремонт ВЛ") == "Аварийное отключение электроэнергии: ремонт ВЛ"
    assert reason(None, None) == "Возможное влияние на работу офиса"
