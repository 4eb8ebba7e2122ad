import pytest
from pyspark.sql import functions as F

from voltmap.functions import address as A
from voltmap.operators.normalize import with_canonical_key

KEYS = [
    ("Новокузнецк", "ул. Кирова", "55", "новокузнецк|кирова|55"),
    ("Новокузнецк", "улица Кирова", "55", "новокузнецк|кирова|55"),
    ("Новокузнецк", "ул Кирова", "д. 55", "новокузнецк|кирова|55"),
    ("Кемерово", "пр-т Ленина", "90", "кемерово|ленина|90"),
    ("г. Кемерово", "проспект Ленина", "90", "кемерово|ленина|90"),
    ("город Кемерово", "пр. Ленина", "90", "кемерово|ленина|90"),
    ("Томск", "пр. Ленина 120", None, "томск|ленина|120"),
    ("Томск", "пр. Ленина 120", "", "томск|ленина|120"),
    ("Томск", "Весенняя", "б/н", "томск|весенняя|"),
    ("Томск", "Весенняя", "без номера", "томск|весенняя|"),
    ("Томск", "Весенняя", None, "томск|весенняя|"),
    (None, None, None, None),
    ("", "", "", None),
    ("Берёзовский", "улица Школьная", "17", "березовский|школьная|17"),
    ("Березовский", "улица Школьная", "17", "березовский|школьная|17"),
    ("Кемерово", "ул Ленина", "10-14", "кемерово|ленина|10"),
]


def test_canonical_key(spark):
    df = spark.createDataFrame(KEYS, "c string, s string, b string, want string")
    rows = with_canonical_key(df, F.col("c"), F.col("s"), F.col("b"), "got").select("want", "got").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "value,want",
    [
        ("улица Кирова, 55", ("улица Кирова", "55")),
        ("улица без номера", ("улица без номера", None)),
        ("пр. Ленина 120", ("пр. Ленина", "120")),
        ("ул Мира 12/34", ("ул Мира", "12/34")),
        ("12", ("12", "12")),
        ("Кирова, д. 3; 5", ("Кирова, д. 3", "5")),
    ],
)
def test_split_address(spark, value, want):
    assert tuple(one(spark, value, A.split_address("v"))) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ("проспект Ленина 90", "ленина"),
        ("Красный проспект", "красный"),
        ("ул Набережная", "набережная"),
        ("площадь", "площадь"),
        ("ул 9 мая", "9 мая"),
        ("ул Ленина 5 7а", "ленина"),
        ("12", "12"),
        ("", ""),
        (None, ""),
    ],
)
def test_street(spark, value, want):
    assert one(spark, value, A.normalize_street("v")) == want


def test_parts(spark):
    assert one(spark, "село Бичура", A.normalize_city("v")) == "бичура"
    assert one(spark, "д. 70А", A.normalize_building("v")) == "70а"
    assert one(spark, "УЛ.КИРОВА №5", A.normalize_text("v")) == "улица кирова 5"
    assert one(spark, "б-р Мира, р-н Центр, прт Ленина", A.normalize_text("v")) == (
        "бульвар мира район центр проспект ленина"
    )
    assert [tuple(r) for r in one(spark, "ул 26-22, 7", A.house_ranges("v"))] == [(22, 26), (7, 7)]


def test_office_address(spark):
    got = one(spark, "Томская обл, с Молчаново, ул Димитрова, д 70А", A.split_office_address("v"))
    assert tuple(got) == ("ул Димитрова", "д 70А")
