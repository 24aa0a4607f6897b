import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalars, text, vectors


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c")).alias("x")).collect()]


PARTIAL = {
    "20250326": ("20250326", "day", dt.date(2025, 3, 26)), " 200906\t": ("200906", "month", None), "2009": ("2009", "year", None), "": (None, None, None), "   ": (None, None, None), None: (None, None, None),
    **{x: (x, "invalid", None) for x in ("00000000", "20250231", "20251301", "209913", "18990101", "202", "2025-03-26", "notadate", "2025²", "21010101", "202500")},
}


def test_partial_dates(spark):
    got = values(spark, lambda c: F.struct(*[x.alias(str(i)) for i, x in enumerate(scalars.partial_date(c))]), list(PARTIAL))
    assert [tuple(r) for r in got] == list(PARTIAL.values())


@pytest.mark.parametrize(
    ("column", "rows", "expected"),
    [
        (scalars.iso_date, ["2024-02-29", " 2024-02-29T10:00:00 ", "2024-02-30", "20240229", "", None], [dt.date(2024, 2, 29), dt.date(2024, 2, 29), None, None, None, None]),
        (scalars.iso_timestamp, ["2024-01-01 10:00:00", "2024-01-01T10:00:00+02:00", "x", None], [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 8), None, None]),
        (scalars.integer, ["12", " 12 ", "12.7", "-12.7", "1e3", "inf", "nan", "²", "", "x", None], [12, 12, 12, -12, 1000, None, None, None, None, None, None]),
        (scalars.number, ["1.5", "1e2", "x", "", None], [1.5, 100.0, None, None, None]),
        (scalars.boolean, ["T", "yes", "1", "F", "No", "0", "maybe", "", None], [True, True, True, False, False, False, None, None, None]),
        (scalars.compact_day, ["20210902", "2021-09-02", "20211332", "", None], [dt.datetime(2021, 9, 2), None, None, None, None]),
        (scalars.day_or_month, ["2021-09-02", "2021-09", "2021", "x", None], [dt.datetime(2021, 9, 2), dt.datetime(2021, 9, 1), None, None, None]),
        (scalars.redact_secret, ["http://a/?api_key=abc&x=1", "http://a/?x=1&token=q#f", None], ["http://a/?api_key=***&x=1", "http://a/?x=1&token=***#f", None]),
        (lambda c: scalars.excerpt(c, "WARNINGS", 0, 12), ["a  b\n warnings: do not", "none", None], ["warnings: do", "none", None]),
        (scalars.clean_field, [" a ", "\t", " x ", None], ["a", None, "x", None]),
    ],
)
def test_scalars(spark, column, rows, expected):
    got = values(spark, column, rows)
    assert [None if isinstance(x, float) and math.isnan(x) else x for x in got] == expected


def test_arrays_ages_and_ratios(spark):
    df = spark.sql("SELECT array('a', ' b ', null, '') AS x, CAST(null AS array<string>) AS y, array('c') AS z")
    assert df.select(scalars.join_texts(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "a b c"
    assert df.select(scalars.first_text(F.col("y"))).first()[0] == ""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ages = values(spark, lambda c: scalars.age_of(c.cast("timestamp"), now), [None, "2024-01-11", "2024-01-09 23:59:59", "2024-01-09 23:00:01", "2024-01-09 20:00:00", "2024-01-05"])
    assert ages == ["never", "just now", "0m ago", "59m ago", "4h ago", "5d ago"]
    row = spark.sql("SELECT 1.0D a, 0.0D b, 2.5D c").select(scalars.safe_ratio(F.col("a"), F.col("b"), 1.0), scalars.half_up(F.col("c"))).first()
    assert tuple(row) == (1.0, 3)
    flags = spark.sql("SELECT '1' a, '2' b, null c").select(scalars.set_flags({"x": F.col("a"), "y": F.col("b"), "z": F.col("c")})).first()[0]
    assert flags == ["x"]


STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}


def test_porter_on_published_examples():
    assert {w: text.porter(w) for w in STEMS} == STEMS


def test_query_language(spark):
    rows = ["liver cancer trial", "cancer of the liver", "tumours in trials", "placebo liver cancer", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", text.stemmed_terms("t").alias("terms"))
    ask = lambda q: sorted(r["i"] for r in df.where(text.matches(text.parse_query(q), F.col("terms"))).collect())
    assert ask("liver cancer") == [0, 1, 3]
    assert ask('"liver cancer"') == [0, 3]
    assert ask('"liver cancer" -placebo') == [0]
    assert ask("cancers or tumour trial") == [0, 2]
    assert ask("the of") == ask("") == []


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [1.0, 0.0, None, None]
    a, b, c = vectors.embed(["liver cancer", "Liver  cancer", "tablet"])
    assert (a == b).all() and abs(a @ a - 1) < 1e-6 and a @ c < 0.9 and not vectors.embed([None]).any()
    assert vectors.embed_column(spark.createDataFrame([(1, "x"), (2, None)], "k int, t string"), "k", "t").count() == 2
