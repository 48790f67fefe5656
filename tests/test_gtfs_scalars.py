import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stopclock.functions import gtfs as G


def one(spark, value, parse, **options):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(parse("v", **options)).first()[0]


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("00:00:00", 0),
        ("05:12:30", 18750),
        ("24:00:00", 86400),
        ("27:15:00", 98100),
        ("5:05:00", 18300),
        (" 05:05:00 ", 18300),
        ("", None),
        ("   ", None),
        (None, None),
    ],
)
def test_time_to_seconds(spark, text, seconds):
    assert one(spark, text, G.time_to_seconds) == seconds


BAD_TIMES = ["05:05", "05:05:00:00", "aa:bb:cc", "05:60:00", "05:00:60", "-1:00:00", "+5:00:00", "05.05.00"]


@pytest.mark.parametrize("text", BAD_TIMES)
def test_bad_times_fail_naming_the_value(spark, text):
    with pytest.raises(PySparkException, match=text.replace("+", r"\+").replace(".", r"\.")):
        one(spark, text, G.time_to_seconds)
    assert one(spark, text, G.time_to_seconds, strict=False) is None


def test_miles(spark):
    assert one(spark, "1", G.miles_to_metres) == pytest.approx(1609.344)
    assert one(spark, "", G.miles_to_metres) is None
    for bad in ("-0.5", "far"):
        with pytest.raises(PySparkException, match=bad):
            one(spark, bad, G.miles_to_metres)


def test_dates(spark):
    assert one(spark, "20260907", G.gtfs_date).isoformat() == "2026-09-07"
    assert one(spark, " ", G.gtfs_date) is None
    for bad in ("202666", "2026-09-07", "20261345"):
        with pytest.raises(PySparkException, match=bad):
            one(spark, bad, G.gtfs_date)


def test_numbers_text_and_flags(spark):
    assert one(spark, " 12 ", G.optional_int) == 12
    assert one(spark, "1.5", G.optional_float) == 1.5
    assert one(spark, "", G.optional_int) is None
    with pytest.raises(PySparkException, match="12.5"):
        one(spark, "12.5", G.optional_int)
    assert one(spark, "  ", G.optional_text) is None
    assert [one(spark, t, G.service_flag) for t in ("1", " 1 ", "0", "true", "", None)] == [True, True, False, False, False, False]


def test_required_names_file_and_column(spark):
    df = spark.createDataFrame([(" ",)], "v string")
    with pytest.raises(PySparkException, match="trips.txt: required column trip_id"):
        df.select(G.required(F.col("v"), "trips.txt", "trip_id")).collect()
