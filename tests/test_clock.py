import pytest
from tests.conftest import day, utc
from pyspark.sql import functions as F

from stopclock.functions import clock as C
from stopclock.functions import labels as L


def at(spark, instant, service_day, column):
    df = spark.createDataFrame([(utc(instant), day(service_day))], "ts timestamp, d date")
    return df.select(column).first()[0]


def test_hour_bin_is_rounded_not_truncated(spark):
    assert at(spark, "2026-10-01 19:30:00", "2026-10-01", C.hour_bin("ts", "d")) == 13
    assert at(spark, "2026-10-01 19:29:59", "2026-10-01", C.hour_bin("ts", "d")) == 12


def test_service_minute_passes_midnight(spark):
    assert at(spark, "2026-10-02 08:00:00", "2026-10-01", C.service_minute("ts", "d")) == 1500


def test_wall_clock_difference_ignores_clock_changes(spark):
    # 2026-03-08 has 23 hours and 2026-11-01 has 25; noon is 43200 on both.
    assert at(spark, "2026-03-08 19:00:00", "2026-03-08", C.seconds_into_service_day("ts", "d")) == 43200
    assert at(spark, "2026-11-01 20:00:00", "2026-11-01", C.seconds_into_service_day("ts", "d")) == 43200


@pytest.mark.parametrize(
    ("instant", "window", "expected"),
    [
        ("2026-09-29 07:05:00", (84900, 86460), "2026-09-28"),
        ("2026-09-29 20:00:00", (46800, 50400), "2026-09-29"),
        ("2026-09-29 09:00:00", (91800, 93900), "2026-09-28"),
        ("2026-09-29 20:00:00", (10, 20), "2026-09-29"),
        ("2026-09-29 20:00:00", None, "2026-09-29"),
    ],
)
def test_service_day(spark, instant, window, expected):
    first, last = window or (None, None)
    df = spark.createDataFrame([(utc(instant), first, last)], "ts timestamp, a int, b int")
    assert df.select(C.resolve_service_day("ts", "a", "b")).first()[0] == day(expected)


def test_grace_bounds_are_inclusive(spark):
    # Window 12:00 to 13:00 local; 11:45 and 14:00 are the last moments that fit.
    for instant in ("2026-09-29 18:45:00", "2026-09-29 21:00:00"):
        df = spark.createDataFrame([(utc(instant), 43200, 46800)], "ts timestamp, a int, b int")
        today = C.seconds_into_service_day("ts", C.local_date("ts"))
        assert df.select(today.between(F.col("a") - 900, F.col("b") + 3600)).first()[0]


def test_epoch_zero_is_no_time(spark):
    df = spark.createDataFrame([(0,), (None,), (60,)], "v bigint")
    assert [r[0] for r in df.select(C.epoch_to_instant("v")).collect()] == [None, None, utc("1970-01-01 00:01:00")]


def test_clamp(spark):
    df = spark.createDataFrame([(utc("2026-10-01 19:00:00"), utc("2026-10-01 19:10:00"))], "a timestamp, c timestamp")
    late, early, raw = df.select(
        C.clamp_to_cutoff(F.col("a"), F.lit(900.0), F.col("c")),
        C.clamp_to_cutoff(F.col("a"), F.lit(60.0), F.col("c")),
        C.clamp_to_cutoff(F.col("a"), F.lit(-60.0), F.col("c"), clamp=False),
    ).first()
    assert (late, early, raw) == (utc("2026-10-01 19:15:00"), utc("2026-10-01 19:10:00"), utc("2026-10-01 19:00:00"))


def test_bands_partition_the_day(spark):
    minutes = spark.range(0, 2000).select(F.col("id").cast("int").alias("m"))
    bands = [b for b in L.TIME_BANDS if b != "all"]
    hits = minutes.select(sum((L.in_time_band("m", b).cast("int") for b in bands), F.lit(0)).alias("n"), L.time_band("m").alias("b"))
    assert hits.where((F.col("n") != 1) | F.col("b").isNull()).isEmpty()
    late = minutes.where(L.in_time_band("m", "late")).agg(F.count(F.lit(1))).first()[0]
    assert late == 360 + (2000 - 1440)


def test_unknown_names_are_errors():
    with pytest.raises(ValueError, match="rush_hour"):
        L.checked_band("rush_hour")
    with pytest.raises(ValueError, match="oracle"):
        L.checked_source("oracle")
    with pytest.raises(ValueError, match="two characters"):
        L.name_contains("name", "a")


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ((10, -30.0, 100, -60.0), (-30.0, "stop_and_route", 10)),
        ((9, -30.0, 30, -60.0), (-60.0, "route", 30)),
        ((9, -30.0, 29, -60.0), (None, "none", None)),
        ((None, None, None, None), (None, "none", None)),
    ],
)
def test_choose_bias(spark, values, expected):
    df = spark.createDataFrame([values], "a int, b double, c int, d double")
    got = df.select(L.choose_bias(*[F.col(x) for x in "abcd"])).first()[0]
    assert tuple(got) == expected


def test_small_labels(spark):
    row = spark.range(1).select(
        L.three_hour_label(L.three_hour_block(F.lit(1000))),
        L.coverage_status(F.lit(79.9)),
        L.coverage_status(F.lit(None).cast("double")),
        L.cut_error(F.lit("x" * 1200), 1000),
        L.correction_is_meaningful(F.lit(-20.0)),
        L.correction_is_meaningful(F.lit(19.9)),
        L.horizon_label(F.lit(10)),
    ).first()
    assert row[0] == "15:00-18:00" and row[1:3] == ("warning", "unknown")
    assert row[3] == "x" * 1000 + "..." and row[4:] == (True, False, "10 min")
