"""Static schedule text files, read by header name."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.fixed import OPTIONAL_FILES, REQUIRED_FILES, WEEKDAYS
from stopclock.functions import gtfs as G
from stopclock.sources.files import exists

# Large files stay splittable; the small ones may hold quoted line breaks.
SPLITTABLE = ("stop_times.txt", "shapes.txt")


def check_files(spark: SparkSession, folder: str) -> None:
    """Name every missing required file at once, before any row is read."""
    missing = [name for name in REQUIRED_FILES if not exists(spark, f"{folder}/{name}")]
    if missing:
        raise FileNotFoundError(f"schedule is missing required files: {', '.join(missing)}")


def read_gtfs_text(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All columns as text; a byte-order mark does not stick to the first column name."""
    df = spark.read.csv(
        f"{folder}/{name}", header=True, escape='"', multiLine=name not in SPLITTABLE, encoding="UTF-8"
    )
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _text(df: DataFrame) -> Callable[[str], Column]:
    return lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")


def map_agencies(df: DataFrame) -> DataFrame:
    c = _text(df)
    return df.select(
        G.required(c("agency_id"), "agency.txt", "agency_id").alias("agency_id"),
        *[
            G.optional_text(c(n)).alias(n)
            for n in ("agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone")
        ],
    )


def map_routes(df: DataFrame) -> DataFrame:
    c = _text(df)
    return df.select(
        G.required(c("route_id"), "routes.txt", "route_id").alias("route_id"),
        *[G.optional_text(c(n)).alias(n) for n in ("agency_id", "route_short_name", "route_long_name")],
        G.optional_int(c("route_type")).cast("smallint").alias("route_type"),
        *[G.optional_text(c(n)).alias(n) for n in ("route_color", "route_text_color")],
    )


def map_stops(df: DataFrame) -> DataFrame:
    c = _text(df)
    return df.select(
        G.required(c("stop_id"), "stops.txt", "stop_id").alias("stop_id"),
        G.optional_text(c("stop_code")).alias("stop_code"),
        G.optional_text(c("stop_name")).alias("stop_name"),
        G.optional_float(c("stop_lat")).alias("stop_lat"),
        G.optional_float(c("stop_lon")).alias("stop_lon"),
        G.optional_int(c("location_type")).cast("smallint").alias("location_type"),
        G.optional_text(c("parent_station")).alias("parent_station"),
        G.optional_int(c("wheelchair_boarding")).cast("smallint").alias("wheelchair_boarding"),
    )


def map_trips(df: DataFrame) -> DataFrame:
    c = _text(df)
    return df.select(
        *[G.required(c(n), "trips.txt", n).alias(n) for n in ("trip_id", "route_id", "service_id")],
        G.optional_text(c("shape_id")).alias("shape_id"),
        G.optional_text(c("trip_headsign")).alias("trip_headsign"),
        G.optional_int(c("direction_id")).cast("smallint").alias("direction_id"),
        G.optional_text(c("block_id")).alias("block_id"),
    )


def map_stop_times(df: DataFrame) -> DataFrame:
    c = _text(df)
    need = lambda n: G.required(c(n), "stop_times.txt", n)
    return df.select(
        need("trip_id").alias("trip_id"),
        G.optional_int(need("stop_sequence")).alias("stop_sequence"),
        need("stop_id").alias("stop_id"),
        G.time_to_seconds(c("arrival_time")).alias("arrival_seconds"),
        G.time_to_seconds(c("departure_time")).alias("departure_seconds"),
        G.miles_to_metres(c("shape_dist_traveled")).alias("shape_dist_traveled_m"),
        *[G.optional_int(c(n)).cast("smallint").alias(n) for n in ("pickup_type", "drop_off_type", "timepoint")],
        G.optional_text(c("stop_headsign")).alias("stop_headsign"),
    )


def map_shapes(df: DataFrame) -> DataFrame:
    c = _text(df)
    need = lambda n: G.required(c(n), "shapes.txt", n)
    return df.select(
        need("shape_id").alias("shape_id"),
        G.optional_int(need("shape_pt_sequence")).alias("shape_pt_sequence"),
        G.optional_float(need("shape_pt_lat")).alias("shape_pt_lat"),
        G.optional_float(need("shape_pt_lon")).alias("shape_pt_lon"),
        G.miles_to_metres(c("shape_dist_traveled")).alias("shape_dist_traveled_m"),
    )


def map_calendar(df: DataFrame) -> DataFrame:
    c = _text(df)
    need = lambda n: G.required(c(n), "calendar.txt", n)
    return df.select(
        need("service_id").alias("service_id"),
        *[G.service_flag(c(n)).alias(n) for n in WEEKDAYS],
        G.gtfs_date(need("start_date")).alias("start_date"),
        G.gtfs_date(need("end_date")).alias("end_date"),
    )


def map_calendar_dates(df: DataFrame) -> DataFrame:
    c = _text(df)
    need = lambda n: G.required(c(n), "calendar_dates.txt", n)
    return df.select(
        need("service_id").alias("service_id"),
        G.gtfs_date(need("date")).alias("service_date"),
        G.optional_int(need("exception_type")).cast("smallint").alias("exception_type"),
    )


# Table -> (file, mapper).
TABLES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "agencies": ("agency.txt", map_agencies),
    "routes": ("routes.txt", map_routes),
    "stops": ("stops.txt", map_stops),
    "trips": ("trips.txt", map_trips),
    "stop_times": ("stop_times.txt", map_stop_times),
    "shapes": ("shapes.txt", map_shapes),
    "calendar": ("calendar.txt", map_calendar),
    "calendar_dates": ("calendar_dates.txt", map_calendar_dates),
}

_NO_EXCEPTIONS = "service_id string, service_date date, exception_type smallint"


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One schedule table, typed. An absent optional file is an empty table."""
    name, mapper = TABLES[table]
    if name in OPTIONAL_FILES and not exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], _NO_EXCEPTIONS)
    return mapper(read_gtfs_text(spark, folder, name))


def feed_info(spark: SparkSession, folder: str) -> DataFrame:
    """Publisher version and validity from the first row of the optional file, at most one row."""
    schema = "publisher_version string, feed_start_date date, feed_end_date date"
    if not exists(spark, f"{folder}/feed_info.txt"):
        return spark.createDataFrame([], schema)
    df = read_gtfs_text(spark, folder, "feed_info.txt")
    c = _text(df)
    return df.limit(1).select(
        G.optional_text(c("feed_version")).alias("publisher_version"),
        G.gtfs_date(c("feed_start_date")).alias("feed_start_date"),
        G.gtfs_date(c("feed_end_date")).alias("feed_end_date"),
    )
