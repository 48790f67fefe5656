"""Which service runs on which date."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import EXCEPTION_ADDED, EXCEPTION_REMOVED, WEEKDAYS


def expand_service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_date, service_id) pairs: weekday pattern over its range, less removals, plus additions.

    A range that ends before it starts and an unknown exception type fail the job. Pattern
    and exceptions meet in one aggregate, so there is one shuffle.
    """
    carried = [c for c in ("feed_version",) if c in calendar.columns]
    end = F.when(F.col("end_date") >= F.col("start_date"), F.col("end_date")).otherwise(
        F.raise_error(F.concat(F.lit("calendar: "), "service_id", F.lit(" ends before it starts or has no range")))
    )
    pattern = (
        calendar.withColumn("_day", F.explode(F.sequence("start_date", end)))
        .where(F.get(F.array(*WEEKDAYS), F.weekday("_day")))
        .select(*carried, F.col("_day").alias("service_date"), "service_id", F.lit(False).alias("_removed"))
    )
    kind = F.col("exception_type")
    removed = F.when(kind == EXCEPTION_ADDED, False).when(kind == EXCEPTION_REMOVED, True).otherwise(
        F.raise_error(F.concat(F.lit("calendar dates: unknown exception_type for "), "service_id"))
    )
    changes = exceptions.where(F.col("service_date").isNotNull()).select(
        *carried, "service_date", "service_id", removed.alias("_removed")
    )
    return (
        pattern.unionByName(changes)
        .groupBy(*carried, "service_date", "service_id")
        .agg(F.bool_or("_removed").alias("_removed"))
        .where(~F.col("_removed"))
        .drop("_removed")
    )


def running_trips(service_dates: DataFrame, trips: DataFrame, keys: tuple[str, ...] = ("feed_version",)) -> DataFrame:
    """What runs on each date."""
    return service_dates.join(trips, [*keys, "service_id"])


def active_version(versions: DataFrame, day) -> DataFrame:
    """The newest loaded schedule covering `day` (a Column or text); open ranges count. One row at most."""
    when = F.to_date(F.lit(day)) if isinstance(day, str) else day
    open_range = F.col("feed_start_date").isNull() | F.col("feed_end_date").isNull()
    covers = when.between(F.col("feed_start_date"), F.col("feed_end_date")) | open_range
    return newest_loaded(versions.where(covers))


def newest_loaded(versions: DataFrame) -> DataFrame:
    return (
        versions.where(F.col("loaded_at").isNotNull())
        .agg(F.max_by("feed_version", F.struct("loaded_at", "feed_version")).alias("feed_version"))
        .where(F.col("feed_version").isNotNull())
    )


def trips_on_date(service_dates: DataFrame, trips: DataFrame) -> DataFrame:
    """Scheduled trips per date and route."""
    return (
        running_trips(service_dates, trips)
        .groupBy("service_date", "route_id")
        .agg(F.count(F.lit(1)).alias("trips"))
    )


def visits_stop_twice(stop_times: DataFrame) -> DataFrame:
    """Per schedule: trips, and trips calling at one stop more than once."""
    return (
        stop_times.groupBy("feed_version", "trip_id", "stop_id")
        .agg(F.count(F.lit(1)).alias("calls"))
        .groupBy("feed_version", "trip_id")
        .agg(F.max("calls").alias("calls"))
        .groupBy("feed_version")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.count_if(F.col("calls") > 1).alias("twice"),
            (100.0 * F.count_if(F.col("calls") > 1) / F.count(F.lit(1))).alias("twice_pct"),
        )
    )


def shape_lengths(shapes: DataFrame) -> DataFrame:
    """Declared and measured length per shape, and their ratio: shows the declared unit.

    The window orders one shape's points, which a schedule bounds.
    """
    from stopclock.functions.geo import haversine_m

    along = Window.partitionBy("feed_version", "shape_id").orderBy("shape_pt_sequence")
    step = haversine_m(
        F.lag("shape_pt_lat").over(along), F.lag("shape_pt_lon").over(along), F.col("shape_pt_lat"), F.col("shape_pt_lon")
    )
    return (
        shapes.withColumn("_step", step)
        .groupBy("feed_version", "shape_id")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.coalesce(F.sum("_step"), F.lit(0.0)).alias("measured_m"),
            (F.max("shape_dist_traveled_m") - F.min("shape_dist_traveled_m")).alias("declared_m"),
        )
        .withColumn("ratio", F.col("declared_m") / F.nullif(F.col("measured_m"), F.lit(0.0)))
    )
