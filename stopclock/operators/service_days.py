"""Which service day an observation of a trip belongs to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.fixed import GRACE_AFTER_SECONDS, GRACE_BEFORE_SECONDS, SERVICE_TZ
from stopclock.functions.clock import local_date, resolve_service_day, seconds_into_service_day


def trip_windows(stop_times: DataFrame, keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """First and last scheduled second of each trip."""
    return (
        stop_times.where(F.col("arrival_seconds").isNotNull())
        .groupBy(*keys)
        .agg(F.min("arrival_seconds").alias("first_seconds"), F.max("arrival_seconds").alias("last_seconds"))
    )


def with_service_day(rows: DataFrame, windows: DataFrame, instant: str) -> DataFrame:
    """Correct `start_date` against the schedule, the stored value staying in `stored_date`.

    Rows without a trip keep what they have. They carry no join key, so each gets one of
    many keys that match nothing rather than all meeting in the null partition.
    """
    no_trip = F.coalesce(F.col("trip_id"), F.lit("")) == ""
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(instant, *_present(rows, "vehicle_id")), F.lit(4096)).cast("string"))
    keyed = rows.withColumn("_trip", F.when(no_trip, spread).otherwise(F.col("trip_id")))
    return (
        keyed.join(windows.withColumnRenamed("trip_id", "_trip"), "_trip", "left")
        .withColumn("stored_date", F.col("start_date"))
        .withColumn(
            "start_date",
            F.when(no_trip, F.col("start_date")).otherwise(resolve_service_day(instant, "first_seconds", "last_seconds")),
        )
        .drop("_trip", "first_seconds", "last_seconds")
    )


def _present(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def moved_count(corrected: DataFrame) -> DataFrame:
    return corrected.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("start_date").eqNullSafe(F.col("stored_date"))).alias("moved"),
    )


def belongs_to_yesterday(instant: Column | str, first: str, last: str, tz: str = SERVICE_TZ) -> Column:
    """Outside today's window of the trip and inside yesterday's."""
    today = seconds_into_service_day(instant, local_date(instant, tz), tz)
    low, high = F.col(first) - GRACE_BEFORE_SECONDS, F.col(last) + GRACE_AFTER_SECONDS
    return ~today.between(low, high) & (today + 86400).between(low, high)


def backfill_days(rows: DataFrame, windows: DataFrame, instant: str) -> DataFrame:
    """Stored rows with the service day moved back where the schedule says so.

    Only clear cases move: a row fitting today, or neither day, stays. The result feeds
    `sinks.tables.move_rows`, or `rows_to_move` for a preview.
    """
    joined = rows.join(windows, "trip_id", "left")
    yesterday = F.coalesce(belongs_to_yesterday(instant, "first_seconds", "last_seconds"), F.lit(False))
    return (
        joined.withColumn("stored_date", F.col("start_date"))
        .withColumn("start_date", F.when(yesterday, F.date_sub(local_date(instant), 1)).otherwise(F.col("start_date")))
        .drop("first_seconds", "last_seconds")
    )


def rows_to_move(rows: DataFrame, windows: DataFrame, instant: str) -> DataFrame:
    hits = rows.join(windows, "trip_id").where(belongs_to_yesterday(instant, "first_seconds", "last_seconds"))
    per_trip = hits.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    return per_trip.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_to_move"), F.count(F.lit(1)).alias("trips")
    )


def key_collisions(corrected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys two rows would share after a correction; must be empty before the key column moves."""
    return corrected.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def implausible_runs(positions: DataFrame, windows: DataFrame) -> DataFrame:
    """Trip records, and those observed more than an hour longer than scheduled."""
    runs = (
        positions.where(F.col("trip_id").isNotNull())
        .groupBy("start_date", "trip_id")
        .agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6).alias("observed_min"))
        .join(windows, "trip_id")
    )
    scheduled = (F.col("last_seconds") - F.col("first_seconds")) / 60
    return runs.agg(
        F.count(F.lit(1)).alias("trip_records"),
        F.count_if(F.col("observed_min") > scheduled + 60).alias("implausible"),
    )


def a_day_off(arrivals: DataFrame, predictions: DataFrame, limit_seconds: int = 72000) -> DataFrame:
    """Arrivals with a prediction of the same key more than `limit_seconds` away.

    Some prediction is that far off exactly when the earliest or the latest one is, so one
    row per key decides it and nothing fans out.
    """
    keys = ["start_date", "trip_id", "stop_sequence"]
    span = predictions.groupBy(*keys).agg(F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last"))
    arrived = F.unix_micros("arrived_at")
    reach = F.lit(limit_seconds * 1_000_000)
    return (
        arrivals.join(span, keys)
        .where((F.unix_micros("_first") < arrived - reach) | (F.unix_micros("_last") > arrived + reach))
        .drop("_first", "_last")
    )
