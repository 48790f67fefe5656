"""Landed realtime snapshots, flattened to rows.

Each flattened frame keeps the refused entries beside the accepted ones: `reason` is null
on an accepted row and `weight` says how many stops a refused one stands for. Works on
batch and streaming frames alike, as it neither joins nor aggregates.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.functions.clock import epoch_to_instant, feed_service_day


def _blank_to_null(name: str):
    return F.nullif(F.col(name), F.lit(""))


def flatten_positions(snapshots: DataFrame) -> DataFrame:
    """One row per vehicle entity. `note` marks a time taken from the header."""
    carried = [c for c in snapshots.columns if c not in ("header_ts", "entity")]
    own = epoch_to_instant("e.vehicle.timestamp")
    rows = (
        snapshots.select(*carried, "header_ts", F.explode("entity").alias("e"))
        .where(F.col("e.vehicle").isNotNull())
        .select(
            *carried,
            F.coalesce(_blank_to_null("e.vehicle.vehicle_id"), _blank_to_null("e.id")).alias("vehicle_id"),
            F.coalesce(own, epoch_to_instant("header_ts")).alias("ts"),
            own.isNull().alias("_from_header"),
            _blank_to_null("e.vehicle.trip.trip_id").alias("trip_id"),
            _blank_to_null("e.vehicle.trip.route_id").alias("route_id"),
            F.col("e.vehicle.trip.start_date").alias("_day"),
            F.col("e.vehicle.position.latitude").alias("lat"),
            F.col("e.vehicle.position.longitude").alias("lon"),
            F.col("e.vehicle.position.bearing").alias("bearing"),
            F.col("e.vehicle.position.speed").alias("speed"),
            F.col("e.vehicle.current_stop_sequence").alias("current_stop_sequence"),
            F.col("e.vehicle.current_status").cast("smallint").alias("current_status"),
            F.col("e.vehicle.occupancy_status").cast("smallint").alias("occupancy_status"),
        )
    )
    reason = F.when(F.col("vehicle_id").isNull(), "no_vehicle_id").when(F.col("ts").isNull(), "no_timestamp")
    return (
        rows.withColumn("start_date", feed_service_day("_day", "ts"))
        .withColumn("reason", reason)
        .withColumn("weight", F.lit(1))
        .withColumn("note", F.when(F.col("reason").isNull() & F.col("_from_header"), "ts_from_header"))
        .drop("_day", "_from_header")
    )


def flatten_predictions(snapshots: DataFrame) -> DataFrame:
    """One row per predicted stop, `feed_order` being its place in the trip's list."""
    carried = [c for c in snapshots.columns if c not in ("header_ts", "entity")]
    trips = (
        snapshots.select(*carried, "header_ts", F.explode("entity").alias("e"))
        .where(F.col("e.trip_update").isNotNull())
        .select(
            *carried,
            _blank_to_null("e.trip_update.trip.trip_id").alias("trip_id"),
            _blank_to_null("e.trip_update.trip.route_id").alias("route_id"),
            _blank_to_null("e.trip_update.vehicle_id").alias("vehicle_id"),
            F.coalesce(epoch_to_instant("e.trip_update.timestamp"), epoch_to_instant("header_ts")).alias("observed_at"),
            F.col("e.trip_update.trip.start_date").alias("_day"),
            F.col("e.trip_update.stop_time_update").alias("_stops"),
        )
        .withColumn("start_date", feed_service_day("_day", "observed_at"))
        .withColumn(
            "_trip_reason",
            F.when(F.col("trip_id").isNull(), "no_trip_id")
            .when(F.col("observed_at").isNull(), "no_timestamp")
            .when(F.col("start_date").isNull(), "no_start_date"),
        )
        .withColumn("weight", F.greatest(F.coalesce(F.size("_stops"), F.lit(0)), F.lit(1)))
        .drop("_day")
    )
    accepted = F.when(F.col("_trip_reason").isNull(), F.col("_stops"))
    head = [*carried, "start_date", "trip_id", "route_id", "vehicle_id", "observed_at", "_trip_reason", "weight"]
    stops = (
        trips.select(*head, F.posexplode_outer(accepted).alias("feed_order", "s"))
        .where(F.col("_trip_reason").isNotNull() | F.col("feed_order").isNotNull())
        .select(
            *head,
            "feed_order",
            F.col("s.stop_sequence").alias("stop_sequence"),
            _blank_to_null("s.stop_id").alias("stop_id"),
            epoch_to_instant("s.arrival.time").alias("arrival_time"),
            epoch_to_instant("s.departure.time").alias("departure_time"),
            F.coalesce("s.arrival.delay", "s.departure.delay").alias("delay_seconds"),
            F.col("s.schedule_relationship").cast("smallint").alias("schedule_relationship"),
        )
    )
    no_content = F.col("arrival_time").isNull() & F.col("departure_time").isNull() & F.col("delay_seconds").isNull()
    return (
        stops.withColumn(
            "reason",
            F.when(F.col("_trip_reason").isNotNull(), F.col("_trip_reason"))
            .when(F.col("stop_sequence").isNull() & F.col("stop_id").isNull(), "no_stop_identity")
            .when(no_content, "no_prediction_content"),
        )
        .withColumn("weight", F.when(F.col("_trip_reason").isNotNull(), F.col("weight")).otherwise(1))
        .drop("_trip_reason")
    )


def accepted(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("reason").isNull()).drop("reason", "weight", "note")


def drop_counts(flat: DataFrame) -> DataFrame:
    """Refused stops or vehicles by reason."""
    return flat.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.sum("weight").cast("bigint").alias("dropped"))


def note_counts(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("note").isNotNull()).groupBy("note").agg(F.count(F.lit(1)).alias("kept"))
