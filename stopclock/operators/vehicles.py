"""Vehicle positions for a map."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import MIN_HEADING_M
from stopclock.functions.geo import heading, planar_metres
from stopclock.functions.ordering import latest_per_key


def fresh(positions: DataFrame, as_of, minutes: int) -> DataFrame:
    """Located positions from the last `minutes` before `as_of`. The bare column is compared, so the bound reaches
    the scan's row groups; the service day a feed states is not relied on."""
    edge = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return positions.where((F.col("ts") > edge) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def latest_positions(positions: DataFrame) -> DataFrame:
    return latest_per_key(positions, ["vehicle_id"], [F.col("ts")], ["route_id", "trip_id", "lat", "lon", "ts"])


def one_per_id(dimension: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """A dimension across schedule versions: the row of the first version for each id."""
    return (
        dimension.groupBy(key)
        .agg(F.min_by(F.struct(*keep), "feed_version").alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in keep])
    )


def headings(positions: DataFrame) -> DataFrame:
    """Heading of each position from the one before; kept from earlier while barely moved, 0 at first.

    The window orders one vehicle's positions of one service day.
    """
    keys = ["start_date", "vehicle_id"]
    along = Window.partitionBy(*keys).orderBy("ts")
    lat, lon = F.lag("lat").over(along), F.lag("lon").over(along)
    moved = planar_metres(lat, lon, F.col("lat"), F.col("lon")) >= MIN_HEADING_M
    turned = F.when(moved, heading(lat, lon, F.col("lat"), F.col("lon")))
    kept = F.last("_turned", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return (
        positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .withColumn("_turned", turned)
        .withColumn("heading_degrees", F.coalesce(kept, F.lit(0.0)))
        .drop("_turned")
    )
