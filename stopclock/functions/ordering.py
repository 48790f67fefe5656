"""Ordered operators over keys that may hold a large share of all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_within_feed(df: DataFrame, keys: list[str], instant: str, out: str, slot_seconds: int = 600) -> DataFrame:
    """The previous instant of the same key, without one task per key.

    A key such as a feed name holds half of all rows. Rows are windowed by (key, time slot);
    only each slot's first row needs the last instant of the nearest earlier slot, which
    comes from one aggregated row per slot.
    """
    slotted = df.withColumn("_slot", F.floor(F.unix_micros(instant) / F.lit(slot_seconds * 1_000_000)))
    inside = Window.partitionBy(*keys, "_slot").orderBy(instant)
    across = Window.partitionBy(*keys).orderBy("_slot")
    edges = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.max(instant).alias("_last"))
        .select(*keys, "_slot", F.lag("_last").over(across).alias("_edge"))
    )
    return (
        slotted.join(edges, [*keys, "_slot"])
        .withColumn(out, F.coalesce(F.lag(instant).over(inside), F.col("_edge")))
        .drop("_slot", "_edge")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The last row of each key by `order`, as an aggregate: a hot key combines map-side."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep])
    )
