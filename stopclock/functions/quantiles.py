"""Exact percentiles that do not put a hot group's rows into one buffer."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_values(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """One row per (keys, values) with its count `_n`. Whole-second errors repeat a lot, so
    this shrinks on the map side, and no later step sees more than the distinct values."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n"))


def counted_percentile(value: Column | str, share: float) -> Column:
    """Interpolated percentile over rows of `count_values`."""
    return F.percentile(value, share, F.col("_n"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float, out: str, width: float = 1.0) -> DataFrame:
    """Interpolated percentile of a fractional column, one row per key.

    First the histogram of `width`-wide slots tells which slot holds the wanted ranks; then
    only rows of that slot are ranked. A group of any size is never gathered: the histogram
    is a plain aggregate and a slot of microsecond values holds at most width * 1e6 of them.
    Keys must not be null.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_slot", F.floor(F.col(value) / width))
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.lit(share) * (F.sum("_n").over(whole) - 1)
    slots = (
        rows.groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_slot",
            "_n",
            (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"),
            F.floor(position).alias("_lo"),
            F.ceil(position).alias("_hi"),
            (position - F.floor(position)).alias("_part"),
        )
    )
    upto = F.col("_before") + F.col("_n")
    wanted = slots.where(
        ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < upto))
        | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < upto))
    ).drop("_n")
    within = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        rows.join(wanted, [*keys, "_slot"])
        .groupBy(*keys, "_slot", value, "_before", "_lo", "_hi", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(within))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end")), F.col(value)))

    return (
        ranked.groupBy(*keys)
        .agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_part").alias("_part"))
        .select(*keys, (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias(out))
    )
