"""Change-only storage of predictions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import CHANGE_THRESHOLD_SECONDS

KEY = ["start_date", "trip_id", "stop_sequence"]


#: What a prediction says: a time (2), only a delay (1), nothing (0).
TIME, DELAY, NOTHING = 2, 1, 0


def _said(arrival: Column, delay: Column) -> tuple[Column, Column]:
    """Kind of a prediction, and its time or delay in micros."""
    kind = F.when(arrival.isNotNull(), TIME).when(delay.isNotNull(), DELAY).otherwise(NOTHING)
    return kind, F.coalesce(arrival, delay.cast("bigint") * 1_000_000, F.lit(0))


def differs(arrival: Column, delay: Column, last_arrival: Column, last_delay: Column, threshold: int) -> Column:
    """Whether a prediction is worth keeping beside the last kept one: it says another kind of thing, or its value
    lies outside the band of `threshold` seconds around the last. Arrivals are epoch micros."""
    (kind, value), (last_kind, last_value) = _said(arrival, delay), _said(last_arrival, last_delay)
    band = threshold * 1_000_000
    outside = (value <= last_value - band) | (value >= last_value + band)
    return (kind != last_kind) | ((kind != NOTHING) & outside)


def select_changed(
    rows: DataFrame, threshold: int = CHANGE_THRESHOLD_SECONDS, last_kept: DataFrame | None = None
) -> DataFrame:
    """Per (day, trip, stop), the first prediction and then those that differ from the last kept.

    The comparison is with the last *kept* row, a fold. Two exact facts shorten it before any
    rows are put together. A row equal to the observation before it is never kept. A row
    whose time or delay appears, disappears, or jumps by twice the threshold is always kept,
    so the fold restarts there and each stretch between restarts folds alone.

    `last_kept` carries state over from an earlier batch: KEY, arrival_time, delay_seconds.
    """
    columns = rows.columns
    seeded = rows.withColumn("_seed", F.lit(False))
    if last_kept is not None:
        seeds = last_kept.select(*KEY, "arrival_time", "delay_seconds").withColumn("_seed", F.lit(True))
        seeded = seeded.unionByName(seeds, allowMissingColumns=True)
    seeded = seeded.withColumn("_arrival", F.unix_micros("arrival_time"))

    order = Window.partitionBy(*KEY).orderBy(F.col("_seed").desc(), "observed_at")
    arrival, delay = F.col("_arrival"), F.col("delay_seconds")
    before_arrival, before_delay = F.col("_before.a"), F.col("_before.d")
    first = F.col("_before").isNull()
    always = first | differs(arrival, delay, before_arrival, before_delay, 2 * max(threshold, 1))
    stretches = (
        seeded.withColumn("_before", F.lag(F.struct(arrival.alias("a"), delay.alias("d"))).over(order))
        .withColumn("_restart", always.cast("int"))
        .withColumn("_stretch", F.sum("_restart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    if threshold > 0:
        same = arrival.eqNullSafe(before_arrival) & delay.eqNullSafe(before_delay)
        stretches = stretches.where(first | ~same)

    payload = [c for c in columns if c not in KEY]
    entry = F.struct(
        (~F.col("_seed")).cast("int").alias("_late"),
        "observed_at",
        "_arrival",
        *[c for c in payload if c != "observed_at"],
    )
    entries = stretches.select(*KEY, "_stretch", entry.alias("_entry"))
    kind = entries.schema["_entry"].dataType.simpleString()
    none = F.struct(
        F.lit(False).alias("any"),
        F.lit(None).cast("bigint").alias("a"),
        F.lit(None).cast("int").alias("d"),
        F.array().cast(f"array<{kind}>").alias("kept"),
    )

    def step(state: Column, row: Column) -> Column:
        keep = ~state["any"] | differs(row["_arrival"], row["delay_seconds"], state["a"], state["d"], threshold)
        taken = F.struct(
            F.lit(True).alias("any"),
            row["_arrival"].alias("a"),
            row["delay_seconds"].cast("int").alias("d"),
            F.concat(state["kept"], F.array(row)).alias("kept"),
        )
        return F.when(keep, taken).otherwise(state)

    folded = entries.groupBy(*KEY, "_stretch").agg(F.array_sort(F.collect_list("_entry")).alias("_list"))
    kept = F.aggregate("_list", none, step, lambda state: state["kept"])
    return (
        folded.select(*KEY, F.explode(kept).alias("_row"))
        .where(F.col("_row._late") == 1)
        .select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in payload])
        .select(*columns)
    )
