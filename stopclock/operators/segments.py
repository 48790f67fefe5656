"""Stop-to-stop travel times and sums of them along a trip."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import (
    DEFAULT_SEGMENT_SECONDS,
    MAX_HOUR_BIN,
    MAX_SEGMENT_SECONDS,
    MIN_SEGMENT_SECONDS,
    TIGHT_LABEL_SECONDS,
)
from stopclock.functions.clock import hour_bin, is_weekend, seconds_between
from stopclock.functions.quantiles import exact_percentile

STAT_KEY = ["feed_version", "from_stop_id", "to_stop_id", "hour_bin", "is_weekend"]


def segment_durations(arrivals: DataFrame, fit_through: str | None = None) -> DataFrame:
    """Consecutive observed stops of each trip run; nothing after `fit_through` is read."""
    if fit_through is not None:
        arrivals = arrivals.where(F.col("start_date") <= F.to_date(F.lit(fit_through)))
    along = Window.partitionBy("feed_version", "start_date", "trip_id").orderBy("stop_sequence")
    return arrivals.select(
        "feed_version",
        "start_date",
        "trip_id",
        "stop_sequence",
        F.col("stop_id").alias("from_stop_id"),
        F.lead("stop_id").over(along).alias("to_stop_id"),
        seconds_between("arrived_at", F.lead("arrived_at").over(along)).alias("seconds"),
        hour_bin("arrived_at", "start_date").alias("hour_bin"),
        is_weekend("start_date").alias("is_weekend"),
        F.col("ping_gap_seconds").alias("from_gap"),
        F.lead("ping_gap_seconds").over(along).alias("to_gap"),
    ).where(F.col("to_stop_id").isNotNull())


def plausible(durations: DataFrame, max_gap: int = TIGHT_LABEL_SECONDS) -> DataFrame:
    return durations.where(
        F.col("seconds").between(MIN_SEGMENT_SECONDS, MAX_SEGMENT_SECONDS)
        & (F.col("from_gap") <= max_gap)
        & (F.col("to_gap") <= max_gap)
        & F.col("hour_bin").between(0, MAX_HOUR_BIN)
    )


def fit_segment_stats(arrivals: DataFrame, fit_through: str, max_gap: int = TIGHT_LABEL_SECONDS) -> DataFrame:
    """Mean, median and spread per segment, hour and day type, up to and including a date."""
    rows = plausible(segment_durations(arrivals, fit_through), max_gap).select(*STAT_KEY, "seconds")
    moments = rows.groupBy(*STAT_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("seconds").alias("mean_seconds"),
        F.stddev_samp("seconds").alias("stddev_seconds"),
    )
    medians = exact_percentile(rows, STAT_KEY, "seconds", 0.5, "median_seconds")
    return moments.join(medians, STAT_KEY).withColumn("fit_through_date", F.to_date(F.lit(fit_through)))


def _weighted(value: str = "mean_seconds") -> Column:
    return F.sum(F.col(value) * F.col("n")) / F.sum("n")


def segment_fallbacks(stats: DataFrame) -> DataFrame:
    """Per schedule version and segment: its weighted mean and its exact means by hour and day type.

    The map has at most one entry per hour bin and day type, sixty in all.
    """
    slot = F.col("hour_bin") * 2 + F.col("is_weekend").cast("int")
    return stats.groupBy("feed_version", "from_stop_id", "to_stop_id").agg(
        _weighted().alias("segment_seconds"),
        F.map_from_entries(F.collect_list(F.struct(slot, F.col("mean_seconds")))).alias("exact_seconds"),
    )


def global_means(stats: DataFrame) -> Column:
    """The mean of all segments of each schedule version, as one map from version to mean; versions are few."""
    means = stats.groupBy("feed_version").agg(_weighted().alias("mean"))
    return means.agg(F.map_from_entries(F.collect_list(F.struct("feed_version", "mean")))).scalar()


def lookup_segments(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Add `mean_seconds` and `level`: exact, else the segment at any time, else the mean of all segments.

    `stats` is one fit; each pair is looked up in its own schedule version. A version without statistics
    gets the default.
    """
    joined = pairs.join(segment_fallbacks(stats), ["feed_version", "from_stop_id", "to_stop_id"], "left")
    slot = F.col("hour_bin") * 2 + F.col("is_weekend").cast("int")
    exact = F.try_element_at("exact_seconds", slot)
    anywhere = F.try_element_at(global_means(stats), F.col("feed_version"))
    level = (
        F.when(exact.isNotNull(), "exact").when(F.col("segment_seconds").isNotNull(), "segment").otherwise("global")
    )
    return (
        joined.withColumn("level", level)
        .withColumn("mean_seconds", F.coalesce(exact, F.col("segment_seconds"), anywhere, F.lit(DEFAULT_SEGMENT_SECONDS)))
        .drop("exact_seconds", "segment_seconds")
    )


def segment_sums(contexts: DataFrame, stop_times: DataFrame, stats: DataFrame) -> DataFrame:
    """Sum of segment means from anchor to target, the share of them that fell back, and the trip's number of stops.

    Walking every context's segments would multiply rows by trip length. Instead each trip gets running totals once per
    hour bin and day type its contexts have, over the stops between the first anchor and the last target of these, and a
    context takes the difference of two of them. The totals travel as an array by sequence number, so either is one look at
    a place. The hour bin is the anchor's for the whole span. `contexts` and `stats` are read more than once: hand over
    stored ones.
    """
    trip = ["feed_version", "trip_id"]
    key = [*trip, "hour_bin", "is_weekend"]
    slots = contexts.groupBy(*key).agg(F.min("anchor_sequence").alias("_low"), F.max("target_sequence").alias("_high"))
    along = Window.partitionBy(*trip).orderBy("stop_sequence")
    pairs = stop_times.select(
        *trip,
        "stop_sequence",
        F.lag("stop_id").over(along).alias("from_stop_id"),
        F.col("stop_id").alias("to_stop_id"),
    )
    inside = F.col("stop_sequence").between(F.col("_low"), F.col("_high"))
    spans = lookup_segments(pairs.join(slots, trip).where(inside), stats)
    order = Window.partitionBy(*key).orderBy("stop_sequence")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("from_stop_id").isNull()
    totals = spans.select(
        *key,
        "stop_sequence",
        (F.col("stop_sequence") - F.coalesce(F.lag("stop_sequence").over(order), F.col("_low") - 1) - 1).cast("int").alias("_missing"),
        F.struct(
            F.sum(F.when(first, 0.0).otherwise(F.col("mean_seconds"))).over(upto).alias("seconds"),
            F.sum(F.when(first | (F.col("level") == "exact"), 0).otherwise(1)).over(upto).alias("coarse"),
            F.count(F.lit(1)).over(upto).alias("stops"),
        ).alias("_total"),
    )
    listed = F.sort_array(F.collect_list(F.struct("stop_sequence", "_missing", "_total")))
    nothing = F.lit(None).cast(totals.schema["_total"].dataType)
    by_sequence = totals.groupBy(*key).agg(
        F.flatten(F.transform(listed, lambda x: F.concat(F.array_repeat(nothing, x["_missing"]), F.array(x["_total"])))).alias("_totals")
    )
    sizes = stop_times.groupBy(*trip).agg(F.count(F.lit(1)).alias("_stops"))
    ready = slots.join(sizes, trip, "left").join(by_sequence, key, "left").drop("_high")
    found = contexts.join(ready, key, "left").select(
        *contexts.columns,
        _at("anchor_sequence").alias("_start"),
        _at("target_sequence").alias("_end"),
        F.coalesce("_stops", F.lit(0)).alias("trip_stops"),
    )
    count = F.coalesce(F.col("_end.stops") - F.col("_start.stops"), F.lit(0))
    return (
        found.withColumn("_count", count)
        .withColumn(
            "segment_sum_seconds",
            F.when(F.col("_count") > 0, F.col("_end.seconds") - F.col("_start.seconds")).otherwise(0.0),
        )
        .withColumn(
            "coarse_segment_share",
            F.when(F.col("_count") > 0, (F.col("_end.coarse") - F.col("_start.coarse")) / F.col("_count")).otherwise(1.0),
        )
        .drop("_start", "_end", "_count")
    )


def _at(sequence: str) -> Column:
    """The running total at a sequence number; null where the trip has no such stop."""
    return F.get("_totals", (F.col(sequence) - F.col("_low")).cast("int"))
