"""Row checks run as Spark jobs: each returns violation counts, so a clean table gives zeros."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import (
    HORIZONS_MINUTES,
    INFERENCE_STATUSES,
    LOAD_STATUSES,
    MAX_HOUR_BIN,
    METHODS,
    POLL_STATUSES,
    SOURCES,
    TIME_BANDS,
)
from stopclock.functions.clock import delay_seconds
from stopclock.functions.labels import time_band
from stopclock.functions.quantiles import count_values, counted_percentile


#: Rows whose keys one task counts, about.
COUNTED_ROWS = 1 << 20


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, and the rows too many. Most keys are single, so a task that counts holds every key it
    meets: rows are dealt out by key before any are counted, over as many tasks as their number asks for."""
    held = df.select(*keys)
    per_key = held.repartition(1 + held.count() // COUNTED_ROWS, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One column per rule with the number of rows breaking it. A rule that is null holds."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])


def scored_rules(sources: tuple[str, ...] = SOURCES) -> dict[str, Column]:
    cutoff = F.unix_micros("arrived_at") - F.col("horizon_minutes") * F.lit(60_000_000).cast("bigint")
    return {
        "abs_matches": F.col("abs_error_seconds") == F.abs("error_seconds"),
        "prediction_precedes_cutoff": F.unix_micros("predicted_at") <= cutoff,
        "horizon_known": F.col("horizon_minutes").isin(*HORIZONS_MINUTES),
        "source_known": F.col("source").isin(*sources),
    }


def arrival_rules() -> dict[str, Column]:
    return {
        "method_known": F.col("method").isin(*METHODS),
        "gap_nonnegative": F.col("ping_gap_seconds") >= 0,
        "nearest_nonnegative": F.col("nearest_ping_m") >= 0,
        "departure_after_arrival": F.col("departed_at") >= F.col("arrived_at"),
    }


def stop_time_rules() -> dict[str, Column]:
    return {
        "arrival_nonnegative": F.col("arrival_seconds") >= 0,
        "departure_nonnegative": F.col("departure_seconds") >= 0,
        "distance_nonnegative": F.col("shape_dist_traveled_m") >= 0,
    }


def exception_rules() -> dict[str, Column]:
    return {"exception_type_known": F.col("exception_type").isin(1, 2)}


def segment_rules() -> dict[str, Column]:
    return {
        "hour_in_range": F.col("hour_bin").between(0, MAX_HOUR_BIN),
        "n_positive": F.col("n") > 0,
        "mean_positive": F.col("mean_seconds") > 0,
    }


def status_rules(log: str) -> dict[str, Column]:
    known = {"poll_log": POLL_STATUSES, "gtfs_load_log": LOAD_STATUSES, "inference_log": INFERENCE_STATUSES}[log]
    return {"status_known": F.col("status").isin(*known)}


def run_rules() -> dict[str, Column]:
    return {"train_before_test": F.col("train_to") < F.col("test_from")}


def shapes_increase(shapes: DataFrame) -> DataFrame:
    """Steps along a shape whose distance does not grow. The window orders one shape's points."""
    along = Window.partitionBy("feed_version", "shape_id").orderBy("shape_pt_sequence")
    points = shapes.where(F.col("shape_dist_traveled_m").isNotNull())
    step = F.col("shape_dist_traveled_m") - F.lag("shape_dist_traveled_m").over(along)
    return points.select(step.alias("step")).agg(
        F.count("step").alias("steps"), F.count_if(F.col("step") <= 0).alias("not_increasing")
    )


def backward_arrivals(arrivals: DataFrame) -> DataFrame:
    """Arrivals earlier than the one before them on the same run."""
    along = Window.partitionBy("start_date", "trip_id").orderBy("stop_sequence")
    pairs = arrivals.select("arrived_at", F.lag("arrived_at").over(along).alias("prev"))
    return pairs.agg(F.count_if(F.col("arrived_at") < F.col("prev")).alias("monotonicity_violations"))


def orphans(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Static rows whose feed version is not registered."""
    return (
        rows.join(versions.select("feed_version"), "feed_version", "left_anti")
        .groupBy("feed_version")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def bands_partition(scored: DataFrame) -> DataFrame:
    """Rows per time band beside the whole: the bands must add up to it."""
    counts = scored.groupBy(time_band("service_minute").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = [name for name, bounds in TIME_BANDS.items() if bounds is not None]
    return counts.agg(
        F.sum("n").alias("all_rows"),
        F.sum(F.when(F.col("band").isin(*bands), F.col("n")).otherwise(0)).alias("band_rows"),
        *[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(b) for b in bands],
    )


def speed_and_lateness(arrivals: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Implied speed between stops and delay against schedule: p10, p50, p90, p95 of each.

    Both are rounded to a tenth and counted by value first.
    """
    along = Window.partitionBy("start_date", "trip_id").orderBy("stop_sequence")
    metres = F.col("stop_offset_m") - F.lag("stop_offset_m").over(along)
    seconds = (F.unix_micros("arrived_at") - F.unix_micros(F.lag("arrived_at").over(along))) / F.lit(1e6)
    speed = arrivals.select(metres.alias("m"), seconds.alias("s")).where((F.col("s") > 0) & (F.col("m") >= 0))
    speeds = speed.select(F.lit("speed_mps").alias("measure"), F.round(F.col("m") / F.col("s"), 1).alias("value"))
    late = arrivals.join(
        stop_times.where(F.col("arrival_seconds").isNotNull()).select(
            "feed_version", "trip_id", "stop_sequence", "arrival_seconds"
        ),
        ["feed_version", "trip_id", "stop_sequence"],
    ).select(
        F.lit("lateness_seconds").alias("measure"),
        F.round(delay_seconds("arrived_at", "start_date", "arrival_seconds"), 1).alias("value"),
    )
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}
    return (
        count_values(speeds.unionByName(late), ["measure"], "value")
        .groupBy("measure")
        .agg(F.sum("_n").alias("n"), *[counted_percentile("value", q).alias(name) for name, q in shares.items()])
    )
