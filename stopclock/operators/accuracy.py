"""Accuracy tables over scored rows.

Errors are whole seconds, so every table starts from counts per distinct error: one small
map-side combining aggregate, after which percentiles stay exact at any group size.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.functions.quantiles import count_values, counted_percentile

ARRIVAL_HORIZON = ["start_date", "trip_id", "stop_sequence", "horizon_minutes"]


def weighted_mean(value: Column, where: Column | None = None) -> Column:
    n = F.col("_n") if where is None else F.when(where, F.col("_n"))
    return F.sum(value * n) / F.sum(n)


def summarise(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, MAE, median, p90 and bias in seconds per key."""
    counted = count_values(scored, keys, "error_seconds")
    size = F.abs("error_seconds")
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        weighted_mean(size).alias("mae_seconds"),
        counted_percentile(size, 0.5).alias("median_seconds"),
        counted_percentile(size, 0.9).alias("p90_seconds"),
        weighted_mean(F.col("error_seconds")).alias("bias_seconds"),
    )


def label_filter(scored: DataFrame, max_ping_gap: int | None, comparable: bool = True) -> DataFrame:
    """Well observed arrivals, and by default those predicted at every horizon. A null gap is out."""
    if comparable:
        scored = scored.where("has_all_horizons")
    if max_ping_gap is not None:
        scored = scored.where(F.col("ping_gap_seconds") <= max_ping_gap)
    return scored


def matched(scored: DataFrame, required: int | None = None) -> DataFrame:
    """Rows of the (arrival, horizon) pairs every source predicted.

    `required` defaults to the number of sources present in `scored`, so filter to the
    window first and to a time band afterwards. One window per pair, which holds at most
    one row per source, replaces the aggregate and the join back.
    """
    sources = F.lit(required) if required is not None else scored.agg(F.count_distinct("source")).scalar()
    per_pair = F.size(F.collect_set("source").over(Window.partitionBy(*ARRIVAL_HORIZON)))
    return scored.withColumn("_sources", per_pair).where(F.col("_sources") == sources).drop("_sources")


def coverage_by_source(scored: DataFrame, base: str, other: str) -> DataFrame:
    """Rows two sources predicted per horizon, before matching, and their ratio."""
    a, b = F.count_if(F.col("source") == base), F.count_if(F.col("source") == other)
    return scored.groupBy("horizon_minutes").agg(
        a.alias(f"{base}_rows"),
        b.alias(f"{other}_rows"),
        F.round(100.0 * b / F.nullif(a, F.lit(0)), 1).alias(f"{other}_coverage_pct"),
    )


def histogram(scored: DataFrame, keys: list[str], width: int = 60, top: int = 600) -> DataFrame:
    """Counts by upper bound; everything from `top` on is in the last bucket, once."""
    buckets = top // width
    bound = F.least(F.floor(F.col("abs_error_seconds") / width) + 1, F.lit(buckets)) * width
    return scored.groupBy(*keys, bound.cast("int").alias("upper_bound_seconds")).agg(F.count(F.lit(1)).alias("n"))


def bias_tables(scored: DataFrame, horizon: int, max_ping_gap: int) -> tuple[DataFrame, DataFrame]:
    """Bias per (stop, route) and per route; the second is rolled up from the first."""
    from stopclock.fixed import AGENCY

    rows = scored.where(
        (F.col("source") == AGENCY)
        & (F.col("horizon_minutes") == horizon)
        & (F.col("ping_gap_seconds") <= max_ping_gap)
        & F.col("route_id").isNotNull()
    )
    sums = rows.groupBy("stop_id", "route_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("error_seconds").alias("_sum")
    )
    pair = sums.select("stop_id", "route_id", "n", (F.col("_sum") / F.col("n")).alias("bias"))
    route = sums.groupBy("route_id").agg(
        F.sum("n").alias("n"), (F.sum("_sum") / F.sum("n")).alias("bias")
    )
    return pair, route


def horizon_series(summary: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """One row per horizon, one column of MAE minutes per source."""
    return summary.groupBy("horizon_minutes").pivot("source", list(sources)).agg(F.max(F.col("mae_seconds") / 60))


def improvement(summary: DataFrame, base: str, other: str) -> DataFrame:
    """Seconds by which `other` beats `base` per horizon, where both are present."""

    def of(source: str, column: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col(column)))

    return (
        summary.groupBy("horizon_minutes")
        .agg(of(base, "mae_seconds").alias("_a"), of(other, "mae_seconds").alias("_b"), of(base, "n").alias("n"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select("horizon_minutes", (F.col("_a") - F.col("_b")).alias("delta_seconds"), "n")
    )


def best_source(summary: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Source with the lowest MAE per horizon; on a tie the earlier one in `order`."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    known = summary.where(F.col("source").isin(*order))
    return known.groupBy("horizon_minutes").agg(
        F.min_by("source", F.struct("mae_seconds", rank.alias("r"))).alias("best_source")
    )


def mae_json(summary: DataFrame) -> DataFrame:
    """{source: {horizon: rounded MAE}} as one JSON text; at most sources x horizons entries."""
    inner = summary.groupBy("source").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("horizon_minutes").cast("string"), F.round("mae_seconds").cast("int"))
                )
            )
        ).alias("by_horizon")
    )
    entries = F.array_sort(F.collect_list(F.struct("source", F.to_json("by_horizon").alias("j"))))
    parts = F.transform(entries, lambda e: F.concat(F.lit('"'), e["source"], F.lit('":'), e["j"]))
    return inner.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("mae_by_horizon"))
