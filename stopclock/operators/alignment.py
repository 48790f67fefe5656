"""Recovering stop sequences of predictions that come without one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.operators.service_days import trip_windows, with_service_day


def align(feed_stops: Column, stop_ids: Column, sequences: Column) -> Column:
    """Ordered feed stop ids against a schedule's ordered stop ids and sequences, as array<int>.

    Both lists are walked forward together, so a stop visited twice resolves to a different
    call each time; a stop with no match ahead is null and does not move the position.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, stop: Column) -> Column:
        ahead = F.slice(stop_ids, state["at"] + 1, F.size(stop_ids))
        hit = F.array_position(ahead, F.coalesce(stop, F.lit(""))).cast("int")
        reached = state["at"] + hit
        matched = F.when(hit > 0, F.get(sequences, reached - 1))
        return F.struct(
            F.when(hit > 0, reached).otherwise(state["at"]).alias("at"),
            F.concat(state["found"], F.array(matched)).alias("found"),
        )

    return F.aggregate(feed_stops, start, step, lambda state: state["found"])


def scheduled_stops(stop_times: DataFrame, keys: tuple[str, ...] = ("trip_id",), **more: Column) -> DataFrame:
    """Each trip's stop ids and sequences in order; a trip's length is set by the schedule. `more` are aggregates of the
    same rows, such as a trip's first second."""
    stops = F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").cast("int").alias("stop_sequence"), "stop_id")))
    return (
        stop_times.groupBy(*keys)
        .agg(stops.alias("_stops"), *[value.alias(name) for name, value in more.items()])
        .select(*keys, F.col("_stops.stop_id").alias("stop_ids"), F.col("_stops.stop_sequence").alias("sequences"), *more)
    )


def resolve_predictions(rows: DataFrame, stop_times: DataFrame | None, poll: str = "observed_at") -> DataFrame:
    """Fill in `stop_sequence`; refused rows carry a `reason`.

    `stop_times` is one schedule version, None when none is loaded, or its `trip_stops`: the same, put together by trip
    when it was loaded. Rows that already have
    a sequence pass untouched. The service day is settled before a trip's stops are put
    together, and only the stops of one trip in one poll are, in feed order.
    """
    keyed = rows.where(F.col("stop_sequence").isNotNull()).withColumn("reason", F.lit(None).cast("string"))
    open_rows = rows.where(F.col("stop_sequence").isNull())
    if stop_times is None:
        return keyed.unionByName(open_rows.withColumn("reason", F.lit("no_schedule_loaded")))

    group = list(dict.fromkeys([poll, "start_date", "trip_id"]))
    carried = [c for c in rows.columns if c not in (*group, "stop_sequence", "feed_order")]
    ready = "stop_ids" in stop_times.columns
    windows = stop_times.select("trip_id", "first_seconds", "last_seconds") if ready else trip_windows(stop_times)
    stops = stop_times.select("trip_id", "stop_ids", "sequences") if ready else scheduled_stops(stop_times)
    settled = with_service_day(open_rows, windows, "observed_at").drop("stored_date")
    lists = settled.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("feed_order", *carried))).alias("_rows")
    )
    aligned = (
        lists.join(stops, "trip_id", "left")
        .withColumn("_known", F.col("stop_ids").isNotNull())
        .withColumn("_found", align(F.col("_rows.stop_id"), F.col("stop_ids"), F.col("sequences")))
        .select(*group, "_known", "_found", F.posexplode("_rows").alias("_at", "_row"))
        .withColumn("stop_sequence", F.get("_found", F.col("_at")))
    )
    reason = F.when(~F.col("_known"), "trip_not_in_schedule").when(F.col("stop_sequence").isNull(), "stop_not_on_trip")
    resolved = aligned.select(
        *group,
        "stop_sequence",
        F.col("_row.feed_order").alias("feed_order"),
        *[F.col(f"_row.{c}").alias(c) for c in carried],
        reason.alias("reason"),
    )
    return keyed.unionByName(resolved)


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """Rows by outcome with their share."""
    counts = resolved.groupBy(F.coalesce("reason", F.lit("resolved")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("rows") / total)
