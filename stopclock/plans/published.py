"""The published queries: one lazy DataFrame each, every parameter explicit."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import (
    AGENCY,
    BIAS_HORIZON_MINUTES,
    GAP_SECONDS,
    MIN_STOP_ROUTE_SAMPLE,
    TIGHT_LABEL_SECONDS,
    TREES,
    VEHICLE_POSITIONS,
)
from stopclock.functions.clock import plus_seconds, scheduled_instant
from stopclock.functions.labels import (
    checked_band,
    checked_source,
    choose_bias,
    correction_is_meaningful,
    in_time_band,
    label_quality,
    name_contains,
)
from stopclock.functions.ordering import lag_within_feed
from stopclock.operators.accuracy import bias_tables, histogram, label_filter, matched, summarise
from stopclock.operators.vehicles import fresh, latest_positions, one_per_id


def _rows() -> Column:
    return F.count(F.lit(1))


def latest_run(runs: DataFrame) -> Column:
    """The newest model run as a struct column, null when there is none."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "trained_at")).scalar()


def resolve_window(scored: DataFrame, runs: DataFrame) -> DataFrame:
    """The days every comparison uses: the newest run's test window, else all scored days. One row."""
    span = scored.agg(F.struct(F.min("start_date").alias("lo"), F.max("start_date").alias("hi"))).scalar()
    one = scored.sparkSession.range(1).select(latest_run(runs).alias("run"), span.alias("span"))
    has_run = F.col("run").isNotNull()
    return one.select(
        F.coalesce("run.test_from", "span.lo").alias("test_from"),
        F.coalesce("run.test_to", "span.hi").alias("test_to"),
        F.col("run.train_from").alias("train_from"),
        F.col("run.train_to").alias("train_to"),
        F.when(has_run, "latest model run")
        .when(F.col("span.lo").isNotNull(), "all scored data, no model run found")
        .otherwise("no data")
        .alias("source_of_window"),
    )


def in_window(scored: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Rows of the newest run's test days; without any run every row is in the window."""
    if runs is None:
        return scored
    window = runs.agg(F.max_by(F.struct("test_from", "test_to"), "trained_at").alias("w")).select(
        F.coalesce("w.test_from", F.to_date(F.lit("0001-01-01"))).alias("lo"),
        F.coalesce("w.test_to", F.to_date(F.lit("9999-12-31"))).alias("hi"),
    )
    return scored.where(F.col("start_date").between(window.select("lo").scalar(), window.select("hi").scalar()))


def headline(
    scored: DataFrame,
    runs: DataFrame | None = None,
    max_ping_gap: int = TIGHT_LABEL_SECONDS,
    time_band: str = "all",
) -> DataFrame:
    """Accuracy per source and horizon on the rows every source predicted.

    The matched population is settled over the window first and the band applied after it.
    """
    checked_band(time_band)
    population = matched(label_filter(in_window(scored, runs), max_ping_gap))
    return summarise(population.where(in_time_band("service_minute", time_band)), ["source", "horizon_minutes"]).orderBy(
        "source", "horizon_minutes"
    )


def routes(
    scored: DataFrame,
    route_names: DataFrame,
    runs: DataFrame | None = None,
    horizon: int = 10,
    min_n: int = 100,
    max_ping_gap: int = TIGHT_LABEL_SECONDS,
    compare: str = TREES,
    time_band: str = "all",
) -> DataFrame:
    """Agency against another predictor per route, matched rows only, worst agency MAE first."""
    checked_source(compare)
    checked_band(time_band)
    rows = label_filter(in_window(scored, runs), max_ping_gap).where(
        (F.col("horizon_minutes") == horizon) & F.col("route_id").isNotNull()
    )
    rows = matched(rows).where(in_time_band("service_minute", time_band))
    agency, other = F.col("source") == AGENCY, F.col("source") == compare
    size = F.col("abs_error_seconds")
    sums = rows.groupBy("feed_version", "route_id").agg(
        F.count_if(agency).alias("_n"),
        F.sum(F.when(agency, size)).alias("_a"),
        F.count_if(other).alias("_m"),
        F.sum(F.when(other, size)).alias("_b"),
    )
    named = sums.join(route_names.select("feed_version", "route_id", "route_long_name"), ["feed_version", "route_id"], "left")
    n, m = F.sum("_n"), F.sum("_m")
    return (
        named.groupBy("route_id")
        .agg(
            F.max("route_long_name").alias("route_name"),
            n.alias("n"),
            (F.sum("_a") / F.nullif(n, F.lit(0))).alias("mts_mae_seconds"),
            (F.sum("_b") / F.nullif(m, F.lit(0))).alias("model_mae_seconds"),
        )
        .where(F.col("n") >= min_n)
        .withColumn("improvement_seconds", F.col("mts_mae_seconds") - F.col("model_mae_seconds"))
        .orderBy(F.desc("mts_mae_seconds"), "route_id")
    )


ROUTE_ORDERS = {"mts": "mts_mae_seconds", "ours": "model_mae_seconds", "delta": "improvement_seconds", "n": "n"}


def order_routes(table: DataFrame, by: str) -> DataFrame:
    """The route table by a chosen figure, largest first, absent figures as 0."""
    if by not in ROUTE_ORDERS:
        raise ValueError(f"unknown order {by!r}, expected one of {', '.join(ROUTE_ORDERS)}")
    return table.orderBy(F.coalesce(F.col(ROUTE_ORDERS[by]), F.lit(0)).desc(), "route_id")


def error_distribution(
    scored: DataFrame,
    runs: DataFrame | None = None,
    horizon: int = 10,
    max_ping_gap: int = TIGHT_LABEL_SECONDS,
    time_band: str = "all",
) -> DataFrame:
    """Rows per source and minute of absolute error. Not matched, on purpose."""
    checked_band(time_band)
    rows = label_filter(in_window(scored, runs), max_ping_gap).where(
        (F.col("horizon_minutes") == horizon) & in_time_band("service_minute", time_band)
    )
    return histogram(rows, ["source"]).orderBy("source", "upper_bound_seconds")


def collection_coverage(polls: DataFrame, feed: str = VEHICLE_POSITIONS, gap_limit: int = GAP_SECONDS) -> DataFrame:
    """Per day: successful polls, hours lost in long gaps, coverage. A gap counts on its later poll's day."""
    good = polls.where(F.col("status").isin("ok", "skipped_unchanged") & (F.col("feed") == feed)).select("feed", "started_at")
    gap = (F.unix_micros("started_at") - F.unix_micros("_prev")) / F.lit(1e6)
    rows = lag_within_feed(good, ["feed"], "started_at", "_prev").select(
        F.to_date("started_at").alias("day"), "started_at", gap.alias("gap")
    )
    lost = F.coalesce(F.sum(F.when(F.col("gap") > gap_limit, F.col("gap"))), F.lit(0.0))
    span = (F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))) / F.lit(1e6)
    return (
        rows.groupBy("day")
        .agg(
            _rows().alias("successful_polls"),
            (lost / 3600).alias("hours_lost"),
            (100 * (1 - lost / F.nullif(span, F.lit(0.0)))).alias("coverage_pct"),
        )
        .orderBy("day")
    )


def worst_lost_share(coverage: DataFrame) -> DataFrame:
    """The largest share lost on any measurable day, at least 0."""
    return coverage.agg(F.greatest(F.max(100 - F.col("coverage_pct")), F.lit(0.0)).alias("worst_lost_pct"))


def label_bands(arrivals: DataFrame, names: str = "page") -> DataFrame:
    """Arrivals per label-quality band with their share; the total is over at most five bands."""
    counts = arrivals.groupBy(label_quality("ping_gap_seconds", names).alias("band")).agg(_rows().alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "band")


def data_quality(polls: DataFrame, arrivals: DataFrame) -> dict[str, DataFrame]:
    return {
        "coverage": collection_coverage(polls),
        "label_bands": label_bands(arrivals),
        "arrivals_total": arrivals.agg(_rows().alias("arrivals_total")),
    }


def model_run(runs: DataFrame) -> DataFrame:
    """The newest run with its feature list read back from JSON; no row when there is none."""
    newest = runs.agg(F.max_by(F.struct(*runs.columns), "trained_at").alias("run")).where(F.col("run").isNotNull())
    keep = ("trained_at", "train_from", "train_to", "test_from", "test_to", "train_rows", "test_rows")
    return newest.select(
        *[F.col(f"run.{c}").alias(c) for c in keep],
        F.from_json("run.features", "array<string>").alias("features"),
        F.col("run.notes").alias("notes"),
    )


def _stop_counts(arrivals: DataFrame, stops: DataFrame) -> DataFrame:
    per_version = arrivals.groupBy("feed_version", "stop_id").agg(_rows().alias("_n"))
    placed = stops.where(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull())
    return (
        per_version.join(placed, ["feed_version", "stop_id"])
        .groupBy("stop_id")
        .agg(
            F.max("stop_name").alias("stop_name"),
            F.max("stop_lat").alias("lat"),
            F.max("stop_lon").alias("lon"),
            F.sum("_n").alias("arrivals"),
        )
    )


def stops(arrivals: DataFrame, stop_table: DataFrame, limit: int = 2000) -> DataFrame:
    """Stops with arrivals and a place, busiest first."""
    return _stop_counts(arrivals, stop_table).orderBy(F.desc("arrivals"), "stop_id").limit(limit)


def stop_search(arrivals: DataFrame, stop_table: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Stops whose name contains the text, busiest first."""
    if limit > 50:
        raise ValueError("limit must be at most 50")
    hits = stop_table.where(name_contains("stop_name", query))
    return _stop_counts(arrivals, hits).orderBy(F.desc("arrivals"), "stop_id").limit(limit)


def recent_at_stops(
    scored: DataFrame, stop_times: DataFrame, horizon: int = 10, limit: int = 25, compare: str = TREES
) -> DataFrame:
    """For every stop its latest arrivals with both predictions side by side.

    The rank filter is applied per map task before the shuffle too, so a busy stop sends on
    no more than `limit` rows per task.
    """
    checked_source(compare)
    rows = scored.where(F.col("horizon_minutes") == horizon)

    def of(source: str, column: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col(column)))

    visits = rows.groupBy(
        "stop_id", "trip_id", "route_id", "stop_sequence", "arrived_at", "horizon_minutes", "feed_version"
    ).agg(
        of(AGENCY, "predicted_arrival").alias("mts_predicted"),
        of(compare, "predicted_arrival").alias("model_predicted"),
        of(AGENCY, "error_seconds").alias("mts_error_seconds"),
        of(compare, "error_seconds").alias("model_error_seconds"),
        F.max("start_date").alias("start_date"),
    )
    latest = Window.partitionBy("stop_id").orderBy(F.desc("arrived_at"), "trip_id", "stop_sequence", "feed_version")
    top = visits.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= limit)
    return (
        top.join(
            stop_times.select("feed_version", "trip_id", "stop_sequence", "arrival_seconds"),
            ["feed_version", "trip_id", "stop_sequence"],
            "left",
        )
        .withColumn("scheduled_at", scheduled_instant("start_date", "arrival_seconds"))
        .drop("arrival_seconds", "feed_version", "start_date")
    )


def stop_detail(
    scored: DataFrame, stop_times: DataFrame, stop_id: str, horizon: int = 10, limit: int = 25, compare: str = TREES
) -> DataFrame:
    """One stop's latest arrivals."""
    return recent_at_stops(scored.where(F.col("stop_id") == stop_id), stop_times, horizon, limit, compare).orderBy("recency")


def stop_name(stop_table: DataFrame, stop_id: str) -> DataFrame:
    return stop_table.where(F.col("stop_id") == stop_id).agg(
        F.max("stop_name").alias("stop_name"), F.max("stop_lat").alias("lat"), F.max("stop_lon").alias("lon")
    )


def upcoming(
    predictions: DataFrame,
    trips: DataFrame,
    route_table: DataFrame,
    scored: DataFrame,
    as_of: Column,
    limit: int = 8,
    horizon: int = BIAS_HORIZON_MINUTES,
    min_sample: int = MIN_STOP_ROUTE_SAMPLE,
) -> DataFrame:
    """For every stop its next services with the agency's time and one corrected by measured bias.

    The latest revision of a run's call is picked before past ones are dropped, so a withdrawn
    older revision cannot come back, and the bias is looked up by the route the trip has. A run that
    began over two days before `as_of` is over; its partitions are not read. Revisions are first combined route by route,
    in numbers only, which takes a hash table and no sort of them all; headsigns are looked up for the next services only.
    """
    pair_bias, route_bias = bias_tables(scored, horizon, TIGHT_LABEL_SECONDS)
    latest = (
        predictions.where(F.col("arrival_time").isNotNull() & (F.col("start_date") >= F.to_date(as_of) - 2))
        .groupBy("stop_id", "start_date", "trip_id", "stop_sequence", "route_id")
        .agg(F.max_by("arrival_time", "observed_at").alias("arrival_time"), F.max("observed_at").alias("observed_at"))
        .groupBy("stop_id", "start_date", "trip_id", "stop_sequence")
        .agg(F.max_by(F.struct("route_id", "arrival_time", "observed_at"), "observed_at").alias("_p"))
        .select("stop_id", "start_date", "trip_id", "stop_sequence", "_p.*")
        .where(F.col("arrival_time") > as_of)
    )
    order = Window.partitionBy("stop_id").orderBy("arrival_time", "trip_id", "stop_sequence", "start_date")
    next_ones = latest.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    versions = trips.select("trip_id", "feed_version", F.struct("trip_headsign", F.col("route_id").alias("_route")).alias("_trip"))
    headed = (
        next_ones.join(versions, "trip_id", "left")
        .groupBy(*next_ones.columns)
        .agg(F.min_by("_trip", "feed_version").alias("_trip"))
        .select(*next_ones.columns, "_trip.*")
    )
    route_side = one_per_id(route_table, "route_id", ["route_short_name", "route_type"])
    chosen = choose_bias(
        F.col("_pn"), F.col("_pb"), F.col("_rn"), F.col("_rb"), min_sample, max(min_sample * 3, 1)
    )
    return (
        headed.withColumn("route_id", F.coalesce("route_id", "_route"))
        .join(route_side, "route_id", "left")
        .join(pair_bias.select("stop_id", "route_id", F.col("n").alias("_pn"), F.col("bias").alias("_pb")), ["stop_id", "route_id"], "left")
        .join(route_bias.select("route_id", F.col("n").alias("_rn"), F.col("bias").alias("_rb")), "route_id", "left")
        .withColumn("_c", chosen)
        .select(
            "stop_id",
            "position",
            "trip_id",
            "route_id",
            "route_short_name",
            "route_type",
            F.col("trip_headsign").alias("headsign"),
            "stop_sequence",
            F.col("arrival_time").alias("mts_arrival"),
            F.col("observed_at").alias("predicted_at"),
            plus_seconds("arrival_time", -F.col("_c.bias")).alias("corrected_arrival"),
            (-F.col("_c.bias")).alias("correction_seconds"),
            F.col("_c.basis").alias("correction_basis"),
            F.col("_c.sample").alias("correction_sample"),
            correction_is_meaningful(-F.col("_c.bias")).alias("correction_is_meaningful"),
        )
    )


def stop_upcoming(predictions: DataFrame, trips, route_table, scored, stop_id: str, as_of: Column, **options) -> DataFrame:
    """One stop's next services."""
    here = predictions.where(F.col("stop_id") == stop_id)
    return upcoming(here, trips, route_table, scored, as_of, **options).orderBy("position")


def vehicles(positions: DataFrame, route_table: DataFrame, as_of: Column, max_age_minutes: int = 15) -> DataFrame:
    """The latest fresh position of each vehicle with its route's name."""
    names = one_per_id(route_table, "route_id", ["route_short_name", "route_type"])
    return latest_positions(fresh(positions, as_of, max_age_minutes)).join(names, "route_id", "left")


def route_shapes(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each route's most used shape (the lowest id on a tie) and its points, of one schedule version."""
    used = trips.where(F.col("shape_id").isNotNull()).groupBy("route_id", "shape_id").agg(_rows().alias("_n"))
    chosen = used.groupBy("route_id").agg(F.min(F.struct((-F.col("_n")).alias("n"), "shape_id")).alias("_s")).select(
        "route_id", F.col("_s.shape_id").alias("shape_id")
    )
    return chosen.join(shapes, "shape_id").select(
        "route_id", "shape_id", "shape_pt_sequence", F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon")
    )


def route_shape(trips: DataFrame, shapes: DataFrame, route_id: str) -> DataFrame:
    """One route's points in order; a route without a shape is an error."""
    points = route_shapes(trips.where(F.col("route_id") == route_id), shapes).orderBy("shape_pt_sequence")
    if points.isEmpty():
        raise LookupError(f"no shape for route {route_id}")
    return points.select("lat", "lon")
