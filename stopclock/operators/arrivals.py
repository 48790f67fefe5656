"""When a vehicle reached each stop."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import AT_STOP_M, DWELL_RADIUS_M
from stopclock.functions.geo import interpolate_time
from stopclock.operators.tracks import RUN, build_track, primary_vehicles
from stopclock.session import written

SHAPE = ("feed_version", "shape_id")
#: Length of the stretches by which stops and runs meet, and the number told apart on either side of a route's begin.
STRETCH_M, STRETCHES = 4000.0, 1 << 14


def find_arrivals(
    track: DataFrame, stops: DataFrame, dwell_radius_m: float = DWELL_RADIUS_M, at_stop_m: float = AT_STOP_M
) -> DataFrame:
    """Arrivals at the stops a track brackets: dwell, else a ping on the stop, else interpolated.

    `track` is RUN, point, ts_us, offset_m with offsets non-decreasing in `point`; `stops` is
    RUN, stop_sequence, stop_id, offset_m. A stop nothing brackets yields no row.

    As offsets never decrease, the points within the dwell radius of a stop are one unbroken
    run and the bracketing pair is the neighbours of the stop in offset order. So stops are
    merged into the track as probes at the stop and at both edges of its radius, and two
    running windows find the neighbours. No stop is paired with more than its neighbours.
    """
    by_point = Window.partitionBy(*RUN).orderBy("point")
    fresh = F.coalesce(F.col("offset_m") != F.lag("offset_m").over(by_point), F.lit(True))
    points = track.select(
        *RUN,
        F.col("offset_m").alias("at_m"),
        F.lit(1).alias("rank"),
        "point",
        F.struct(
            "point",
            "ts_us",
            "offset_m",
            F.last(F.when(fresh, F.col("ts_us")), ignorenulls=True)
            .over(by_point.rowsBetween(Window.unboundedPreceding, 0))
            .alias("first_us"),
            F.lead("ts_us").over(by_point).alias("next_us"),
        ).alias("here"),
        F.lit(None).cast("struct<stop_sequence:int,stop_id:string,offset_m:double,probe:string>").alias("stop"),
    )
    target = F.col("offset_m").cast("double")
    radius = F.lit(float(dwell_radius_m))

    def probe(name: str, at: Column, rank: int) -> Column:
        return F.struct(F.lit(name).alias("probe"), at.alias("at_m"), F.lit(rank).alias("rank"))

    probes = (
        stops.where(F.col("offset_m").isNotNull())
        .withColumn(
            "_p",
            F.explode(
                F.array(probe("enter", target - radius, 0), probe("stop", target, 0), probe("leave", target + radius, 2))
            ),
        )
        .select(
            *RUN,
            "_p.at_m",
            "_p.rank",
            F.lit(-1).alias("point"),
            F.lit(None).cast(points.schema["here"].dataType).alias("here"),
            F.struct(
                F.col("stop_sequence").cast("int").alias("stop_sequence"), "stop_id", target.alias("offset_m"), "_p.probe"
            ).alias("stop"),
        )
    )
    run = Window.partitionBy(*RUN)
    forward = run.orderBy("at_m", "rank", "point").rowsBetween(Window.unboundedPreceding, 0)
    backward = run.orderBy(F.desc("at_m"), F.desc("rank"), F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        points.unionByName(probes)
        .withColumn("before", F.last("here", ignorenulls=True).over(forward))
        .withColumn("after", F.last("here", ignorenulls=True).over(backward))
        .where(F.col("stop").isNotNull())
    )

    def at(name: str, value: str) -> Column:
        return F.max(F.when(F.col("stop.probe") == name, F.col(value)))

    found = seen.groupBy(*RUN, F.col("stop.stop_sequence").alias("stop_sequence")).agg(
        F.max("stop.stop_id").alias("stop_id"),
        F.max("stop.offset_m").alias("stop_offset_m"),
        at("enter", "after").alias("entered"),
        at("leave", "before").alias("left"),
        at("stop", "before").alias("before"),
        at("stop", "after").alias("after"),
    )
    goal = F.col("stop_offset_m")
    to_before, to_after = goal - F.col("before.offset_m"), F.col("after.offset_m") - goal
    dwell = F.col("left.point") > F.col("entered.point")
    between = F.col("before").isNotNull() & F.col("after").isNotNull()
    on_first = F.col("before").isNull() & (to_after == 0) & F.col("after.next_us").isNotNull()
    nearest = F.least(to_before, to_after)
    gap_us = F.when(between, F.col("after.ts_us") - F.col("before.ts_us")).otherwise(
        F.col("after.next_us") - F.col("after.ts_us")
    )
    at_ping = F.when(to_before <= to_after, F.col("before.first_us")).otherwise(F.col("after.ts_us"))
    passed = interpolate_time(
        F.col("before.ts_us"), F.col("after.ts_us"), F.col("before.offset_m"), F.col("after.offset_m"), goal
    )
    return (
        found.where(F.coalesce(dwell, F.lit(False)) | between | on_first)
        .withColumn("_dwell", F.coalesce(dwell, F.lit(False)))
        .withColumn("nearest_ping_m", nearest)
        .withColumn(
            "method",
            F.when(F.col("_dwell"), "dwell").when(nearest <= at_stop_m, "at_ping").otherwise("interpolated"),
        )
        .withColumn(
            "arrived_us",
            F.when(F.col("_dwell"), F.col("entered.ts_us"))
            .when(F.col("method") == "at_ping", at_ping)
            .otherwise(passed),
        )
        .select(
            *RUN,
            "stop_sequence",
            "stop_id",
            F.timestamp_micros("arrived_us").alias("arrived_at"),
            F.when(
                F.col("_dwell") & (F.col("left.ts_us") > F.col("entered.ts_us")), F.timestamp_micros("left.ts_us")
            ).alias("departed_at"),
            "method",
            F.when(F.col("_dwell"), F.lit(0)).otherwise(F.bround(gap_us / 1e6)).cast("int").alias("ping_gap_seconds"),
            "nearest_ping_m",
            "stop_offset_m",
        )
    )


def infer_arrivals(
    positions: DataFrame, trips: DataFrame, shapes: DataFrame, stop_times: DataFrame, version: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(arrivals, outcome log) of every trip run, one vehicle each.

    The schedule frames hold one version, or several with `version` choosing; a trip that is in several versions without
    one being chosen is an error. `stop_times` states stops by trip_id, or by shape_id where all trips of a shape make the
    same stops: then they are read once for a shape and not once for each of its trips. Every run gets a log row, also those without pings, shape, stops or arrivals. Runs, their
    valid pings and the track are written once, to the session's shared folder; arrivals and log both read them.
    """
    if version is not None:
        pick = F.col("feed_version") == version
        trips, shapes, stop_times = trips.where(pick), shapes.where(pick), stop_times.where(pick)
    chosen = primary_vehicles(positions)
    running = written(chosen.join(_one_version(trips), "trip_id", "left"), "runs")
    valid = written(
        positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .join(running.select(*RUN, *SHAPE), RUN)
        .select(*RUN, "ts", "lat", "lon", *SHAPE),
        "pings",
    )
    points = shapes.where(F.col("shape_dist_traveled_m").isNotNull()).select(
        *SHAPE,
        "shape_pt_sequence",
        F.col("shape_pt_lat").alias("lat"),
        F.col("shape_pt_lon").alias("lon"),
        F.col("shape_dist_traveled_m").alias("offset_m"),
    )
    stops = stop_times.where(F.col("shape_dist_traveled_m").isNotNull()).select(
        *_stops_key(stop_times), "stop_sequence", "stop_id", F.col("shape_dist_traveled_m").alias("offset_m")
    )
    track = written(build_track(valid.where(F.col("shape_id").isNotNull()), points, on=SHAPE), "track")
    passed = track.where("on_route")
    found = find_arrivals(passed, stops_in_reach(passed, running, stops))
    arrivals = found.join(running.select(*RUN, "feed_version"), RUN)
    return arrivals, _outcomes(running, valid, points, stops, track, arrivals)


def _stops_key(stops: DataFrame) -> list[str]:
    return ["feed_version", "trip_id" if "trip_id" in stops.columns else "shape_id"]


def stops_in_reach(track: DataFrame, running: DataFrame, stops: DataFrame, dwell_radius_m: float = DWELL_RADIUS_M) -> DataFrame:
    """RUN, stop_sequence, stop_id, offset_m of the stops a run's track comes within the dwell radius of or passes. No other
    stop can have an arrival, so what is merged into tracks grows with arrivals and not with trips times stops. Stops meet
    runs by the stretch of the route they lie in; those beyond the last stretch share it."""
    key = _stops_key(stops)
    radius = F.lit(float(dwell_radius_m))

    def stretch(at: Column) -> Column:
        return F.floor(F.greatest(F.least(at / STRETCH_M, F.lit(float(STRETCHES))), F.lit(-float(STRETCHES))))

    extent = track.groupBy(*RUN).agg((F.min("offset_m") - radius).alias("_low"), (F.max("offset_m") + radius).alias("_high"))
    runs = (
        running.select(*dict.fromkeys([*RUN, *key]))
        .join(extent, RUN)
        .withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_low")), stretch(F.col("_high")))))
    )
    placed = stops.withColumn("_stretch", stretch(F.col("offset_m").cast("double")))
    near = runs.join(placed, [*key, "_stretch"]).where(F.col("offset_m").between(F.col("_low"), F.col("_high")))
    return near.select(*RUN, "stop_sequence", "stop_id", "offset_m")


def _one_version(trips: DataFrame) -> DataFrame:
    """trip_id with its version and shape; a trip of several versions stops the job."""
    one = trips.groupBy("trip_id").agg(
        F.min(F.struct(*SHAPE)).alias("_one"), F.min("feed_version").alias("_lo"), F.max("feed_version").alias("_hi")
    )
    several = F.raise_error(F.concat(F.lit("trip "), "trip_id", F.lit(" is in several schedule versions: choose one")))
    version = F.when(F.col("_lo") < F.col("_hi"), several).otherwise(F.col("_one.feed_version"))
    return one.select("trip_id", version.alias("feed_version"), F.col("_one.shape_id").alias("shape_id"))


def _outcomes(running, valid, points, stops, track, arrivals) -> DataFrame:
    """One row per run. What is known of a run is counted by run in one aggregate over all sources."""
    count = F.count(F.lit(1))
    zero = F.lit(0).cast("bigint")

    def told(df: DataFrame, **counts) -> DataFrame:
        names = ("_valid", "_used", "offroute_pings", "clamped_pings", "arrivals_written")
        return df.groupBy(*RUN).agg(*[counts.get(n, F.max(zero)).alias(n) for n in names])

    parts = told(valid, _valid=count).unionByName(
        told(
            track,
            _used=F.count_if("on_route"),
            offroute_pings=F.count_if(~F.col("on_route")),
            clamped_pings=F.count_if("clamped"),
        )
    ).unionByName(told(arrivals, arrivals_written=count))
    per_run = parts.groupBy(*RUN).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in RUN])
    log = (
        running.select(*RUN, "skipped_vehicles", *SHAPE)
        .join(per_run, RUN, "left")
        .join(points.groupBy(*SHAPE).agg(count.alias("_points")), list(SHAPE), "left")
        .join(stops.groupBy(*_stops_key(stops)).agg(count.alias("stops_total")), _stops_key(stops), "left")
        .fillna(0)
    )
    status = (
        F.when(F.col("_valid") == 0, "no_pings")
        .when(F.col("_points") < 2, "no_shape")
        .when(F.col("stops_total") == 0, "no_stops")
        .when(F.col("arrivals_written") == 0, "no_arrivals")
        .otherwise("ok")
    )
    return log.withColumn("status", status).select(
        *RUN,
        F.when(F.col("status").isin("no_shape", "no_stops"), F.col("_valid")).otherwise(F.col("_used")).alias("pings"),
        "stops_total",
        "arrivals_written",
        (F.col("stops_total") - F.col("arrivals_written")).alias("stops_skipped"),
        "offroute_pings",
        "clamped_pings",
        "skipped_vehicles",
        "status",
    )


def run_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("arrivals_written").alias("arrivals"),
        F.sum("stops_skipped").alias("skipped_stops"),
        F.sum("offroute_pings").alias("offroute_pings"),
        F.sum("clamped_pings").alias("clamped"),
        F.sum("skipped_vehicles").alias("secondary_vehicles_skipped"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("ok", "no_pings", "no_shape", "no_stops", "no_arrivals")],
    )
