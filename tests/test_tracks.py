import datetime as dt
import math
import random

import numpy as np
import pytest
from tests.conftest import day, utc
from pyspark.sql import functions as F

from stopclock.functions import geo
from stopclock.operators import arrivals as A
from stopclock.operators import tracks as T

DAY, START = day("2026-10-01"), utc("2026-10-01 19:00:00")
LAT0, LON0, PER_LAT, PER_LON = 32.70, -117.16, 111_194.93, 93_675.0


def shape(spark, points=None):
    points = points or [(i * 250.0, 0.0, i * 250.0) for i in range(21)]
    rows = [("t", i, LAT0 + n / PER_LAT, LON0 + e / PER_LON, m) for i, (n, e, m) in enumerate(points)]
    return spark.createDataFrame(rows, "trip_id string, shape_pt_sequence int, lat double, lon double, offset_m double")


def pings(spark, spots):
    """spots: (seconds, metres north, metres east)"""
    rows = [(DAY, "t", "bus", START + dt.timedelta(seconds=s), LAT0 + n / PER_LAT, LON0 + e / PER_LON) for s, n, e in spots]
    return spark.createDataFrame(rows, "start_date date, trip_id string, vehicle_id string, ts timestamp, lat double, lon double")


def stops(spark, offsets):
    rows = [(DAY, "t", "bus", i + 1, f"s{i + 1}", float(m)) for i, m in enumerate(offsets)]
    return spark.createDataFrame(rows, "start_date date, trip_id string, vehicle_id string, stop_sequence int, stop_id string, offset_m double")


def run(spark, spots, offsets, points=None):
    track = T.build_track(pings(spark, spots), shape(spark, points))
    found = A.find_arrivals(track.where("on_route"), stops(spark, offsets)).orderBy("stop_sequence").collect()
    return track.orderBy("ts_us").collect(), {r["stop_sequence"]: r for r in found}


def seconds(row):
    return (row["arrived_at"] - START).total_seconds()


def test_projection_on_one_segment(spark):
    start, end = (F.lit(LAT0), F.lit(LON0), F.lit(0.0)), (F.lit(LAT0 + 1000 / PER_LAT), F.lit(LON0), F.lit(1000.0))

    def place(north, east, a=start, b=end):
        offset, away = geo.project_onto_segment(F.lit(LAT0 + north / PER_LAT), F.lit(LON0 + east / PER_LON), a, b)
        return spark.range(1).select(offset, away).first()

    assert place(400, 0)[0] == pytest.approx(400, abs=0.5)
    assert place(400, 50)[1] == pytest.approx(50, abs=0.5)
    assert place(1400, 0) == pytest.approx((1000, 400), abs=0.5)
    assert place(300, 0, start, start) == pytest.approx((0, 300), abs=0.5)


def test_constant_speed_is_interpolated(spark):
    _, got = run(spark, [(0, 0, 0), (60, 600, 0), (120, 1200, 0)], [300, 900])
    assert seconds(got[1]) == pytest.approx(30, abs=0.5) and seconds(got[2]) == pytest.approx(90, abs=0.5)
    assert got[1]["method"] == "interpolated" and got[1]["ping_gap_seconds"] == 60
    assert got[1]["nearest_ping_m"] == pytest.approx(300, abs=1)


def test_dwell_starts_at_its_first_ping(spark):
    _, got = run(spark, [(0, 0, 0), (60, 990, 0), (90, 1000, 0), (120, 1010, 0), (180, 2000, 0)], [1000])
    row = got[1]
    assert (row["method"], seconds(row), row["ping_gap_seconds"]) == ("dwell", 60, 0)
    assert row["departed_at"] == START + dt.timedelta(seconds=120)


def test_one_near_ping_is_no_dwell_but_at_ping(spark):
    _, got = run(spark, [(0, 0, 0), (60, 1005, 0), (120, 2000, 0)], [1000])
    assert (got[1]["method"], seconds(got[1]), got[1]["departed_at"]) == ("at_ping", 60, None)


def test_unbracketed_stops_are_skipped(spark):
    _, got = run(spark, [(0, 500, 0), (60, 1500, 0)], [100, 1000, 3000])
    assert set(got) == {2}


def test_stop_exactly_at_the_first_ping(spark):
    _, got = run(spark, [(0, 500, 0), (60, 1500, 0)], [500])
    assert got[1]["method"] == "at_ping" and seconds(got[1]) == 0 and got[1]["ping_gap_seconds"] == 60


def test_single_ping_gives_nothing(spark):
    assert run(spark, [(0, 500, 0)], [500])[1] == {}


def test_noise_backwards_is_clamped_and_off_route_dropped(spark):
    track, _ = run(spark, [(0, 500, 0), (30, 400, 0), (60, 600, 400), (90, 900, 0)], [700])
    assert [r["on_route"] for r in track] == [True, True, False, True]
    assert [r["clamped"] for r in track] == [False, True, False, False]
    assert track[1]["offset_m"] == pytest.approx(500, abs=1) and track[1]["raw_offset_m"] == pytest.approx(400, abs=1)
    assert [r["point"] for r in track] == [0, 1, None, 2]


def test_a_loop_does_not_snap_back(spark):
    # Out 2,000 m and back over the same ground: offset 3,900 lies where offset 100 does.
    out = [(i * 250.0, 0.0, i * 250.0) for i in range(9)]
    back = [(2000 - i * 250.0, 0.0, 2000 + i * 250.0) for i in range(1, 9)]
    track, _ = run(spark, [(0, 0, 0), (60, 1000, 0), (120, 1900, 0), (150, 1900, 0), (210, 1000, 0), (270, 100, 0)], [], out + back)
    assert [round(r["offset_m"], -2) for r in track] == [0, 1000, 1900, 1900, 3000, 3900]


def brute_arrivals(track, targets, radius=40.0, at=15.0):
    """The definition, stop by stop over the whole track: list of (us, offset)."""
    out = {}
    for seq, goal in enumerate(targets, start=1):
        if len(track) < 2:
            continue
        inside = [i for i, p in enumerate(track) if abs(p[1] - goal) <= radius]
        end = 0
        while end + 1 < len(inside) and inside[end + 1] == inside[end] + 1:
            end += 1
        if inside and end:
            out[seq] = ("dwell", track[inside[0]][0])
            continue
        pair = next(((a, b) for a, b in zip(track, track[1:]) if a[1] <= goal <= b[1]), None)
        if pair is None:
            continue
        near = min(track, key=lambda p: abs(p[1] - goal))
        if abs(near[1] - goal) <= at:
            out[seq] = ("at_ping", near[0])
        else:
            (a, b) = pair
            share = 0 if b[1] <= a[1] else (goal - a[1]) / (b[1] - a[1])
            out[seq] = ("interpolated", a[0] + round((b[0] - a[0]) * share))
    return out


def test_random_tracks_match_the_definition(spark):
    rng = random.Random(7)
    track_rows, stop_rows, expected = [], [], {}
    for run_no in range(60):
        trip, where, points = f"t{run_no}", 0.0, []
        for i in range(rng.randint(1, 25)):
            where += rng.choice([0, 0, 5, 20, 60, 200, 500])
            points.append((i * 30_000_000, where))
            track_rows.append((DAY, trip, "bus", i, i * 30_000_000, where))
        targets = [float(rng.randrange(0, 4000, 5)) for _ in range(15)] + [points[0][1], points[-1][1]]
        stop_rows += [(DAY, trip, "bus", s, f"s{s}", m) for s, m in enumerate(targets, start=1)]
        expected.update({(trip, s): v for s, v in brute_arrivals(points, targets).items()})
    track = spark.createDataFrame(track_rows, "start_date date, trip_id string, vehicle_id string, point int, ts_us bigint, offset_m double")
    stop = spark.createDataFrame(stop_rows, "start_date date, trip_id string, vehicle_id string, stop_sequence int, stop_id string, offset_m double")
    got = {
        (r["trip_id"], r["stop_sequence"]): (r["method"], r["us"])
        for r in A.find_arrivals(track, stop).select("*", F.unix_micros("arrived_at").alias("us")).collect()
    }
    assert got.keys() == expected.keys()
    for key, (method, us) in expected.items():
        assert got[key][0] == method and abs(got[key][1] - us) <= 1


def schedule(spark):
    trips = spark.createDataFrame(
        [("v1", "t", "r", "sh"), ("v1", "u", "r", None), ("v1", "w", "r", "sh")], "feed_version string, trip_id string, route_id string, shape_id string"
    )
    shapes = shape(spark).select(
        F.lit("v1").alias("feed_version"),
        F.lit("sh").alias("shape_id"),
        "shape_pt_sequence",
        F.col("lat").alias("shape_pt_lat"),
        F.col("lon").alias("shape_pt_lon"),
        F.col("offset_m").alias("shape_dist_traveled_m"),
    )
    stop_times = spark.createDataFrame(
        [("v1", "t", 1, "a", 500.0), ("v1", "t", 2, "b", 900.0), ("v1", "t", 3, "c", None), ("v1", "u", 1, "a", 500.0)],
        "feed_version string, trip_id string, stop_sequence int, stop_id string, shape_dist_traveled_m double",
    )
    return trips, shapes, stop_times


def test_whole_inference_logs_every_run(spark):
    spots = pings(spark, [(0, 0, 0), (60, 600, 0), (120, 1200, 0)]).unionByName(
        pings(spark, [(30, 100, 0)]).withColumn("vehicle_id", F.lit("second"))
    )
    positions = (
        spots.unionByName(pings(spark, [(0, 0, 0)]).withColumn("trip_id", F.lit("u")))
        .unionByName(pings(spark, [(0, 0, 0), (9, 9, 0)]).withColumn("trip_id", F.lit("w")))
        .unionByName(pings(spark, [(0, 0, 0)]).withColumn("trip_id", F.lit("x")).withColumn("lat", F.lit(None).cast("double")))
    )
    found, log = A.infer_arrivals(positions, *schedule(spark), version="v1")
    assert {(r["trip_id"], r["vehicle_id"], r["stop_sequence"]) for r in found.collect()} == {("t", "bus", 1), ("t", "bus", 2)}
    rows = {r["trip_id"]: r for r in log.collect()}
    assert {t: r["status"] for t, r in rows.items()} == {"t": "ok", "u": "no_shape", "w": "no_stops", "x": "no_pings"}
    assert rows["t"]["skipped_vehicles"] == 1 and rows["t"]["stops_skipped"] == 0 and rows["w"]["pings"] == 2
    totals = A.run_totals(log).first()
    assert (totals["trips"], totals["arrivals"], totals["secondary_vehicles_skipped"], totals["status_ok"]) == (4, 2, 1, 1)


def test_stops_out_of_reach_are_not_merged_and_a_shape_may_state_them(spark):
    """Stops by shape give what stops by trip give, and a track meets only those it passes: 3 of 4000."""
    spots = pings(spark, [(0, 0, 0), (60, 600, 0), (120, 1200, 0)])
    positions = spots.unionByName(spots.withColumn("trip_id", F.lit("w")))
    trips, shapes, _ = schedule(spark)
    of_shape = spark.range(4000).select(
        F.lit("v1").alias("feed_version"), F.lit("sh").alias("shape_id"), F.col("id").cast("int").alias("stop_sequence"),
        F.concat(F.lit("s"), "id").alias("stop_id"), ((F.col("id") - 2000) * 500.0).alias("shape_dist_traveled_m"),
    )
    of_trip = trips.select("trip_id", "shape_id").join(of_shape, "shape_id").drop("shape_id")
    results = []
    for stops in (of_shape, of_trip):
        found, log = A.infer_arrivals(positions, trips, shapes, stops, version="v1")
        results.append((sorted(map(str, found.collect())), sorted(map(str, log.collect()))))
        assert {(r["stops_total"], r["arrivals_written"]) for r in log.collect()} == {(4000, 3)}
        lengths = found.select(*T.RUN).distinct().withColumn("offset_m", F.explode(F.array(F.lit(0.0), F.lit(1200.0))))
        running = found.select(*T.RUN, F.lit("v1").alias("feed_version"), F.lit("sh").alias("shape_id")).distinct()
        near = A.stops_in_reach(lengths, running, stops.withColumnRenamed("shape_dist_traveled_m", "offset_m"))
        assert {tuple(r) for r in near.groupBy("trip_id").count().collect()} == {("t", 3), ("w", 3)}
    assert results[0] == results[1]
    far = of_shape.select("feed_version", "shape_id", "stop_sequence", "stop_id", F.lit(9e9).alias("offset_m")).limit(1)
    beyond = lengths.withColumn("offset_m", F.lit(9e9))
    assert A.stops_in_reach(beyond, running, far).count() == 2


def test_a_ping_without_a_window_meets_the_segments_near_its_latitude(monkeypatch):
    """The same places as among all segments, from a small share of the pairs."""
    rng = np.random.default_rng(5)
    lat = np.cumsum(rng.uniform(-100, 300, 3000)) / PER_LAT + LAT0
    lon, offset = rng.uniform(-80, 80, 3000) / PER_LON + LON0, np.arange(3000) * 300.0
    at = rng.integers(0, 3000, 400)
    spot = lat[at] + rng.uniform(-250, 250, 400) / PER_LAT, lon[at] + rng.uniform(-250, 250, 400) / PER_LON
    pairs, nearest = [], T._Shape._nearest

    def counted(self, lat, lon, first, count, listed):
        pairs.append(int(count.sum()))
        return nearest(self, lat, lon, first, count, listed)

    monkeypatch.setattr(T._Shape, "_nearest", counted)
    none = np.full(400, np.nan)
    raw, away = T._Shape(lat, lon, offset, 150.0).place(*spot, none, none)
    some, pairs[:] = sum(pairs), []
    whole, far = T._Shape(lat, lon, offset).place(*spot, none, none)
    near = far <= 150.0
    assert 100 < near.sum() < 400 and (near == (away <= 150.0)).all()
    assert (raw[near] == whole[near]).all() and (away[near] == far[near]).all()
    assert some * 50 < sum(pairs)


def test_points_are_sent_for_the_pings_of_their_shape_only(spark, monkeypatch):
    """Forty shapes of 20 pings each are one group each, however many pings there are together."""
    monkeypatch.setattr(T, "GROUP_PINGS", 20)
    ping = spark.range(800).select(
        F.lit(DAY).alias("start_date"), F.concat(F.lit("t"), F.col("id")).alias("trip_id"), F.lit("bus").alias("vehicle_id"), (F.col("id") % 40).alias("shape")
    )
    point = spark.range(400).select((F.col("id") % 40).alias("shape"), F.col("id").alias("shape_pt_sequence"), *[F.lit(0.0).alias(c) for c in ("lat", "lon", "offset_m")])
    dealt, sent = T.fold_inputs(ping, point, ["shape"])
    assert (dealt.count(), sent.count()) == (800, 400)


def test_grid_search_equals_all_segments(spark):
    rng = random.Random(3)
    points = [(i * 180.0, rng.uniform(-300, 300), i * 200.0) for i in range(25)]
    spots = [(i, rng.uniform(-200, 4700), rng.uniform(-500, 500)) for i in range(300)]
    shp = shape(spark, points).select(
        F.lit("sh").alias("shape_id"), "shape_pt_sequence", F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), F.col("offset_m").alias("shape_dist_traveled_m")
    )
    placed = T.nearest_segment(pings(spark, spots).withColumn("shape_id", F.lit("sh")), shp).orderBy("ts").collect()
    fold = T._Shape(*map(np.array, zip(*[(LAT0 + n / PER_LAT, LON0 + e / PER_LON, m) for n, e, m in points])))
    none = np.full(1, np.nan)
    for (_, n, e), row in zip(spots, placed, strict=True):
        (offset,), (away,) = fold.place(np.array([LAT0 + n / PER_LAT]), np.array([LON0 + e / PER_LON]), none, none)
        if away > 150:
            assert row["raw_offset_m"] is None
        else:
            assert row["raw_offset_m"] == pytest.approx(offset, abs=1e-4) and row["perpendicular_m"] == pytest.approx(away, abs=1e-4)


def test_folding_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    spots = [(i * 20, i * 60 + rng.uniform(-80, 80), rng.uniform(-60, 60)) for i in range(80)]
    results = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append([tuple(r) for r in T.build_track(pings(spark, spots).repartition(5), shape(spark)).orderBy("ts_us").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def one_by_one(spots, points, limit=150.0, backtrack=300.0, speed=35.0):
    """The definition of a track, ping by ping and segment by segment: (second, on route, clamped, offset)."""
    out, before = [], None
    for s, n, e in sorted(spots):
        lat, lon = LAT0 + n / PER_LAT, LON0 + e / PER_LON
        low, high = (-math.inf, math.inf) if before is None else (before[1] - backtrack, before[1] + max(s - before[0], 0) * speed + backtrack)
        begin = max(sum(p[2] < low for p in points) - 1, 0)
        end = min(sum(p[2] <= high for p in points) + 1, len(points) - 1)
        best = (math.inf, 0.0)
        for a, b in zip(points[begin:end], points[begin + 1 : end + 1], strict=True):
            (alat, alon), (blat, blon) = ((LAT0 + p[0] / PER_LAT, LON0 + p[1] / PER_LON) for p in (a, b))
            scale = 6_371_000 * math.cos(math.radians((alat + blat) / 2))
            dx, dy = math.radians(blon) * scale - math.radians(alon) * scale, math.radians(blat - alat) * 6_371_000
            px, py = math.radians(lon) * scale - math.radians(alon) * scale, math.radians(lat - alat) * 6_371_000
            share = min(max((px * dx + py * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
            best = min(best, (round(math.hypot(px - share * dx, py - share * dy), 6), a[2] + share * (b[2] - a[2])))
        if best[0] > limit:
            out.append((s, False, False, None))
            continue
        clamped = before is not None and best[1] < before[1]
        before = (s, before[1] if clamped else best[1])
        out.append((s, True, clamped, before[1]))
    return out


@pytest.mark.parametrize("pings_of_a_group", [1 << 17, 60])
def test_many_runs_on_shapes_that_revisit_themselves(spark, monkeypatch, pings_of_a_group):
    """Random runs against the definition, and what goes into the fold: pings, and points once for each salt."""
    monkeypatch.setattr(T, "GROUP_PINGS", pings_of_a_group)
    monkeypatch.setattr(T._Shape, "STEP", 500)
    rng = random.Random(12)
    shapes, rows, want = [], [], {}
    for name in ("out and back", "eight", "single"):
        points = [(i * 150.0, rng.uniform(-40, 40) if name == "eight" else 0.0, i * 150.0) for i in range(18)]
        if name != "single":
            points += [(2550 - i * 150.0, 30.0, 2550 + i * 150.0) for i in range(1, 18)]
        points = points[:1] if name == "single" else points
        shapes += [(name, i, LAT0 + n / PER_LAT, LON0 + e / PER_LON, m) for i, (n, e, m) in enumerate(points)]
        for r in range(14 if name == "out and back" else 5):
            trip, where, spots = f"{name} {r}", 0.0, []
            for k in range(rng.randint(1, 45)):
                where += rng.choice([0, 30, 120, 260])
                north = min(where, 5100 - where)
                spots.append((k * 20, north + rng.uniform(-60, 60), rng.choice([0, 20, 400]) if k % 9 == 4 else rng.uniform(-30, 60)))
            rows += [(DAY, trip, "bus", START + dt.timedelta(seconds=s), LAT0 + n / PER_LAT, LON0 + e / PER_LON, name) for s, n, e in spots]
            if name != "single":
                want[trip] = one_by_one(spots, points)
    ping = spark.createDataFrame(rows, "start_date date, trip_id string, vehicle_id string, ts timestamp, lat double, lon double, shape string").repartition(5)
    point = spark.createDataFrame(shapes, "shape string, shape_pt_sequence int, lat double, lon double, offset_m double")
    got = {}
    for r in T.build_track(ping, point, on=("shape",)).orderBy("trip_id", "ts_us").collect():
        got.setdefault(r["trip_id"], []).append((r["ts_us"] / 1e6 - START.replace(tzinfo=dt.UTC).timestamp(), r["on_route"], r["clamped"], r["offset_m"]))
    assert got.keys() == want.keys()
    for trip, track in want.items():
        assert [x[:3] for x in got[trip]] == [x[:3] for x in track]
        assert [x[3] for x in got[trip]] == [pytest.approx(x[3], abs=1e-3) if x[3] is not None else None for x in track]
    assert sum(x[2] for t in want.values() for x in t) > 20 and sum(not x[1] for t in want.values() for x in t) > 10
    dealt, sent = T.fold_inputs(ping, point, ["shape"])
    salts = dealt.groupBy("shape").agg(F.count_distinct("salt_").alias("salts"))
    assert dealt.count() == len(rows)
    assert sent.count() == point.join(salts, "shape").agg(F.sum("salts")).first()[0]


def test_a_trip_of_two_versions_is_an_error(spark):
    trips, shapes, stop_times = schedule(spark)
    both = trips.unionByName(trips.withColumn("feed_version", F.lit("v2")))
    spots = pings(spark, [(0, 0, 0), (60, 600, 0)])
    with pytest.raises(Exception, match="several schedule versions"):
        A.infer_arrivals(spots, both, shapes, stop_times)
    found, _ = A.infer_arrivals(spots, both, shapes, stop_times, version="v1")
    assert found.count() == 1


def test_heading_and_distance(spark):
    row = spark.range(1).select(
        geo.heading(F.lit(32.7), F.lit(-117.1), F.lit(32.8), F.lit(-117.1)),
        geo.heading(F.lit(32.7), F.lit(-117.1), F.lit(32.7), F.lit(-117.0)),
        geo.heading(F.lit(32.7), F.lit(-117.1), F.lit(32.7), F.lit(-117.1)),
        geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)),
    ).first()
    assert row[0] == pytest.approx(0, abs=1e-6) and row[1] == pytest.approx(90, abs=0.1) and row[2] is None
    assert row[3] == pytest.approx(math.radians(1) * 6_371_000)
