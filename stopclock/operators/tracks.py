"""Placing pings along a route shape."""

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import BACKTRACK_M, EARTH_RADIUS_M, MAX_OFFROUTE_M, MAX_SPEED_MPS
from stopclock.functions.geo import project_onto_segment
from stopclock.session import ship_package

#: Pings of one group of the fold, about.
GROUP_PINGS = 1 << 17
RUN = ["start_date", "trip_id", "vehicle_id"]
TRACK_SCHEMA = (
    "start_date date, trip_id string, vehicle_id string, ts_us bigint, on_route boolean, clamped boolean, "
    "point int, offset_m double, raw_offset_m double, perpendicular_m double"
)


def pings_per_vehicle(positions: DataFrame) -> DataFrame:
    return (
        positions.where(F.col("trip_id").isNotNull())
        .groupBy(*RUN)
        .agg(F.count(F.lit(1)).alias("pings"))
    )


def primary_vehicles(positions: DataFrame) -> DataFrame:
    """One vehicle per trip run, the one with most pings (the lowest id on a tie), and how
    many other vehicles were passed over."""
    return (
        pings_per_vehicle(positions)
        .groupBy("start_date", "trip_id")
        .agg(
            F.min(F.struct((-F.col("pings")).alias("m"), F.col("vehicle_id").alias("v"))).alias("_best"),
            (F.count(F.lit(1)) - 1).alias("skipped_vehicles"),
        )
        .select(
            "start_date",
            "trip_id",
            F.col("_best.v").alias("vehicle_id"),
            (-F.col("_best.m")).alias("pings"),
            "skipped_vehicles",
        )
    )


def shape_segments(shapes: DataFrame, key: str = "shape_id") -> DataFrame:
    """Consecutive points of each shape; points without a distance are left out."""
    along = Window.partitionBy(key).orderBy("shape_pt_sequence")
    points = shapes.where(F.col("shape_dist_traveled_m").isNotNull())
    return points.select(
        key,
        (F.row_number().over(along) - 1).alias("segment"),
        F.col("shape_pt_lat").alias("a_lat"),
        F.col("shape_pt_lon").alias("a_lon"),
        F.col("shape_dist_traveled_m").alias("a_m"),
        F.lead("shape_pt_lat").over(along).alias("b_lat"),
        F.lead("shape_pt_lon").over(along).alias("b_lon"),
        F.lead("shape_dist_traveled_m").over(along).alias("b_m"),
    ).where(F.col("b_m").isNotNull())


def nearest_segment(
    pings: DataFrame, shapes: DataFrame, max_offroute_m: float = MAX_OFFROUTE_M, cell_degrees: float = 0.003
) -> DataFrame:
    """Each ping (with its `shape_id`) on the nearest segment of the whole shape.

    Only segments within the off-route limit can matter, so each segment is listed in the
    grid cells its surroundings touch and a ping meets the few in its own cell. A ping with
    none near enough gets null offsets: it is off route.
    """
    reach_lat = float(np.degrees(max_offroute_m / EARTH_RADIUS_M)) * 1.01
    segments = shape_segments(shapes)
    widest = F.greatest(F.abs("a_lat"), F.abs("b_lat")) + reach_lat
    reach_lon = F.lit(reach_lat) / F.cos(F.radians(widest))

    def cells(low, high):
        return F.sequence(F.floor(low / cell_degrees), F.floor(high / cell_degrees))

    listed = segments.withColumn(
        "_y", F.explode(cells(F.least("a_lat", "b_lat") - reach_lat, F.greatest("a_lat", "b_lat") + reach_lat))
    ).withColumn(
        "_x", F.explode(cells(F.least("a_lon", "b_lon") - reach_lon, F.greatest("a_lon", "b_lon") + reach_lon))
    )
    columns = pings.columns
    offset, away = project_onto_segment(
        F.col("lat"),
        F.col("lon"),
        (F.col("a_lat"), F.col("a_lon"), F.col("a_m")),
        (F.col("b_lat"), F.col("b_lon"), F.col("b_m")),
    )
    located = pings.withColumn("_y", F.floor(F.col("lat") / cell_degrees)).withColumn(
        "_x", F.floor(F.col("lon") / cell_degrees)
    )
    near = F.when(away <= max_offroute_m, F.struct(away.alias("away"), F.col("segment")))
    return (
        located.join(listed, ["shape_id", "_y", "_x"], "left")
        .groupBy(*columns)
        .agg(F.min_by(F.struct(offset.alias("m"), away.alias("away")), near).alias("_hit"))
        .select(*columns, F.col("_hit.m").alias("raw_offset_m"), F.col("_hit.away").alias("perpendicular_m"))
    )


def clamped_track(placed: DataFrame) -> DataFrame:
    """Non-decreasing offsets per run: the running maximum over on-route pings.

    Equals the full fold of `build_track` where a shape does not revisit itself and no ping
    jumps outside the search window; the fold covers every case.
    """
    earlier = Window.partitionBy(*RUN).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("raw_offset_m").over(earlier)
    return (
        placed.where(F.col("raw_offset_m").isNotNull())
        .withColumn("clamped", F.coalesce(F.col("raw_offset_m") < before, F.lit(False)))
        .withColumn("offset_m", F.greatest(F.col("raw_offset_m"), before))
        .withColumn("point", F.row_number().over(Window.partitionBy(*RUN).orderBy("ts_us")) - 1)
    )


class _Shape:
    """One shape's segments, ready for placing many points at once."""

    #: Pairs of a point and a segment looked at in one step.
    STEP = 1 << 20

    def __init__(self, lat: np.ndarray, lon: np.ndarray, offset: np.ndarray, limit: float | None = None) -> None:
        """With a `limit`, a point that no window limits meets only the segments whose latitudes come as near as that;
        without any it is placed at an infinite distance."""
        self.offset = offset
        self.bands = self._bands(lat, limit) if limit is not None and np.isfinite(lat).all() and np.isfinite(lon).all() else None
        mid = (lat[:-1] + lat[1:]) / 2
        self.scale = EARTH_RADIUS_M * np.cos(np.radians(mid))
        self.ax = np.radians(lon[:-1]) * self.scale
        self.ay = np.radians(lat[:-1]) * EARTH_RADIUS_M
        self.dx = np.radians(lon[1:]) * self.scale - self.ax
        self.dy = np.radians(lat[1:]) * EARTH_RADIUS_M - self.ay
        self.square = self.dx**2 + self.dy**2
        self.step = np.diff(offset)

    @staticmethod
    def _bands(lat: np.ndarray, limit: float) -> tuple[float, float, np.ndarray, np.ndarray]:
        """(lowest latitude, height, begins, segments): the segments that lie within the limit of each band of latitude, in
        order. Bands are as high as a segment is on average, so a segment is in a few of them."""
        reach = float(np.degrees(limit / EARTH_RADIUS_M)) * 1.01 + 1e-9
        least, most = np.minimum(lat[:-1], lat[1:]) - reach, np.maximum(lat[:-1], lat[1:]) + reach
        lowest, height = float(least.min()), float(np.mean(most - least))
        first = np.floor((least - lowest) / height).astype(np.int64)
        count = np.floor((most - lowest) / height).astype(np.int64) - first + 1
        segment = np.repeat(np.arange(len(first)), count)
        band = first[segment] + np.arange(len(segment)) - (np.cumsum(count) - count)[segment]
        order = np.argsort(band, kind="stable")
        begins = np.searchsorted(band[order], np.arange(int(band.max()) + 2))
        return lowest, height, begins, segment[order]

    def place(self, lat: np.ndarray, lon: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, distance) of each point on the nearest segment overlapping [low, high]; the first on a tie. A limit
        that is NaN does not limit; where no segment is left the distance is infinite."""
        free = np.isnan(low) & np.isnan(high) if self.bands is not None else np.zeros(len(lat), bool)
        raw, away = np.zeros(len(lat)), np.full(len(lat), np.inf)
        if free.any():
            raw[free], away[free] = self._place_free(lat[free], lon[free])
        if not free.all():
            raw[~free], away[~free] = self._place_within(lat[~free], lon[~free], low[~free], high[~free])
        return raw, away

    def _place_free(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lowest, height, begins, listed = self.bands
        bands = len(begins) - 1
        place = np.floor((lat - lowest) / height)
        inside = (place >= 0) & (place < bands)  # NaN is not
        band = np.where(inside, place, 0).astype(np.int64)
        return self._in_steps(lat, lon, begins[band], np.where(inside, begins[band + 1] - begins[band], 0), listed)

    def _place_within(self, lat: np.ndarray, lon: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segments = len(self.step)
        first = np.where(np.isnan(low), 0, np.maximum(np.searchsorted(self.offset, low, "left") - 1, 0))
        last = np.where(np.isnan(high), segments, np.minimum(np.searchsorted(self.offset, high, "right") + 1, segments))
        return self._in_steps(lat, lon, first, np.maximum(last - first, 0), None)

    def _in_steps(
        self, lat: np.ndarray, lon: np.ndarray, first: np.ndarray, count: np.ndarray, listed: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        raw, away = np.zeros(len(lat)), np.full(len(lat), np.inf)
        upto = np.cumsum(count)
        at = 0
        while at < len(lat):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self.STEP, "right")))
            some = np.flatnonzero(count[at:to]) + at
            raw[some], away[some] = self._nearest(lat[some], lon[some], first[some], count[some], listed)
            at = to
        return raw, away

    def _nearest(
        self, lat: np.ndarray, lon: np.ndarray, first: np.ndarray, count: np.ndarray, listed: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray]:
        point = np.repeat(np.arange(len(lat)), count)
        begin = np.cumsum(count) - count
        at = first[point] + np.arange(len(point)) - begin[point]
        at = at if listed is None else listed[at]
        px = np.radians(lon)[point] * self.scale[at] - self.ax[at]
        py = (np.radians(lat) * EARTH_RADIUS_M)[point] - self.ay[at]
        dx, dy, square = self.dx[at], self.dy[at], self.square[at]
        along = np.divide(px * dx + py * dy, square, out=np.zeros_like(square), where=square != 0)
        share = np.clip(along, 0.0, 1.0)
        distance = np.hypot(px - share * dx, py - share * dy)
        if not len(begin):
            return np.zeros(0), np.zeros(0)
        least = np.minimum.reduceat(distance, begin)
        hits = np.flatnonzero(distance == least[point])
        best = hits[np.searchsorted(hits, begin)]
        return self.offset[at[best]] + share[best] * self.step[at[best]], least


def _runs_of(pings: pa.Table) -> np.ndarray:
    """A number for each ping's run."""
    codes = [pings.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in RUN]
    run = np.zeros(pings.num_rows, np.int64)
    for code in codes:
        _, run = np.unique(run * (code.max(initial=0) + 2) + code + 1, return_inverse=True)
    return run


def _fold(limit: float, backtrack: float, speed: float):
    """Pings of many runs on one shape, and its points, to the runs' tracks: all runs take their next ping at once."""

    def fold(pings: pa.Table, points: pa.Table) -> pa.Table:
        if points.num_rows < 2:
            pings = pings.slice(0, 0)
        number = {c: pings.column(c).to_numpy() for c in ("ts_us", "lat", "lon")}
        run = _runs_of(pings)
        order = np.lexsort((number["ts_us"], run))
        run, ts, lat, lon = run[order], *(number[c][order] for c in ("ts_us", "lat", "lon"))
        along = np.argsort(points.column("shape_pt_sequence").to_numpy(), kind="stable")
        shape = _Shape(*(points.column(c).to_numpy().astype(float)[along] for c in ("lat", "lon", "offset_m")), limit) if len(run) else None
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        length = np.diff(np.append(starts, len(run)))
        before_ts, before_m, count = np.zeros(len(starts)), np.full(len(starts), np.nan), np.zeros(len(starts), np.int32)
        on, clamped, point = np.zeros(len(run), bool), np.zeros(len(run), bool), np.zeros(len(run), np.int32)
        offset, raw, away = (np.full(len(run), np.nan) for _ in range(3))
        for k in range(int(length.max(initial=0))):
            who = np.flatnonzero(length > k)
            at = starts[who] + k
            reach = np.maximum((ts[at] - before_ts[who]) / 1e6, 0.0) * speed
            found, far = shape.place(lat[at], lon[at], before_m[who] - backtrack, before_m[who] + reach + backtrack)
            near = far <= limit
            who, at, found = who[near], at[near], found[near]
            on[at], raw[at], away[at], point[at] = True, found, far[near], count[who]
            clamped[at] = found < before_m[who]  # nothing is less than NaN
            offset[at] = np.where(clamped[at], before_m[who], found)
            before_ts[who], before_m[who] = ts[at], offset[at]
            count[who] += 1
        keys = [pings.column(c).take(pa.array(order)) for c in RUN]
        fields = [pa.array(ts), pa.array(on), pa.array(clamped), *[pa.array(x, mask=~on) for x in (point, offset, raw, away)]]
        return pa.Table.from_arrays([*keys, *fields], [c.split()[0] for c in TRACK_SCHEMA.split(", ")])

    return fold


def fold_inputs(pings: DataFrame, shapes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pings and shape points, both by shape and salt: runs of a shape are dealt over salts, so many that a group has some
    GROUP_PINGS pings, and a shape's points are sent once for each salt that has runs. A shape's salts are counted from its
    own pings, so the points sent grow with the pings and not with pings times shapes. Pings without a shape stay out."""
    share = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / GROUP_PINGS))
    salts = pings.groupBy(*on).agg(share.alias("salts_"))
    dealt = pings.join(salts, on).withColumn("salt_", F.pmod(F.xxhash64(*RUN), F.col("salts_")).cast("int")).drop("salts_")
    points = shapes.select(*on, "shape_pt_sequence", "lat", "lon", "offset_m")
    used = dealt.select(*[F.col(c).alias(f"{c}_") for c in on], F.col("salt_").alias("salt")).distinct()
    same = reduce(and_, [points[c] == used[f"{c}_"] for c in on])
    return dealt, points.join(used, same).drop(*[f"{c}_" for c in on])


def build_track(
    pings: DataFrame,
    shapes: DataFrame,
    max_offroute_m: float = MAX_OFFROUTE_M,
    backtrack_m: float = BACKTRACK_M,
    max_speed_mps: float = MAX_SPEED_MPS,
    on: tuple[str, ...] = ("trip_id",),
) -> DataFrame:
    """Map matching with a search window that moves with the vehicle.

    `pings` holds RUN, ts, lat, lon and the columns `on`; `shapes` holds `on`, shape_pt_sequence, lat, lon and offset_m.
    The window depends on where the last accepted ping was placed, so this is a fold per run. The runs of one shape
    meet its points in a few groups (`fold_inputs`), and all runs of a group advance together, a ping each. Off-route
    pings come out with on_route = false; runs without a shape of two points do not come out.
    """
    ship_package(pings.sparkSession)
    asked = pings.select(*dict.fromkeys([*RUN, *on]), F.unix_micros("ts").alias("ts_us"), "lat", "lon")
    dealt, points = fold_inputs(asked, shapes, list(on))
    fold = _fold(max_offroute_m, backtrack_m, max_speed_mps)
    return dealt.groupBy(*on, "salt_").cogroup(points.groupBy(*on, "salt")).applyInArrow(fold, TRACK_SCHEMA)
