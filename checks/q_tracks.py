"""Map matching and arrival inference."""

from pyspark.sql import functions as F

from checks.catalog import query
from stopclock.operators import arrivals as A
from stopclock.operators import tracks

R = 6371000


def project(lat: str, lon: str) -> str:
    """Distance and offset of a point on segment columns alat, alon, am, blat, blon, bm."""
    return f"""
  (select *, am + share * (bm - am) as off, sqrt(pow(px - (ax + share * dx), 2) + pow(py - (ay + share * dy), 2)) as away from (
    select *, case when dx * dx + dy * dy = 0 then 0 else least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) end as share from (
      select *, radians({lon}) * {R} * cos(radians((alat + blat) / 2)) as px, radians({lat}) * {R} as py,
             radians(alon) * {R} * cos(radians((alat + blat) / 2)) as ax, radians(alat) * {R} as ay,
             (radians(blon) - radians(alon)) * {R} * cos(radians((alat + blat) / 2)) as dx, (radians(blat) - radians(alat)) * {R} as dy
      from {{rows}}) q1) q2)
"""


SEGMENTS = """
pts as (select shape_id, shape_pt_lat as lat, shape_pt_lon as lon, shape_dist_traveled_m as m,
               row_number() over w - 1 as i, count(*) over (partition by shape_id) as n from shapes
        window w as (partition by shape_id order by shape_pt_sequence)),
segs as (select a.shape_id, a.i, a.n, a.lat as alat, a.lon as alon, a.m as am, b.lat as blat, b.lon as blon, b.m as bm
         from pts a join pts b on b.shape_id = a.shape_id and b.i = a.i + 1)
"""
PRIMARY = """
cnt as (select start_date, trip_id, vehicle_id, count(*) as pings from positions where trip_id is not null group by all),
prim as (select *, row_number() over (partition by start_date, trip_id order by pings desc, vehicle_id) as rk,
                count(*) over (partition by start_date, trip_id) - 1 as skipped_vehicles from cnt),
chosen as (select * from prim where rk = 1),
runping as (
  select p.start_date, p.trip_id, p.vehicle_id, t.shape_id, epoch_us(p.ts) as us, p.lat as plat, p.lon as plon,
         row_number() over (partition by p.start_date, p.trip_id, p.vehicle_id order by p.ts) as pn
  from positions p join chosen c using (start_date, trip_id, vehicle_id) join run_trips t using (trip_id)
  where p.lat is not null and p.lon is not null)
"""
NEEDS = ("positions", "run_trips", "shapes")


def run_pings(v):
    chosen = tracks.primary_vehicles(v.positions)
    return (
        v.positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .join(chosen.select(*tracks.RUN), tracks.RUN)
        .select(*tracks.RUN, "ts", "lat", "lon")
    )


def shape_points(v):
    return v.shapes.select(
        "shape_id",
        "shape_pt_sequence",
        F.col("shape_pt_lat").alias("lat"),
        F.col("shape_pt_lon").alias("lon"),
        F.col("shape_dist_traveled_m").alias("offset_m"),
    )


@query(
    "primary_vehicles",
    f"with {PRIMARY} select start_date::varchar as start_date, trip_id, vehicle_id, pings, skipped_vehicles from chosen",
    *NEEDS,
)
def _(v):
    return tracks.primary_vehicles(v.positions)


@query(
    "pings_per_vehicle",
    "select start_date::varchar as start_date, trip_id, vehicle_id, count(*) as pings from positions where trip_id is not null group by all",
    "positions",
)
def _(v):
    return tracks.pings_per_vehicle(v.positions)


NEAREST = f"""
near as (
  select start_date, trip_id, vehicle_id, us, pn, off, away,
         row_number() over (partition by vehicle_id, us order by away, i) as rk
  from {project("plat", "plon").format(rows="(select * from runping join segs using (shape_id)) r0")} q3 where away <= 150)
"""


def placed(v):
    pings = run_pings(v).join(v.run_trips.select("trip_id", "shape_id"), "trip_id")
    return tracks.nearest_segment(pings.withColumn("ts_us", F.unix_micros("ts")).drop("ts"), v.shapes)


@query(
    "pings_on_shape",
    f"""
with {SEGMENTS}, {PRIMARY}, {NEAREST}
select p.start_date::varchar as start_date, p.trip_id, p.vehicle_id, p.us as ts_us, round(n.off, 4) as raw_offset_m, round(n.away, 4) as perpendicular_m
from runping p left join near n on n.vehicle_id = p.vehicle_id and n.us = p.us and n.rk = 1
""",
    *NEEDS,
)
def _(v):
    return placed(v).select(
        *tracks.RUN, "ts_us", F.round("raw_offset_m", 4).alias("raw_offset_m"), F.round("perpendicular_m", 4).alias("perpendicular_m")
    )


@query(
    "tracks_clamped",
    f"""
with {SEGMENTS}, {PRIMARY}, {NEAREST},
c as (
  select *, max(off) over (partition by start_date, trip_id, vehicle_id order by us rows between unbounded preceding and 1 preceding) as before,
         row_number() over (partition by start_date, trip_id, vehicle_id order by us) - 1 as point from near where rk = 1)
select start_date::varchar as start_date, trip_id, vehicle_id, us as ts_us, point, round(greatest(off, coalesce(before, off)), 4) as offset_m,
       coalesce(off < before, false) as clamped from c
""",
    *NEEDS,
)
def _(v):
    return tracks.clamped_track(placed(v)).select(*tracks.RUN, "ts_us", "point", F.round("offset_m", 4).alias("offset_m"), "clamped")


FOLD = f"""
with recursive {SEGMENTS}, {PRIMARY},
cnts as (select shape_id, list(m order by i) as ms, max(n) as n from pts group by shape_id having max(n) >= 2),
pings as (select * from runping join cnts using (shape_id)),
fold as (
  select start_date, trip_id, vehicle_id, 0::bigint as pn, null::bigint as us, false as on_route, false as clamped, -1::bigint as point,
         null::double as off, null::double as raw, null::bigint as pus, null::double as poff
  from (select distinct start_date, trip_id, vehicle_id from pings) z
  union all
  select start_date, trip_id, vehicle_id, pn, us, ok, coalesce(ok and raw < poff, false), case when ok then point + 1 else point end,
         case when ok then greatest(raw, coalesce(poff, raw)) end, case when ok then raw end,
         case when ok then us else pus end, case when ok then greatest(raw, coalesce(poff, raw)) else poff end
  from (
    select start_date, trip_id, vehicle_id, pn, us, point, pus, poff, arg_min(off, away * 1000000 + i * 0.000001) as raw,
           coalesce(min(away) <= 150, false) as ok
    from (
      select q.* from {project("plat", "plon").format(rows='''(
        select f.start_date, f.trip_id, f.vehicle_id, p.pn, p.us, f.point, f.pus, f.poff, p.plat, p.plon, s.*
        from fold f join pings p on p.start_date = f.start_date and p.trip_id = f.trip_id and p.vehicle_id = f.vehicle_id and p.pn = f.pn + 1
        left join segs s on s.shape_id = p.shape_id
          and s.i >= case when f.poff is null then 0
                          else greatest(0, len(list_filter(p.ms, lambda x: x < f.poff - 300)) - 1) end
          and s.i < case when f.poff is null then p.n - 1
                         else least(p.n - 1, len(list_filter(p.ms, lambda x: x <= f.poff + greatest((p.us - f.pus) / 1000000.0, 0) * 35 + 300)) + 1) end
      ) r1''')} q) w
    group by start_date, trip_id, vehicle_id, pn, us, point, pus, poff) g)
"""


@query(
    "tracks_folded",
    f"""
{FOLD}
select start_date::varchar as start_date, trip_id, vehicle_id, us as ts_us, on_route, clamped, case when on_route then point end as point,
       round(off, 4) as offset_m, round(raw, 4) as raw_offset_m
from fold where pn > 0
""",
    *NEEDS,
)
def _(v):
    pings = run_pings(v).join(v.run_trips.select("trip_id", "shape_id"), "trip_id")
    return tracks.build_track(pings, shape_points(v), on=("shape_id",)).select(
        *tracks.RUN, "ts_us", "on_route", "clamped", "point", F.round("offset_m", 4).alias("offset_m"), F.round("raw_offset_m", 4).alias("raw_offset_m")
    )


ARRIVALS = """
trk as (select start_date, trip_id, vehicle_id, us, point, off from fold where on_route),
st as (select c.start_date, c.trip_id, c.vehicle_id, s.stop_sequence, s.stop_id, s.shape_dist_traveled_m as goal
       from chosen c join run_stops s using (trip_id)),
d as (
  select st.*, trk.us, trk.point, abs(trk.off - goal) as dist, trk.off,
         lead(trk.off) over w as noff, lead(trk.us) over w as nus
  from st join trk using (start_date, trip_id, vehicle_id)
  window w as (partition by start_date, trip_id, vehicle_id, stop_sequence order by trk.point)),
isl as (
  select *, point - row_number() over (partition by start_date, trip_id, vehicle_id, stop_sequence order by point) as island from d where dist <= 40),
fi as (select start_date, trip_id, vehicle_id, stop_sequence, island, count(*) as n, min(us) as a, max(us) as b,
              row_number() over (partition by start_date, trip_id, vehicle_id, stop_sequence order by min(point)) as rk from isl
       group by start_date, trip_id, vehicle_id, stop_sequence, island),
br as (select *, row_number() over (partition by start_date, trip_id, vehicle_id, stop_sequence order by point) as rk
       from d where off <= goal and goal <= noff),
ne as (select start_date, trip_id, vehicle_id, stop_sequence, min(dist) as nearest, arg_min(us, dist * 1000000000 + point * 0.001) as nus
       from d group by all),
arr as (
  select st.*, nearest, case when fi.n >= 2 then 'dwell' when br.us is null then null when nearest <= 15 then 'at_ping' else 'interpolated' end as method,
         case when fi.n >= 2 then fi.a when nearest <= 15 then ne.nus when br.noff = br.off then br.us
              else br.us + round((br.nus - br.us) * least(greatest((st.goal - br.off) / (br.noff - br.off), 0), 1)) end as hit,
         case when fi.n >= 2 and fi.b > fi.a then fi.b end as gone,
         case when fi.n >= 2 then 0 else round((br.nus - br.us) / 1e6) end as gap
  from st left join fi on fi.start_date = st.start_date and fi.trip_id = st.trip_id and fi.vehicle_id = st.vehicle_id
       and fi.stop_sequence = st.stop_sequence and fi.rk = 1
  left join br on br.start_date = st.start_date and br.trip_id = st.trip_id and br.vehicle_id = st.vehicle_id
       and br.stop_sequence = st.stop_sequence and br.rk = 1
  left join ne on ne.start_date = st.start_date and ne.trip_id = st.trip_id and ne.vehicle_id = st.vehicle_id
       and ne.stop_sequence = st.stop_sequence)
"""


@query(
    "arrivals_inferred",
    f"""
{FOLD}, {ARRIVALS}
select start_date::varchar as start_date, trip_id, vehicle_id, stop_sequence::bigint as stop_sequence, stop_id, 'f0' as feed_version,
       round(hit / 1000.0)::bigint as arrived_ms, gone as departed_at, method, gap::bigint as ping_gap_seconds,
       round(nearest, 3) as nearest_ping_m, round(goal, 3) as stop_offset_m
from arr where method is not null
""",
    *NEEDS,
    "run_stops",
)
def _(v):
    found, _ = A.infer_arrivals(v.positions, v.run_trips, v.shapes, v.shape_stops)
    return found.withColumn("arrived_ms", F.round(F.unix_micros("arrived_at") / 1000).cast("bigint")).drop("arrived_at").withColumns(
        {"nearest_ping_m": F.round("nearest_ping_m", 3), "stop_offset_m": F.round("stop_offset_m", 3)}
    )


LOG = f"""
{FOLD}, {ARRIVALS},
lp as (select trip_id, count(*) as valid from runping group by 1),
lf as (select trip_id, count(*) filter (on_route) as used, count(*) filter (not on_route) as off, count(*) filter (clamped) as cl
       from fold where pn > 0 group by 1),
la as (select trip_id, count(*) as n from arr where method is not null group by 1),
ls as (select trip_id, count(*) as n from run_stops group by 1),
lx as (select trip_id, count(*) as n from run_trips join shapes using (shape_id) group by 1),
outcome as (
  select c.start_date, c.trip_id, c.vehicle_id, c.skipped_vehicles, coalesce(lp.valid, 0) as valid, coalesce(lf.used, 0) as used,
         coalesce(lf.off, 0) as offroute_pings, coalesce(lf.cl, 0) as clamped_pings, coalesce(la.n, 0) as arrivals_written,
         coalesce(ls.n, 0) as stops_total, coalesce(lx.n, 0) as points
  from chosen c left join lp using (trip_id) left join lf using (trip_id) left join la using (trip_id) left join ls using (trip_id)
  left join lx using (trip_id)),
status as (
  select *, case when valid = 0 then 'no_pings' when points < 2 then 'no_shape' when stops_total = 0 then 'no_stops'
                 when arrivals_written = 0 then 'no_arrivals' else 'ok' end as status from outcome)
"""


@query(
    "inference_log",
    f"""
{LOG}
select start_date::varchar as start_date, trip_id, vehicle_id, case when status in ('no_shape', 'no_stops') then valid else used end as pings,
       stops_total, arrivals_written, stops_total - arrivals_written as stops_skipped, offroute_pings, clamped_pings, skipped_vehicles, status
from status
""",
    *NEEDS,
    "run_stops",
)
def _(v):
    return A.infer_arrivals(v.positions, v.run_trips, v.shapes, v.shape_stops)[1]


@query(
    "inference_outcomes",
    f"""
{LOG}
select status, count(*) as trips, sum(arrivals_written)::bigint as arrivals, sum(stops_total - arrivals_written)::bigint as stops_skipped
from status group by status
""",
    *NEEDS,
    "run_stops",
)
def _(v):
    from stopclock.plans.reports import inference_outcomes

    return inference_outcomes(A.infer_arrivals(v.positions, v.run_trips, v.shapes, v.shape_stops)[1])
