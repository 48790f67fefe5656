"""Stop, vehicle and shape queries, over all stops and routes at once."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import local, utc
from stopclock.operators.vehicles import headings
from stopclock.plans import published

STOPS = """
select a.stop_id, max(s.stop_name) as stop_name, round(max(s.stop_lat), 6) as lat, round(max(s.stop_lon), 6) as lon,
       count(*) as arrivals
from arrivals a join stops s on s.feed_version = a.feed_version and s.stop_id = a.stop_id
where s.stop_lat is not null and s.stop_lon is not null {more} group by a.stop_id order by count(*) desc, a.stop_id limit {limit}
"""


@query("stops_busiest_first", STOPS.format(more="", limit=2000), "arrivals", "stops")
def _(v):
    return published.stops(v.arrivals, v.stops)


@query("stop_search", STOPS.format(more="and s.stop_name ilike '%NVIL 1%'", limit=12), "arrivals", "stops")
def _(v):
    return published.stop_search(v.arrivals, v.stops, "nvil 1")


@query(
    "recent_at_stops",
    f"""
with x as (
  select stop_id, trip_id, route_id, stop_sequence, arrived_at, horizon_minutes, feed_version, max(start_date) as d,
         max(predicted_arrival) filter (source = 'mts') as mp, max(predicted_arrival) filter (source = 'lgbm') as lp,
         max(error_seconds) filter (source = 'mts') as me, max(error_seconds) filter (source = 'lgbm') as le
  from scored where horizon_minutes = 10 group by all),
r as (select *, row_number() over (partition by stop_id order by arrived_at desc, trip_id, stop_sequence, feed_version) as rn from x)
select stop_id, r.trip_id, route_id, r.stop_sequence::bigint as stop_sequence, epoch_us(arrived_at) as arrived_at,
       horizon_minutes::bigint as horizon_minutes, epoch_us(mp) as mts_predicted, epoch_us(lp) as model_predicted,
       me::bigint as mts_error_seconds, le::bigint as model_error_seconds, rn as recency,
       epoch_us({utc("d::timestamp + to_seconds(st.arrival_seconds)")}) as scheduled_at
from r left join stop_times st on st.feed_version = r.feed_version and st.trip_id = r.trip_id and st.stop_sequence = r.stop_sequence
where rn <= 25
""".replace("r left join stop_times st", "(select * from r) r left join (select feed_version, trip_id, stop_sequence, arrival_seconds from stop_times) st").replace("select stop_id, r.trip_id", "select r.stop_id, r.trip_id"),
    "scored",
    "stop_times",
)
def _(v):
    return published.recent_at_stops(v.scored, v.stop_times)


@query(
    "upcoming_at_stops",
    """
with l as (
  select *, row_number() over (partition by stop_id, start_date, trip_id, stop_sequence order by observed_at desc) as rn
  from predictions where arrival_time is not null and start_date >= date '1997-12-30'),
f as (select *, row_number() over (partition by stop_id order by arrival_time, trip_id, stop_sequence, start_date) as pos
      from l where rn = 1 and arrival_time > timestamp '1998-01-01 12:00:00'),
t as (select trip_id, arg_min(trip_headsign, feed_version) as headsign, arg_min(route_id, feed_version) as troute from trips group by 1),
rt as (select route_id, arg_min(route_short_name, feed_version) as short, arg_min(route_type, feed_version) as kind from routes group by 1),
pb as (select stop_id, route_id, count(*) as n, avg(error_seconds) as bias from scored
       where source = 'mts' and horizon_minutes = 10 and ping_gap_seconds <= 180 and route_id is not null group by all),
rb as (select route_id, count(*) as n, avg(error_seconds) as bias from scored
       where source = 'mts' and horizon_minutes = 10 and ping_gap_seconds <= 180 and route_id is not null group by all),
x as (
  select f.stop_id, f.pos, f.trip_id, coalesce(f.route_id, t.troute) as route_id, t.headsign, f.stop_sequence, f.arrival_time,
         f.observed_at from f left join t using (trip_id) where pos <= 8),
y as (
  select x.*, rt.short, rt.kind,
         case when pb.n >= 10 then pb.bias when rb.n >= 30 then rb.bias end as bias,
         case when pb.n >= 10 then 'stop_and_route' when rb.n >= 30 then 'route' else 'none' end as basis,
         case when pb.n >= 10 then pb.n when rb.n >= 30 then rb.n end as sample
  from x left join rt on rt.route_id = x.route_id left join pb on pb.stop_id = x.stop_id and pb.route_id = x.route_id
  left join rb on rb.route_id = x.route_id)
select stop_id, pos as position, trip_id, route_id, short as route_short_name, kind::bigint as route_type, headsign,
       stop_sequence::bigint as stop_sequence, epoch_us(arrival_time) as mts_arrival, epoch_us(observed_at) as predicted_at,
       epoch_us(arrival_time) - round(bias * 1000000)::bigint as corrected_arrival, round(-bias, 6) as correction_seconds,
       basis as correction_basis, sample as correction_sample, coalesce(abs(bias) >= 20, false) as correction_is_meaningful
from y
""",
    "predictions",
    "trips",
    "routes",
    "scored",
)
def _(v):
    return published.upcoming(v.predictions, v.trips, v.routes, v.scored, F.to_timestamp(F.lit("1998-01-01 12:00:00")))


@query(
    "vehicles_on_map",
    """
with l as (
  select *, row_number() over (partition by vehicle_id order by ts desc) as rn from positions
  where ts > timestamp '2024-01-15 17:00:00' - to_minutes(75) and lat is not null and lon is not null),
rt as (select route_id, arg_min(route_short_name, feed_version) as short, arg_min(route_type, feed_version) as kind from routes group by 1)
select vehicle_id, l.route_id, trip_id, round(lat, 6) as lat, round(lon, 6) as lon, epoch_us(ts) as ts,
       short as route_short_name, kind::bigint as route_type
from l left join rt on rt.route_id = l.route_id where rn = 1
""",
    "positions",
    "routes",
)
def _(v):
    return published.vehicles(v.positions, v.routes, F.to_timestamp(F.lit("2024-01-15 17:00:00")), 75)


@query(
    "vehicle_headings",
    """
with p as (
  select start_date, vehicle_id, ts, lat, lon, lag(lat) over w as plat, lag(lon) over w as plon
  from positions where lat is not null and lon is not null window w as (partition by start_date, vehicle_id order by ts)),
h as (
  select *, case when sqrt(pow((lon - plon) * 93675, 2) + pow((lat - plat) * 111320, 2)) >= 12 then
    fmod(degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)),
      cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360, 360) end as turned
  from p)
select start_date::varchar as start_date, vehicle_id, epoch_us(ts) as ts,
       round(coalesce(last_value(turned ignore nulls) over (partition by start_date, vehicle_id order by ts
             rows between unbounded preceding and current row), 0), 4) as heading_degrees
from h
""",
    "positions",
)
def _(v):
    return headings(v.positions).select("start_date", "vehicle_id", "ts", F.round("heading_degrees", 4).alias("heading_degrees"))


@query(
    "route_shapes",
    """
with u as (select route_id, shape_id, count(*) as n from run_trips where shape_id is not null group by all),
c as (select *, row_number() over (partition by route_id order by n desc, shape_id) as rn from u)
select route_id, shape_id, shape_pt_sequence::bigint as shape_pt_sequence, round(shape_pt_lat, 6) as lat, round(shape_pt_lon, 6) as lon
from c join shapes using (shape_id) where rn = 1
""",
    "run_trips",
    "shapes",
)
def _(v):
    return published.route_shapes(v.run_trips, v.shapes)


_ = local
