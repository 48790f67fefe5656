"""Schedule operators: service days, versions, shapes."""

from pyspark.sql import functions as F

from checks.catalog import query
from stopclock.operators import calendar as C
from stopclock.operators import service_days as S
from checks.duck import day_seconds, local, secs

SERVICE_DATES = """
p as (
  select service_id, (start_date + d.d::int)::date as service_date from calendar, range(91) d(d)
  where (bits >> (isodow(start_date + d.d::int) - 1)) & 1 = 1),
u as (select service_id, service_date from p union select service_id, service_date from exceptions where exception_type = 1),
sd as (select * from u where (service_id, service_date) not in (select service_id, service_date from exceptions where exception_type = 2))
"""


@query(
    "service_dates",
    f"with {SERVICE_DATES} select service_date::varchar as service_date, service_id from sd",
    "calendar",
    "exceptions",
)
def _(v):
    return C.expand_service_dates(v.calendar, v.exceptions)


@query(
    "trips_running_per_date",
    f"""
with {SERVICE_DATES}
select sd.service_date::varchar as service_date, t.route_id, count(*) as trips from sd join trips t using (service_id) group by all
""",
    "calendar",
    "exceptions",
    "trips",
)
def _(v):
    dates = C.expand_service_dates(v.calendar, v.exceptions)
    return (
        C.running_trips(dates, v.trips, keys=())
        .groupBy("service_date", "route_id")
        .agg(F.count(F.lit(1)).alias("trips"))
    )


@query(
    "active_schedule",
    """
with f as (
  select o_orderpriority as v, max(o_orderdate) + to_seconds(length(o_orderpriority)) as loaded_at, min(o_orderdate::date) as s,
         case when o_orderpriority <> '2-HIGH' then max(o_orderdate::date) end as e
  from orders group by 1)
select v as feed_version from f where date '1998-07-01' between s and e or s is null or e is null order by loaded_at desc, v desc limit 1
""",
)
def _(v):
    day = F.to_date("o_orderdate")
    versions = v.table("orders").groupBy(F.col("o_orderpriority").alias("feed_version")).agg(
        (F.max("o_orderdate").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,max(length(o_orderpriority)))")).alias("loaded_at"),
        F.min(day).alias("feed_start_date"),
        F.max(F.when(F.col("o_orderpriority") != "2-HIGH", day)).alias("feed_end_date"),
    )
    return C.active_version(versions, "1998-07-01")


@query(
    "shape_lengths",
    """
with s as (
  select *, radians(shape_pt_lat) as la, radians(shape_pt_lon) as lo, lag(radians(shape_pt_lat)) over w as pla,
         lag(radians(shape_pt_lon)) over w as plo from shapes window w as (partition by shape_id order by shape_pt_sequence)),
d as (
  select *, 2 * 6371000 * asin(sqrt(pow(sin((la - pla) / 2), 2) + cos(pla) * cos(la) * pow(sin((lo - plo) / 2), 2))) as m from s),
a as (select feed_version, shape_id, count(*) as points, coalesce(sum(m), 0) as measured, max(shape_dist_traveled_m) - min(shape_dist_traveled_m) as declared from d group by all)
select feed_version, shape_id, points, round(measured, 4) as measured_m, round(declared, 4) as declared_m,
       round(declared / nullif(measured, 0), 6) as ratio
from a
""",
    "shapes",
)
def _(v):
    return C.shape_lengths(v.shapes).withColumns(
        {"measured_m": F.round("measured_m", 4), "declared_m": F.round("declared_m", 4)}
    )


@query(
    "trips_visiting_a_stop_twice",
    """
with c as (select feed_version, trip_id, stop_id, count(*) as n from long_stop_times group by all),
t as (select feed_version, trip_id, max(n) as n from c group by all)
select feed_version, count(*) as trips, count(*) filter (n > 1) as twice, round(100.0 * count(*) filter (n > 1) / count(*), 6) as twice_pct
from t group by feed_version
""",
    "long_stop_times",
)
def _(v):
    return C.visits_stop_twice(v.long_stop_times)


# --- service days: pings at the moments of arrival, filed under their local date ---

WINDOWS = """
w as (select trip_id, min(arrival_seconds) as s0, max(arrival_seconds) as s1 from stop_times where arrival_seconds is not null group by 1)
"""
PINGS = f"""
pings as (
  select 'V' || (ok % 50) || '-' || ln as vehicle_id, arrived_at as ts, case when pk % 31 <> 0 then trip_id end as trip_id,
         {local("arrived_at")}::date as start_date
  from calls)
"""


def pings(v):
    from stopclock.functions.clock import local_date

    return v.calls.select(
        F.concat(F.lit("V"), (F.col("ok") % 50).cast("string"), F.lit("-"), F.col("ln").cast("string")).alias("vehicle_id"),
        F.col("arrived_at").alias("ts"),
        F.when(F.col("pk") % 31 != 0, F.col("trip_id")).alias("trip_id"),
        local_date("arrived_at").alias("start_date"),
    )


@query(
    "service_days_applied",
    f"""
with {WINDOWS}, {PINGS},
r as (
  select p.*, case when p.trip_id is null then p.start_date
    when w.s0 is null then p.start_date
    when {day_seconds("ts", "p.start_date")} between s0 - 900 and s1 + 3600 then p.start_date
    when {day_seconds("ts", "(p.start_date - 1)")} between s0 - 900 and s1 + 3600 then p.start_date - 1
    else p.start_date end as day
  from pings p left join w using (trip_id))
select day::varchar as start_date, count(*) as pings, count(*) filter (day <> start_date) as moved from r group by day
""",
    "calls",
    "stop_times",
)
def _(v):
    fixed = S.with_service_day(pings(v), S.trip_windows(v.stop_times), "ts")
    return fixed.groupBy("start_date").agg(
        F.count(F.lit(1)).alias("pings"), F.count_if(F.col("start_date") != F.col("stored_date")).alias("moved")
    )


BACKFILL = f"""
b as (
  select p.*, w.s0, w.s1, {day_seconds("ts", "p.start_date")} as today from pings p left join w using (trip_id)),
m as (
  select *, coalesce(not (today between s0 - 900 and s1 + 3600) and today + 86400 between s0 - 900 and s1 + 3600, false) as moves from b)
"""


@query(
    "service_days_backfilled",
    f"""
with {WINDOWS}, {PINGS}, {BACKFILL}
select (case when moves then start_date - 1 else start_date end)::varchar as start_date, count(*) as pings,
       count(*) filter (moves) as moved
from m group by 1
""",
    "calls",
    "stop_times",
)
def _(v):
    fixed = S.backfill_days(pings(v), S.trip_windows(v.stop_times), "ts")
    return fixed.groupBy("start_date").agg(
        F.count(F.lit(1)).alias("pings"), F.count_if(F.col("start_date") != F.col("stored_date")).alias("moved")
    )


@query(
    "backfill_preview",
    f"with {WINDOWS}, {PINGS}, {BACKFILL} select count(*) as rows_to_move, count(distinct trip_id) as trips from m where moves",
    "calls",
    "stop_times",
)
def _(v):
    return S.rows_to_move(pings(v), S.trip_windows(v.stop_times), "ts")


@query(
    "implausible_runs",
    f"""
with {WINDOWS}, {PINGS},
r as (select start_date, trip_id, {secs("min(ts)", "max(ts)")} / 60 as seen from pings where trip_id is not null group by all)
select count(*) as trip_records, count(*) filter (seen > (s1 - s0) / 60.0 + 60) as implausible from r join w using (trip_id)
""",
    "calls",
    "stop_times",
)
def _(v):
    return S.implausible_runs(pings(v), S.trip_windows(v.stop_times))
