"""The views of `checks/views.py` as SQL, for the independent check engine."""

TZ = "America/Los_Angeles"

# name -> (needs, select)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, select: str, *needs: str) -> None:
    VIEWS[name] = (needs, select.strip())


def local(instant: str) -> str:
    """Wall clock of a UTC timestamp."""
    return f"timezone('{TZ}', timezone('UTC', {instant}))"


def utc(wall: str) -> str:
    """UTC timestamp of a wall clock."""
    return f"timezone('UTC', timezone('{TZ}', {wall}))"


def day_seconds(instant: str, day: str) -> str:
    return f"(date_diff('microsecond', {day}::timestamp, {local(instant)}) / 1e6)"


def secs(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 1e6)"


_view(
    "calls",
    f"""
select ok, ln, pk, sk, start_date, ck, sched, g,
       {utc("start_date::timestamp + to_microseconds(sched::bigint * 1000000 + late_us)")} as arrived_at,
       case when pk % 23 <> 0 then case when pk % 2 = 0 then g % 200 else g end end as gap,
       'T' || ok as trip_id, 'f' || (ok % 2) as feed_version, 'S' || (pk % 40) as stop_id, 'R' || ck as route_id
from (
  select l_orderkey as ok, l_linenumber as ln, l_partkey as pk, l_suppkey as sk,
         o_orderdate::date as start_date, o_custkey % 25 as ck,
         14400 + (l_orderkey % 1200) * 60 + l_linenumber * 240 as sched,
         (((l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 900 - 240) * 4 + l_suppkey % 4) * 250000 as late_us,
         (l_suppkey * 17 + l_partkey) % 800 as g,
         row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn
  from lineitem join orders on o_orderkey = l_orderkey
) x where rn = 1
""",
)
_view(
    "arrivals",
    """
select start_date, trip_id, ln as stop_sequence, feed_version, stop_id, 'V' || (ok % 50) as vehicle_id, arrived_at,
       case when pk % 3 = 1 then arrived_at + to_seconds(sk % 50) end as departed_at,
       case pk % 3 when 0 then 'interpolated' when 1 then 'dwell' else 'at_ping' end as method,
       gap as ping_gap_seconds, (pk % 400) / 10.0::double as nearest_ping_m, ln * 350.0::double + pk % 50 as stop_offset_m
from calls
""",
    "calls",
)
_view(
    "trips",
    """
select 'f' || (o_orderkey % 2) as feed_version, 'T' || o_orderkey as trip_id, 'R' || (o_custkey % 25) as route_id,
       'SV' || (o_orderkey % 6) as service_id, 'H' || (o_custkey % 25) || '-' || (o_orderkey % 3) as shape_id,
       o_orderpriority as trip_headsign
from orders
""",
)
_view(
    "routes",
    """
select v.feed_version, 'R' || n_nationkey as route_id, n_nationkey || '/' || v.feed_version as route_short_name,
       n_name || ' ' || v.feed_version as route_long_name, n_regionkey as route_type
from nation, (values ('f0'), ('f1')) v(feed_version)
""",
)
_view(
    "stops",
    """
select v.feed_version, 'S' || k as stop_id, name || ' ' || k as stop_name,
       case when k <> 39 then 32.5::double + k * 0.001::double end as stop_lat, k * 0.001::double - 117.25::double as stop_lon
from (select p_partkey % 40 as k, min(p_name) as name from part group by 1) p, (values ('f0'), ('f1')) v(feed_version)
""",
)
_view(
    "stop_times",
    """
select feed_version, trip_id, ln as stop_sequence, stop_id,
       case when pk % 37 <> 0 then sched end as arrival_seconds,
       case when pk % 37 <> 0 then sched + 20 end as departure_seconds,
       ln * 350.0::double as shape_dist_traveled_m
from calls
""",
    "calls",
)
_view(
    "predictions",
    """
select start_date, trip_id, ln as stop_sequence, arrived_at - to_seconds(lead) as observed_at, stop_id,
       case when pk % 5 <> 0 then route_id end as route_id,
       case when (sk + k) % 19 <> 0 then arrived_at + to_seconds(err) end as arrival_time, err as delay_seconds
from (
  select c.*, r.k, case r.k when 0 then 45 when 1 then 60 when 2 then 290 + pk % 20 when 3 then 600
                            when 4 then 1100 + pk % 200 else 5400 + pk % 3600 end as lead,
         (pk * 31 + sk * 17 + r.k * 101) % 1500 - 700 as err
  from calls c, range(6) r(k) where (pk + 3 * r.k + sk) % 7 <> 0
) x
""",
    "calls",
)
_view(
    "scored",
    f"""
select start_date, trip_id, ln as stop_sequence, h as horizon_minutes, s as source, feed_version, stop_id, route_id, arrived_at,
       arrived_at + to_seconds(e) as predicted_arrival, arrived_at - to_seconds(h * 60 + sk % 40) as predicted_at,
       e as error_seconds, abs(e) as abs_error_seconds, gap as ping_gap_seconds,
       round({day_seconds("arrived_at", "start_date")} / 60)::int as service_minute,
       isodow(start_date) in (6, 7) as is_weekend,
       (sk + 1) % 11 <> 0 and (sk + 5) % 11 <> 0 and (sk + 10) % 11 <> 0 and (sk + 20) % 11 <> 0 as has_all_horizons
from (
  select c.*, h.h, s.i, s.s,
         case when s.i = 0 then (pk * 31 + sk * 17 + h.h * 101) % 1500 - 700
              else (pk * (31 + s.i) + sk * (17 + 2 * s.i) + h.h * 53 * s.i) % 1300 - 600 end as e
  from calls c, (values (1), (5), (10), (20)) h(h),
       (values (0, 'mts'), (1, 'persist_delay'), (2, 'segment_mean'), (3, 'lgbm')) s(i, s)
  where (sk + h.h) % 11 <> 0 and (s.i = 0 or (pk + h.h + 7 * s.i) % 9 <> 0)
) x
""",
    "calls",
)
_view("ev", "select event_id as eid, ts, user_id as u, json_extract_string(props, '$.k')::bigint as k, value, event_type from events")
_view(
    "hours",
    f"""
select u, seq, eid, start_date, sched, case when eid % 41 <> 0 then (eid * 13) % 300 end as gap,
       {utc('''start_date::timestamp + to_microseconds(sched::bigint * 1000000 +
         (case when eid % 11 = 0 then (eid * 7919) % 600 else (eid * 7919) % 200 end) * 250000)''')} as arrived_at
from (
  select u, seq, min(eid) as eid, date '2024-03-04' + (u % 14)::int as start_date, seq * 60 + 18000 as sched
  from (select u, eid, floor((epoch_us(ts) - 1704067200000000) / 3600000000)::int as seq from ev) e group by u, seq
) x
""",
    "ev",
)
_view(
    "long_arrivals",
    """
select start_date, 'U' || u as trip_id, seq as stop_sequence, 'f' || (u % 2) as feed_version, 'E' || (seq % 60) as stop_id, arrived_at,
       gap as ping_gap_seconds
from hours
""",
    "hours",
)
_view("long_trips", "select distinct 'f' || (u % 2) as feed_version, 'U' || u as trip_id, 'R' || (u % 7) as route_id from ev", "ev")
_view(
    "long_stop_times",
    """
select 'f' || (u % 2) as feed_version, 'U' || u as trip_id, seq as stop_sequence, 'E' || (seq % 60) as stop_id,
       case when eid % 43 <> 0 then sched end as arrival_seconds
from hours
""",
    "hours",
)
_view(
    "long_agency",
    f"""
select start_date, 'U' || u as trip_id, seq as stop_sequence, h as horizon_minutes, 'mts' as source, 'f' || (u % 2) as feed_version,
       'E' || (seq % 60) as stop_id, 'R' || (u % 7) as route_id, arrived_at, arrived_at + to_seconds(e) as predicted_arrival,
       arrived_at - to_seconds(h * 60) as predicted_at, e as error_seconds, abs(e) as abs_error_seconds,
       gap as ping_gap_seconds, round({day_seconds("arrived_at", "start_date")} / 60)::int as service_minute,
       isodow(start_date) in (6, 7) as is_weekend, true as has_all_horizons
from (select hours.*, h.h, (eid * 37 + h.h * 11) % 900 - 400 as e from hours, (values (1), (5), (10), (20)) h(h)) x
""",
    "hours",
)
_view(
    "polls",
    """
select case when u % 2 = 0 then 'vehicle_positions' else 'trip_updates' end as feed, ts as started_at,
       round(value * 10)::bigint as duration_ms,
       case when k % 10 <= 5 then 'ok' when k % 10 <= 7 then 'skipped_unchanged' when k % 10 = 8 then 'http_error'
            else 'parse_error' end as status,
       case when k % 10 <= 5 then k end as rows_written
from ev
""",
    "ev",
)
_view(
    "shapes",
    """
select 'f0' as feed_version, 'G' || s_nationkey as shape_id, s_suppkey::int as shape_pt_sequence,
       32.7::double + s_suppkey * 0.0005::double as shape_pt_lat,
       ((s_suppkey * 37) % 11 - 5) * 0.0002::double - 117.16::double as shape_pt_lon,
       s_suppkey * 56.0::double as shape_dist_traveled_m
from supplier
""",
)
_view(
    "run_trips",
    """
select distinct 'f0' as feed_version, 'U' || u as trip_id, 'R' || (u % 7) as route_id, 'G' || (u % 25) as shape_id from ev
""",
    "ev",
)
_view(
    "run_stops",
    """
select t.feed_version, trip_id, shape_pt_sequence as stop_sequence, 'P' || shape_pt_sequence as stop_id,
       shape_dist_traveled_m + 20 as shape_dist_traveled_m
from run_trips t join shapes using (shape_id)
""",
    "run_trips",
    "shapes",
)
_view(
    "positions",
    """
select vehicle_id,
       timestamp '2024-01-15 16:00:00' + to_seconds(second) as ts,
       'U' || u as trip_id, 'R' || (u % 7) as route_id, date '2024-01-01' + (u % 7)::int as start_date,
       case when eid % 53 <> 0 then 32.7::double + (second * top / 4320.0::double) * 0.0005::double
                                    + ((eid * 7919) % 13 - 6) * 0.00008::double end as lat,
       ((eid * 104729) % 11 - 5) * 0.0001::double + case when eid % 29 = 0 then 0.01::double else 0.0::double end
         - 117.16::double as lon
from (
  select u, vehicle_id, second, min(eid) as eid from (
    select u, eid, case when eid % 10 = 3 then 'W' else 'V' end || u as vehicle_id,
           floor((epoch_us(ts) - 1704067200000000) / 600000000)::bigint as second from ev) e
  group by all) x, (select max(s_suppkey) as top from supplier) m
""",
    "ev",
)
_view(
    "observed",
    """
select date '2024-01-01' + (u % 14)::int as start_date, 'U' || u as trip_id, (k % 3)::int as stop_sequence, ts as observed_at,
       case when eid % 11 <> 0 then 1710000000000000 + ((eid * 37) % 90) * 1000000 end as arrival_us,
       case when eid % 13 <> 0 then eid % 50 end as delay_seconds, eid
from ev
""",
    "ev",
)
_view(
    "calendar",
    """
select 'SV' || s_suppkey as service_id, s_suppkey as bits, date '2024-01-01' + (s_suppkey % 60)::int as start_date,
       date '2024-01-01' + (s_suppkey % 60)::int + 90 as end_date
from supplier
""",
)
_view(
    "exceptions",
    """
select 'SV' || (c_custkey % 150) as service_id, date '2024-01-01' + ((c_custkey * 7) % 120)::int as service_date,
       c_custkey % 2 + 1 as exception_type
from customer
""",
)
_view(
    "runs",
    """
select max(o_orderdate) + to_seconds(length(o_orderpriority)) as trained_at, o_orderpriority as source,
       min(o_orderdate::date) as train_from, date '1996-12-31' as train_to, date '1997-01-01' as test_from,
       max(o_orderdate::date) as test_to, count(*) as train_rows, count(*) * 2 as test_rows, '["a","b"]' as features,
       'run ' || o_orderpriority as notes
from orders group by o_orderpriority
""",
)


def _closure(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _closure(VIEWS[name][0], done)
            done.append(name)
    return done


def with_views(body: str, *needs: str) -> str:
    """`body` with the views it names in front. `body` may start with its own CTEs after `with`."""
    ctes = ",\n".join(f"{n} as materialized (\n{VIEWS[n][1]}\n)" for n in _closure(needs, []))
    body = body.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        head = "with recursive " if body[5:15].lower() == "recursive " else "with "
        rest = body[len(head):]
        return f"{head}{ctes},\n{rest}"
    return f"with {ctes}\n{body}"
