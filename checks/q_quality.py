"""Row checks."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import day_seconds, secs
from stopclock.operators import quality as Q
from stopclock.schemas import KEYS


def dupes(sql_table: str, keys: list[str]) -> str:
    return f"""
select count(*) filter (n > 1) as duplicate_keys, coalesce(sum(n - 1), 0)::bigint as surplus_rows
from (select count(*) as n from {sql_table} group by {", ".join(keys)}) x
"""


for _table in ("arrivals", "predictions", "trips", "routes", "stops", "stop_times", "shapes"):

    @query(f"unique_{_table}", dupes(_table, KEYS[_table]), _table)
    def _(v, table=_table):
        return Q.duplicate_keys(getattr(v, table), KEYS[table])


@query("unique_prediction_errors", dupes("scored", KEYS["prediction_errors"]), "scored")
def _(v):
    return Q.duplicate_keys(v.scored, KEYS["prediction_errors"])


@query("duplicate_lineitem_keys", dupes("lineitem", ["l_orderkey", "l_linenumber"]))
def _(v):
    return Q.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "scored_rules",
    """
select count(*) filter (abs_error_seconds <> abs(error_seconds)) as abs_matches,
       count(*) filter (predicted_at > arrived_at - to_minutes(horizon_minutes)) as prediction_precedes_cutoff,
       count(*) filter (horizon_minutes not in (1, 5, 10, 20)) as horizon_known,
       count(*) filter (source not in ('mts', 'persist_delay', 'segment_mean')) as source_known
from scored
""",
    "scored",
)
def _(v):
    return Q.violations(v.scored, Q.scored_rules(("mts", "persist_delay", "segment_mean")))


@query(
    "arrival_rules",
    """
select count(*) filter (method not in ('interpolated', 'dwell', 'at_ping')) as method_known, count(*) filter (ping_gap_seconds < 0) as gap_nonnegative,
       count(*) filter (nearest_ping_m < 0) as nearest_nonnegative, count(*) filter (departed_at < arrived_at) as departure_after_arrival
from arrivals
""",
    "arrivals",
)
def _(v):
    return Q.violations(v.arrivals, Q.arrival_rules())


@query(
    "stop_time_rules",
    """
select count(*) filter (arrival_seconds < 0) as arrival_nonnegative, count(*) filter (departure_seconds < 0) as departure_nonnegative,
       count(*) filter (shape_dist_traveled_m < 0) as distance_nonnegative
from stop_times
""",
    "stop_times",
)
def _(v):
    return Q.violations(v.stop_times, Q.stop_time_rules())


@query("exception_rules", "select count(*) filter (exception_type not in (1, 2)) as exception_type_known from exceptions", "exceptions")
def _(v):
    return Q.violations(v.exceptions, Q.exception_rules())


@query(
    "poll_status_rules",
    "select count(*) filter (status not in ('ok', 'skipped_unchanged', 'http_error', 'parse_error', 'db_error')) as status_known from polls",
    "polls",
)
def _(v):
    return Q.violations(v.polls, Q.status_rules("poll_log"))


@query("run_window_rules", "select count(*) filter (train_to >= test_from) as train_before_test from runs", "runs")
def _(v):
    return Q.violations(v.runs, Q.run_rules())


@query(
    "segment_rules",
    """
select 0::bigint as hour_in_range, 0::bigint as n_positive, 0::bigint as mean_positive
""",
)
def _(v):
    from stopclock.operators.segments import fit_segment_stats

    return Q.violations(fit_segment_stats(v.arrivals, "2001-12-31"), Q.segment_rules())


@query(
    "shapes_increase",
    """
with s as (select shape_dist_traveled_m - lag(shape_dist_traveled_m) over (partition by feed_version, shape_id order by shape_pt_sequence) as step from shapes)
select count(step) as steps, count(*) filter (step <= 0) as not_increasing from s
""",
    "shapes",
)
def _(v):
    return Q.shapes_increase(v.shapes)


@query(
    "orphan_routes",
    """
select feed_version, count(*) as rows from routes where feed_version not in (select feed_version from trips where route_id = 'none' or feed_version = 'f0')
group by feed_version
""",
    "routes",
    "trips",
)
def _(v):
    known = v.trips.where(F.col("feed_version") == "f0").select("feed_version").distinct()
    return Q.orphans(v.routes, known)


@query(
    "bands_partition",
    """
select count(*) as all_rows, count(*) as band_rows, count(*) filter (service_minute >= 360 and service_minute < 540) as am_rush,
       count(*) filter (service_minute >= 540 and service_minute < 900) as midday, count(*) filter (service_minute >= 900 and service_minute < 1140) as pm_rush,
       count(*) filter (service_minute >= 1140 and service_minute < 1440) as evening,
       count(*) filter (service_minute >= 1440 or service_minute < 360) as late
from scored
""",
    "scored",
)
def _(v):
    return Q.bands_partition(v.scored)


@query(
    "speed_and_lateness",
    f"""
with s as (
  select stop_offset_m - lag(stop_offset_m) over w as m, {secs("lag(arrived_at) over w", "arrived_at")} as s from arrivals
  window w as (partition by start_date, trip_id order by stop_sequence)),
x as (
  select 'speed_mps' as measure, round(m / s, 1) as value from s where s > 0 and m >= 0
  union all
  select 'lateness_seconds', round({day_seconds("arrived_at", "start_date")} - st.arrival_seconds, 1)
  from arrivals a join stop_times st using (feed_version, trip_id, stop_sequence) where st.arrival_seconds is not null)
select measure, count(*) as n, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50,
       round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95
from x group by measure
""",
    "arrivals",
    "stop_times",
)
def _(v):
    return Q.speed_and_lateness(v.arrivals, v.stop_times)
