"""Feed side: flattening, alignment, change-only, streams."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import local
from stopclock.operators import alignment, changes
from stopclock.sources import snapshots as S

EPOCH = "(epoch_us(ts) // 1000000)"
HEADER = f"case when eid % 13 = 0 then null when eid % 17 <> 0 then {EPOCH} end"
DAY = "case when eid % 4 = 0 then date '2024-01-05' else {day}::date end"

POSITIONS = f"""
raw as (
  select *, case when eid % 3 = 0 then case when eid % 7 = 0 then null else 'e' || eid end else 'V' || u end as vid,
         coalesce(case when eid % 5 <> 0 then {EPOCH} + 1 end, {HEADER}) as sec, eid % 5 = 0 as borrowed from ev),
flat as (
  select *, case when vid is null then 'no_vehicle_id' when sec is null then 'no_timestamp' end as reason from raw)
"""


@query(
    "positions_flattened",
    f"""
with {POSITIONS}
select eid, vid as vehicle_id, sec * 1000000 as ts, case when eid % 23 <> 0 then 'U' || u end as trip_id, 'R' || (u % 7) as route_id,
       {DAY.format(day=local("make_timestamp(sec * 1000000)"))}::varchar as start_date,
       case when eid % 6 <> 0 then round(32.7::double + (u % 50) * 0.001::double, 6) end as lat,
       k as current_stop_sequence, reason, case when reason is null and borrowed then 'ts_from_header' end as note
from flat
""",
    "ev",
)
def _(v):
    return S.flatten_positions(v.snapshots).select(
        "eid", "vehicle_id", "ts", "trip_id", "route_id", "start_date", "lat", "current_stop_sequence", "reason", "note"
    )


@query(
    "position_drop_counts",
    f"with {POSITIONS} select reason, count(*) as dropped from flat where reason is not null group by reason",
    "ev",
)
def _(v):
    return S.drop_counts(S.flatten_positions(v.snapshots))


PREDICTIONS = f"""
t as (
  select *, coalesce(case when eid % 5 <> 1 then {EPOCH} + 2 end, {HEADER}) as sec,
         case when eid % 31 <> 0 then 3 else 0 end as size from ev),
tr as (select *, case when eid % 23 = 0 then 'no_trip_id' when sec is null then 'no_timestamp' end as treason from t),
st as (
  select tr.*, i.i, case when k % 3 <> 0 then k + i.i end as seq, case when (eid + i.i) % 6 <> 0 then 'E' || ((k * 3 + i.i * 11) % 60) end as stop,
         case when (eid + i.i) % 8 <> 0 and (eid + i.i) % 9 <> 0 then {EPOCH} + 60 * i.i + k end as arr,
         case when (eid + i.i) % 8 <> 0 and (eid + i.i) % 4 = 0 then k when (eid + i.i) % 8 = 1 then 7 end as delay
  from tr, range(3) i(i) where treason is null and size > 0),
flat as (
  select eid, u, sec, i, seq, stop, case when arr > 0 then arr end as arr, delay,
         case when seq is null and stop is null then 'no_stop_identity' when arr is null and delay is null then 'no_prediction_content' end as reason,
         1 as weight
  from st
  union all
  select eid, u, sec, null, null, null, null, null, treason, greatest(size, 1) from tr where treason is not null)
"""


@query(
    "predictions_flattened",
    f"""
with {PREDICTIONS}
select eid, case when eid % 23 <> 0 then 'U' || u end as trip_id, sec * 1000000 as observed_at,
       {DAY.format(day=local("make_timestamp(sec * 1000000)"))}::varchar as start_date, i as feed_order, seq as stop_sequence,
       stop as stop_id, arr * 1000000 as arrival_time, delay as delay_seconds, reason, weight::bigint as weight
from flat
""",
    "ev",
)
def _(v):
    return S.flatten_predictions(v.snapshots).select(
        "eid", "trip_id", "observed_at", "start_date", "feed_order", "stop_sequence", "stop_id", "arrival_time", "delay_seconds", "reason", "weight"
    )


@query(
    "prediction_drop_counts",
    f"with {PREDICTIONS} select reason, sum(weight)::bigint as dropped from flat where reason is not null group by reason",
    "ev",
)
def _(v):
    return S.drop_counts(S.flatten_predictions(v.snapshots))


# --- alignment: four feed stops per event against the user's own schedule, which loops ---

ALIGN = """
f as (
  select eid, 'U' || u as trip_id, 'E' || ((k * 3) % 60) as a, 'E' || ((k * 3 + 11) % 60) as b,
         case when eid % 5 = 0 then 'zzz' else 'E' || ((k * 3 + 22) % 60) end as c, 'E' || ((k * 3) % 60) as d from ev),
p1 as (select f.*, (select min(s.stop_sequence) from long_stop_times s where s.trip_id = f.trip_id and s.stop_id = f.a) as s1 from f),
p2 as (select p1.*, (select min(s.stop_sequence) from long_stop_times s where s.trip_id = p1.trip_id and s.stop_id = p1.b
       and s.stop_sequence > coalesce(p1.s1, -1)) as s2 from p1),
p3 as (select p2.*, (select min(s.stop_sequence) from long_stop_times s where s.trip_id = p2.trip_id and s.stop_id = p2.c
       and s.stop_sequence > coalesce(p2.s2, p2.s1, -1)) as s3 from p2),
p4 as (select p3.*, (select min(s.stop_sequence) from long_stop_times s where s.trip_id = p3.trip_id and s.stop_id = p3.d
       and s.stop_sequence > coalesce(p3.s3, p3.s2, p3.s1, -1)) as s4 from p3),
al as (
  select eid, trip_id, 0 as i, a as stop_id, s1 as seq from p4 union all select eid, trip_id, 1, b, s2 from p4
  union all select eid, trip_id, 2, c, s3 from p4 union all select eid, trip_id, 3, d, s4 from p4)
"""


def unresolved(v):
    k = F.col("k")
    stop = lambda i: F.concat(F.lit("E"), ((k * 3 + i) % 60).cast("string"))
    listed = F.array(stop(0), stop(11), F.when(F.col("eid") % 5 == 0, "zzz").otherwise(stop(22)), stop(0))
    return v.events.select(
        "eid",
        F.concat(F.lit("U"), F.col("u").cast("string")).alias("trip_id"),
        F.lit(None).cast("date").alias("start_date"),
        F.col("ts").alias("observed_at"),
        F.posexplode(listed).alias("feed_order", "stop_id"),
        F.lit(None).cast("int").alias("stop_sequence"),
    )


@query(
    "stop_sequences_aligned",
    f"""
with {ALIGN}
select eid, trip_id, i::bigint as feed_order, stop_id, seq::bigint as stop_sequence,
       case when seq is null then 'stop_not_on_trip' end as reason from al
""",
    "ev",
    "long_stop_times",
)
def _(v):
    resolved = alignment.resolve_predictions(unresolved(v), v.long_stop_times, poll="eid")
    return resolved.select("eid", "trip_id", "feed_order", "stop_id", "stop_sequence", "reason")


@query(
    "resolution_summary",
    f"""
with {ALIGN}
select case when seq is null then 'stop_not_on_trip' else 'resolved' end as outcome, count(*) as rows,
       round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from al group by 1
""",
    "ev",
    "long_stop_times",
)
def _(v):
    return alignment.resolution_summary(alignment.resolve_predictions(unresolved(v), v.long_stop_times, poll="eid"))


# --- change-only ---

def changed_sql(given: str = "", rows: str = "observed", more: tuple[str, ...] = ()) -> str:
    """Change-only as a fold over each key; `more` columns of `rows`, which `given` may define, start a key anew."""
    keys = ("start_date", "trip_id", "stop_sequence", *more)
    key, of_o = ", ".join(keys), ", ".join(f"o.{k}" for k in keys)
    same = " and ".join(f"o.{k} = f.{k}" for k in keys)
    return f"""
with recursive {given} o as (
  select *, row_number() over (partition by {key} order by observed_at) as rn from {rows}),
fold as (
  select {key}, rn, eid, true as keep, arrival_us as la, delay_seconds as ld from o where rn = 1
  union all
  select {of_o}, o.rn, o.eid, x.keep,
         case when x.keep then o.arrival_us else f.la end, case when x.keep then o.delay_seconds else f.ld end
  from fold f join o on {same} and o.rn = f.rn + 1,
  lateral (select case
    when o.arrival_us is not null and f.la is not null then abs(o.arrival_us - f.la) >= 30000000
    when (o.arrival_us is null) <> (f.la is null) then true
    when o.delay_seconds is not null and f.ld is not null then abs(o.delay_seconds - f.ld) >= 30
    else o.delay_seconds is distinct from f.ld end as keep) x)
select eid from fold where keep
"""


CHANGED = changed_sql()


@query("change_only_batch", CHANGED, "observed")
def _(v):
    return changes.select_changed(v.observed).select("eid")


@query("change_only_stream", CHANGED, "observed")
def _(v):
    """The same through a stream: whole table landed as files, state per key, then read back."""
    from stopclock.streaming.replay import replay_changes

    return replay_changes(v.observed).select("eid")


FIRST_WRITE = """
with r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events)
select user_id, event_type, event_id, round(value, 6) as value from r where rn = 1
"""


@query("keep_first_per_key", FIRST_WRITE)
def _(v):
    from stopclock.sinks.tables import keep_first

    rows = v.table("events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "merged_captures",
    """
with both_ as (
  select event_id, user_id, value, 0 as capture from events where event_type in ('click', 'view', 'error')
  union all select event_id, user_id, -value, 1 from events where event_type in ('error', 'signup', 'purchase')),
r as (select *, row_number() over (partition by event_id order by capture) as rn from both_)
select event_id, user_id, round(value, 6) as value from r where rn = 1
""",
)
def _(v):
    from stopclock.sinks.tables import merge_captures

    e = v.table("events").select("event_id", "user_id", "value", "event_type")
    first = e.where(F.col("event_type").isin("click", "view", "error")).drop("event_type")
    second = e.where(F.col("event_type").isin("error", "signup", "purchase")).drop("event_type").withColumn("value", -F.col("value"))
    return merge_captures(first, second, ["event_id"])


@query(
    "merged_capture_counts",
    """
select (select count(*) from events where event_type in ('click', 'view', 'error')) as before_rows,
       (select count(*) from events where event_type in ('error', 'signup', 'purchase')) as offered_rows,
       (select count(*) from events) as after_rows
""",
)
def _(v):
    from stopclock.sinks.tables import merge_counts

    e = v.table("events").select("event_id", "event_type")
    return merge_counts(
        e.where(F.col("event_type").isin("click", "view", "error")), e.where(F.col("event_type").isin("error", "signup", "purchase")), ["event_id"]
    )


@query(
    "upserted_scores",
    """
with n as (select start_date, trip_id, stop_sequence, horizon_minutes, source, error_seconds + 1 as error_seconds from scored where source = 'lgbm' and is_weekend),
o as (select start_date, trip_id, stop_sequence, horizon_minutes, source, error_seconds from scored
      where not (source = 'lgbm' and is_weekend))
select source, count(*) as n, sum(error_seconds)::bigint as total from (select * from n union all select * from o) x group by source
""",
    "scored",
)
def _(v):
    from stopclock.sinks.tables import upsert_rows
    from stopclock.schemas import KEYS

    keys = KEYS["prediction_errors"]
    stored = v.scored.select(*keys, "error_seconds")
    new = v.scored.where("source = 'lgbm' and is_weekend").select(*keys, (F.col("error_seconds") + 1).alias("error_seconds"))
    return upsert_rows(stored, new, keys, within="source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("error_seconds").alias("total"))
