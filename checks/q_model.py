"""Segments, anchors, training pairs, conditions, features and predictors."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import day_seconds, local, secs, utc
from stopclock.fixed import PERSIST_DELAY, SEGMENT_MEAN, TREES
from stopclock.operators import accuracy, conditions, contexts, features, model, segments
from stopclock.operators.scoring import score_source
from stopclock.session import written

FIT = "2024-03-12"


def durations(table: str, through: str) -> str:
    return f"""
dur as (
  select feed_version, start_date, trip_id, stop_sequence, stop_id as from_stop_id, lead(stop_id) over w as to_stop_id,
         {secs("arrived_at", "lead(arrived_at) over w")} as seconds,
         round({day_seconds("arrived_at", "start_date")} / 3600)::bigint as hour_bin, isodow(start_date) in (6, 7) as is_weekend,
         ping_gap_seconds as from_gap, lead(ping_gap_seconds) over w as to_gap
  from {table} where start_date <= date '{through}'
  window w as (partition by feed_version, start_date, trip_id order by stop_sequence)),
good as (select * from dur where to_stop_id is not null and seconds between 1 and 1800 and from_gap <= 180 and to_gap <= 180
         and hour_bin between 0 and 29),
stats as (
  select feed_version, from_stop_id, to_stop_id, hour_bin, is_weekend, count(*) as n, avg(seconds) as mean_seconds,
         stddev_samp(seconds) as stddev_seconds, quantile_cont(seconds, 0.5) as median_seconds
  from good group by all)
"""


@query(
    "segment_durations",
    f"""
with {durations("arrivals", "2001-12-31")}
select feed_version, start_date::varchar as start_date, trip_id, stop_sequence::bigint as stop_sequence, from_stop_id, to_stop_id,
       round(seconds, 6) as seconds, hour_bin, is_weekend, from_gap::bigint as from_gap, to_gap::bigint as to_gap
from dur where to_stop_id is not null
""",
    "arrivals",
)
def _(v):
    return segments.segment_durations(v.arrivals)


for _name, _table, _through in (("short", "arrivals", "1999-06-30"), ("long", "long_arrivals", FIT)):

    @query(
        f"segment_stats_{_name}",
        f"""
with {durations(_table, _through)}
select feed_version, from_stop_id, to_stop_id, hour_bin, is_weekend, n, round(mean_seconds, 6) as mean_seconds,
       round(stddev_seconds, 6) as stddev_seconds, round(median_seconds, 6) as median_seconds, '{_through}' as fit_through_date
from stats
""",
        _table,
    )
    def _(v, table=_table, through=_through):
        return segments.fit_segment_stats(getattr(v, table), through)


LOOKUP = """
seg as (select feed_version, from_stop_id, to_stop_id, sum(mean_seconds * n) / sum(n) as m from stats group by all),
everywhere as (select feed_version, sum(mean_seconds * n) / sum(n) as m from stats group by feed_version)
"""


def long_stats(v):
    return segments.fit_segment_stats(v.long_arrivals, FIT)


@query(
    "segment_lookup",
    f"""
with {durations("long_arrivals", FIT)}, {LOOKUP},
q as (
  select feed_version, start_date, trip_id, stop_sequence, stop_id as from_stop_id, lead(stop_id) over w as to_stop_id,
         round({day_seconds("arrived_at", "start_date")} / 3600)::bigint as hour_bin, isodow(start_date) in (6, 7) as is_weekend
  from long_arrivals window w as (partition by feed_version, start_date, trip_id order by stop_sequence))
select q.trip_id, q.stop_sequence::bigint as stop_sequence, round(coalesce(s.mean_seconds, g.m, w.m, 60), 6) as mean_seconds,
       case when s.mean_seconds is not null then 'exact' when g.m is not null then 'segment' else 'global' end as level
from q left join stats s on s.feed_version = q.feed_version and s.from_stop_id = q.from_stop_id and s.to_stop_id = q.to_stop_id
       and s.hour_bin = q.hour_bin and s.is_weekend = q.is_weekend
left join seg g on g.feed_version = q.feed_version and g.from_stop_id = q.from_stop_id and g.to_stop_id = q.to_stop_id
left join everywhere w on w.feed_version = q.feed_version
where q.to_stop_id is not null
""",
    "long_arrivals",
)
def _(v):
    pairs = segments.segment_durations(v.long_arrivals).select(
        "feed_version", "trip_id", "stop_sequence", "from_stop_id", "to_stop_id", "hour_bin", "is_weekend"
    )
    return segments.lookup_segments(pairs, written(long_stats(v), "stats")).select("trip_id", "stop_sequence", "mean_seconds", "level")


ANCHORS = f"""
cand as (
  select q.start_date, q.trip_id, q.stop_sequence, q.stop_id, q.feed_version, q.route_id, q.arrived_at, q.ping_gap_seconds,
         q.horizon_minutes, a.stop_sequence as aseq, a.stop_id as astop, a.arrived_at as aat, a.known,
         row_number() over (partition by q.start_date, q.trip_id, q.stop_sequence, q.horizon_minutes order by a.stop_sequence desc) as rn
  from {{agency}} q join (
    select *, arrived_at + to_seconds(coalesce(ping_gap_seconds, 0)) as known from {{arrivals}}) a
    on a.start_date = q.start_date and a.trip_id = q.trip_id and a.stop_sequence < q.stop_sequence
    and a.known <= q.arrived_at - to_minutes(q.horizon_minutes)),
ctx as (
  select c.*, sa.arrival_seconds as asec, sb.arrival_seconds as tsec,
         round({day_seconds("aat", "start_date")} / 3600)::bigint as hour_bin, isodow(start_date) in (6, 7) as is_weekend,
         c.arrived_at - to_minutes(horizon_minutes) as instant
  from cand c
  join {{stop_times}} sa on sa.feed_version = c.feed_version and sa.trip_id = c.trip_id and sa.stop_sequence = c.aseq
  join {{stop_times}} sb on sb.feed_version = c.feed_version and sb.trip_id = c.trip_id and sb.stop_sequence = c.stop_sequence
  where rn = 1 and sa.arrival_seconds is not null and sb.arrival_seconds is not null)
"""
LONG = ANCHORS.format(agency="long_agency", arrivals="long_arrivals", stop_times="long_stop_times")
SHORT = ANCHORS.format(
    agency="(select * from scored where source = 'mts')", arrivals="arrivals", stop_times="stop_times"
)
LONG_NEEDS = ("long_agency", "long_arrivals", "long_stop_times")
CONTEXT = """
select start_date::varchar as start_date, trip_id, feed_version, route_id, stop_sequence::bigint as target_sequence,
       stop_id as target_stop_id, aseq::bigint as anchor_sequence, astop as anchor_stop_id, epoch_us(aat) as anchor_arrived_at,
       epoch_us(known) as anchor_known_at, asec::bigint as anchor_scheduled_seconds, tsec::bigint as target_scheduled_seconds,
       hour_bin, is_weekend, horizon_minutes::bigint as horizon_minutes, epoch_us(arrived_at) as actual_arrived_at,
       ping_gap_seconds::bigint as ping_gap_seconds, epoch_us(instant) as prediction_instant
from ctx
"""


def long_contexts(v):
    return contexts.evaluation_contexts(v.long_agency, v.long_arrivals, v.long_stop_times)


def written_long(v):
    """Contexts and statistics, stored: sums along trips read both more than once."""
    return written(long_contexts(v), "contexts"), written(long_stats(v), "stats")


@query("anchors_long_trips", f"with {LONG} {CONTEXT}", *LONG_NEEDS)
def _(v):
    return long_contexts(v)


@query("anchors_short_trips", f"with {SHORT} {CONTEXT}", "scored", "arrivals", "stop_times")
def _(v):
    return contexts.evaluation_contexts(v.scored, v.arrivals, v.stop_times)


PAIRS = f"""
obs as (
  select a.*, st.arrival_seconds as sec from long_arrivals a
  join long_stop_times st using (feed_version, trip_id, stop_sequence)
  where a.ping_gap_seconds <= 180 and st.arrival_seconds is not null),
pairs as (
  select a.start_date, a.trip_id, a.feed_version, tr.route_id, b.stop_sequence as tseq, b.stop_id as tstop, a.stop_sequence as aseq,
         a.stop_id as astop, a.arrived_at as aat, a.arrived_at + to_seconds(a.ping_gap_seconds) as known, a.sec as asec,
         b.sec as tsec, b.arrived_at as bat, b.ping_gap_seconds as gap
  from obs a join obs b on b.start_date = a.start_date and b.trip_id = a.trip_id and b.stop_sequence > a.stop_sequence
   and b.stop_sequence <= a.stop_sequence + 30
  join long_trips tr on tr.feed_version = a.feed_version and tr.trip_id = a.trip_id
  where b.arrived_at > a.arrived_at and {secs("a.arrived_at", "b.arrived_at")} <= 7200
    and (b.stop_sequence - a.stop_sequence <= 12
         or ('0x' || left(md5(a.trip_id || ':' || a.stop_sequence || ':' || b.stop_sequence), 8))::bigint % 100 < 35))
"""


def long_pairs(v):
    return contexts.training_contexts(v.long_arrivals, v.long_trips, v.long_stop_times)


@query(
    "training_pairs",
    f"""
with {PAIRS}
select start_date::varchar as start_date, trip_id, feed_version, route_id, tseq::bigint as target_sequence, tstop as target_stop_id,
       aseq::bigint as anchor_sequence, astop as anchor_stop_id, epoch_us(aat) as anchor_arrived_at,
       epoch_us(known) as anchor_known_at, asec::bigint as anchor_scheduled_seconds, tsec::bigint as target_scheduled_seconds,
       round({day_seconds("aat", "start_date")} / 3600)::bigint as hour_bin, isodow(start_date) in (6, 7) as is_weekend,
       null::bigint as horizon_minutes, epoch_us(bat) as actual_arrived_at, gap::bigint as ping_gap_seconds,
       epoch_us(known) as prediction_instant
from pairs
""",
    "long_arrivals",
    "long_stop_times",
    "long_trips",
)
def _(v):
    return long_pairs(v)


CONDITIONS = f"""
ob as (
  select t.route_id, epoch_us(a.arrived_at) + coalesce(a.ping_gap_seconds, 0) * 1000000 as known,
         {day_seconds("a.arrived_at", "a.start_date")} - st.arrival_seconds as delay
  from long_arrivals a join long_trips t using (feed_version, trip_id)
  join long_stop_times st using (feed_version, trip_id, stop_sequence)
  where a.ping_gap_seconds <= 180 and st.arrival_seconds is not null),
span as (select route_id, min(known) // 300000000 as b0, max(known) // 300000000 + 1 as b1 from ob group by 1),
grid as (select route_id, unnest(range(b0, b1 + 1)) as bucket from span),
cond as (
  select g.route_id, g.bucket, avg(o.delay) as d, count(*) as n from grid g
  join ob o on o.route_id = g.route_id and o.known <= g.bucket * 300000000 and o.known > g.bucket * 300000000 - 1800000000
  group by all)
"""
COND_NEEDS = ("long_arrivals", "long_trips", "long_stop_times")


def long_conditions(v):
    return conditions.build_conditions(conditions.observations(v.long_arrivals, v.long_trips, v.long_stop_times))


@query(
    "route_conditions",
    f"with {CONDITIONS} select route_id, bucket, round(d, 6) as recent_delay_seconds, n as recent_n from cond",
    *COND_NEEDS,
)
def _(v):
    return long_conditions(v)


@query(
    "route_conditions_lookup",
    f"""
with {CONDITIONS},
q as (select route_id, trip_id, stop_sequence, horizon_minutes, epoch_us(arrived_at - to_minutes(horizon_minutes)) // 300000000 as b
      from long_agency)
select q.route_id, q.trip_id, q.stop_sequence::bigint as stop_sequence, q.horizon_minutes::bigint as horizon_minutes,
       round(case when c.n is not null then c.d when p.n is not null then p.d else 0 end, 6) as route_recent_delay_seconds,
       coalesce(c.n, p.n, 0) as route_recent_n
from q left join cond c on c.route_id = q.route_id and c.bucket = q.b
left join cond p on p.route_id = q.route_id and p.bucket = q.b - 1
""",
    "long_agency",
    *COND_NEEDS,
)
def _(v):
    from stopclock.functions.clock import plus_seconds

    asked = v.long_agency.select(
        "route_id", "trip_id", "stop_sequence", "horizon_minutes",
        plus_seconds("arrived_at", -F.col("horizon_minutes") * 60).alias("instant"),
    )
    return conditions.lookup_conditions(asked, long_conditions(v), "instant").drop("instant")


SUMS = """
hops as (
  select feed_version, trip_id, stop_sequence, lag(stop_id) over w as f, stop_id as t from long_stop_times
  window w as (partition by feed_version, trip_id order by stop_sequence)),
sums as (
  select c.start_date, c.trip_id, c.stop_sequence, c.horizon_minutes,
         sum(coalesce(s.mean_seconds, g.m, w.m, 60)) as total, count(*) filter (s.mean_seconds is null) / count(*)::double as coarse
  from ctx c join hops h on h.feed_version = c.feed_version and h.trip_id = c.trip_id and h.stop_sequence > c.aseq
       and h.stop_sequence <= c.stop_sequence
  left join stats s on s.feed_version = h.feed_version and s.from_stop_id = h.f and s.to_stop_id = h.t and s.hour_bin = c.hour_bin
       and s.is_weekend = c.is_weekend
  left join seg g on g.feed_version = h.feed_version and g.from_stop_id = h.f and g.to_stop_id = h.t
  left join everywhere w on w.feed_version = h.feed_version
  group by all)
"""


@query(
    "segment_sums",
    f"""
with {durations("long_arrivals", FIT)}, {LOOKUP}, {LONG}, {SUMS}
select trip_id, stop_sequence::bigint as target_sequence, horizon_minutes::bigint as horizon_minutes,
       round(total, 4) as segment_sum_seconds, round(coarse, 6) as coarse_segment_share
from sums
""",
    *LONG_NEEDS,
)
def _(v):
    asked, stats = written_long(v)
    return segments.segment_sums(asked, v.long_stop_times, stats).select(
        "trip_id", "target_sequence", "horizon_minutes", F.round("segment_sum_seconds", 4).alias("segment_sum_seconds"),
        "coarse_segment_share",
    )


FEATURE_SQL = f"""
with {durations("long_arrivals", FIT)}, {LOOKUP}, {LONG}, {SUMS}, {CONDITIONS},
routes_ as (select route_id, row_number() over (order by route_id) - 1 as code from (select distinct route_id from long_agency)),
sizes as (select feed_version, trip_id, count(*) as stops from long_stop_times group by all)
select c.trip_id, c.stop_sequence::bigint as target_sequence, c.horizon_minutes::bigint as horizon_minutes,
       (c.stop_sequence - c.aseq)::double as stops_ahead, (c.tsec - c.asec)::double as scheduled_remaining_seconds,
       round({day_seconds("aat", "c.start_date")} - c.asec, 6) as anchor_delay_seconds, round(u.total, 4) as segment_sum_seconds,
       c.hour_bin::double as hour_bin, case when c.is_weekend then 1.0 else 0.0 end::double as is_weekend,
       round(u.coarse, 6) as coarse_segment_share,
       round(case when k.n is not null then k.d when p.n is not null then p.d else 0 end, 6) as route_recent_delay_seconds,
       coalesce(k.n, p.n, 0)::double as route_recent_n, round(c.aseq / z.stops::double, 6) as trip_progress,
       (hour({local("aat")}) * 60 + minute({local("aat")}))::double as minute_of_day, r.code::double as route_index,
       round({secs("aat", "c.arrived_at")}, 6) as label_seconds
from ctx c join sums u using (start_date, trip_id, stop_sequence, horizon_minutes)
join sizes z on z.trip_id = c.trip_id and z.feed_version = c.feed_version join routes_ r on r.route_id = c.route_id
left join cond k on k.route_id = c.route_id and k.bucket = epoch_us(c.instant) // 300000000
left join cond p on p.route_id = c.route_id and p.bucket = epoch_us(c.instant) // 300000000 - 1
"""


@query("feature_matrix", FEATURE_SQL, *LONG_NEEDS, "long_trips")
def _(v):
    from stopclock.fixed import FEATURES

    asked, stats = written_long(v)
    rows = features.build_features(asked, v.long_stop_times, stats, long_conditions(v), features.route_index(v.long_agency))
    return rows.select("trip_id", "target_sequence", "horizon_minutes", *FEATURES, "label_seconds").withColumn(
        "segment_sum_seconds", F.round("segment_sum_seconds", 4)
    )


BASELINE_SUMMARY = """
select '{source}' as source, horizon_minutes::bigint as horizon_minutes, count(*) as n, round(avg(abs(e)), 6) as mae_seconds,
       quantile_cont(abs(e), 0.5) as median_seconds, round(quantile_cont(abs(e), 0.9), 6) as p90_seconds, round(avg(e), 6) as bias_seconds
from x group by horizon_minutes
"""


@query(
    "persist_delay",
    f"""
with {LONG},
x as (
  select horizon_minutes, round({secs("arrived_at", utc("start_date::timestamp + to_seconds(tsec)") + " + to_microseconds(round((" + day_seconds("aat", "start_date") + " - asec) * 1000000)::bigint)")})::bigint as e
  from ctx)
{BASELINE_SUMMARY.format(source=PERSIST_DELAY)}
""",
    *LONG_NEEDS,
)
def _(v):
    rows = score_source(v.long_agency, model.persist_delay(long_contexts(v)), PERSIST_DELAY)
    return accuracy.summarise(rows, ["source", "horizon_minutes"])


@query(
    "segment_mean",
    f"""
with {durations("long_arrivals", FIT)}, {LOOKUP}, {LONG}, {SUMS},
x as (
  select c.horizon_minutes, round({secs("arrived_at", "aat + to_microseconds(round(total * 1000000)::bigint)")})::bigint as e
  from ctx c join sums using (start_date, trip_id, stop_sequence, horizon_minutes))
{BASELINE_SUMMARY.format(source=SEGMENT_MEAN)}
""",
    *LONG_NEEDS,
)
def _(v):
    asked, stats = written_long(v)
    said = model.segment_mean(asked, v.long_stop_times, stats)
    rows = score_source(v.long_agency, said, SEGMENT_MEAN)
    return accuracy.summarise(rows, ["source", "horizon_minutes"])


@query(
    "time_ordered_split",
    f"""
with {PAIRS},
r as (select *, row_number() over (order by aat, start_date, trip_id, aseq, tseq) as rn, count(*) over () as total from pairs)
select start_date::varchar as start_date, count(*) as rows, count(*) filter (rn > floor(0.8 * total)) as late from r group by 1
""",
    "long_arrivals",
    "long_stop_times",
    "long_trips",
)
def _(v):
    split = features.time_split(long_pairs(v), "anchor_arrived_at", 0.8, ["start_date", "trip_id", "anchor_sequence", "target_sequence"])
    return split.groupBy("start_date").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_late").alias("late"))


@query(
    "route_index",
    "select route_id, row_number() over (order by route_id) - 1 as route_index from (select distinct route_id from scored)",
    "scored",
)
def _(v):
    return features.route_index(v.scored)


TEST = ("2024-03-13", "2024-03-17")
RUN_SQL = f"""
with {durations("long_arrivals", FIT)}, {LOOKUP}, {LONG}, {SUMS},
asked as (select c.*, total from ctx c join sums using (start_date, trip_id, stop_sequence, horizon_minutes)
          where c.start_date between date '{TEST[0]}' and date '{TEST[1]}' and c.ping_gap_seconds <= 180),
x as (
  select 'mts' as source, a.horizon_minutes, g.error_seconds as e from asked a
  join long_agency g using (start_date, trip_id, stop_sequence, horizon_minutes)
  union all
  select '{PERSIST_DELAY}', horizon_minutes, round({secs("arrived_at", utc("start_date::timestamp + to_seconds(tsec)") + " + to_microseconds(round((" + day_seconds("aat", "start_date") + " - asec) * 1000000)::bigint)")})::bigint from asked
  union all
  select '{SEGMENT_MEAN}', horizon_minutes, round({secs("arrived_at", "aat + to_microseconds(round(total * 1000000)::bigint)")})::bigint from asked)
select source, horizon_minutes::bigint as horizon_minutes, count(*) as n, round(avg(abs(e)), 6) as mae_seconds,
       quantile_cont(abs(e), 0.5) as median_seconds, round(quantile_cont(abs(e), 0.9), 6) as p90_seconds, round(avg(e), 6) as bias_seconds,
       null::boolean as after_cutoff, null::boolean as rounds_recorded
from x group by all
union all
select 'lgbm', horizon_minutes::bigint, count(*), null, null, null, null, true, true from asked group by horizon_minutes
"""


@query("boosted_trees_accuracy", RUN_SQL, *LONG_NEEDS, "long_trips")
def _(v):
    """Both baselines and the agency on the test days, matched. No SQL fits the trees: of them the rows, that no prediction
    lies before its cutoff, and that the recorded rounds are the trees kept. `tests/test_model.py` holds their errors."""
    run = model.run_models(v.long_arrivals, v.long_trips, v.long_stop_times, v.long_agency, ("2024-03-04", FIT), TEST)
    population = written(accuracy.matched(accuracy.label_filter(run.scored, 180)), "population")
    trees = F.col("source") == TREES
    ahead = population.where(trees).groupBy("horizon_minutes").agg(F.bool_and(F.col("predicted_arrival") >= F.col("predicted_at")).alias("_after"))
    rounds = run.registry.select(F.get_json_object("params", "$.rounds_used").cast("int")).scalar()
    shown = [F.when(~trees, F.col(c)).alias(c) for c in ("mae_seconds", "median_seconds", "p90_seconds", "bias_seconds")]
    return accuracy.summarise(population, ["source", "horizon_minutes"]).join(ahead, "horizon_minutes").select(
        "source", "horizon_minutes", "n", *shown,
        F.when(trees, F.col("_after")).alias("after_cutoff"),
        F.when(trees, rounds == len(run.model.trees)).alias("rounds_recorded"),
    )
