"""Polls, gaps, coverage and freshness."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import secs
from stopclock.plans import published, reports
from stopclock.streaming import health

# As late as the events go and as far back as they go, so the window filters run over all of them.
AS_OF = "2024-01-31 00:00:00"
HOURS = 24 * 31


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query(
    "polls_by_status",
    """
with recent as (
  select feed, status, duration_ms as ms, if(rows_written is null, 0, rows_written) as written
  from polls where epoch_us(started_at) > epoch_us(timestamp '2024-01-31') - 744 * 3600000000)
select feed, status, count(*) as polls, round(sum(ms)::double / count(ms)) as avg_ms, max(ms) as worst_ms, sum(written)::bigint as rows_written
from recent group by feed, status
""",
    "polls",
)
def _(v):
    return reports.polls_by_status(v.polls, as_of(), HOURS)


GAPS = f"""
with worked as (
  select distinct feed, started_at from polls
  where status not in ('http_error', 'parse_error', 'timeout', 'error', 'db_error') and epoch_us(started_at) > epoch_us(timestamp '2024-01-31') - 744 * 3600000000),
x as (
  select b.feed, b.started_at, a.started_at as prev, {secs("a.started_at", "b.started_at")} as gap
  from worked b asof join worked a on a.feed = b.feed and b.started_at > a.started_at)
"""


@query(
    "success_gaps",
    f"""{GAPS}
select feed, epoch_us(prev) as previous_success, epoch_us(started_at) as recovered_at, round(gap, 6) as gap from x where gap > 120
""",
    "polls",
)
def _(v):
    return reports.success_gaps(v.polls, as_of(), HOURS)


@query(
    "longest_success_gaps",
    f"""{GAPS}
select feed, epoch_us(prev) as previous_success, epoch_us(started_at) as recovered_at, round(gap) as gap_seconds from x
where gap > 120 order by gap desc, feed, started_at limit 20
""",
    "polls",
)
def _(v):
    return reports.longest_gaps(v.polls, as_of(), HOURS)


@query(
    "change_only_compression",
    """
select (select count(*) from polls where feed = 'trip_updates' and status = 'ok') as successful_polls,
       (select count(*) from observed) as predictions_written, (select count(*) from positions) as positions_written
""",
    "polls",
    "observed",
    "positions",
)
def _(v):
    return reports.compression(
        v.polls,
        v.observed.withColumn("ingested_at", F.col("observed_at")),
        v.positions.withColumn("ingested_at", F.col("ts")),
        as_of(),
        HOURS,
    )


@query(
    "latest_polls",
    """
select f.feed, (select max(epoch_us(p.started_at)) from polls p where p.feed = f.feed) as last_attempt,
       (select max(epoch_us(p.started_at)) from polls p where p.feed = f.feed and p.status = 'ok') as last_success
from (select distinct feed from polls) f
""",
    "polls",
)
def _(v):
    return reports.latest_polls(v.polls)


COVERAGE = f"""
with s as (
  select started_at::date as day, started_at, {secs("lag(started_at) over (order by started_at)", "started_at")} as gap
  from polls where status in ('ok', 'skipped_unchanged') and feed = 'vehicle_positions'),
c as (
  select day, count(*) as n, coalesce(sum(gap) filter (gap > 120), 0) as lost, {secs("min(started_at)", "max(started_at)")} as span
  from s group by day)
"""


@query(
    "collection_coverage",
    f"""{COVERAGE}
select day::varchar as day, n as successful_polls, round(lost / 3600.0, 6) as hours_lost,
       round(100.0 * (1 - lost / nullif(span, 0)), 6) as coverage_pct,
       case when span = 0 then 'unknown' when 100.0 * (1 - lost / span) < 50 then 'critical'
            when 100.0 * (1 - lost / span) < 80 then 'warning' else 'good' end as status
from c
""",
    "polls",
)
def _(v):
    from stopclock.functions.labels import coverage_status

    return published.collection_coverage(v.polls).withColumn("status", coverage_status("coverage_pct"))


@query(
    "worst_lost_share",
    f"{COVERAGE} select round(greatest(max(100 - 100.0 * (1 - lost / nullif(span, 0))), 0), 6) as worst_lost_pct from c",
    "polls",
)
def _(v):
    return published.worst_lost_share(published.collection_coverage(v.polls))


@query(
    "label_bands",
    """
with bands(band, above, upto) as (
  values ('tight (<=60s)', -1, 60), ('ok (<=3min)', 60, 180), ('loose (<=10min)', 180, 600), ('poor (>10min)', 600, 2147483647)),
placed as (
  select coalesce(b.band, 'unknown') as band from arrivals a left join bands b on a.ping_gap_seconds > b.above and a.ping_gap_seconds <= b.upto)
select band, count(*) as n, round(count(*) * 100.0 / (select count(*) from arrivals), 6) as pct from placed group by band
""",
    "arrivals",
)
def _(v):
    return published.label_bands(v.arrivals)


@query(
    "feed_freshness",
    """
with f as (select feed, max(started_at) filter (status in ('ok', 'skipped_unchanged')) as last from polls group by feed),
a as (select feed, coalesce(date_diff('microsecond', last, timestamp '2024-01-31') / 1e6, 999999) as age from f)
select feed, round(age, 1) as seconds_since_success, age > 300 as stale, (select bool_and(age > 300) from a) as all_stale from a
""",
    "polls",
)
def _(v):
    return health.freshness(v.polls, as_of())


@query(
    "outage_alerts",
    """
with c as (select feed, started_at, status in ('ok', 'skipped_unchanged') as healthy from polls),
i as (select *, count(*) filter (healthy) over (partition by feed order by started_at rows unbounded preceding) as island from c),
d as (select *, row_number() over (partition by feed, island order by started_at) as nth from i where not healthy),
f as (select *, min(started_at) filter (nth = 2) over (partition by feed, island) as alarm from d),
r as (
  select *, date_diff('microsecond', alarm, started_at) // 1000000 as since from f where nth >= 2)
select feed, island::bigint as island, count(*) as bad_checks, epoch_us(min(started_at)) as alerted_at, epoch_us(max(started_at)) as last_bad_check
from r group by feed, island
""",
    "polls",
)
def _(v):
    return health.outages(health.checks_from_polls(v.polls))


@query(
    "outage_notifications",
    """
with recursive c as (select feed, started_at, status in ('ok', 'skipped_unchanged') as healthy from polls),
i as (select *, count(*) filter (healthy) over (partition by feed order by started_at rows unbounded preceding) as island from c),
d as (select *, row_number() over (partition by feed, island order by started_at) as nth from i where not healthy),
t as (select distinct feed, island, epoch_us(started_at) // 1000000 as s from d where nth >= 2),
sent as (
  select feed, island, min(s) as s from t group by feed, island
  union all
  select x.feed, x.island, (select min(t.s) from t where t.feed = x.feed and t.island = x.island and t.s >= x.s + 1800)
  from sent x where x.s is not null)
select feed, island::bigint as island, s * 1000000 as notified_at from sent where s is not null
""",
    "polls",
)
def _(v):
    return health.notifications(health.checks_from_polls(v.polls), again_after=1800)
