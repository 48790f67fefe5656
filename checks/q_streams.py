"""Ingest and loading: whole tables through streams and loaders, and what they leave stored."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks.catalog import query
from checks.q_feeds import POSITIONS, changed_sql
from stopclock.fixed import VEHICLE_POSITIONS
from stopclock.operators.changes import KEY
from stopclock.schemas import KEYS, VEHICLE_POSITIONS as POSITION_ROWS
from stopclock.session import shared_folder
from stopclock.sinks import schedule, tables
from stopclock.streaming import feeds, replay
from stopclock.streaming.changes import changed_stream
from stopclock.streaming.vehicles import on_map, vehicle_updates


def folder(v, name: str) -> str:
    return f"{shared_folder(v.spark, fallback='file:///tmp/stopclock-shared')}/{name}-{uuid.uuid4().hex}"


# --- change-only state with eviction ---

CUTS = ("2024-01-09", "2024-01-20")
SLICE = "case when observed_at < timestamp '2024-01-09' then 0 when observed_at < timestamp '2024-01-20' then 1 else 2 end"
# A key starts anew in the commit after one whose newest observation lies two days past the close of its service day.
AGED = f"""
sliced as (select *, {SLICE} as slice from observed),
newest as (select s.slice, (select max(observed_at) from sliced z where z.slice <= s.slice) as at from (select distinct slice from sliced) s),
told as (
  select sliced.*, (select count(*) from newest n where n.slice < sliced.slice and n.at >= sliced.start_date + interval 5 day) as age from sliced),
"""


@query("ingest_predictions_stream", changed_sql(AGED, "told", ("age",)), "observed")
def _(v):
    """Change-only state over three commits, closed service days being forgotten."""
    cuts = [dt.datetime.fromisoformat(c) for c in CUTS]
    return replay.replay(v.observed, "observed_at", changed_stream, cuts, KEY).select("eid")


# --- the map of vehicles ---

MAP_CUTS = ("2024-01-15 16:24:00", "2024-01-15 16:48:00")


@query(
    "vehicles_streamed",
    f"""
with p as (
  select *, case when ts < timestamp '{MAP_CUTS[0]}' then 0 when ts < timestamp '{MAP_CUTS[1]}' then 1 else 2 end as slice
  from positions where lat is not null and lon is not null),
c as (select distinct slice as commit from p),
r as (
  select c.commit, p.*, row_number() over (partition by c.commit, vehicle_id order by ts desc) as rn, max(ts) over (partition by c.commit) as newest
  from p join c on p.slice <= c.commit)
select commit::bigint as commit, vehicle_id, epoch_us(ts) as ts, route_id, trip_id, round(lon, 6) as lon
from r where rn = 1 and ts > newest - interval 15 minute
""",
    "positions",
)
def _(v):
    """The map after each of three commits."""
    cuts = [dt.datetime.fromisoformat(c) for c in MAP_CUTS]
    updates = replay.replay(v.positions, "ts", vehicle_updates, cuts, ["vehicle_id"], mode="update")
    maps = [on_map(updates.where(F.col("commit") <= k), ["batch"]).withColumn("commit", F.lit(k)) for k in range(3)]
    return maps[0].unionByName(maps[1]).unionByName(maps[2]).drop("lat")  # its last digit depends on the engine


# --- polls of a feed ---

HEADED = """
seen as (
  select *, case when eid % 13 = 0 then null else 1700000000 + (eid // 3) * 30 end as head,
         timestamp '2024-03-01' + to_seconds(eid) as received from flat),
marked as (
  select *, coalesce(head = lag(head) over (order by received), false) as unchanged from seen),
"""
FRESH = f"""
with {POSITIONS}, {HEADED}
fresh as (
  select eid, received, unchanged, vid, coalesce(case when eid % 5 <> 0 then (epoch_us(ts) // 1000000) + 1 end, head) as second,
         case when eid % 23 <> 0 then 'U' || u end as trip_id, k from marked),
told as (select * from fresh where not unchanged and vid is not null and second is not null),
firsts as (select *, row_number() over (partition by vid, second order by received) as rn from told)
"""


def landed(v):
    """Every event as a landed snapshot of the position feed, three in a row with one header."""
    eid = F.col("eid")
    header = F.when(eid % 13 == 0, 0).otherwise(1_700_000_000 + F.floor(eid / 3) * 30).cast("long")
    received = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00").cast("timestamp")) + eid)
    return v.snapshots.select(F.lit(VEHICLE_POSITIONS).alias("feed"), header.alias("header_ts"), "entity", received.alias("received_at"), "eid")


def ingested(v) -> feeds.Store:
    """The position feed, landed and ingested in three runs from one checkpoint."""
    root = folder(v, "ingest")
    store, all_ = feeds.Store(root), landed(v)
    top = v.events.agg(F.max("eid")).first()[0] or 0
    for k in range(3):
        part = all_.where((F.col("eid") > top * k // 3 if k else F.lit(True)) & (F.col("eid") <= top * (k + 1) // 3))
        part.drop("eid").write.mode("append").json(f"{root}/landing")
        feeds.start_feed(v.spark, f"{root}/landing", VEHICLE_POSITIONS, store, every=None).awaitTermination()
    return store


@query(
    "poll_outcomes",
    FRESH
    + """
select epoch_us(m.received) as started_at, case when m.unchanged then 'skipped_unchanged' else 'ok' end as status,
       case when m.eid % 13 <> 0 then m.head * 1000000 end as feed_timestamp, 2::bigint as entity_count,
       (select count(*) from firsts f where f.eid = m.eid and f.rn = 1) as rows_written
from marked m
""",
    "ev",
)
def _(v):
    polls = v.spark.read.parquet(ingested(v).table("poll_log"))
    return polls.select("started_at", "status", "feed_timestamp", "entity_count", "rows_written")


@query(
    "unchanged_snapshots",
    FRESH + " select unchanged, count(*) as snapshots, sum(eid)::bigint as eids from marked group by unchanged",
    "ev",
)
def _(v):
    marked = feeds.mark_unchanged(landed(v))
    return marked.groupBy("unchanged").agg(F.count(F.lit(1)).alias("snapshots"), F.sum("eid").alias("eids"))


@query(
    "ingest_positions_stream",
    FRESH
    + """
select vid as vehicle_id, second * 1000000 as ts, trip_id, k as current_stop_sequence from firsts where rn = 1
""",
    "ev",
)
def _(v):
    rows = tables.table(v.spark, ingested(v).table("vehicle_positions"), POSITION_ROWS, ["start_date"])
    return rows.select("vehicle_id", "ts", "trip_id", "current_stop_sequence")


# --- tables whose partitions are replaced ---


@query(
    "scores_upserted_in_place",
    """
with n as (select * replace (error_seconds + 1 as error_seconds) from scored where source = 'lgbm' and is_weekend)
select source, count(*) as n, sum(error_seconds)::bigint as total, count(distinct start_date) as days
from (select source, start_date, error_seconds from n
      union all select source, start_date, error_seconds from scored where not (source = 'lgbm' and is_weekend)) x group by source
""",
    "scored",
)
def _(v):
    """Stored, then the weekend's rows of one source upserted: only their partitions are written again."""
    keys, path = KEYS["prediction_errors"], folder(v, "scores")
    day = F.date_trunc("month", "start_date").cast("date")
    rows = v.scored.select(*keys, "error_seconds", day.alias("month"))
    tables.upsert(rows, path, keys, ["month", "source"])
    new = v.scored.where("source = 'lgbm' and is_weekend").select(*keys, (F.col("error_seconds") + 1).alias("error_seconds"), day.alias("month"))
    tables.upsert(new, path, keys, ["month", "source"], within="start_date")
    stored = tables.table(v.spark, path, rows.schema, ["month", "source"])
    return stored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("error_seconds").alias("total"), F.count_distinct("start_date").alias("days")
    )


@query(
    "arrivals_appended_twice",
    """
select year(start_date)::bigint as year, count(*) as n, sum(stop_sequence)::bigint as sequences, count(*) filter (method = 'again') as from_second
from (select start_date, stop_sequence, method from arrivals where stop_sequence <= 3
      union all select start_date, stop_sequence, 'again' from arrivals where stop_sequence > 3) x group by 1
""",
    "arrivals",
)
def _(v):
    """First write wins: the early stops, then all of them under another method."""
    path, keys = folder(v, "arrivals"), KEYS["arrivals"]
    year = F.date_trunc("year", "start_date").cast("date")
    rows = v.arrivals.withColumn("year_day", year)
    tables.append_new(rows.where("stop_sequence <= 3"), path, keys, ["arrived_at"], ["year_day"])
    tables.append_new(rows.withColumn("method", F.lit("again")), path, keys, ["arrived_at"], ["year_day"])
    stored = tables.table(v.spark, path, rows.schema, ["year_day"])
    return stored.groupBy(F.year("start_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("stop_sequence").alias("sequences"), F.count_if(F.col("method") == "again").alias("from_second")
    )


# --- a schedule of text files ---


def clock(seconds):
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60))


def written_schedule(v) -> str:
    """The short trips as schedule text: version f0, services as the supplier and customer tables give them."""
    root = folder(v, "schedule")
    nation, trips = v.table("nation"), v.trips.where("feed_version = 'f0'")
    flags = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    files = {
        "agency.txt": nation.select(F.col("n_regionkey").cast("string").alias("agency_id"), F.lit("America/Los_Angeles").alias("agency_timezone")).distinct(),
        "routes.txt": v.routes.where("feed_version = 'f0'").select("route_id", "route_long_name", "route_type"),
        "stops.txt": v.stops.where("feed_version = 'f0'").select("stop_id", "stop_name", "stop_lat", "stop_lon"),
        "trips.txt": trips.select("route_id", "service_id", "trip_id", "shape_id", "trip_headsign"),
        "stop_times.txt": v.stop_times.where("feed_version = 'f0'").select(
            "trip_id",
            clock(F.col("arrival_seconds")).alias("arrival_time"),
            clock(F.col("departure_seconds")).alias("departure_time"),
            "stop_id",
            "stop_sequence",
            (F.col("stop_sequence") * 0.25).alias("shape_dist_traveled"),
        ),
        "shapes.txt": v.shapes.select("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", (F.col("shape_pt_sequence") * 0.5).alias("shape_dist_traveled")),
        "calendar.txt": v.calendar.select(
            "service_id", *[F.col(f).cast("int").alias(f) for f in flags], *[F.date_format(c, "yyyyMMdd").alias(c) for c in ("start_date", "end_date")]
        ),
        "calendar_dates.txt": v.exceptions.groupBy("service_id", F.date_format("service_date", "yyyyMMdd").alias("date")).agg(F.min("exception_type").alias("exception_type")),
        "feed_info.txt": nation.agg(F.concat(F.lit("v"), F.count(F.lit(1)).cast("string")).alias("feed_version"), F.lit("20240101").alias("feed_start_date")),
    }
    for name, rows in files.items():
        rows.write.csv(f"{root}/{name}", header=True)
    return root


def loaded(v, forced: tuple[bool, ...] = (False,)) -> tuple[str, list[str]]:
    """The store and the statuses of some loads of one schedule."""
    source, store = written_schedule(v), folder(v, "store")
    return store, [schedule.load_schedule(v.spark, source, store, "generated", force=f) for f in forced]


# One exception of a service on a date, as the text has it.
EXPANDED = """
days as (select service_id, bits, unnest(generate_series(start_date, end_date, interval 1 day))::date as service_date from calendar),
regular as (select service_id, service_date from days where bits & (1 << (isodow(service_date) - 1)) <> 0),
exc as (select service_id, service_date, min(exception_type) as kind from exceptions group by all),
running as (
  select service_id, service_date from regular anti join (select * from exc where kind = 2) x using (service_id, service_date)
  union select service_id, service_date from exc where kind = 1)
"""


@query(
    "schedule_loaded_twice",
    f"""
with {EXPANDED},
n(item, value) as (
  select 'load 1', 'ok' union all select 'load 2', 'skipped_unchanged' union all select 'load 3', 'ok' union all select 'versions', '1'
  union all select 'publisher', 'v' || (select count(*) from nation)
  union all select 'agencies', (select count(distinct n_regionkey) from nation)::varchar
  union all select 'routes', (select count(*) from routes where feed_version = 'f0')::varchar
  union all select 'stops', (select count(*) from stops where feed_version = 'f0')::varchar
  union all select 'trips', (select count(*) from trips where feed_version = 'f0')::varchar
  union all select 'stop_times', (select count(*) from stop_times where feed_version = 'f0')::varchar
  union all select 'shapes', (select count(*) from shapes)::varchar
  union all select 'calendar', (select count(*) from calendar)::varchar
  union all select 'calendar_dates', (select count(*) from exc)::varchar
  union all select 'service_dates', (select count(*) from running)::varchar)
select * from n
""",
    "routes",
    "stops",
    "trips",
    "stop_times",
    "shapes",
    "calendar",
    "exceptions",
)
def _(v):
    """What three loads say, and the rows of every table as readers see them afterwards."""
    store, statuses = loaded(v, (False, False, True))  # new, the same again, and forced
    versions = schedule.registry(v.spark, store)
    said = [(f"load {i}", s) for i, s in enumerate(statuses, start=1)]
    rows = v.spark.createDataFrame(said, "item string, value string")
    rows = rows.unionByName(versions.agg(F.lit("versions").alias("item"), F.count(F.lit(1)).cast("string").alias("value")))
    rows = rows.unionByName(versions.select(F.lit("publisher").alias("item"), F.col("publisher_version").alias("value")))
    for name in (*schedule.TABLES, "service_dates"):
        count = schedule.read_static(v.spark, store, name).agg(F.lit(name).alias("item"), F.count(F.lit(1)).cast("string").alias("value"))
        rows = rows.unionByName(count)
    return rows


@query(
    "loaded_stop_times",
    """
select trip_id, stop_sequence::bigint as stop_sequence, stop_id, arrival_seconds::bigint as arrival_seconds, departure_seconds::bigint as departure_seconds,
       round(stop_sequence * 0.25::double * 1609.344::double, 6) as shape_dist_traveled_m
from stop_times where feed_version = 'f0'
""",
    "stop_times",
)
def _(v):
    rows = schedule.read_static(v.spark, loaded(v)[0], "stop_times")
    return rows.select("trip_id", "stop_sequence", "stop_id", "arrival_seconds", "departure_seconds", "shape_dist_traveled_m")


@query(
    "loaded_service_dates",
    f"with {EXPANDED} select service_id, service_date::varchar as service_date from running",
    "calendar",
    "exceptions",
)
def _(v):
    return schedule.read_static(v.spark, loaded(v)[0], "service_dates").select("service_id", "service_date")
