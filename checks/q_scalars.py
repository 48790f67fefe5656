"""Scalar functions over whole tables, malformed text included."""

from pyspark.sql import functions as F

from checks.catalog import query
from checks.duck import day_seconds, local, secs, utc
from stopclock.functions import clock, gtfs, labels


@query(
    "gtfs_time_text",
    """
select trip_id, ln::bigint as stop_sequence,
       case when pk % 9 in (0, 1, 3, 4, 5) then null else sched::bigint end as seconds,
       pk % 9 in (3, 4, 5) as refused
from calls
""",
    "calls",
)
def _(v):
    s, pk = F.col("sched"), F.col("pk")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    full = F.format_string("%02d:%02d:%02d", h, m, rest)
    text = (
        F.when(pk % 9 == 0, "  ")
        .when(pk % 9 == 2, F.format_string(" %d:%02d:%02d ", h, m, rest))
        .when(pk % 9 == 3, F.format_string("%02d:%02d", h, m))
        .when(pk % 9 == 4, F.format_string("%02d:75:%02d", h, rest))
        .when(pk % 9 == 5, F.concat(F.lit("-"), full))
        .when(pk % 9 != 1, full)
    )
    rows = v.calls.withColumn("text", text).withColumn("seconds", gtfs.time_to_seconds("text", strict=False))
    refused = gtfs.optional_text("text").isNotNull() & F.col("seconds").isNull()
    return rows.select("trip_id", F.col("ln").alias("stop_sequence"), "seconds", refused.alias("refused"))


@query(
    "gtfs_dates_and_numbers",
    """
select o_orderkey as id, case o_orderkey % 5 when 0 then null when 1 then null when 2 then null else o_orderdate::date::varchar end as day,
       case when o_orderkey % 4 <> 0 then o_custkey end as whole, case when o_orderkey % 6 <> 0 then round(o_totalprice, 6) end as number,
       case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then null else round((o_orderkey % 1000) / 8.0 * 1609.344, 6) end as metres,
       coalesce(o_orderkey % 3 = 1, false) as flag, nullif(trim(o_orderpriority), '5-LOW') as label
from orders
""",
)
def _(v):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    o = v.table("orders")
    return o.select(
        key.alias("id"),
        gtfs.gtfs_date(
            F.when(key % 5 == 0, "").when(key % 5 == 1, F.substring(day, 1, 6)).when(key % 5 == 2, "20241350").otherwise(day), strict=False
        ).alias("day"),
        gtfs.optional_int(F.when(key % 4 == 0, "1x").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))), strict=False).alias("whole"),
        gtfs.optional_float(F.when(key % 6 != 0, F.col("o_totalprice").cast("string")), strict=False).alias("number"),
        gtfs.miles_to_metres(
            F.when(key % 7 == 0, "-1").when(key % 7 != 1, (key % 1000 / 8).cast("string")).otherwise(""), strict=False
        ).alias("metres"),
        gtfs.service_flag(F.when(key % 3 == 1, " 1 ").when(key % 3 == 2, "true")).alias("flag"),
        gtfs.optional_text(F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))).alias("label"),
    )


@query(
    "service_clock",
    f"""
select trip_id, stop_sequence::bigint as stop_sequence, round({day_seconds("arrived_at", "start_date")}, 6) as service_seconds,
       round({day_seconds("arrived_at", "start_date")} / 60)::bigint as service_minute,
       round({day_seconds("arrived_at", "start_date")} / 3600)::bigint as hour_bin, isodow(start_date) in (6, 7) as weekend,
       (hour({local("arrived_at")}) * 60 + minute({local("arrived_at")}))::bigint as minute_of_day,
       epoch_us(arrived_at) + coalesce(ping_gap_seconds, 0) * 1000000 as known_at
from arrivals
""",
    "arrivals",
)
def _(v):
    return v.arrivals.select(
        "trip_id",
        "stop_sequence",
        clock.seconds_into_service_day("arrived_at", "start_date").alias("service_seconds"),
        clock.service_minute("arrived_at", "start_date").alias("service_minute"),
        clock.hour_bin("arrived_at", "start_date").alias("hour_bin"),
        clock.is_weekend("start_date").alias("weekend"),
        clock.minute_of_day("arrived_at").alias("minute_of_day"),
        clock.known_at("arrived_at", "ping_gap_seconds").alias("known_at"),
    )


@query(
    "scheduled_instants",
    f"""
select c.trip_id, c.ln::bigint as stop_sequence, epoch_us({utc("start_date::timestamp + to_seconds(sched)")}) as scheduled_at,
       round({day_seconds("arrived_at", "start_date")} - sched, 6) as delay_seconds,
       round({secs(utc("start_date::timestamp + to_seconds(sched)"), "arrived_at")}, 6) as late_seconds
from calls c
""",
    "calls",
)
def _(v):
    at = clock.scheduled_instant("start_date", "sched")
    return v.calls.select(
        "trip_id",
        F.col("ln").alias("stop_sequence"),
        at.alias("scheduled_at"),
        clock.delay_seconds("arrived_at", "start_date", "sched").alias("delay_seconds"),
        clock.seconds_between(at, "arrived_at").alias("late_seconds"),
    )


@query(
    "rows_per_time_band",
    """
select case when service_minute >= 360 and service_minute < 540 then 'am_rush' when service_minute >= 540 and service_minute < 900 then 'midday'
            when service_minute >= 900 and service_minute < 1140 then 'pm_rush' when service_minute >= 1140 and service_minute < 1440 then 'evening'
            else 'late' end as band, count(*) as n
from scored group by 1
""",
    "scored",
)
def _(v):
    return v.scored.groupBy(labels.time_band("service_minute").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_sample",
    """
select trip_id, stop_sequence::bigint as stop_sequence, ('0x' || left(md5(trip_id || ':' || stop_sequence || ':' || (stop_sequence + 13)), 8))::bigint % 100 as pct
from long_arrivals
""",
    "long_arrivals",
)
def _(v):
    s = F.col("stop_sequence")
    return v.long_arrivals.select("trip_id", "stop_sequence", labels.hash_percent(F.col("trip_id"), s, s + 13).alias("pct"))


@query(
    "epoch_instants",
    "select eid, case when eid % 3 = 0 then null else eid * 1000000000 end as instant from ev",
    "ev",
)
def _(v):
    eid = F.col("eid")
    return v.events.select("eid", clock.epoch_to_instant(F.when(eid % 3 == 0, 0).otherwise(eid * 1000)).alias("instant"))

