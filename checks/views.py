"""Transit-shaped views of the generated tables, in Spark.

Each view reads whole tables. Natural keys are made unique by keeping the first row per key,
as the stores do, so no view needs a window and a hot key combines map-side.
`checks/duck.py` states the same views in SQL.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.fixed import AGENCY, HORIZONS_MINUTES, SERVICE_TZ, SOURCES
from stopclock.functions.clock import is_weekend, plus_seconds, service_minute
from stopclock.session import ship_package, use_utc

VERSIONS = ("f0", "f1")
PACK = 1 << 31  # two keys in one whole number: their minimum stays a plain hash aggregate
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, where the events start


def text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def local_instant(day: Column, micros: Column) -> Column:
    wall = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros)
    return F.to_utc_timestamp(wall, SERVICE_TZ)


class Views:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        use_utc(spark)
        ship_package(spark)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- short trips: one per order, one call per line number ---

    @cached_property
    def calls(self) -> DataFrame:
        # Dealt out by order first: the aggregate and the join below share one shuffle.
        lines = (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") * PACK + F.col("l_suppkey")).alias("r"))
            .where(F.col("ok").isNotNull())
            .repartition("ok")
            .groupBy("ok", "ln")
            .agg(F.min("r").alias("r"))
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("ok"),
            F.to_date("o_orderdate").alias("start_date"),
            (F.col("o_custkey") % 25).alias("ck"),
        )
        return (
            lines.join(orders, "ok")
            .select("ok", "ln", F.shiftright("r", 31).alias("pk"), F.col("r").bitwiseAND(PACK - 1).alias("sk"), "start_date", "ck")
            .withColumn("sched", (14400 + (F.col("ok") % 1200) * 60 + F.col("ln") * 240).cast("int"))
            .withColumn("late_us", (((F.col("pk") * 7 + F.col("sk") * 13 + F.col("ok")) % 900 - 240) * 4 + F.col("sk") % 4) * 250_000)
            .withColumn("arrived_at", local_instant(F.col("start_date"), F.col("sched").cast("bigint") * 1_000_000 + F.col("late_us")))
            .withColumn("g", (F.col("sk") * 17 + F.col("pk")) % 800)
            .withColumn(
                "gap",
                F.when(F.col("pk") % 23 != 0, F.when(F.col("pk") % 2 == 0, F.col("g") % 200).otherwise(F.col("g"))).cast("int"),
            )
            .withColumn("trip_id", text("T", F.col("ok")))
            .withColumn("feed_version", text("f", F.col("ok") % 2))
            .withColumn("stop_id", text("S", F.col("pk") % 40))
            .withColumn("route_id", text("R", F.col("ck")))
        )

    @cached_property
    def arrivals(self) -> DataFrame:
        method = F.when(F.col("pk") % 3 == 0, "interpolated").when(F.col("pk") % 3 == 1, "dwell").otherwise("at_ping")
        return self.calls.select(
            "start_date",
            "trip_id",
            F.col("ln").alias("stop_sequence"),
            "feed_version",
            "stop_id",
            text("V", F.col("ok") % 50).alias("vehicle_id"),
            "arrived_at",
            F.when(F.col("pk") % 3 == 1, plus_seconds("arrived_at", F.col("sk") % 50)).alias("departed_at"),
            method.alias("method"),
            F.col("gap").alias("ping_gap_seconds"),
            ((F.col("pk") % 400) / 10).alias("nearest_ping_m"),
            (F.col("ln") * 350.0 + F.col("pk") % 50).alias("stop_offset_m"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        ok, ck = F.col("o_orderkey"), F.col("o_custkey") % 25
        return self.table("orders").select(
            text("f", ok % 2).alias("feed_version"),
            text("T", ok).alias("trip_id"),
            text("R", ck).alias("route_id"),
            text("SV", ok % 6).alias("service_id"),
            F.concat(text("H", ck), text("-", ok % 3)).alias("shape_id"),
            F.col("o_orderpriority").alias("trip_headsign"),
        )

    @cached_property
    def routes(self) -> DataFrame:
        version = F.explode(F.array(*[F.lit(v) for v in VERSIONS]))
        return self.table("nation").withColumn("feed_version", version).select(
            "feed_version",
            text("R", F.col("n_nationkey")).alias("route_id"),
            F.concat(F.col("n_nationkey").cast("string"), F.lit("/"), F.col("feed_version")).alias("route_short_name"),
            F.concat(F.col("n_name"), F.lit(" "), F.col("feed_version")).alias("route_long_name"),
            F.col("n_regionkey").cast("smallint").alias("route_type"),
        )

    @cached_property
    def stops(self) -> DataFrame:
        k = F.col("k")
        version = F.explode(F.array(*[F.lit(v) for v in VERSIONS]))
        return (
            self.table("part")
            .groupBy((F.col("p_partkey") % 40).alias("k"))
            .agg(F.min("p_name").alias("stop_name"))
            .withColumn("feed_version", version)
            .select(
                "feed_version",
                text("S", k).alias("stop_id"),
                F.concat("stop_name", F.lit(" "), k.cast("string")).alias("stop_name"),
                F.when(k != 39, 32.5 + k * 0.001).alias("stop_lat"),
                (k * 0.001 - 117.25).alias("stop_lon"),
            )
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        return self.calls.select(
            "feed_version",
            "trip_id",
            F.col("ln").alias("stop_sequence"),
            "stop_id",
            F.when(F.col("pk") % 37 != 0, F.col("sched")).alias("arrival_seconds"),
            F.when(F.col("pk") % 37 != 0, F.col("sched") + 20).alias("departure_seconds"),
            (F.col("ln") * 350.0).alias("shape_dist_traveled_m"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        pk, sk, k = F.col("pk"), F.col("sk"), F.col("k")
        lead = (
            F.when(k == 0, 45)
            .when(k == 1, 60)
            .when(k == 2, 290 + pk % 20)
            .when(k == 3, 600)
            .when(k == 4, 1100 + pk % 200)
            .otherwise(5400 + pk % 3600)
        )
        return (
            self.calls.withColumn("k", F.explode(F.array(*[F.lit(n) for n in range(6)])))
            .where((pk + 3 * k + sk) % 7 != 0)
            .withColumn("lead", lead)
            .withColumn("err", (pk * 31 + sk * 17 + k * 101) % 1500 - 700)
            .select(
                "start_date",
                "trip_id",
                F.col("ln").alias("stop_sequence"),
                plus_seconds("arrived_at", -F.col("lead")).alias("observed_at"),
                "stop_id",
                F.when(pk % 5 != 0, F.col("route_id")).alias("route_id"),
                F.when((sk + k) % 19 != 0, plus_seconds("arrived_at", F.col("err"))).alias("arrival_time"),
                F.col("err").cast("int").alias("delay_seconds"),
            )
        )

    @cached_property
    def scored(self) -> DataFrame:
        pk, sk, h, i = F.col("pk"), F.col("sk"), F.col("p.h"), F.col("p.i")
        # Constant pairs and one expression: sixteen spelled-out ones make a method too long to be compiled.
        pairs = F.array(
            *[
                F.struct(F.lit(h).alias("h"), F.lit(i).alias("i"), F.lit(source).alias("s"))
                for h in HORIZONS_MINUTES
                for i, source in enumerate(SOURCES)
            ]
        )
        agency = (pk * 31 + sk * 17 + h * 101) % 1500 - 700
        other = (pk * (31 + i) + sk * (17 + 2 * i) + h * 53 * i) % 1300 - 600
        whole = F.lit(True)
        for minutes in HORIZONS_MINUTES:
            whole = whole & ((sk + minutes) % 11 != 0)
        return (
            self.calls.withColumn("service_minute", service_minute("arrived_at", "start_date"))
            .withColumn("is_weekend", is_weekend("start_date"))
            .withColumn("has_all_horizons", whole)
            .withColumn("p", F.explode(pairs))
            .where(((sk + h) % 11 != 0) & ((i == 0) | ((pk + h + 7 * i) % 9 != 0)))
            .withColumn("error_seconds", F.when(i == 0, agency).otherwise(other).cast("int"))
            .select(
                "start_date",
                "trip_id",
                F.col("ln").alias("stop_sequence"),
                F.col("p.h").alias("horizon_minutes"),
                F.col("p.s").alias("source"),
                "feed_version",
                "stop_id",
                "route_id",
                "arrived_at",
                plus_seconds("arrived_at", F.col("error_seconds")).alias("predicted_arrival"),
                plus_seconds("arrived_at", -(F.col("p.h") * 60 + sk % 40)).alias("predicted_at"),
                "error_seconds",
                F.abs("error_seconds").alias("abs_error_seconds"),
                F.col("gap").alias("ping_gap_seconds"),
                "service_minute",
                "is_weekend",
                "has_all_horizons",
            )
        )

    # --- long trips: one per user, one stop per hour of events ---

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("eid"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("u"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            "value",
            "event_type",
        )

    @cached_property
    def hours(self) -> DataFrame:
        seq = F.floor((F.unix_micros("ts") - F.lit(EPOCH_US)) / F.lit(3_600_000_000)).cast("int")
        eid = F.col("eid")
        noise = F.when(eid % 11 == 0, (eid * 7919) % 600).otherwise((eid * 7919) % 200) * 250_000
        return (
            self.events.groupBy("u", seq.alias("seq"))
            .agg(F.min("eid").alias("eid"))
            .withColumn("start_date", F.date_add(F.to_date(F.lit("2024-03-04")), (F.col("u") % 14).cast("int")))
            .withColumn("sched", F.col("seq") * 60 + 18000)
            .withColumn("arrived_at", local_instant(F.col("start_date"), F.col("sched").cast("bigint") * 1_000_000 + noise))
            .withColumn("gap", F.when(eid % 41 != 0, (eid * 13) % 300).cast("int"))
        )

    @cached_property
    def long_arrivals(self) -> DataFrame:
        return self.hours.select(
            "start_date",
            text("U", F.col("u")).alias("trip_id"),
            F.col("seq").alias("stop_sequence"),
            text("f", F.col("u") % 2).alias("feed_version"),
            text("E", F.col("seq") % 60).alias("stop_id"),
            "arrived_at",
            F.col("gap").alias("ping_gap_seconds"),
        )

    @cached_property
    def long_trips(self) -> DataFrame:
        return self.events.select("u").distinct().select(
            text("f", F.col("u") % 2).alias("feed_version"),
            text("U", F.col("u")).alias("trip_id"),
            text("R", F.col("u") % 7).alias("route_id"),
        )

    @cached_property
    def long_stop_times(self) -> DataFrame:
        return self.hours.select(
            text("f", F.col("u") % 2).alias("feed_version"),
            text("U", F.col("u")).alias("trip_id"),
            F.col("seq").alias("stop_sequence"),
            text("E", F.col("seq") % 60).alias("stop_id"),
            F.when(F.col("eid") % 43 != 0, F.col("sched")).alias("arrival_seconds"),
        )

    @cached_property
    def long_agency(self) -> DataFrame:
        """Agency rows of the long trips, as scored."""
        horizon = F.explode(F.array(*[F.lit(h) for h in HORIZONS_MINUTES]))
        error = (F.col("eid") * 37 + F.col("h") * 11) % 900 - 400
        return (
            self.hours.withColumn("h", horizon)
            .withColumn("e", error.cast("int"))
            .select(
                "start_date",
                text("U", F.col("u")).alias("trip_id"),
                F.col("seq").alias("stop_sequence"),
                F.col("h").alias("horizon_minutes"),
                F.lit(AGENCY).alias("source"),
                text("f", F.col("u") % 2).alias("feed_version"),
                text("E", F.col("seq") % 60).alias("stop_id"),
                text("R", F.col("u") % 7).alias("route_id"),
                "arrived_at",
                plus_seconds("arrived_at", F.col("e")).alias("predicted_arrival"),
                plus_seconds("arrived_at", -F.col("h") * 60).alias("predicted_at"),
                F.col("e").alias("error_seconds"),
                F.abs("e").alias("abs_error_seconds"),
                F.col("gap").alias("ping_gap_seconds"),
                service_minute("arrived_at", "start_date").alias("service_minute"),
                is_weekend("start_date").alias("is_weekend"),
                F.lit(True).alias("has_all_horizons"),
            )
        )

    # --- collection ---

    @cached_property
    def polls(self) -> DataFrame:
        digit = F.col("k") % 10
        return self.events.select(
            F.when(F.col("u") % 2 == 0, "vehicle_positions").otherwise("trip_updates").alias("feed"),
            F.col("ts").alias("started_at"),
            F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"),
            F.when(digit <= 5, "ok")
            .when(digit <= 7, "skipped_unchanged")
            .when(digit == 8, "http_error")
            .otherwise("parse_error")
            .alias("status"),
            F.when(digit <= 5, F.col("k")).alias("rows_written"),
        )

    # --- one vehicle run per user along a shape made of the suppliers of one nation ---

    @cached_property
    def shapes(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            F.lit("f0").alias("feed_version"),
            text("G", F.col("s_nationkey")).alias("shape_id"),
            s.cast("int").alias("shape_pt_sequence"),
            (32.7 + s * 0.0005).alias("shape_pt_lat"),
            (((s * 37) % 11 - 5) * 0.0002 - 117.16).alias("shape_pt_lon"),
            (s * 56.0).alias("shape_dist_traveled_m"),
        )

    @cached_property
    def run_trips(self) -> DataFrame:
        return self.events.select("u").distinct().select(
            F.lit("f0").alias("feed_version"),
            text("U", F.col("u")).alias("trip_id"),
            text("R", F.col("u") % 7).alias("route_id"),
            text("G", F.col("u") % 25).alias("shape_id"),
        )

    @cached_property
    def run_stops(self) -> DataFrame:
        return self.run_trips.join(self.shape_stops.drop("feed_version"), "shape_id").select(
            "feed_version", "trip_id", "stop_sequence", "stop_id", "shape_dist_traveled_m"
        )

    @cached_property
    def shape_stops(self) -> DataFrame:
        """The same stops stated once for each shape: all trips of a shape make them."""
        return self.shapes.select(
            "feed_version",
            "shape_id",
            F.col("shape_pt_sequence").alias("stop_sequence"),
            text("P", F.col("shape_pt_sequence")).alias("stop_id"),
            (F.col("shape_dist_traveled_m") + 20).alias("shape_dist_traveled_m"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        top = self.table("supplier").agg(F.max("s_suppkey")).scalar()
        eid = F.col("eid")
        second = F.floor((F.unix_micros("ts") - F.lit(EPOCH_US)) / F.lit(600_000_000))
        first = (
            self.events.withColumn("second", second)
            .withColumn("vehicle_id", F.concat(F.when(eid % 10 == 3, "W").otherwise("V"), F.col("u").cast("string")))
            .groupBy("u", "vehicle_id", "second")
            .agg(F.min("eid").alias("eid"))
            .withColumn("top", top)
        )
        along = F.col("second") * F.col("top") / 4320
        off = F.when(eid % 29 == 0, 0.01).otherwise(0.0)
        return first.select(
            "vehicle_id",
            F.timestamp_seconds(F.lit(1_705_334_400) + F.col("second")).alias("ts"),
            text("U", F.col("u")).alias("trip_id"),
            text("R", F.col("u") % 7).alias("route_id"),
            F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("u") % 7).cast("int")).alias("start_date"),
            F.when(eid % 53 != 0, 32.7 + along * 0.0005 + ((eid * 7919) % 13 - 6) * 0.00008).alias("lat"),
            (((eid * 104729) % 11 - 5) * 0.0001 + off - 117.16).alias("lon"),
        )

    # --- feed side ---

    @cached_property
    def snapshots(self) -> DataFrame:
        """One landed snapshot per event, with a vehicle and a trip update entity."""
        from stopclock.schemas import SNAPSHOT

        eid, u, k = F.col("eid"), F.col("u"), F.col("k")
        epoch = F.floor(F.unix_micros("ts") / F.lit(1_000_000))
        day = F.when(eid % 4 == 0, "20240105").when(eid % 4 == 1, "2024-13").when(eid % 4 == 2, "")
        trip = F.struct(
            F.when(eid % 23 == 0, "").otherwise(text("U", u)).alias("trip_id"),
            text("R", u % 7).alias("route_id"),
            day.alias("start_date"),
        )
        stops = []
        for i in range(3):
            when = F.when((eid + i) % 9 != 0, epoch + 60 * i + k)
            event = F.struct(when.alias("time"), F.when((eid + i) % 4 == 0, k.cast("int")).alias("delay"))
            stops.append(
                F.struct(
                    F.when(k % 3 != 0, k + i).cast("int").alias("stop_sequence"),
                    F.when((eid + i) % 6 != 0, text("E", (k * 3 + i * 11) % 60)).otherwise("").alias("stop_id"),
                    F.lit(0).alias("schedule_relationship"),
                    F.when((eid + i) % 8 != 0, event).alias("arrival"),
                    F.when((eid + i) % 8 == 1, F.struct(F.lit(0).cast("bigint").alias("time"), F.lit(7).alias("delay"))).alias(
                        "departure"
                    ),
                )
            )
        vehicle = F.struct(
            F.when(eid % 3 == 0, "").otherwise(text("V", u)).alias("vehicle_id"),
            F.when(eid % 5 != 0, epoch + 1).otherwise(0).alias("timestamp"),
            trip.alias("trip"),
            F.when(
                eid % 6 != 0,
                F.struct(
                    (32.7 + (u % 50) * 0.001).alias("latitude"),
                    (-117.1 - (k % 50) * 0.001).alias("longitude"),
                    F.lit(None).cast("float").alias("bearing"),
                    F.col("value").cast("float").alias("speed"),
                ),
            ).alias("position"),
            k.cast("int").alias("current_stop_sequence"),
            F.lit(2).alias("current_status"),
            F.lit(None).cast("int").alias("occupancy_status"),
        )
        update = F.struct(
            F.when(eid % 5 != 1, epoch + 2).alias("timestamp"),
            text("V", u).alias("vehicle_id"),
            trip.alias("trip"),
            F.when(eid % 31 != 0, F.array(*stops)).otherwise(F.array().cast(SNAPSHOT["entity"].dataType.elementType["trip_update"].dataType["stop_time_update"].dataType)).alias("stop_time_update"),
        )
        name = F.when(eid % 7 == 0, "").otherwise(text("e", eid))
        kinds = SNAPSHOT["entity"].dataType.elementType
        none = lambda field: F.lit(None).cast(kinds[field].dataType).alias(field)
        entities = F.array(
            F.struct(name.alias("id"), vehicle.cast(kinds["vehicle"].dataType).alias("vehicle"), none("trip_update")),
            F.struct(name.alias("id"), none("vehicle"), update.cast(kinds["trip_update"].dataType).alias("trip_update")),
        )
        return self.events.select(
            eid.alias("eid"),
            F.lit("both").alias("feed"),
            F.when(eid % 13 == 0, 0).when(eid % 17 != 0, epoch).alias("header_ts"),
            entities.alias("entity"),
        )

    @cached_property
    def observed(self) -> DataFrame:
        """Predictions as observed poll after poll: many small changes per key."""
        eid = F.col("eid")
        return self.events.select(
            F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("u") % 14).cast("int")).alias("start_date"),
            text("U", F.col("u")).alias("trip_id"),
            (F.col("k") % 3).cast("int").alias("stop_sequence"),
            F.col("ts").alias("observed_at"),
            F.when(eid % 11 != 0, F.timestamp_micros(F.lit(1_710_000_000_000_000) + ((eid * 37) % 90) * 1_000_000)).alias("arrival_time"),
            F.when(eid % 13 != 0, eid % 50).cast("int").alias("delay_seconds"),
            eid.alias("eid"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        s = F.col("s_suppkey")
        flags = [((s.bitwiseAND(1 << i)) != 0).alias(d) for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))]
        start = F.date_add(F.to_date(F.lit("2024-01-01")), (s % 60).cast("int"))
        return self.table("supplier").select(
            text("SV", s).alias("service_id"), *flags, start.alias("start_date"), F.date_add(start, 90).alias("end_date")
        )

    @cached_property
    def exceptions(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            text("SV", c % 150).alias("service_id"),
            F.date_add(F.to_date(F.lit("2024-01-01")), ((c * 7) % 120).cast("int")).alias("service_date"),
            (c % 2 + 1).cast("smallint").alias("exception_type"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Model runs: one per customer segment, its windows from the orders."""
        day = F.to_date("o_orderdate")
        return (
            self.table("orders")
            .groupBy("o_orderpriority")
            .agg(F.max("o_orderdate").alias("m"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.count(F.lit(1)).alias("n"))
            .select(
                (F.col("m").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,length(o_orderpriority))")).alias("trained_at"),
                F.col("o_orderpriority").alias("source"),
                F.col("lo").alias("train_from"),
                F.to_date(F.lit("1996-12-31")).alias("train_to"),
                F.to_date(F.lit("1997-01-01")).alias("test_from"),
                F.col("hi").alias("test_to"),
                F.col("n").alias("train_rows"),
                (F.col("n") * 2).alias("test_rows"),
                F.lit('["a","b"]').alias("features"),
                F.concat(F.lit("run "), "o_orderpriority").alias("notes"),
            )
        )
