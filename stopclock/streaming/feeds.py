"""Realtime ingest as Structured Streaming over landed snapshots.

Each feed is its own query with its own checkpoint, so one failing leaves the other running.
A landed snapshot is one row of LANDED: the flattened message with the moment it was received.
"""

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stopclock.fixed import CHANGE_THRESHOLD_SECONDS, RETAIN_SERVICE_DAYS, TRIP_UPDATES, VEHICLE_POSITIONS
from stopclock.functions.clock import epoch_to_instant
from stopclock.operators.alignment import resolve_predictions
from stopclock.operators.changes import KEY, select_changed
from stopclock.operators.service_days import with_service_day
from stopclock.schemas import KEYS, POLL_LOG, PREDICTIONS, SNAPSHOT, VEHICLE_POSITIONS as POSITIONS
from stopclock.sinks.schedule import read_static, registry, trip_stops
from stopclock.sinks.tables import append, append_log, keep_first, not_yet_stored, table
from stopclock.sources.files import delete, exists, stored
from stopclock.sources.snapshots import accepted, flatten_positions, flatten_predictions

log = logging.getLogger(__name__)
STORED_POLLS = T.StructType([*POLL_LOG.fields, T.StructField("started_on", T.DateType()), T.StructField("batch", T.LongType())])
WINDOW = ("trip_id", "first_seconds", "last_seconds")
LANDED = T.StructType([*SNAPSHOT.fields, T.StructField("received_at", T.TimestampType())])


@dataclass(frozen=True)
class Store:
    """Where the tables and checkpoints live: a folder all executors share."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def read_landed(spark: SparkSession, path: str, feed: str, max_files: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).json(path).where(F.col("feed") == feed)
    )


#: Headers sorted in one group are those of so many seconds of a feed.
SLOT_SECONDS = 3600


def mark_unchanged(snapshots: DataFrame, last_header: int | None = None) -> DataFrame:
    """Add `unchanged`: the header time equals that of the snapshot before.

    A skipped snapshot has the header of the one last written, so comparing with the one
    before is comparing with the one last written. A missing header is never unchanged.
    Snapshots landed in one instant share a mark: unchanged if each of them is. Only headers are sorted; the messages stay where they are.

    A feed's headers are sorted by time slot; one row for each slot, its last header, is carried over to the next.
    """
    inside = Window.partitionBy("feed", "_slot").orderBy("received_at")
    across = Window.partitionBy("feed").orderBy("_slot")
    header = F.when(F.col("header_ts") > 0, F.col("header_ts"))
    # snapshots without an instant come first, as in a sort
    slot = F.coalesce(F.floor(F.unix_micros("received_at") / F.lit(SLOT_SECONDS * 1_000_000)), F.lit(-(1 << 62)))
    slotted = snapshots.select("feed", "received_at", slot.alias("_slot"), F.struct(header.alias("ts")).alias("_header"))
    edges = (
        slotted.groupBy("feed", "_slot")
        .agg(F.max_by("_header", F.struct("received_at")).alias("_last"))
        .select("feed", "_slot", F.lag("_last").over(across).alias("_edge"))
    )
    first = F.struct(F.lit(last_header).cast("bigint").alias("ts"))
    marks = (
        slotted.withColumn("_before", F.lag("_header").over(inside))
        .join(edges, ["feed", "_slot"])
        .withColumn("_before", F.coalesce("_before", "_edge", first))
        .select("feed", "received_at", F.coalesce(F.col("_header.ts") == F.col("_before.ts"), F.lit(False)).alias("unchanged"))
    )
    marks = marks.groupBy("feed", "received_at").agg(F.bool_and("unchanged").alias("unchanged"))
    return snapshots.join(marks, ["feed", "received_at"])


@dataclass(frozen=True)
class Batch:
    """One micro-batch of a feed. What it leaves is filed under its number, so a batch that is run again, as after a failure
    between its writes and the stream's own commit, writes the same once more and nothing twice."""

    store: Store
    feed: str
    number: int

    def staged(self, name: str, back: int = 0) -> str:
        return f"{self.store.root}/_batches/{self.feed}/{name}/{self.number - back}"

    def finish(self, spark: SparkSession) -> None:
        """Files of the batch before the last are needed no more."""
        for name in ("rows", "head"):
            delete(spark, self.staged(name, back=2))


HEAD = "header_ts long"


def _last_header(snapshots: DataFrame, batch: Batch) -> int | None:
    """Header time of the newest poll that worked, as the batch before left it. Where a stream starts anew beside an older
    store the poll log tells: yesterday's and today's, or all of it after a longer outage."""
    spark = snapshots.sparkSession
    if exists(spark, batch.staged("head", back=1)):
        return spark.read.schema(HEAD).json(batch.staged("head", back=1)).first()[0]
    since, first = snapshots.agg(F.date_sub(F.to_date(F.min("received_at")), 1), F.min("received_at")).first()
    worked = stored(spark, batch.store.table("poll_log"), STORED_POLLS).where(
        (F.col("feed") == batch.feed) & F.col("status").isin("ok", "skipped_unchanged") & (F.col("started_at") < F.lit(first))
    )
    for log in (worked.where(F.col("started_on") >= F.lit(since)), worked):
        polls, header = log.agg(F.count(F.lit(1)), F.max_by(F.unix_timestamp("feed_timestamp"), "started_at")).first()
        if polls:
            return header
    return None


def _leave_header(marked: DataFrame, batch: Batch) -> None:
    header = F.when(F.col("header_ts") > 0, F.col("header_ts"))
    newest = marked.agg(F.max_by(header, "received_at").alias("header_ts"))
    newest.write.mode("overwrite").option("ignoreNullFields", False).json(batch.staged("head"))


def _recent_days(batch: DataFrame, days: int) -> tuple:
    """Oldest and newest service day in a batch, reaching `days` further back."""
    return batch.agg(F.date_sub(F.min("start_date"), days), F.max("start_date")).first()


def _write_new(rows: DataFrame, name: str, schema: T.StructType, poll: str, batch: Batch) -> DataFrame:
    """First write wins; returns rows written per poll.

    New rows are staged under the batch's number and then appended. A batch that is run again takes what it staged
    before, appends of it what is not there yet, and counts the same.
    """
    spark, keys, path = rows.sparkSession, KEYS[name], batch.store.table(name)

    def known(some: DataFrame) -> DataFrame:
        lo, hi = _recent_days(some, 0)
        days = F.col("start_date").between(F.lit(lo), F.lit(hi)) if lo is not None else F.col("start_date").isNull()
        return table(spark, path, schema, ["start_date"]).where(days)

    staged = batch.staged("rows")
    kept = T.StructType([*schema.fields, T.StructField(poll, T.TimestampType())])
    if not exists(spark, f"{staged}/_SUCCESS"):
        first = keep_first(rows, keys, [poll, *[c for c in rows.columns if c not in (*keys, poll)]]).persist()
        try:
            not_yet_stored(first, known(first), keys).select(*kept.fieldNames()).write.mode("overwrite").parquet(staged)
        finally:
            first.unpersist()
    new = spark.read.schema(kept).parquet(staged)
    append(not_yet_stored(new, known(new), keys).select(*schema.fieldNames()), path, ["start_date"])
    return new.groupBy(poll).agg(F.count(F.lit(1)).alias("rows_written"))


def _outcomes(snapshots: DataFrame, status, rows_written, error=None) -> DataFrame:
    return snapshots.select(
        "feed",
        F.col("received_at").alias("started_at"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        status.alias("status"),
        F.lit(200).alias("http_code"),
        epoch_to_instant("header_ts").alias("feed_timestamp"),
        F.size("entity").cast("bigint").alias("entity_count"),
        F.coalesce(rows_written, F.lit(0)).cast("bigint").alias("rows_written"),
        F.lit(error).cast("string").alias("error"),
    )


def _log_polls(rows: DataFrame, batch: Batch) -> None:
    filed = rows.withColumns({"started_on": F.to_date("started_at"), "batch": F.lit(batch.number)})
    append_log(filed, batch.store.table("poll_log"), ["started_on", "feed", "batch"], once=True)


def _ingest(snapshots: DataFrame, batch: Batch, write) -> None:
    """Mark unchanged polls, write the rows of the others, log every poll, leave the last header for the next batch."""
    marked = mark_unchanged(snapshots, _last_header(snapshots, batch)).persist()
    try:
        written = write(marked.where(~F.col("unchanged")).drop("unchanged", "feed"))
        status = F.when(F.col("unchanged"), "skipped_unchanged").otherwise("ok")
        _log_polls(_outcomes(marked.join(written, "received_at", "left"), status, F.col("rows_written")), batch)
        _leave_header(marked, batch)
        batch.finish(snapshots.sparkSession)
    except Exception as error:
        _log_polls(_outcomes(snapshots, F.lit("db_error"), F.lit(0), str(error)), batch)
        raise
    finally:
        marked.unpersist()


def ingest_positions(snapshots: DataFrame, stops: DataFrame | None, batch: Batch) -> None:
    """One micro-batch: flatten, settle service days, write new positions, log every poll. `stops` is `trip_stops`."""

    def write(fresh: DataFrame) -> DataFrame:
        rows = accepted(flatten_positions(fresh))
        if stops is not None:
            rows = with_service_day(rows, stops.select(*WINDOW), "ts").drop("stored_date")
        return _write_new(rows, "vehicle_positions", POSITIONS, "received_at", batch)

    _ingest(snapshots, batch, write)


def last_kept(rows: DataFrame, store: Store, first, last) -> DataFrame:
    """Last written prediction of the keys in `rows`, from the table itself: what was not durably
    written is not remembered, and only the open service days are read."""
    asked = rows.select(*KEY).distinct()
    held = table(rows.sparkSession, store.table("predictions"), PREDICTIONS, ["start_date"]).join(asked, KEY, "left_semi")
    days = F.col("start_date").between(F.lit(first), F.lit(last)) if first is not None else F.lit(False)
    latest = F.max_by(F.struct("arrival_time", "delay_seconds"), "observed_at")
    return held.where(days).groupBy(*KEY).agg(latest.alias("_l")).select(*KEY, "_l.arrival_time", "_l.delay_seconds")


def ingest_predictions(
    snapshots: DataFrame, stops: DataFrame | None, batch: Batch, threshold: int = CHANGE_THRESHOLD_SECONDS
) -> None:
    """One micro-batch: flatten, resolve stops, keep changes only, write, log every poll. `stops` is `trip_stops`.

    A batch that is run again takes its staged rows and does not look at what it wrote itself.
    """

    def write(fresh: DataFrame) -> DataFrame:
        rows = accepted(flatten_predictions(fresh))
        resolved = accepted(resolve_predictions(rows, stops, poll="received_at")).drop("feed_order").persist()
        try:
            first, last = _recent_days(resolved, RETAIN_SERVICE_DAYS)
            changed = select_changed(resolved, threshold, last_kept(resolved, batch.store, first, last))
            return _write_new(changed, "predictions", PREDICTIONS, "received_at", batch)
        finally:
            resolved.unpersist()

    _ingest(snapshots, batch, write)


def active_stops(spark: SparkSession, schedule: str) -> DataFrame | None:
    """`trip_stops` of the newest loaded version; None when none is loaded. Called for each batch, it reads the registry
    and nothing else: a batch is resolved against the version that is loaded when it comes."""
    newest = registry(spark, schedule).agg(F.max_by("feed_version", "loaded_at")).first()[0]
    if newest is None:
        return None
    return read_static(spark, schedule, "trip_stops").where(F.col("feed_version") == newest).drop("feed_version")


def start_feed(
    spark: SparkSession,
    landing: str,
    feed: str,
    store: Store,
    stop_times: DataFrame | None = None,
    every: str | None = "30 seconds",
    schedule: str | None = None,
) -> StreamingQuery:
    """One feed's ingest. `every=None` takes what has landed and stops.

    `schedule` is the folder of loaded schedules: each batch is resolved against the version loaded then, whose stops
    stand ready by trip. `stop_times` is one fixed schedule instead; its stops are put together once, at the start.
    """
    ingest = ingest_positions if feed == VEHICLE_POSITIONS else ingest_predictions
    trigger = {"processingTime": every} if every else {"availableNow": True}
    fixed = None
    if stop_times is not None:
        path = f"{store.root}/_trip_stops/{feed}-{uuid.uuid4().hex}"

    def take(rows: DataFrame, number: int) -> None:
        nonlocal fixed
        if rows.isEmpty():
            return
        batch = Batch(store, feed, number)
        session = rows.sparkSession
        if schedule is not None:
            stops = active_stops(session, schedule)
        elif stop_times is not None:
            try:
                if fixed is None:
                    trip_stops(stop_times).write.parquet(path)
                    fixed = session.read.parquet(path)
            except Exception as error:
                _log_polls(_outcomes(rows, F.lit("db_error"), F.lit(0), str(error)), batch)
                raise
            stops = fixed
        else:
            stops = None
        ingest(rows, stops, batch)

    return (
        read_landed(spark, landing, feed)
        .writeStream.queryName(f"ingest_{feed}")
        .option("checkpointLocation", store.checkpoint(feed))
        .foreachBatch(take)
        .trigger(**trigger)
        .start()
    )


def dedupe_positions(positions: DataFrame, delay: str = "2 days") -> DataFrame:
    """Streaming dedupe on the natural key within the watermark; the sink covers what is later."""
    return positions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEYS["vehicle_positions"])
