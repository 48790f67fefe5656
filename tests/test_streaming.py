import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stopclock.operators.changes import select_changed
from stopclock.streaming import changes
from stopclock.streaming import feeds as S
from stopclock.streaming.changes import changed_stream
from stopclock.streaming.replay import replay
from stopclock.streaming.vehicles import on_map, vehicle_updates
from tests.conftest import day, utc

EPOCH = 1_790_881_200  # 2026-10-01 19:00:00 UTC


def land(folder, name, feed, header, entities, second=0):
    folder.mkdir(exist_ok=True)
    snapshot = {"feed": feed, "header_ts": header, "entity": entities, "received_at": f"2026-10-01T19:{second // 60:02d}:{second % 60:02d}.000Z"}
    (folder / name).write_text(json.dumps(snapshot) + "\n")


def bus(vehicle, at, lat=32.7):
    return {"id": vehicle, "vehicle": {"vehicle_id": vehicle, "timestamp": at, "trip": {"trip_id": "t"}, "position": {"latitude": lat, "longitude": -117.1}}}


def told(at, *times):
    stops = [{"stop_id": s, "arrival": {"time": t}} for s, t in zip("abc", times)]
    return {"id": "u", "trip_update": {"timestamp": at, "trip": {"trip_id": "t"}, "stop_time_update": stops}}


def stop_times(spark):
    return spark.createDataFrame(
        [("t", 1, "a", 43000), ("t", 2, "b", 43300), ("t", 3, "c", 43600)], "trip_id string, stop_sequence int, stop_id string, arrival_seconds int"
    )


def ingest(spark, landing, store, feed):
    query = S.start_feed(spark, str(landing), feed, store, stop_times(spark), every=None)
    query.awaitTermination()


def log_of(spark, store):
    return [(r["status"], r["rows_written"]) for r in spark.read.parquet(store.table("poll_log")).orderBy("started_at").collect()]


def test_positions_are_written_once_and_unchanged_polls_skipped(spark, tmp_path):
    landing, store = tmp_path / "land", S.Store(str(tmp_path / "store"))
    land(landing, "1.json", "vehicle_positions", EPOCH, [bus("b1", EPOCH), bus("b2", EPOCH), bus("b1", EPOCH, 99.0)], 0)
    land(landing, "2.json", "vehicle_positions", EPOCH, [bus("b1", EPOCH), bus("b3", EPOCH)], 30)
    ingest(spark, landing, store, "vehicle_positions")
    assert log_of(spark, store) == [("ok", 2), ("skipped_unchanged", 0)]
    land(landing, "3.json", "vehicle_positions", EPOCH, [bus("b9", EPOCH)], 60)
    land(landing, "4.json", "vehicle_positions", EPOCH + 60, [bus("b1", EPOCH), bus("b1", EPOCH + 60)], 90)
    ingest(spark, landing, store, "vehicle_positions")
    assert log_of(spark, store)[2:] == [("skipped_unchanged", 0), ("ok", 1)]
    rows = spark.read.parquet(store.table("vehicle_positions"))
    assert rows.count() == 3 and {r[0] for r in rows.select("start_date").distinct().collect()} == {day("2026-10-01")}


def test_predictions_are_resolved_and_kept_change_only(spark, tmp_path):
    landing, store = tmp_path / "land", S.Store(str(tmp_path / "store"))
    land(landing, "1.json", "trip_updates", EPOCH, [told(EPOCH, EPOCH + 100, EPOCH + 400, EPOCH + 700)], 0)
    land(landing, "2.json", "trip_updates", EPOCH + 30, [told(EPOCH + 30, EPOCH + 110, EPOCH + 440, EPOCH + 700)], 30)
    ingest(spark, landing, store, "trip_updates")
    land(landing, "3.json", "trip_updates", EPOCH + 60, [told(EPOCH + 60, EPOCH + 129, EPOCH + 460, EPOCH + 730)], 60)
    ingest(spark, landing, store, "trip_updates")
    rows = spark.read.parquet(store.table("predictions")).orderBy("stop_sequence", "observed_at").collect()
    assert [(r["stop_sequence"], int(r["observed_at"].replace(tzinfo=dt.UTC).timestamp()) - EPOCH) for r in rows] == [(1, 0), (2, 0), (2, 30), (3, 0), (3, 60)]
    assert log_of(spark, store) == [("ok", 3), ("ok", 1), ("ok", 1)]


def test_one_feed_failing_leaves_the_other(spark, tmp_path):
    landing, store = tmp_path / "land", S.Store(str(tmp_path / "store"))
    land(landing, "1.json", "vehicle_positions", EPOCH, [bus("b1", EPOCH)], 0)
    land(landing, "2.json", "trip_updates", EPOCH, [told(EPOCH, EPOCH + 100)], 0)
    broken = spark.createDataFrame([("t", 1, "a", 1)], "trip_id string, stop_sequence int, stop_id string, arrival_seconds int").where(
        F.when(F.col("stop_sequence") == 1, F.raise_error(F.lit("schedule store is gone"))).isNotNull()
    )
    bad = S.start_feed(spark, str(landing), "trip_updates", store, broken, every=None)
    with pytest.raises(Exception, match="schedule store is gone"):
        bad.awaitTermination()
    ingest(spark, landing, store, "vehicle_positions")
    by_feed = {r["feed"]: r["status"] for r in spark.read.parquet(store.table("poll_log")).collect()}
    assert by_feed == {"trip_updates": "db_error", "vehicle_positions": "ok"}


SERIES = "start_date date, trip_id string, stop_sequence int, observed_at timestamp, arrival_time timestamp, delay_seconds int"


def run_stream(spark, tmp_path, frames, **options):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(landing)
    query = (
        changed_stream(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(frames[0].schema).parquet(out)


def polls(spark, values, start="2026-10-01 18:00:00", on="2026-10-01"):
    base = utc(start)
    rows = [
        (day(on), "t", 1, base + dt.timedelta(seconds=30 * i), None if a is None else utc("2026-10-01 19:00:00") + dt.timedelta(seconds=a), d) for i, (a, d) in enumerate(values)
    ]
    return spark.createDataFrame(rows, SERIES)


def test_stream_state_carries_over_batches_and_equals_batch(spark, tmp_path):
    values = [(0, None), (10, None), (29, None), (31, None), (None, 5), (None, 20), (None, 40), (50, 1), (70, 1), (81, None)]
    whole = polls(spark, values)
    parts = [whole.where(F.col("observed_at") < F.lit(utc("2026-10-01 18:02:00"))), whole.where(F.col("observed_at") >= F.lit(utc("2026-10-01 18:02:00")))]
    got = run_stream(spark, tmp_path, parts, retain_days=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, select_changed(whole).collect()))


def test_closed_service_days_are_forgotten(spark, tmp_path):
    first = polls(spark, [(0, None)])
    later = polls(spark, [(0, None)], start="2026-10-20 18:00:00", on="2026-10-20")
    same_day_again = polls(spark, [(5, None)], start="2026-10-19 00:00:00")
    got = run_stream(spark, tmp_path, [first, later, polls(spark, [(0, None)], start="2026-10-21 18:00:00", on="2026-10-21"), same_day_again], retain_days=2)
    days = [r["start_date"].isoformat() for r in got.orderBy("observed_at").collect()]
    assert days[0] == "2026-10-01" and days.count("2026-10-01") == 2, "after eviction the key counts as new"


def test_streaming_dedupe_and_latest(spark, tmp_path):
    rows = spark.createDataFrame(
        [("b", utc("2026-10-01 10:00:00"), 1.0), ("b", utc("2026-10-01 10:00:00"), 1.0), ("b", utc("2026-10-01 10:01:00"), 2.0)], "vehicle_id string, ts timestamp, lat double"
    ).withColumns({"lon": F.lit(0.0), "route_id": F.lit("r"), "trip_id": F.lit("t")})
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    unique = S.dedupe_positions(stream).writeStream.format("memory").queryName("unique_positions").outputMode("append").trigger(availableNow=True).start()
    unique.awaitTermination()
    assert spark.table("unique_positions").count() == 2


def test_a_vehicle_not_seen_for_a_while_leaves_map_and_state(spark):
    def at(minute, vehicle, lat):
        return (vehicle, utc("2026-10-01 10:00:00") + dt.timedelta(minutes=minute), "r", "t", lat, 0.0)

    rows = spark.createDataFrame(
        [at(0, "a", 1.0), at(1, "b", 2.0), at(1, "c", None), at(14, "b", 3.0), at(14, "b", 2.5), at(16, "d", 4.0), at(40, "a", 5.0)],
        "vehicle_id string, ts timestamp, route_id string, trip_id string, lat double, lon double",
    )
    cuts = [utc("2026-10-01 10:10:00"), utc("2026-10-01 10:30:00")]
    updates = replay(rows, "ts", vehicle_updates, cuts, ["vehicle_id"], mode="update").persist()
    shown = [{(r["vehicle_id"], r["lat"]) for r in on_map(updates.where(F.col("commit") <= k), ["batch"]).collect()} for k in range(3)]
    assert shown == [{("a", 1.0), ("b", 2.0)}, {("b", 3.0), ("d", 4.0)}, {("a", 5.0)}]
    assert {(r["vehicle_id"], r["commit"]) for r in updates.where("gone").collect()} == {("a", 1), ("b", 2), ("d", 2)}


def test_keys_of_one_group_fold_each_by_itself(spark, tmp_path, monkeypatch):
    """Many keys, some null, in two groups of a day: the stream keeps what the batch keeps, over files and a stored start."""
    base = utc("2026-10-01 18:00:00")
    rows = [
        (day("2026-10-01"), None if k == 7 else f"t{k % 5}", None if k == 8 else k % 4, base + dt.timedelta(seconds=30 * i + k), base + dt.timedelta(seconds=3600 + (i * (k + 3) * 7) % 90), (i * k) % 40 or None)
        for k in range(20)
        for i in range(12)
    ]
    whole = spark.createDataFrame(rows, SERIES)
    cut = F.col("observed_at") < F.lit(base + dt.timedelta(seconds=150))
    monkeypatch.setattr("stopclock.streaming.changes.BUCKETS", 2)
    got = run_stream(spark, tmp_path, [whole.where(cut), whole.where(~cut)], retain_days=None)
    want = select_changed(whole)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert changes._dealt(whole).agg(F.count("*")).count() <= 2


def test_a_group_of_vehicles_loses_those_not_seen_each_at_its_time(spark, monkeypatch):
    """All vehicles in one group: each leaves when the watermark comes to its own last position, the end included."""
    monkeypatch.setattr("stopclock.streaming.vehicles.BUCKETS", 1)
    start = utc("2026-10-01 10:00:00")

    def at(second, vehicle):
        return (vehicle, start + dt.timedelta(seconds=second), "r", "t", 1.0, 0.0)

    rows = spark.createDataFrame(
        [at(0, "a"), at(60, "b"), at(61, "c"), at(62, "d"), at(960, "e"), at(962, "d"), at(1900, "f")],
        "vehicle_id string, ts timestamp, route_id string, trip_id string, lat double, lon double",
    )
    cuts = [start + dt.timedelta(seconds=s) for s in (900, 961, 1000)]
    updates = replay(rows, "ts", vehicle_updates, cuts, ["vehicle_id"], mode="update").persist()
    assert {(r["vehicle_id"], r["commit"]) for r in updates.where("gone").collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 3)}
    shown = [{r["vehicle_id"] for r in on_map(updates.where(F.col("commit") <= k), ["batch"]).collect()} for k in range(4)]
    assert shown == [{"a", "b", "c", "d"}, {"c", "d", "e"}, {"d", "e"}, {"f"}]


def test_a_stream_starts_from_the_stored_table_and_reads_it_once(spark, tmp_path):
    """The first row differs little from what is stored; started again, the stream does not touch the table."""
    stored = polls(spark, [(0, None)])
    first, second = polls(spark, [(0, None), (10, None), (45, None)], start="2026-10-01 18:05:00"), polls(spark, [(50, None), (90, None)], start="2026-10-01 18:10:00")
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    gone = stored.withColumn("trip_id", F.when(F.col("stop_sequence") == 1, F.raise_error(F.lit("read again"))))
    for rows, start in ((first, stored), (second, gone)):
        rows.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        query = changed_stream(stream, stored=start).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    got = [r["arrival_time"] for r in spark.read.schema(stored.schema).parquet(out).orderBy("observed_at").collect()]
    assert got == [utc("2026-10-01 19:00:45"), utc("2026-10-01 19:01:30")]


@pytest.mark.parametrize("lost", ["_log_polls", "_leave_header", "append"])
def test_a_batch_that_is_run_again_leaves_everything_once(spark, tmp_path, monkeypatch, lost):
    """The batch fails after staging, before or after its rows are appended; the stream takes it up again."""
    landing, store = tmp_path / "land", S.Store(str(tmp_path / "store"))
    land(landing, "1.json", "vehicle_positions", EPOCH, [bus("b1", EPOCH), bus("b2", EPOCH)], 0)
    land(landing, "2.json", "vehicle_positions", EPOCH, [bus("b3", EPOCH)], 30)
    usual, calls = getattr(S, lost), []

    def broken(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("executor lost")
        return usual(*a, **k)

    with monkeypatch.context() as m:
        m.setattr(S, lost, broken)
        with pytest.raises(Exception, match="executor lost"):
            ingest(spark, landing, store, "vehicle_positions")
    ingest(spark, landing, store, "vehicle_positions")
    assert log_of(spark, store) == [("ok", 2), ("skipped_unchanged", 0)]
    assert spark.read.parquet(store.table("vehicle_positions")).count() == 2
    land(landing, "3.json", "vehicle_positions", EPOCH, [bus("b4", EPOCH)], 60)
    ingest(spark, landing, store, "vehicle_positions")
    assert log_of(spark, store)[-1] == ("skipped_unchanged", 0)


def test_each_batch_is_resolved_against_the_version_loaded_then(spark, tmp_path):
    from stopclock.sinks import schedule
    from tests.test_sinks import FILES, folder

    landing, store, static = tmp_path / "land", S.Store(str(tmp_path / "store")), str(tmp_path / "static")

    def run():
        S.start_feed(spark, str(landing), "trip_updates", store, every=None, schedule=static).awaitTermination()

    def trip(header):
        stops = [{"stop_id": s, "arrival": {"time": EPOCH + 100 + 100 * i}} for i, s in enumerate("abc")]
        return {"id": "u", "trip_update": {"timestamp": header, "trip": {"trip_id": "t1", "start_date": "20261001"}, "stop_time_update": stops}}

    land(landing, "1.json", "trip_updates", EPOCH, [trip(EPOCH)], 0)
    run()
    schedule.load_schedule(spark, folder(tmp_path), static, "test")
    land(landing, "2.json", "trip_updates", EPOCH + 30, [trip(EPOCH + 30)], 30)
    run()
    renumbered = FILES["stop_times.txt"].replace(",a,1,", ",a,11,").replace(",b,2,", ",b,12,").replace(",c,3,", ",c,13,")
    schedule.load_schedule(spark, folder(tmp_path, "second", **{"stop_times.txt": renumbered}), static, "test")
    land(landing, "3.json", "trip_updates", EPOCH + 60, [trip(EPOCH + 60)], 60)
    run()
    assert log_of(spark, store) == [("ok", 0), ("ok", 3), ("ok", 3)]
    rows = spark.read.parquet(store.table("predictions")).orderBy("observed_at", "stop_sequence").collect()
    assert [r["stop_sequence"] for r in rows] == [1, 2, 3, 11, 12, 13]


def test_unchanged_compares_with_the_last_only(spark):
    df = spark.createDataFrame(
        [("f", h, [], utc(f"2026-10-01 10:0{i}:00")) for i, h in enumerate([5, 5, None, None, 6, 5, 5])], S.LANDED["feed"].name + " string, header_ts bigint, entity array<int>, received_at timestamp"
    )
    got = [r["unchanged"] for r in S.mark_unchanged(df).orderBy("received_at").collect()]
    assert got == [False, True, False, False, False, False, True]
    assert [r["unchanged"] for r in S.mark_unchanged(df, last_header=5).orderBy("received_at").collect()][0] is True


def test_unchanged_is_told_across_time_slots(spark):
    """Three days of polls against a loop, with a poll's headers sorted by slot: no group holds a feed."""
    heads = [(i // 3 * 10 or None) if i % 11 else None for i in range(240)]
    rows = [(f, h, [], utc("2026-10-01 00:00:00") + dt.timedelta(minutes=17 * i + (f == "b"))) for f in ("a", "b") for i, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "feed string, header_ts bigint, entity array<int>, received_at timestamp")
    want = [h is not None and h == before for before, h in zip([0, *heads], heads, strict=False)]
    marked = S.mark_unchanged(df)
    for feed in ("a", "b"):
        assert [r["unchanged"] for r in marked.where(F.col("feed") == feed).orderBy("received_at").collect()] == want
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "received_at" in line]
    assert len(windows) == 1 and "_slot" in windows[0].split("],")[1]
