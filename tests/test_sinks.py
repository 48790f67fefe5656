import datetime as dt
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stopclock.operators.calendar import active_version, expand_service_dates
from stopclock.operators.service_days import backfill_days, key_collisions, trip_windows, with_service_day
from stopclock.sinks import schedule as S
from stopclock.sinks import tables as TB
from stopclock.sinks.tables import append, append_log, append_new, log_row, merge_captures, merge_counts, move_rows, table, upsert, vacuum
from stopclock.schemas import LOAD_LOG
from stopclock.sources.gtfs_text import read_table
from tests.conftest import day, utc

POS = "vehicle_id string, ts timestamp, start_date date, lat double, n int"


def positions(spark, *rows):
    return spark.createDataFrame([(v, utc(f"2026-10-01 {t}"), day("2026-10-01"), lat, n) for v, t, lat, n in rows], POS)


def test_first_write_wins_and_counts_are_real(spark, tmp_path):
    path = str(tmp_path / "positions")
    key = ["vehicle_id", "ts"]
    batch = positions(spark, ("a", "10:00:00", 1.0, 1), ("a", "10:00:00", 2.0, 2), ("a", "10:00:30", 3.0, 3))
    assert append_new(batch, path, key, ["n"], ["start_date"]) == {"offered": 3, "inserted": 2}
    again = positions(spark, ("a", "10:00:00", 9.0, 1), ("b", "10:00:00", 4.0, 2))
    assert append_new(again, path, key, ["n"], ["start_date"], ("2026-10-01", "2026-10-01")) == {"offered": 2, "inserted": 1}
    stored = spark.read.parquet(path)
    assert sorted(r["lat"] for r in stored.collect()) == [1.0, 3.0, 4.0]


def test_upsert_replaces_and_leaves_other_partitions(spark, tmp_path):
    path, key = str(tmp_path / "errors"), ["start_date", "trip_id", "source"]
    schema = "start_date date, trip_id string, source string, error int"
    d1, d2 = day("2026-10-01"), day("2026-10-02")
    upsert(spark.createDataFrame([(d1, "t", "lgbm", 1), (d1, "u", "lgbm", 2), (d2, "t", "lgbm", 3)], schema), path, key, ["start_date", "source"])
    upsert(spark.createDataFrame([(d1, "t", "lgbm", 10), (d1, "t", "mts", 5)], schema), path, key, ["start_date", "source"])
    by = ["start_date", "source"]
    got = {(r["start_date"], r["trip_id"], r["source"]): r["error"] for r in table(spark, path, spark.createDataFrame([], schema).schema, by).collect()}
    assert got == {(d1, "t", "lgbm"): 10, (d1, "u", "lgbm"): 2, (d2, "t", "lgbm"): 3, (d1, "t", "mts"): 5}


def test_backfill_moves_rows_between_days(spark, tmp_path):
    path = str(tmp_path / "positions")
    rows = spark.createDataFrame(
        [("bus", utc("2026-09-29 07:05:00"), "night", day("2026-09-29")), ("bus", utc("2026-09-29 06:50:00"), "night", day("2026-09-28")),
         ("bus", utc("2026-09-30 20:00:00"), None, day("2026-09-30"))],
        "vehicle_id string, ts timestamp, trip_id string, start_date date",
    )
    append(rows, path, ["start_date"])
    stop_times = spark.createDataFrame([("night", 84900), ("night", 86460)], "trip_id string, arrival_seconds int")
    stored = table(spark, path, rows.schema, ["start_date"])
    fixed = backfill_days(stored, trip_windows(stop_times), "ts").select(*rows.columns, "stored_date")
    assert key_collisions(fixed, ["vehicle_id", "ts"]).isEmpty()
    assert move_rows(fixed, path, "stored_date") == 1
    after = table(spark, path, rows.schema, ["start_date"])
    assert sorted(r["start_date"].isoformat() for r in after.collect()) == ["2026-09-28", "2026-09-28", "2026-09-30"]
    again = backfill_days(after, trip_windows(stop_times), "ts").select(*rows.columns, "stored_date")
    assert move_rows(again, path, "stored_date") == 0


ERRORS = "start_date date, trip_id string, source string, error int"
BY = ["start_date", "source"]


def errors(spark, *rows):
    return spark.createDataFrame([(day(d), t, s, e) for d, t, s, e in rows], ERRORS)


def held(spark, path):
    rows = table(spark, path, errors(spark).schema, BY).collect()
    return sorted((r["start_date"].day, r["trip_id"], r["source"], r["error"]) for r in rows)


def test_a_replacement_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    """Lost in the middle of its files, or after them: readers see the old table whole, and a second try goes through."""
    path, key = str(tmp_path / "errors"), ["start_date", "trip_id", "source"]
    upsert(errors(spark, ("2026-10-01", "t", "a", 1), ("2026-10-02", "t", "a", 2), ("2026-10-02", "u", "b", 3)), path, key, BY)
    old = held(spark, path)
    new = errors(spark, ("2026-10-01", "t", "a", 10), ("2026-10-02", "t", "a", 20), ("2026-10-02", "x", "a", 30))
    broken = new.withColumn("error", F.when(F.col("trip_id") == "x", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("error")))
    with pytest.raises(Exception, match="lost"):
        upsert(broken, path, key, BY)
    assert held(spark, path) == old
    with monkeypatch.context() as m:
        m.setattr(TB, "_put_manifest", lambda *a: (_ for _ in ()).throw(OSError("no manifest")))
        with pytest.raises(OSError, match="no manifest"):
            upsert(new, path, key, BY)
    assert held(spark, path) == old
    reader = table(spark, path, new.schema, BY)
    upsert(new, path, key, BY)
    want = [(1, "t", "a", 10), (2, "t", "a", 20), (2, "u", "b", 3), (2, "x", "a", 30)]
    assert held(spark, path) == want
    assert sorted(r["error"] for r in reader.collect()) == [1, 2, 3], "whoever reads the old table goes on reading it"
    assert append_new(errors(spark, ("2026-10-02", "t", "a", 99), ("2026-10-02", "n", "a", 4)), path, key, ["error"], BY) == {"offered": 2, "inserted": 1}
    assert vacuum(spark, path, BY) >= 2 and vacuum(spark, path, BY) == 0
    assert held(spark, path) == sorted([*want, (2, "n", "a", 4)])


def test_a_day_all_rows_leave_is_empty_and_can_be_filled_again(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, day("2026-10-01")), (2, day("2026-10-02")), (3, None)], "n int, start_date date")
    append(rows, path, ["start_date"])
    moved = rows.where("n = 1").withColumn("old", F.col("start_date")).withColumn("start_date", F.lit(day("2026-10-02")))
    moved = moved.unionByName(rows.where("n <> 1").withColumn("old", F.col("start_date")))
    assert move_rows(moved, path, "old") == 1
    read = lambda: sorted((r["n"], str(r["start_date"])) for r in table(spark, path, rows.schema, ["start_date"]).collect())
    assert read() == [(1, "2026-10-02"), (2, "2026-10-02"), (3, "None")]
    append(spark.createDataFrame([(4, day("2026-10-01"))], rows.schema), path, ["start_date"])
    assert read()[-1] == (4, "2026-10-01")


def test_rows_without_a_trip_keep_their_day(spark):
    rows = spark.createDataFrame(
        [("a", utc("2026-09-29 07:05:00"), None, day("2020-01-01")), ("b", utc("2026-09-29 07:05:00"), "", None), ("c", utc("2026-09-29 07:05:00"), "unknown", None)],
        "vehicle_id string, ts timestamp, trip_id string, start_date date",
    )
    windows = spark.createDataFrame([], "trip_id string, first_seconds int, last_seconds int")
    got = {r["vehicle_id"]: r["start_date"] for r in with_service_day(rows, windows, "ts").collect()}
    assert got == {"a": day("2020-01-01"), "b": None, "c": day("2026-09-29")}


def test_merging_captures(spark):
    a = positions(spark, ("a", "10:00:00", 1.0, 1), ("b", "10:00:00", 2.0, 1))
    b = positions(spark, ("b", "10:00:00", 9.0, 1), ("c", "10:00:00", 3.0, 1))
    merged = {r["vehicle_id"]: r["lat"] for r in merge_captures(a, b, ["vehicle_id", "ts"]).collect()}
    assert merged == {"a": 1.0, "b": 2.0, "c": 3.0}
    assert tuple(merge_counts(a, b, ["vehicle_id", "ts"]).first()) == (2, 2, 3)


def test_log_failure_does_not_fail_the_job(spark, tmp_path):
    target = tmp_path / "file"
    target.write_text("in the way")
    row = log_row(spark, LOAD_LOG, status="ok", error="x" * 3000)
    assert append_log(row, str(target)) is False
    assert append_log(row, str(tmp_path / "log")) is True
    assert len(spark.read.parquet(str(tmp_path / "log")).first()["error"]) == 1003


# --- schedule files ---

FILES = {
    "agency.txt": "agency_id,agency_name,agency_url,agency_timezone,agency_lang,agency_phone\n1,City Lines,https://example.org,America/Los_Angeles,en,\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_long_name,route_type,route_color,route_text_color\n"
    "7,1,7,Downtown - University,3,,\n510,1,Blue,Blue Line,0,0000FF,FFFFFF\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    "wk,1,1,1,1,1,0,0,20260907,20260930\nsun,0,0,0,0,0,0,1,20260907,20260930\n",
    "calendar_dates.txt": "service_id,date,exception_type\nwk,20260910,2\nwk,20260912,1\n",
    "trips.txt": "route_id,service_id,trip_id,trip_headsign,direction_id,block_id,shape_id\n7,wk,t1,North,0,,s1\n7,sun,t2,,1,,s1\n510,wk,t3,Border,0,b,s2\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type,shape_dist_traveled,timepoint\n"
    "t1,05:12:30,05:12:40,a,1,,0,0,0.0,1\nt1,,,b,2,,0,0,0.5,0\nt1,5:30:00,5:30:00,c,3,,0,0,1.0,1\n"
    "t2,08:00:00,08:00:00,a,1,,0,0,0.0,1\nt2,08:10:00,08:10:00,b,2,,0,0,0.5,1\nt3,25:30:00,25:30:00,c,1,,0,0,0.0,1\nt3,26:05:00,26:05:00,d,2,,0,0,2.0,1\n",
    "stops.txt": "stop_id,stop_code,stop_name,stop_lat,stop_lon,location_type,parent_station,wheelchair_boarding\n"
    'a,100,"Main St, North",32.7,-117.1,0,,1\nb,101,B,32.71,-117.1,0,,\nc,102,C,32.72,-117.1,0,d,\nd,,Station,32.73,-117.1,1,,\n',
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\n"
    "s1,32.70,-117.1,1,0.0\ns1,32.71,-117.1,2,0.5\ns1,32.72,-117.1,3,1.0\ns2,32.72,-117.1,1,0.0\ns2,32.73,-117.1,2,2.0\n",
    "feed_info.txt": "feed_publisher_name,feed_publisher_url,feed_lang,feed_start_date,feed_end_date,feed_version\nCity,https://example.org,en,20260907,20260930,2026-09\n",
}
COUNTS = {"agencies": 1, "routes": 2, "stops": 4, "trips": 3, "stop_times": 7, "shapes": 5, "calendar": 2, "calendar_dates": 2}


def folder(tmp_path, name="feed", **changes):
    where = tmp_path / name
    where.mkdir()
    for file, text in {**FILES, **changes}.items():
        if text is not None:
            (where / file).write_text(text, encoding="utf-8")
    return str(where)


def test_every_table_is_typed(spark, tmp_path):
    feed = folder(tmp_path)
    assert {t: read_table(spark, feed, t).count() for t in COUNTS} == COUNTS
    times = {(r["trip_id"], r["stop_sequence"]): r for r in read_table(spark, feed, "stop_times").collect()}
    assert times["t1", 1]["arrival_seconds"] == 18750 and times["t1", 2]["arrival_seconds"] is None
    assert times["t3", 2]["arrival_seconds"] == 93900 and times["t1", 2]["shape_dist_traveled_m"] == pytest.approx(804.672)
    stops = {r["stop_id"]: r for r in read_table(spark, feed, "stops").collect()}
    assert stops["a"]["stop_name"] == "Main St, North" and stops["d"]["stop_code"] is None


def test_byte_order_mark_missing_columns_and_files(spark, tmp_path):
    feed = folder(
        tmp_path, **{"agency.txt": "﻿agency_id,agency_name\n1,City\n", "calendar_dates.txt": None, "feed_info.txt": None}
    )
    row = read_table(spark, feed, "agencies").first()
    assert (row["agency_id"], row["agency_name"], row["agency_phone"]) == ("1", "City", None)
    assert read_table(spark, feed, "calendar_dates").count() == 0
    broken = folder(tmp_path, "broken", **{"trips.txt": None, "shapes.txt": None})
    with pytest.raises(FileNotFoundError, match="trips.txt, shapes.txt"):
        S.load_schedule(spark, broken, str(tmp_path / "store"), "test")


def test_service_dates(spark, tmp_path):
    feed = folder(tmp_path)
    rows = expand_service_dates(read_table(spark, feed, "calendar"), read_table(spark, feed, "calendar_dates")).collect()
    running = {(r["service_id"], r["service_date"].isoformat()) for r in rows}
    assert len(rows) == len(running) == 18 - 1 + 1 + 3
    assert ("wk", "2026-09-10") not in running and ("wk", "2026-09-12") in running and ("sun", "2026-09-13") in running


@pytest.mark.parametrize(
    ("calendar", "exceptions", "message"),
    [
        ("w,1,1,1,1,1,1,1,20260910,20260909", "", "ends before"),
        ("w,1,1,1,1,1,1,1,20260910,20260912", "w,20260910,3", "unknown exception_type"),
    ],
)
def test_bad_calendars_fail(spark, tmp_path, calendar, exceptions, message):
    feed = folder(
        tmp_path,
        **{
            "calendar.txt": FILES["calendar.txt"].splitlines()[0] + "\n" + calendar + "\n",
            "calendar_dates.txt": "service_id,date,exception_type\n" + exceptions + "\n",
        },
    )
    with pytest.raises(PySparkException, match=message):
        expand_service_dates(read_table(spark, feed, "calendar"), read_table(spark, feed, "calendar_dates")).collect()


def test_service_added_only_by_exception(spark):
    calendar = spark.createDataFrame(
        [("none", *[False] * 7, day("2026-09-07"), day("2026-09-30"))],
        "service_id string, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean, sunday boolean, start_date date, end_date date",
    )
    extra = spark.createDataFrame([("new", day("2026-09-08"), 1)], "service_id string, service_date date, exception_type int")
    assert [tuple(r) for r in expand_service_dates(calendar, extra).collect()] == [(day("2026-09-08"), "new")]


def test_versions_load_skip_replace_and_drop(spark, tmp_path):
    store = str(tmp_path / "store")
    feed = folder(tmp_path)
    assert S.load_schedule(spark, feed, store, "test") == "ok"
    assert S.load_schedule(spark, feed, store, "test") == "skipped_unchanged"
    copy = folder(tmp_path, "copy")
    import os

    os.utime(copy + "/agency.txt", (2_000_000_000, 2_000_000_000))
    assert S.load_schedule(spark, copy, store, "test") == "skipped_already_loaded"
    assert S.load_schedule(spark, copy, store, "test", force=True) == "ok"
    versions = S.registry(spark, store).collect()
    assert len(versions) == 1 and versions[0]["publisher_version"] == "2026-09"
    assert S.read_static(spark, store, "stop_times").count() == 7
    assert S.read_static(spark, store, "service_dates").count() == 21
    changed = folder(tmp_path, "changed", **{"routes.txt": FILES["routes.txt"].replace("Blue Line", "Green Line")})
    assert S.load_schedule(spark, changed, store, "test") == "ok"
    assert S.registry(spark, store).count() == 2
    with pytest.raises(PySparkException):
        S.load_schedule(spark, folder(tmp_path, "bad", **{"stop_times.txt": FILES["stop_times.txt"].replace("08:10:00", "08:99:00")}), store, "test")
    assert S.registry(spark, store).count() == 2, "a failed load is not visible"
    assert S.read_static(spark, store, "stop_times").count() == 14
    log = [r["status"] for r in spark.read.parquet(f"{store}/gtfs_load_log").orderBy("started_at").collect()]
    assert log == ["ok", "skipped_unchanged", "skipped_already_loaded", "ok", "ok", "parse_error"]
    S.drop_version(spark, store, versions[0]["feed_version"])
    assert S.registry(spark, store).count() == 1 and S.read_static(spark, store, "routes").count() == 2


def test_a_forced_load_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store, feed = str(tmp_path / "store"), folder(tmp_path)
    assert S.load_schedule(spark, feed, store, "test") == "ok"
    before = S.read_static(spark, store, "stop_times")
    with monkeypatch.context() as m:
        m.setattr(S, "_register", lambda *a: (_ for _ in ()).throw(OSError("lost before the registry row")))
        with pytest.raises(OSError):
            S.load_schedule(spark, feed, store, "test", force=True)
    assert S.read_static(spark, store, "stop_times").count() == 7
    assert S.load_schedule(spark, feed, store, "test", force=True) == "ok"
    assert S.read_static(spark, store, "stop_times").count() == 7 == before.count()
    assert S.drop_old_loads(spark, store) == 2 * len(S.STATIC) and S.drop_old_loads(spark, store) == 0
    stops = {r["trip_id"]: r for r in S.read_static(spark, store, "trip_stops").collect()}
    assert stops["t1"]["stop_ids"] == ["a", "b", "c"] and (stops["t3"]["first_seconds"], stops["t3"]["last_seconds"]) == (91800, 93900)


def test_content_version_ignores_line_order(spark, tmp_path):
    lines = FILES["stops.txt"].splitlines()
    shuffled = "\n".join([lines[0], *reversed(lines[1:])]) + "\n"
    one, two = folder(tmp_path), folder(tmp_path, "two", **{"stops.txt": shuffled})
    three = folder(tmp_path, "three", **{"stops.txt": FILES["stops.txt"].replace("Station", "Stationn")})
    ids = [S.content_version(spark, f) for f in (one, two, three)]
    assert ids[0] == ids[1] != ids[2]


def test_active_schedule_allows_open_ranges(spark):
    schema = "feed_version string, loaded_at timestamp, feed_start_date date, feed_end_date date"
    rows = [
        ("old", utc("2026-01-01 00:00:00"), day("2026-01-01"), day("2026-12-31")),
        ("new", utc("2026-05-01 00:00:00"), day("2026-06-01"), day("2026-06-30")),
        ("unfinished", None, None, None),
    ]
    pick = lambda data, when: [r[0] for r in active_version(spark.createDataFrame(data, schema), when).collect()]
    assert pick(rows, "2026-06-15") == ["new"] and pick(rows, "2026-07-15") == ["old"] and pick(rows, "2030-01-01") == []
    assert pick([*rows, ("open", utc("2026-04-01 00:00:00"), None, day("2020-01-01"))], "2026-07-15") == ["open"]


def test_registry_row_comes_last(spark, tmp_path):
    store = str(tmp_path / "store")
    S.load_version(spark, folder(tmp_path), store, "v")
    assert spark.read.parquet(f"{store}/stop_times").count() == 7
    assert S.registry(spark, store).isEmpty() and S.read_static(spark, store, "stop_times").isEmpty()


_ = (dt, F)


def test_stored_rows_of_sources_not_written_are_kept_without_a_comparison(spark):
    """The same rows as the plain upsert, with nulls and repeated rows; only the sources written reach the join."""
    stored = spark.range(60).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 9).alias("k"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.col("id").alias("v")
    )
    stored = stored.unionByName(stored.limit(20))
    for picked in ("source = 's2'", "source in ('s1', 's3') or source is null", "false", "source is null"):
        new = stored.where(picked).where("v % 2 = 0").withColumn("v", F.col("v") + 1000)
        plain = TB.upsert_rows(stored, new, ["k", "source"])
        within = TB.upsert_rows(stored, new, ["k", "source"], within="source")
        assert within.columns == plain.columns
        assert sorted(map(str, within.collect())) == sorted(map(str, plain.collect()))
    sources = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "source string, k int, v int")
    joined = TB.upsert_rows(sources, sources.where("source = 'a'"), ["k", "source"], within="source")
    assert sorted(map(tuple, joined.collect())) == [("a", 1, 1), ("b", 1, 2)]


def test_trip_stops_take_one_pass_and_content_does_not_depend_on_parts(spark, tmp_path):
    """Stops and seconds of a trip come of one aggregate, as two joined gave them; a folder of parts is the file it makes."""
    from stopclock.operators.alignment import scheduled_stops

    rows = [("t", 2, "b", 50), ("t", 1, "a", None), ("t", 3, "c", 90), ("u", 1, "a", None), (None, 1, "a", 10), ("t", 3, "c", 90)]
    stop_times = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop_id string, arrival_seconds int")
    got = S.trip_stops(stop_times)
    want = scheduled_stops(stop_times).join(trip_windows(stop_times), "trip_id", "left")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    whole, parts = folder(tmp_path, "whole"), folder(tmp_path, "parts")
    lines = FILES["stop_times.txt"].splitlines()
    (Path(parts) / "stop_times.txt").unlink()
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(2, F.col("value")).write.text(f"{parts}/stop_times.txt")
    assert S.content_version(spark, whole) == S.content_version(spark, parts)


def test_upsert_makes_its_new_rows_once(spark, tmp_path):
    """The rows are made for the write alone; partitions without a value keep the rows the new ones do not replace."""
    path, key = str(tmp_path / "errors"), ["k", "source"]
    upsert(spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4)], "k int, source string, error int"), path, key, ["source"])
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(2, "a", 20), (5, "a", 50), (6, None, 60)], "k int, source string, error int")
    upsert(rows.mapInArrow(counted, rows.schema), path, key, ["source"])
    assert made.value == 3
    got = table(spark, path, rows.schema, ["source"]).collect()
    assert {tuple(r) for r in got} == {(1, "a", 1), (2, "a", 20), (5, "a", 50), (3, "b", 3), (4, None, 4), (6, None, 60)} and len(got) == 6


def test_upsert_compares_only_rows_of_touched_days(spark, tmp_path, monkeypatch):
    """All stored rows of a rewritten month were shuffled to be held against the new ones of a day."""
    path, key, by, compared = str(tmp_path / "errors"), ["day", "k"], ["month"], []
    schema = "day date, k int, month string, error int"
    d1, d2 = day("2026-10-01"), day("2026-10-02")
    old = [(d1, 1, "10", 1), (d1, 2, "10", 2), (d2, 1, "10", 3), (None, 1, "10", 4), (d2, 9, "11", 5)]
    upsert(spark.createDataFrame(old, schema), path, key, by)
    hold = TB.not_yet_stored
    monkeypatch.setattr(TB, "not_yet_stored", lambda batch, stored, keys: compared.extend(batch.collect()) or hold(batch, stored, keys))
    upsert(spark.createDataFrame([(d1, 2, "10", 20), (d1, 3, "10", 30), (None, 1, "10", 40)], schema), path, key, by, within="day")
    assert sorted(r["error"] for r in compared) == [1, 2]
    stored = table(spark, path, spark.createDataFrame(old, schema).schema, by)
    assert sorted(r["error"] for r in stored.collect()) == [1, 3, 4, 5, 20, 30, 40]
