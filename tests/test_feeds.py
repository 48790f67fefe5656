import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stopclock.operators.alignment import align, resolution_summary, resolve_predictions
from stopclock.operators.changes import select_changed
from stopclock.schemas import SNAPSHOT
from stopclock.sources.snapshots import accepted, drop_counts, flatten_positions, flatten_predictions, note_counts
from tests.conftest import day, utc

EPOCH = 1_790_881_200  # 2026-10-01 19:00:00 UTC


def snapshot(spark, *entities, header=EPOCH, feed="any"):
    return spark.createDataFrame([(feed, header, list(entities))], SNAPSHOT)


def vehicle(id="e1", vehicle_id="bus", timestamp=EPOCH, trip=("t", "r", "20261001"), position=(32.7, -117.1, None, None)):
    return (id, (vehicle_id, timestamp, trip, position, None, None, None), None)


def update(stops, trip=("t", "r", "20261001"), timestamp=EPOCH):
    return ("e", None, (timestamp, "bus", trip, stops))


def stop(seq=None, stop_id="s", arrival=(EPOCH + 60, None), departure=None):
    return (seq, stop_id, None, arrival, departure)


def test_positions_fall_back_and_drop_by_reason(spark):
    df = flatten_positions(
        snapshot(
            spark,
            vehicle(),
            vehicle(id="e2", vehicle_id=""),
            vehicle(id="", vehicle_id=None),
            vehicle(id="e3", timestamp=0),
            vehicle(id="e4", trip=None, position=None),
            update([stop()]),
        )
    )
    rows = {r["vehicle_id"]: r for r in accepted(df.where("vehicle_id != 'bus' or note is null")).collect()}
    assert {"bus", "e2"} <= rows.keys()
    assert [tuple(r) for r in drop_counts(df).collect()] == [("no_vehicle_id", 1)]
    assert [tuple(r) for r in note_counts(df).collect()] == [("ts_from_header", 1)]
    assert df.count() == 5


def test_no_time_anywhere_drops(spark):
    df = flatten_positions(snapshot(spark, vehicle(timestamp=None), header=0))
    assert [tuple(r) for r in drop_counts(df).collect()] == [("no_timestamp", 1)]


def test_start_date_falls_back_to_the_local_day(spark):
    late = 1_790_924_400  # 2026-10-02 07:00 UTC is midnight local, so 06:59 is still the first
    df = flatten_positions(
        snapshot(spark, vehicle(trip=("t", "r", "nonsense"), timestamp=late - 60), vehicle(vehicle_id="b2", trip=("t", "r", None), timestamp=late))
    )
    assert [r[0] for r in df.orderBy("ts").select("start_date").collect()] == [day("2026-10-01"), day("2026-10-02")]


def test_predictions_keep_order_and_count_drops(spark):
    df = flatten_predictions(
        snapshot(
            spark,
            update([stop(stop_id="a"), stop(seq=7, stop_id=None), stop(stop_id=""), stop(stop_id="d", arrival=None)]),
            update([stop(), stop()], trip=("", "r", None)),
            update([], trip=(None, None, None)),
            update([]),
            update([stop(stop_id="x", arrival=None, departure=(0, 45))], trip=("t2", "r", None)),
            vehicle(),
        )
    )
    kept = accepted(df).orderBy("trip_id", "feed_order").collect()
    assert [(r["trip_id"], r["feed_order"], r["stop_id"], r["stop_sequence"]) for r in kept] == [
        ("t", 0, "a", None), ("t", 1, None, 7), ("t2", 0, "x", None)
    ]
    assert kept[2]["delay_seconds"] == 45 and kept[2]["arrival_time"] is None
    assert {r["reason"]: r["dropped"] for r in drop_counts(df).collect()} == {
        "no_trip_id": 3, "no_stop_identity": 1, "no_prediction_content": 1
    }


LOOP = [(1, "94031"), (2, "12510"), (3, "12853"), (4, "94031")]
ABC = [(1, "a"), (2, "b"), (3, "c")]


def aligned(spark, feed, schedule):
    df = spark.createDataFrame([(feed, [s for _, s in schedule], [n for n, _ in schedule])], "f array<string>, i array<string>, s array<int>")
    return df.select(align(F.col("f"), F.col("i"), F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("feed", "schedule", "expected"),
    [
        (["a", "b", "c"], ABC, [1, 2, 3]),
        (["94031", "12510", "12853", "94031"], LOOP, [1, 2, 3, 4]),
        (["94031"], LOOP, [1]),
        (["12853", "94031"], LOOP, [3, 4]),
        (["a", "zzz", "c"], ABC, [1, None, 3]),
        (["c", "a"], ABC, [3, None]),
        (["a", "a", "a"], ABC[:2], [1, None, None]),
        ([], ABC, []),
        (["a"], [], [None]),
        ([None, "b"], ABC, [None, 2]),
    ],
)
def test_alignment(spark, feed, schedule, expected):
    assert aligned(spark, feed, schedule) == expected


PRED = "eid int, trip_id string, start_date date, observed_at timestamp, feed_order int, stop_id string, stop_sequence int, arrival_time timestamp"


def test_resolution_settles_the_day_first_and_reports_reasons(spark):
    seen = utc("2026-09-29 07:05:00")
    rows = [
        (1, "night", day("2026-09-29"), seen, 0, "a", None, None),
        (1, "night", day("2026-09-29"), seen, 1, "q", None, None),
        (1, "ghost", day("2026-09-29"), seen, 0, "a", None, None),
        (1, "keyed", day("2026-09-29"), seen, 0, "a", 42, None),
    ]
    stop_times = spark.createDataFrame(
        [("night", 1, "a", 84900), ("night", 2, "b", 86460)], "trip_id string, stop_sequence int, stop_id string, arrival_seconds int"
    )
    df = spark.createDataFrame(rows, PRED)
    got = {(r["trip_id"], r["stop_id"]): r for r in resolve_predictions(df, stop_times, "eid").collect()}
    assert got["night", "a"]["stop_sequence"] == 1 and got["night", "a"]["start_date"] == day("2026-09-28")
    assert got["night", "q"]["reason"] == "stop_not_on_trip" and got["ghost", "a"]["reason"] == "trip_not_in_schedule"
    assert got["keyed", "a"]["stop_sequence"] == 42 and got["keyed", "a"]["start_date"] == day("2026-09-29")
    summary = {r["outcome"]: r["rows"] for r in resolution_summary(resolve_predictions(df, None, "eid")).collect()}
    assert summary == {"no_schedule_loaded": 3, "resolved": 1}


CHANGE = "start_date date, trip_id string, stop_sequence int, observed_at timestamp, arrival_time timestamp, delay_seconds int, n int"


def series(spark, values, trip="t"):
    """values: (arrival seconds or None, delay or None), one per poll."""
    base = utc("2026-10-01 18:00:00")
    rows = [
        (day("2026-10-01"), trip, 1, base + dt.timedelta(seconds=30 * i), None if a is None else base + dt.timedelta(seconds=a), d, i)
        for i, (a, d) in enumerate(values)
    ]
    return spark.createDataFrame(rows, CHANGE)


def kept(df):
    return sorted(r["n"] for r in df.collect())


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([(600, None)], [0]),
        ([(600, None), (600, None)], [0]),
        ([(600, None), (629, None)], [0]),
        ([(600, None), (630, None)], [0, 1]),
        ([(600, None), (570, None)], [0, 1]),
        ([(600, None), (620, None), (640, None), (641, None)], [0, 2]),
        ([(600, None), (None, None), (600, None)], [0, 1, 2]),
        ([(None, 0), (None, 29), (None, 30)], [0, 2]),
        ([(None, 0), (None, None), (None, 0)], [0, 1, 2]),
        ([(600, 0), (600, 500)], [0]),
    ],
)
def test_change_only(spark, values, expected):
    assert kept(select_changed(series(spark, values))) == expected


def test_threshold_zero_keeps_everything_timed(spark):
    assert kept(select_changed(series(spark, [(600, None), (600, None)]), threshold=0)) == [0, 1]


def test_random_series_match_the_fold_also_across_batches(spark):
    rng = random.Random(5)
    frames, expected = [], {}
    for t in range(25):
        value, values = 600, []
        for _ in range(40):
            value += rng.choice([0, 0, 0, 5, -7, 12, 29, 31, -60, 200])
            values.append((None if rng.random() < 0.1 else value, None if rng.random() < 0.2 else rng.randrange(0, 90)))
        frames.append(series(spark, values, f"t{t}"))
        last, keep = None, []
        for i, (a, d) in enumerate(values):
            now = ("time", a) if a is not None else ("delay", d) if d is not None else ("nothing", 0)
            if last is None or now[0] != last[0] or (now[0] != "nothing" and abs(now[1] - last[1]) >= 30):
                last = now
                keep.append(i)
        expected[f"t{t}"] = keep
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.repartition(6).persist()

    def by_trip(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["trip_id"], []).append(r["n"])
        return {k: sorted(v) for k, v in out.items()}

    assert by_trip(select_changed(rows)) == expected
    first = select_changed(rows.where("n < 17")).persist()
    last = first.groupBy("start_date", "trip_id", "stop_sequence").agg(
        F.max_by(F.struct("arrival_time", "delay_seconds"), "observed_at").alias("l")
    ).select("start_date", "trip_id", "stop_sequence", "l.*")
    second = select_changed(rows.where("n >= 17"), last_kept=last)
    assert by_trip(first.unionByName(second)) == expected
