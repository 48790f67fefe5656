import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopclock.fixed import FEATURES
from stopclock.functions.ordering import lag_within_feed
from stopclock.functions.quantiles import exact_percentile
from stopclock.operators import boosting as B
from stopclock.operators import conditions as C
from stopclock.operators import contexts as X
from stopclock.operators import features as FT
from stopclock.operators import model as M
from stopclock.operators import segments as S
from tests.conftest import day, utc

DAY, NOON = day("2026-10-01"), utc("2026-10-01 19:00:00")
ARR = "start_date date, trip_id string, stop_sequence int, feed_version string, stop_id string, arrived_at timestamp, ping_gap_seconds int"
SCORED = "start_date date, trip_id string, stop_sequence int, stop_id string, feed_version string, route_id string, arrived_at timestamp, ping_gap_seconds int, horizon_minutes int, source string"


def arrivals(spark, *rows, trip="t", on=DAY):
    """rows: (sequence, seconds after noon, gap)"""
    return spark.createDataFrame(
        [(on, trip, s, "v", f"s{s}", NOON + dt.timedelta(seconds=sec, days=(on - DAY).days), gap) for s, sec, gap in rows], ARR
    )


def asked(spark, *rows, trip="t"):
    """rows: (sequence, seconds after noon, horizon)"""
    return spark.createDataFrame(
        [(DAY, trip, s, f"s{s}", "v", "r", NOON + dt.timedelta(seconds=sec), 30, h, "mts") for s, sec, h in rows], SCORED
    )


def stop_times(spark, *seconds, trip="t"):
    return spark.createDataFrame(
        [("v", trip, i + 1, f"s{i + 1}", s) for i, s in enumerate(seconds)],
        "feed_version string, trip_id string, stop_sequence int, stop_id string, arrival_seconds int",
    )


def anchor_of(df):
    return [(r["stop_sequence"], r["horizon_minutes"], r["anchor"]["sequence"]) for r in df.orderBy("stop_sequence", "horizon_minutes").collect()]


def test_anchor_must_be_known_not_just_past(spark):
    # Stop 2 was reached before the cutoff, but the ping proving it came after.
    a = arrivals(spark, (1, 0, 10), (2, 100, 60), (3, 400, 10))
    assert anchor_of(X.anchors(asked(spark, (3, 400, 5)), a)) == [(3, 5, 1)]
    assert anchor_of(X.anchors(asked(spark, (3, 460, 5)), a)) == [(3, 5, 2)], "known exactly at the cutoff counts"


def test_a_target_is_never_its_own_anchor(spark):
    assert X.anchors(asked(spark, (1, 900, 1)), arrivals(spark, (1, 0, 0))).isEmpty()


def test_scored_rows_are_not_sorted_for_their_anchors(spark):
    """They were, as whole rows, in time order of their trip: what memory did not hold was spilled."""
    q, a = asked(spark, (3, 460, 5)), arrivals(spark, (1, 0, 0), (2, 100, 60))
    plan = X.anchors(q, a)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_equal_scored_rows_whose_trip_runs_on_or_backwards(spark):
    """Each keeps its own answer where the furthest known stop lies ahead of it; else equal ones count once."""
    on, back = arrivals(spark, (1, 0, 0), (3, 600, 0)), arrivals(spark, (1, 0, 0), (9, 10, 0), (3, 600, 0))
    twice = asked(spark, (3, 600, 5), (3, 600, 5))
    assert len(X.anchors(twice, on).collect()) == 2 and len(X.anchors(twice, back).collect()) == 1
    assert anchor_of(X.anchors(twice, back)) == [(3, 5, 1)]


def test_anchor_is_the_furthest_stop_not_the_latest_time(spark):
    a = arrivals(spark, (1, 300, 0), (2, 100, 0), (3, 2000, 0))
    assert anchor_of(X.anchors(asked(spark, (3, 2000, 1)), a)) == [(3, 1, 2)]


def test_random_anchors_match_the_definition(spark):
    rng = random.Random(11)
    a_rows, q_rows, expected = [], [], {}
    for t in range(40):
        clock, known = 0, []
        for s in range(1, 25):
            clock += rng.choice([20, 60, 120, -150])
            gap = rng.choice([None, 0, 30, 300])
            known.append((s, clock, clock + (gap or 0)))
            a_rows.append((DAY, f"t{t}", s, "v", f"s{s}", NOON + dt.timedelta(seconds=clock), gap))
        for s, sec, _ in known:
            for h in (1, 5):
                q_rows.append((DAY, f"t{t}", s, f"s{s}", "v", "r", NOON + dt.timedelta(seconds=sec), 30, h, "mts"))
                ok = [k for k, _, at in known if k < s and at <= sec - h * 60]
                if ok:
                    expected[f"t{t}", s, h] = max(ok)
    got = X.anchors(spark.createDataFrame(q_rows, SCORED), spark.createDataFrame(a_rows, ARR)).collect()
    assert {(r["trip_id"], r["stop_sequence"], r["horizon_minutes"]): r["anchor"]["sequence"] for r in got} == expected


def test_training_pairs_match_the_definition(spark):
    rows = [(s, s * 50, 10 if s % 7 else 400) for s in range(1, 90)]
    a, st = arrivals(spark, *rows), stop_times(spark, *[43200 + 50 * i if i % 11 else None for i in range(1, 95)])
    trips = spark.createDataFrame([("v", "t", "r")], "feed_version string, trip_id string, route_id string")
    usable = [s for s, _, gap in rows if gap <= 180 and s % 11]
    got = {(r["anchor_sequence"], r["target_sequence"]) for r in X.training_contexts(a, trips, st, far_pct=100).collect()}
    assert got == {(x, y) for x in usable for y in usable if 0 < y - x <= 30}
    near = {(x, y) for x, y in got if y - x <= 12}
    sampled = [tuple(r) for r in X.training_contexts(a, trips, st).select("anchor_sequence", "target_sequence").collect()]
    assert len(sampled) == len(set(sampled)) and near < set(sampled) < got
    again = {tuple(r) for r in X.training_contexts(a.repartition(3), trips, st).select("anchor_sequence", "target_sequence").collect()}
    assert again == set(sampled)


def test_both_context_builders_share_their_columns(spark):
    a, st = arrivals(spark, (1, 0, 0), (2, 600, 0)), stop_times(spark, 43200, 43800)
    trips = spark.createDataFrame([("v", "t", "r")], "feed_version string, trip_id string, route_id string")
    evaluation = X.evaluation_contexts(asked(spark, (2, 600, 5)), a, st)
    training = X.training_contexts(a, trips, st)
    assert evaluation.columns == training.columns == X.CONTEXT
    assert [f.dataType for f in evaluation.schema] == [f.dataType for f in training.schema]
    assert evaluation.first()["prediction_instant"] == NOON + dt.timedelta(seconds=300)
    assert training.first()["prediction_instant"] == NOON


def test_time_since_the_anchor_is_no_feature():
    assert len(FEATURES) == 12
    assert not {f for f in FEATURES if "elapsed" in f or "since" in f or "age" in f}


def test_segment_stats_stop_at_the_boundary_and_need_good_ends(spark):
    good = arrivals(spark, (1, 0, 10), (2, 120, 10), (3, 300, 10))
    later = arrivals(spark, (1, 0, 10), (2, 999, 10), on=day("2026-10-02"))
    poor = arrivals(spark, (1, 0, 10), (2, 500, 181), trip="p")
    odd = arrivals(spark, (1, 0, 10), (2, 1801, 10), (3, 1801, 10), trip="o")
    got = S.fit_segment_stats(good.unionByName(later).unionByName(poor).unionByName(odd), "2026-10-01").collect()
    assert {(r["from_stop_id"], r["to_stop_id"]): (r["n"], r["mean_seconds"], r["median_seconds"]) for r in got} == {
        ("s1", "s2"): (1, 120.0, 120.0), ("s2", "s3"): (1, 180.0, 180.0)
    }
    assert {r["hour_bin"] for r in got} == {12} and got[0]["stddev_seconds"] is None


STATS = "feed_version string, from_stop_id string, to_stop_id string, hour_bin int, is_weekend boolean, n int, mean_seconds double, fit_through_date date"


def stats(spark):
    d = day("2026-09-30")
    return spark.createDataFrame(
        [("v", "s1", "s2", 12, False, 3, 100.0, d), ("v", "s1", "s2", 8, False, 1, 200.0, d), ("v", "s2", "s3", 8, True, 4, 50.0, d)], STATS
    )


def test_lookup_falls_back_exact_segment_global(spark):
    pairs = spark.createDataFrame(
        [("v", "s1", "s2", 12, False), ("v", "s1", "s2", 9, False), ("v", "s8", "s9", 12, False)], "feed_version string, from_stop_id string, to_stop_id string, hour_bin int, is_weekend boolean"
    )
    got = {(r["from_stop_id"], r["hour_bin"]): (r["mean_seconds"], r["level"]) for r in S.lookup_segments(pairs, stats(spark)).collect()}
    assert got == {("s1", 12): (100.0, "exact"), ("s1", 9): (125.0, "segment"), ("s8", 12): (87.5, "global")}
    empty = S.lookup_segments(pairs, stats(spark).where("n < 0")).collect()
    assert {(r["mean_seconds"], r["level"]) for r in empty} == {(60.0, "global")}


def test_versions_that_share_a_segment_keep_their_own_means(spark):
    other = stats(spark).withColumn("feed_version", F.lit("w")).withColumn("mean_seconds", F.col("mean_seconds") * 2)
    both = stats(spark).unionByName(other)
    pairs = spark.createDataFrame(
        [(v, "s1", "s2", h, False) for v in ("v", "w", "x") for h in (12, 9)], "feed_version string, from_stop_id string, to_stop_id string, hour_bin int, is_weekend boolean"
    )
    got = {(r["feed_version"], r["hour_bin"]): (r["mean_seconds"], r["level"]) for r in S.lookup_segments(pairs, both).collect()}
    assert got == {
        ("v", 12): (100.0, "exact"), ("v", 9): (125.0, "segment"), ("w", 12): (200.0, "exact"), ("w", 9): (250.0, "segment"),
        ("x", 12): (60.0, "global"), ("x", 9): (60.0, "global"),
    }
    row = S.segment_sums(context(spark, 1, 3), stop_times(spark, 1, 2, 3, 4), both).first()
    assert row["segment_sum_seconds"] == pytest.approx(150.0)


def test_the_best_round_is_looked_for_with_patience():
    assert B.best_round([5.0, 4.0, 3.0, 3.5, 2.0], 5) == 5
    assert B.best_round([5.0, 4.0, 3.0, 3.5, 3.4, 2.0], 2) == 3
    assert B.best_round([1.0], 3) == 1


def boosting_rows(n, seed=5, routes=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side, route = float(i % 2), rng.randrange(-1, routes)
        label = 100 * side + 30 * (route in (1, 3)) + (60.0 if rng.random() < 0.2 else 0.0) + rng.randrange(8)
        noise = [rng.uniform(0, 5) for _ in range(len(FEATURES) - 2)]
        rows.append((NOON + dt.timedelta(seconds=i), DAY, f"t{i}", 1, 2, route, None if i % 97 == 5 else float("nan") if i % 97 == 6 else label, side, *noise))
    return rows


def boosting_frame(spark, rows, parts=3):
    names = [n for n in FEATURES if n != "route_index"]
    schema = "anchor_arrived_at timestamp, start_date date, trip_id string, anchor_sequence int, target_sequence int, route_index int, label_seconds double, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{n} double" for n in names)).repartition(parts)


def test_rounds_are_searched_until_patience_ends(spark):
    assert (M.TreeSettings().rounds, M.TreeSettings().patience, M.TreeSettings().step) == (2000, 50, 0.05)
    # each round takes off a fifth of what is left of 50 seconds, down to a sixteenth of a second
    rows = [(*r[:5], 0, 100.0 * r[7], r[7], *[0.0] * (len(FEATURES) - 2)) for r in boosting_rows(400)]
    model, rounds = M.fit_trees(boosting_frame(spark, rows), 1, M.TreeSettings(step=0.2, depth=1, patience=3))
    assert 20 < rounds < 2000 and model.rounds == rounds


def brute_trees(rows, routes, settings, rounds, edges):
    """The same boosting in loops over rows: splits tried one by one, medians by sorting."""
    order = [FEATURES[0], *[n for n in FEATURES if n not in (FEATURES[0], "route_index")]]
    at = {n: 7 + i for i, n in enumerate(order)}
    values = [[float(r[5]) if n == "route_index" else r[at[n]] for n in FEATURES] for r in rows]
    bins = [[(int(v) + 1 if 0 <= v < routes else 0) if edges[j] is None else sum(e < v for e in edges[j]) for j, v in enumerate(x)] for x in values]
    widths = [routes + 1 if e is None else len(e) + 1 for e in edges]
    labels = [r[6] for r in rows]

    def median(residuals):
        s = sorted(math.floor(x * 16 + 0.5) for x in residuals)
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 32

    sums = [median(labels)] * len(rows)
    for _ in range(rounds):
        leaves = [list(range(len(rows)))]
        for _ in range(settings.depth):
            after = []
            for part in leaves:
                best, won = None, 0.0
                for j, width in enumerate(widths):
                    n, g = [0] * width, [0] * width
                    for i in part:
                        n[bins[i][j]] += 1
                        g[bins[i][j]] += (labels[i] > sums[i]) - (labels[i] < sums[i])
                    turn = sorted(range(width), key=lambda b: (g[b] / max(n[b], 1), b)) if edges[j] is None else range(width)
                    low = pull = 0
                    for k, b in enumerate(turn):
                        low, pull = low + n[b], pull + g[b]
                        if low >= settings.min_rows and len(part) - low >= settings.min_rows:
                            gain = round(pull**2 / low + (sum(g) - pull) ** 2 / (len(part) - low) - sum(g) ** 2 / len(part), 6)
                            if gain > won:
                                best, won = (j, set(list(turn)[: k + 1])), gain
                after.append([i for i in part if best is None or bins[i][best[0]] in best[1]])
                after.append([i for i in part if best is not None and bins[i][best[0]] not in best[1]])
            leaves = after
        add = [settings.step * median([labels[i] - sums[i] for i in part]) if part else 0.0 for part in leaves]
        for part, x in zip(leaves, add, strict=True):
            for i in part:
                sums[i] += x
    return sums


@pytest.mark.parametrize("seed", [1, 2])
def test_boosting_equals_loops_over_rows(spark, monkeypatch, seed):
    """The searched model against a fit from nothing with as many rounds, in one task and in many."""
    rows = boosting_rows(260, seed)
    settings = M.TreeSettings(rounds=12, step=0.3, depth=2, min_rows=9, patience=4)
    one, rounds = M.fit_trees(boosting_frame(spark, rows, 1), 4, settings)
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    many, again = M.fit_trees(boosting_frame(spark, rows, 7), 4, settings)
    usable = [r for r in rows if r[6] is not None and r[6] == r[6]]
    order = [FEATURES[0], *[n for n in FEATURES if n not in (FEATURES[0], "route_index")]]
    values = np.array([[float(r[5]) if n == "route_index" else r[7 + order.index(n)] for n in FEATURES] for r in usable])
    assert rounds == again >= 3
    assert one.predict(values).tolist() == many.predict(values).tolist()
    assert one.predict(values).tolist() == pytest.approx(brute_trees(usable, 4, settings, rounds, one.edges), abs=1e-9)


def test_a_small_table_grows_the_same_trees_when_its_file_is_read_in_parts(spark):
    """Parts without rows grew trees too: they ended the search after the first eight."""
    rows, settings = boosting_rows(260), M.TreeSettings(rounds=40, step=0.1, depth=2, min_rows=9, patience=9)
    model, rounds = M.fit_trees(boosting_frame(spark, rows, 1), 4, settings)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parted, again = M.fit_trees(boosting_frame(spark, rows, 1), 4, settings)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert again == rounds > B.UNWRITTEN
    assert [t.value.tolist() for t in parted.trees] == [t.value.tolist() for t in model.trees]


def test_a_search_over_a_small_table_is_one_pass(spark, monkeypatch):
    """A pass ended after eight trees, and what a pass costs was paid for every eight."""
    asked, grow = [], B._Series.grow
    monkeypatch.setattr(B._Series, "grow", lambda self, *of: asked.append(1) or grow(self, *of))
    _, rounds = M.fit_trees(boosting_frame(spark, boosting_rows(260), 1), 4, M.TreeSettings(rounds=40, step=0.1, depth=2, min_rows=9, patience=9))
    assert rounds > 8 and len(asked) == 1


def test_a_long_search_is_the_same_in_several_passes(spark, monkeypatch):
    rows, settings = boosting_rows(260), M.TreeSettings(rounds=40, step=0.1, depth=2, min_rows=9, patience=9)
    whole, rounds = M.fit_trees(boosting_frame(spark, rows, 1), 4, settings)
    monkeypatch.setattr(B, "GROWN", 4)
    parted, again = M.fit_trees(boosting_frame(spark, rows, 1), 4, settings)
    assert again == rounds > 8 and [t.value.tolist() for t in parted.trees] == [t.value.tolist() for t in whole.trees]


def test_passes_use_the_cores_there_are():
    assert [B.tasks_for(n, 12) for n in (0, 1000, 1 << 18, 325_243, 2_000_000, 12_000_000)] == [1, 1, 1, 5, 12, 46]


def test_boosting_without_late_rows_or_rows(spark):
    rows = boosting_rows(40)
    frame = boosting_frame(spark, rows).withColumn("late", F.lit(False))
    fit = lambda df: B.boost(df, list(FEATURES), "route_index", 4, "label_seconds", "late", 9, 0.1, 2, 5, 3)[0]
    assert fit(frame).rounds == 1 and fit(frame.withColumn("late", F.lit(True))).rounds == 1
    assert fit(frame.limit(0)).rounds == 0 and fit(frame.limit(0)).predict(np.zeros((2, len(FEATURES)))).tolist() == [0.0, 0.0]
    unseen = np.array([[0.0] * (len(FEATURES) - 1) + [x] for x in (-1.0, 99.0, float("nan"))])
    assert len(set(fit(frame).predict(unseen).tolist())) == 1


def context(spark, anchor, target, arrived=0, hour=12):
    return spark.createDataFrame(
        [(DAY, "t", "v", anchor, target, hour, False)],
        "start_date date, trip_id string, feed_version string, anchor_sequence int, target_sequence int, hour_bin int, is_weekend boolean",
    )


@pytest.mark.parametrize(("anchor", "target", "total", "coarse"), [(1, 2, 100.0, 0.0), (1, 3, 150.0, 0.5), (2, 4, 137.5, 1.0), (3, 3, 0.0, 1.0), (9, 12, 0.0, 1.0)])
def test_segment_sums(spark, anchor, target, total, coarse):
    row = S.segment_sums(context(spark, anchor, target), stop_times(spark, 1, 2, 3, 4), stats(spark)).first()
    assert row["segment_sum_seconds"] == pytest.approx(total) and row["coarse_segment_share"] == pytest.approx(coarse)


OBS = "route_id string, known_at timestamp, delay_seconds double"


def test_conditions_match_the_window_definition(spark):
    rng = random.Random(2)
    start = 1_790_880_000
    rows = [(f"r{rng.randrange(3)}", start + rng.choice([rng.randrange(0, 9000), 300 * rng.randrange(0, 30)]), float(rng.randrange(-300, 600))) for _ in range(150)]
    observed = spark.createDataFrame(rows, "route_id string, known bigint, delay_seconds double").withColumn("known_at", F.timestamp_seconds("known"))
    expected = {}
    for route in {r for r, _, _ in rows}:
        mine = [(k, d) for r, k, d in rows if r == route]
        for bucket in range(min(k for k, _ in mine) // 300, max(k for k, _ in mine) // 300 + 2):
            inside = [d for k, d in mine if bucket * 300 - 1800 < k <= bucket * 300]
            if inside:
                expected[route, bucket] = (pytest.approx(sum(inside) / len(inside)), len(inside))
    got = {(r["route_id"], r["bucket"]): (r["recent_delay_seconds"], r["recent_n"]) for r in C.build_conditions(observed).collect()}
    assert got == expected


def test_conditions_lookup_falls_back_once(spark):
    table = spark.createDataFrame([("r", 10, 60.0, 3)], "route_id string, bucket bigint, recent_delay_seconds double, recent_n bigint")
    ask = spark.createDataFrame([("r", 3000), ("r", 3300), ("r", 3600), ("q", 3000), (None, 3000)], "route_id string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["route_id"], r["s"]): (r["route_recent_delay_seconds"], r["route_recent_n"]) for r in C.lookup_conditions(ask, table, "at").collect()}
    assert got == {("r", 3000): (60.0, 3), ("r", 3300): (60.0, 3), ("r", 3600): (0.0, 0), ("q", 3000): (0.0, 0), (None, 3000): (0.0, 0)}


def test_an_observation_is_used_only_once_known(spark):
    late = spark.createDataFrame([("r", utc("2026-10-01 19:00:01"), 100.0)], OBS)
    first = min(r["bucket"] for r in C.build_conditions(late).collect())
    assert first * 300 > utc("2026-10-01 19:00:01").replace(tzinfo=dt.UTC).timestamp()


def test_persistence_carries_the_delay(spark):
    a, st = arrivals(spark, (1, 90, 0), (2, 700, 0)), stop_times(spark, 43200, 43500)
    ctx = X.evaluation_contexts(asked(spark, (2, 700, 5)), a, st)
    assert M.persist_delay(ctx).first()["predicted_arrival"] == NOON + dt.timedelta(seconds=390)


def test_windows_must_not_overlap():
    with pytest.raises(ValueError, match="2026-10-01 is not before 2026-10-01"):
        M.check_windows("2026-10-01", "2026-10-01")
    with pytest.raises(ValueError, match="fit through"):
        M.check_windows("2026-09-30", "2026-10-01", "2026-10-01")


def test_stats_guard(spark):
    M.check_stats(stats(spark), "2026-10-01")
    with pytest.raises(ValueError, match="fit through 2026-09-30"):
        M.check_stats(stats(spark), "2026-09-30")


def test_route_codes_come_from_training_only(spark):
    routes = FT.route_index(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "route_id string"))
    assert {tuple(r) for r in routes.collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("n", [1, 7, 100])
def test_time_split_is_exact(spark, n):
    rows = spark.range(n).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") % 13 * 40).alias("at"))
    split = FT.time_split(rows, "at", 0.8, ["k"]).collect()
    order = sorted(split, key=lambda r: (r["at"], r["k"]))
    assert len(order) == n and [r["is_late"] for r in order] == [i >= int(n * 0.8) for i in range(n)]


def test_exact_percentile_matches_a_sort(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.choice([rng.uniform(0, 50), float(rng.randrange(5))])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {r["k"]: r["p"] for r in exact_percentile(df, ["k"], "v", share, "p").collect()}
        for key in "hot", "a", "b", "c":
            values = sorted(v for k, v in rows if k == key)
            at = share * (len(values) - 1)
            lo = values[int(at)]
            hi = values[min(int(at) + 1, len(values) - 1)]
            assert got[key] == pytest.approx(lo + (at - int(at)) * (hi - lo))


def test_lag_over_slots_equals_a_plain_lag(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b"]), utc("2026-10-01 00:00:00") + dt.timedelta(seconds=rng.randrange(0, 90000))) for _ in range(400)]
    rows = sorted(set(rows))
    got = {(r["k"], r["at"]): r["prev"] for r in lag_within_feed(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at", "prev").collect()}
    for key in "ab":
        mine = [t for k, t in rows if k == key]
        assert [got[key, t] for t in mine] == [None, *mine[:-1]]


def test_trees_learn_and_record_what_they_used(spark):
    rng = random.Random(8)
    a_rows, st_rows, e_rows, t_rows = [], [], [], []
    for d in range(6):
        for t in range(12):
            trip, clock, slow = f"t{t}", t * 300, 1.0 + (t % 3) * 0.5
            for s in range(1, 13):
                clock += int(60 * slow + rng.randrange(0, 6))
                at = NOON + dt.timedelta(days=d - 6, seconds=clock)
                date = DAY - dt.timedelta(days=6 - d)
                a_rows.append((date, trip, s, "v", f"s{s}", at, 5))
                for h in (1, 5):
                    e_rows.append((date, trip, s, h, "mts", "v", f"s{s}", f"r{t % 3}", at, at + dt.timedelta(seconds=200), at, 200, 200, 5, 720, False, True))
        if d == 0:
            t_rows = [("v", f"t{t}", f"r{t % 3}") for t in range(12)]
            st_rows = [("v", f"t{t}", s, f"s{s}", 43200 + t * 300 + s * 60) for t in range(12) for s in range(1, 13)]
    agency = spark.createDataFrame(
        e_rows,
        "start_date date, trip_id string, stop_sequence int, horizon_minutes int, source string, feed_version string, stop_id string, route_id string, "
        "arrived_at timestamp, predicted_arrival timestamp, predicted_at timestamp, error_seconds int, abs_error_seconds int, ping_gap_seconds int, "
        "service_minute int, is_weekend boolean, has_all_horizons boolean",
    )
    run = M.run_models(
        spark.createDataFrame(a_rows, ARR),
        spark.createDataFrame(t_rows, "feed_version string, trip_id string, route_id string"),
        spark.createDataFrame(st_rows, "feed_version string, trip_id string, stop_sequence int, stop_id string, arrival_seconds int"),
        agency,
        ("2026-09-25", "2026-09-28"),
        ("2026-09-29", "2026-09-30"),
        M.TreeSettings(rounds=6, step=0.3, depth=3, min_rows=5),
    )
    mae = {(r["source"], r["horizon_minutes"]): r["m"] for r in run.scored.groupBy("source", "horizon_minutes").agg(F.avg("abs_error_seconds").alias("m")).collect()}
    assert mae["lgbm", 5] < mae["persist_delay", 5] and mae["lgbm", 5] < mae["mts", 5]
    early = run.scored.where("source = 'lgbm' and predicted_arrival < predicted_at")
    assert early.isEmpty(), "no tree prediction lies before its cutoff"
    row = run.registry.first()
    import json

    assert json.loads(row["features"]) == list(FEATURES) and json.loads(row["params"])["rounds_used"] >= 1
    assert set(json.loads(row["mae_by_horizon"])) == {"mts", "persist_delay", "segment_mean", "lgbm"}
    assert row["train_rows"] > 0 and row["test_rows"] > 0
    top = M.importance(run.model, spark).collect()
    assert len(top) == 12 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
