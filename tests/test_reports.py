import pytest
from pyspark.sql import functions as F

from stopclock.operators import accuracy as A
from stopclock.operators import quality as Q
from stopclock.operators.vehicles import headings
from stopclock.plans import published as P
from stopclock.plans import reports as R
from stopclock.streaming import health
from tests.conftest import day, utc

SCORED = (
    "start_date date, trip_id string, stop_sequence int, horizon_minutes int, source string, feed_version string, stop_id string, route_id string, "
    "arrived_at timestamp, predicted_arrival timestamp, predicted_at timestamp, error_seconds int, abs_error_seconds int, ping_gap_seconds int, "
    "service_minute int, is_weekend boolean, has_all_horizons boolean"
)


def row(trip="t", h=10, source="mts", error=120, minute=720, gap=30, whole=True, route="r", on="2026-10-01"):
    at = utc(f"{on} 19:00:00")
    return (day(on), trip, 1, h, source, "v", "stop", route, at, at, utc(f"{on} 18:30:00"), error, abs(error), gap, minute, False, whole)


def scored(spark, *rows):
    return spark.createDataFrame(list(rows), SCORED)


def seed():
    return [row(h=h, source=s, error=e) for h in (1, 5, 10, 20) for s, e in (("mts", 120), ("lgbm", 60))]


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "trained_at timestamp, train_from date, train_to date, test_from date, test_to date, features string, train_rows bigint, test_rows bigint, notes string")


def test_unmatched_rows_do_not_count(spark):
    lonely = row(trip="only-mts", error=9999)
    got = {(r["source"], r["horizon_minutes"]): r for r in P.headline(scored(spark, *seed(), lonely)).collect()}
    assert len(got) == 8 and {r["n"] for r in got.values()} == {1}
    assert got["mts", 10]["mae_seconds"] == 120 and got["lgbm", 10]["bias_seconds"] == 60


def test_one_source_alone_is_matched_with_itself(spark):
    only = [r for r in seed() if r[4] == "mts"]
    assert P.headline(scored(spark, *only)).count() == 4


def test_the_population_is_matched_before_the_band(spark):
    # Only the agency is present at noon; matching inside the band would count its row.
    rows = [*seed(), row(trip="u", minute=1200), row(trip="u", minute=1200, source="lgbm"), row(trip="w", minute=400)]
    assert P.headline(scored(spark, *rows), time_band="am_rush").isEmpty()
    per_band = sum(r["n"] for b in ("am_rush", "midday", "pm_rush", "evening", "late") for r in P.headline(scored(spark, *rows), time_band=b).collect())
    assert per_band == sum(r["n"] for r in P.headline(scored(spark, *rows)).collect()) == 10


def test_unknown_arguments_fail_before_any_plan(spark):
    with pytest.raises(ValueError, match="noonish"):
        P.headline(None, time_band="noonish")
    with pytest.raises(ValueError, match="crystal_ball"):
        P.routes(None, None, compare="crystal_ball")
    with pytest.raises(ValueError, match="sideways"):
        P.order_routes(None, "sideways")


def test_wide_gaps_and_null_gaps_are_out(spark):
    rows = [row(), row(trip="wide", gap=181), row(trip="null", gap=None)]
    assert P.headline(scored(spark, *rows)).first()["n"] == 1
    assert P.headline(scored(spark, *rows), max_ping_gap=600).first()["n"] == 2


def test_window_is_the_newest_run_else_everything(spark):
    table = scored(spark, row(), row(trip="u", on="2026-10-05"))
    one = (utc("2026-10-06 00:00:00"), day("2026-09-01"), day("2026-09-30"), day("2026-10-05"), day("2026-10-06"), '["a"]', 1, 2, "x")
    old = (utc("2026-10-01 00:00:00"), *one[1:3], day("2026-10-01"), day("2026-10-01"), *one[5:])
    both = runs(spark, one, old)
    assert P.headline(table, both).first()["n"] == 1
    window = P.resolve_window(table, both).first()
    assert (window["test_from"], window["source_of_window"]) == (day("2026-10-05"), "latest model run")
    none = runs(spark)
    assert P.headline(table, none).first()["n"] == 2
    assert P.resolve_window(table, none).first()["source_of_window"] == "all scored data, no model run found"
    assert P.resolve_window(table.where("false"), none).first()["source_of_window"] == "no data"
    assert P.model_run(both).first()["features"] == ["a"] and P.model_run(none).isEmpty()


def test_overflow_bucket_is_one_row(spark):
    rows = [row(trip=str(i), error=e) for i, e in enumerate((0, 59, 60, 599, 600, 5000))]
    got = {r["upper_bound_seconds"]: r["n"] for r in P.error_distribution(scored(spark, *rows)).collect()}
    assert got == {60: 2, 120: 1, 600: 3}


def test_route_table(spark):
    rows = [row(trip=str(i), route=r, source=s, error=e) for r, n in (("a", 3), ("b", 2)) for i in range(n) for s, e in (("mts", 100), ("lgbm", 70))]
    names = spark.createDataFrame([("v", "a", "Alpha")], "feed_version string, route_id string, route_long_name string")
    rows = [(*x[:1], f"{x[7]}{x[1]}", *x[2:]) for x in rows]
    got = P.routes(scored(spark, *rows), names, min_n=3).collect()
    assert [(r["route_id"], r["route_name"], r["n"], r["improvement_seconds"]) for r in got] == [("a", "Alpha", 3, 30.0)]
    every = P.order_routes(P.routes(scored(spark, *rows), names, min_n=1), "n").collect()
    assert [r["route_id"] for r in every] == ["a", "b"] and every[1]["route_name"] is None


def test_best_source_breaks_ties_in_order(spark):
    summary = spark.createDataFrame([("lgbm", 5, 60.0), ("mts", 5, 60.0), ("mts", 10, 70.0), ("lgbm", 10, 69.0)], "source string, horizon_minutes int, mae_seconds double")
    got = {r["horizon_minutes"]: r["best_source"] for r in A.best_source(summary, ("mts", "lgbm")).collect()}
    assert got == {5: "mts", 10: "lgbm"}


def test_improvement_skips_horizons_missing_a_side(spark):
    summary = spark.createDataFrame([("mts", 5, 60.0, 4), ("lgbm", 5, 50.0, 4), ("mts", 20, 1.0, 1)], "source string, horizon_minutes int, mae_seconds double, n bigint")
    assert [tuple(r) for r in A.improvement(summary, "mts", "lgbm").collect()] == [(5, 10.0, 4)]


def polls(spark, *rows):
    return spark.createDataFrame([(f, utc(t), s, 10, 1) for f, t, s in rows], "feed string, started_at timestamp, status string, duration_ms bigint, rows_written bigint")


def test_a_day_with_one_poll_has_no_coverage(spark):
    table = polls(spark, ("vehicle_positions", "2026-10-01 10:00:00", "ok"), ("vehicle_positions", "2026-10-02 10:00:00", "ok"), ("vehicle_positions", "2026-10-02 10:01:40", "ok"))
    got = {r["day"]: r for r in P.collection_coverage(table).collect()}
    assert got[day("2026-10-01")]["coverage_pct"] is None
    assert got[day("2026-10-02")]["hours_lost"] == pytest.approx(24.0), "the gap counts on its later poll's day"
    worst = P.worst_lost_share(P.collection_coverage(table).where("day = '2026-10-01'")).first()[0]
    assert worst == 0.0


def test_gaps_are_between_successes_and_skips_count(spark):
    table = polls(
        spark, ("a", "2026-10-01 10:00:00", "ok"), ("a", "2026-10-01 10:01:30", "skipped_unchanged"), ("a", "2026-10-01 10:02:30", "http_error"), ("a", "2026-10-01 10:04:00", "ok")
    )
    as_of = F.to_timestamp(F.lit("2026-10-01 12:00:00"))
    assert [(r["gap_seconds"], r["previous_success"]) for r in R.longest_gaps(table, as_of).collect()] == [(150.0, utc("2026-10-01 10:01:30"))]
    assert R.longest_gaps(table, as_of, hours=1).isEmpty()


def test_freshness_is_stale_only_when_all_are(spark):
    table = polls(spark, ("a", "2026-10-01 10:00:00", "ok"), ("b", "2026-10-01 10:00:00", "http_error"))
    got = {r["feed"]: r for r in health.freshness(table, F.to_timestamp(F.lit("2026-10-01 10:05:00"))).collect()}
    assert not got["a"]["stale"] and got["b"]["stale"] and got["b"]["seconds_since_success"] == 999999 and not got["a"]["all_stale"]


def test_alerts_need_two_bad_checks_and_repeat_hourly(spark):
    times = ["00", "10", "20", "30", "40", "50"]
    rows = [("f", f"2026-10-01 10:{m}:00", "http_error") for m in times] + [("f", f"2026-10-01 11:{m}:00", "http_error") for m in times]
    rows += [("f", "2026-10-01 12:00:00", "ok"), ("f", "2026-10-01 12:10:00", "http_error"), ("f", "2026-10-01 12:20:00", "ok")]
    checks = health.checks_from_polls(polls(spark, *rows))
    got = health.outages(checks).collect()
    assert [(r["alerted_at"], r["bad_checks"]) for r in got] == [(utc("2026-10-01 10:10:00"), 11)]
    sent = sorted(r["notified_at"] for r in health.notifications(checks).collect())
    assert sent == [utc("2026-10-01 10:10:00"), utc("2026-10-01 11:10:00")]


def test_upcoming_uses_the_latest_revision_and_the_best_bias(spark):
    when = lambda t: utc(f"2026-10-01 {t}")
    preds = spark.createDataFrame(
        [(day("2026-10-01"), "stop", "t", 1, None, when("20:00:00"), when("18:00:00")), (day("2026-10-01"), "stop", "t", 1, None, when("18:30:00"), when("18:10:00")), (day("2026-10-01"), "stop", "u", 1, "r", when("19:30:00"), when("18:10:00"))],
        "start_date date, stop_id string, trip_id string, stop_sequence int, route_id string, arrival_time timestamp, observed_at timestamp",
    )
    trips = spark.createDataFrame([("v", "u", "r", "North")], "feed_version string, trip_id string, route_id string, trip_headsign string")
    table = spark.createDataFrame([("v1", "r", "7", 3), ("v2", "r", "7X", 3)], "feed_version string, route_id string, route_short_name string, route_type int")
    history = scored(spark, *[row(trip=str(i), error=-60) for i in range(12)])
    got = P.stop_upcoming(preds, trips, table, history, "stop", F.lit(when("19:00:00"))).collect()
    assert len(got) == 1, "a service whose latest revision is past does not come back through an older one"
    only = got[0]
    assert (only["trip_id"], only["route_short_name"], only["headsign"]) == ("u", "7", "North")
    assert only["corrected_arrival"] == when("19:31:00") and only["correction_basis"] == "stop_and_route" and only["correction_sample"] == 12
    weak = P.stop_upcoming(preds, trips, table, history, "stop", F.lit(when("19:00:00")), min_sample=13).first()
    assert weak["correction_basis"] == "none" and weak["corrected_arrival"] is None


def test_upcoming_keeps_runs_of_one_trip_on_two_days_apart(spark):
    when = lambda d, t: utc(f"2026-10-0{d} {t}")
    preds = spark.createDataFrame(
        [(day("2026-10-01"), "stop", "t", 1, "r", when(1, "18:30:00"), when(1, "18:20:00")), (day("2026-10-02"), "stop", "t", 1, "r", when(2, "18:30:00"), when(1, "18:10:00"))],
        "start_date date, stop_id string, trip_id string, stop_sequence int, route_id string, arrival_time timestamp, observed_at timestamp",
    )
    trips = spark.createDataFrame([("v", "t", "r", "North")], "feed_version string, trip_id string, route_id string, trip_headsign string")
    table = spark.createDataFrame([("v", "r", "7", 3)], "feed_version string, route_id string, route_short_name string, route_type int")
    got = P.stop_upcoming(preds, trips, table, scored(spark, row(error=1)), "stop", F.lit(when(1, "19:00:00"))).collect()
    assert [r["mts_arrival"] for r in got] == [when(2, "18:30:00")]


def test_filters_by_time_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "predictions")
    preds = spark.createDataFrame(
        [(day(f"2026-10-0{d}"), "stop", "t", 1, "r", utc(f"2026-10-0{d} 18:30:00"), utc(f"2026-10-0{d} 18:00:00")) for d in range(1, 9)],
        "start_date date, stop_id string, trip_id string, stop_sequence int, route_id string, arrival_time timestamp, observed_at timestamp",
    )
    preds.write.partitionBy("start_date").parquet(path)
    trips = spark.createDataFrame([("v", "t", "r", "North")], "feed_version string, trip_id string, route_id string, trip_headsign string")
    table = spark.createDataFrame([("v", "r", "7", 3)], "feed_version string, route_id string, route_short_name string, route_type int")
    upcoming = P.upcoming(spark.read.parquet(path), trips, table, scored(spark, row(error=1)), F.to_timestamp(F.lit("2026-10-08 12:00:00")))
    plan = upcoming._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_date" in plan and "start_date" in plan.split("PartitionFilters")[1][:200]
    polls = spark.createDataFrame([("f", "ok", utc("2026-10-08 11:00:00"), 5, 1)], "feed string, status string, started_at timestamp, duration_ms int, rows_written int")
    stored = str(tmp_path / "polls")
    polls.write.parquet(stored)
    plan = R.polls_by_status(spark.read.parquet(stored), F.to_timestamp(F.lit("2026-10-08 12:00:00")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(started_at" in plan


def test_stop_detail_pivots_sources(spark):
    st = spark.createDataFrame([("v", "t", 1, 43000)], "feed_version string, trip_id string, stop_sequence int, arrival_seconds int")
    got = P.stop_detail(scored(spark, *seed()), st, "stop").first()
    assert (got["mts_error_seconds"], got["model_error_seconds"]) == (120, 60)
    assert got["scheduled_at"] == utc("2026-10-01 18:56:40")


def test_shape_of_a_route(spark):
    trips = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", None)], "route_id string, shape_id string")
    shapes = spark.createDataFrame([("a", 2, 2.0, 0.0), ("a", 1, 1.0, 0.0), ("b", 1, 9.0, 0.0)], "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    assert [r["lat"] for r in P.route_shape(trips, shapes, "r").collect()] == [1.0, 2.0]
    with pytest.raises(LookupError, match="no shape for route q"):
        P.route_shape(trips, shapes, "q")


def test_heading_is_kept_while_standing(spark):
    rows = [(day("2026-10-01"), "b", utc(f"2026-10-01 10:0{i}:00"), lat, lon) for i, (lat, lon) in enumerate([(32.70, -117.1), (32.71, -117.1), (32.71005, -117.1), (32.71005, -117.0)])]
    df = spark.createDataFrame(rows, "start_date date, vehicle_id string, ts timestamp, lat double, lon double")
    got = [round(r["heading_degrees"]) % 360 for r in headings(df).orderBy("ts").collect()]
    assert got == [0, 0, 0, 90]


def test_report_sections(spark):
    table = scored(spark, *seed())
    base = R.baseline_report(table)
    assert set(base) == {"headline", "all_pairs", "label_noise", "worst_routes", "best_routes", "by_time_of_day", "day_type"}
    assert base["headline"].first()["horizon"] == "1 min" and base["by_time_of_day"].first()["service_hours"] == "12:00-15:00"
    assert base["worst_routes"].isEmpty(), "a route needs 200 rows"
    compare = R.compare_report(table, runs(spark))
    assert compare["head_to_head"].isEmpty(), "the comparison asks for all four sources"
    assert {r["lgbm_coverage_pct"] for r in compare["coverage"].collect()} == {100.0}


def test_quality_rules_find_what_is_broken(spark):
    bad = scored(spark, row(), (*row()[:11], 120, 90, *row()[13:]), row(h=7), row(source="guess"))
    got = Q.violations(bad, Q.scored_rules()).first()
    assert (got["abs_matches"], got["horizon_known"], got["source_known"], got["prediction_precedes_cutoff"]) == (1, 1, 1, 0)
    assert tuple(Q.duplicate_keys(bad, ["start_date", "trip_id", "stop_sequence", "horizon_minutes", "source"]).first()) == (1, 1)


def test_keys_are_dealt_out_before_they_are_counted(spark, monkeypatch, capsys):
    monkeypatch.setattr(Q, "COUNTED_ROWS", 10)
    rows = spark.createDataFrame([(i % 25, None if i % 25 == 3 else "a") for i in range(30)], "k int, s string")
    found = Q.duplicate_keys(rows, ["k", "s"])
    assert tuple(found.first()) == (5, 5)
    found.explain()
    plan = capsys.readouterr().out
    assert "4), REPARTITION_BY_NUM" in plan
    assert "HashAggregate(keys=[k" not in plan[plan.index("REPARTITION_BY_NUM") :]


def test_upcoming_combines_revisions_without_sorting_them(spark):
    """Revisions by two routes and by none are one call; trips are not reduced for services that are not shown."""
    when = lambda t: utc(f"2026-10-01 {t}")
    said = [("t", "r", "20:00:00", "18:00:00"), ("t", None, "20:05:00", "18:10:00"), ("t", "q", "20:02:00", "18:05:00"), (None, "r", "20:10:00", "18:00:00")]
    preds = spark.createDataFrame(
        [(day("2026-10-01"), "stop", t, 1, r, when(a), when(o)) for t, r, a, o in said],
        "start_date date, stop_id string, trip_id string, stop_sequence int, route_id string, arrival_time timestamp, observed_at timestamp",
    )
    trips = spark.createDataFrame(
        [("v2", "t", "r2", "South"), ("v1", "t", "r", "North"), ("v1", "t", "r", "North"), ("v1", "w", "r", "West")],
        "feed_version string, trip_id string, route_id string, trip_headsign string",
    )
    names = spark.createDataFrame([("v", "r", "7", 3)], "feed_version string, route_id string, route_short_name string, route_type int")
    got = P.upcoming(preds, trips, names, scored(spark, row(error=1)), F.lit(when("19:00:00")))
    shown = [(r["position"], r["trip_id"], r["route_id"], r["headsign"], r["mts_arrival"], r["predicted_at"]) for r in got.orderBy("position").collect()]
    assert shown == [(1, "t", "r", "North", when("20:05:00"), when("18:10:00")), (2, None, "r", None, when("20:10:00"), when("18:00:00"))]
    assert "max_by(arrival_time" in got._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in reversed(got._jdf.queryExecution().sparkPlan().toString().splitlines()) if "partial_max_by(arrival_time" in line)
    assert "HashAggregate" in first
