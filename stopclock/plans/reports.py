"""The text reports, as named sections. Every `now` is an explicit `as_of`."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.fixed import AGENCY, GAP_SECONDS, SOURCES, TIGHT_LABEL_SECONDS, TREES
from stopclock.functions.labels import (
    day_type,
    horizon_label,
    in_minutes,
    label_quality,
    schedule_status,
    three_hour_block,
    three_hour_label,
)
from stopclock.functions.ordering import lag_within_feed
from stopclock.functions.quantiles import count_values, counted_percentile
from stopclock.operators.accuracy import coverage_by_source, label_filter, matched, summarise, weighted_mean
from stopclock.operators.quality import backward_arrivals


def _rows() -> Column:
    return F.count(F.lit(1))


def _size() -> Column:
    return F.col("abs_error_seconds")


def _tight(scored: DataFrame, horizon: int = 10) -> DataFrame:
    return label_filter(scored, TIGHT_LABEL_SECONDS, comparable=False).where(F.col("horizon_minutes") == horizon)


# --- baseline ---


def headline_minutes(scored: DataFrame, keys: tuple[str, ...] = ("horizon_minutes",)) -> DataFrame:
    summary = summarise(label_filter(scored, TIGHT_LABEL_SECONDS), list(keys))
    return summary.orderBy(*keys).select(
        *[k for k in keys if k != "horizon_minutes"],
        horizon_label("horizon_minutes").alias("horizon"),
        "n",
        in_minutes("mae_seconds").alias("mae_min"),
        in_minutes("median_seconds").alias("median_min"),
        in_minutes("p90_seconds").alias("p90_min"),
        in_minutes("bias_seconds").alias("bias_min"),
    )


def all_pairs(scored: DataFrame) -> DataFrame:
    return (
        summarise(scored, ["horizon_minutes"])
        .orderBy("horizon_minutes")
        .select(
            horizon_label("horizon_minutes").alias("horizon"),
            "n",
            in_minutes("mae_seconds").alias("mae_min"),
            in_minutes("p90_seconds").alias("p90_min"),
        )
    )


def label_noise(scored: DataFrame) -> DataFrame:
    tight, poor = F.col("ping_gap_seconds") <= TIGHT_LABEL_SECONDS, F.col("ping_gap_seconds") > 600
    return (
        label_filter(scored, None)
        .groupBy("horizon_minutes")
        .agg(
            F.avg(F.when(tight, _size())).alias("a"),
            F.avg(F.when(poor, _size())).alias("b"),
            F.count_if(tight).alias("n_tight"),
            F.count_if(poor).alias("n_poor"),
        )
        .orderBy("horizon_minutes")
        .select(
            horizon_label("horizon_minutes").alias("horizon"),
            in_minutes("a").alias("mae_tight_labels"),
            in_minutes("b").alias("mae_poor_labels"),
            "n_tight",
            "n_poor",
        )
    )


def ranked_routes(scored: DataFrame, worst: bool, min_n: int = 200, limit: int = 8) -> DataFrame:
    by_route = (
        _tight(scored)
        .groupBy("route_id")
        .agg(_rows().alias("n"), F.avg(_size()).alias("mae"), F.avg("error_seconds").alias("bias"))
        .where(F.col("n") >= min_n)
    )
    order = F.desc("mae") if worst else F.asc("mae")
    return by_route.orderBy(order, "route_id").limit(limit).select(
        "route_id", "n", in_minutes("mae").alias("mae_min"), in_minutes("bias").alias("bias_min")
    )


def by_three_hours(scored: DataFrame) -> DataFrame:
    return (
        _tight(scored)
        .groupBy(three_hour_block("service_minute").alias("block"))
        .agg(_rows().alias("n"), F.avg(_size()).alias("mae"))
        .orderBy("block")
        .select(three_hour_label("block").alias("service_hours"), "n", in_minutes("mae").alias("mae_min"))
    )


def by_day_type(scored: DataFrame) -> DataFrame:
    return (
        _tight(scored)
        .groupBy("is_weekend")
        .agg(_rows().alias("n"), F.avg(_size()).alias("mae"))
        .select(day_type("is_weekend").alias("day_type"), "n", in_minutes("mae").alias("mae_min"))
    )


def baseline_report(scored: DataFrame) -> dict[str, DataFrame]:
    return {
        "headline": headline_minutes(scored),
        "all_pairs": all_pairs(scored),
        "label_noise": label_noise(scored),
        "worst_routes": ranked_routes(scored, worst=True),
        "best_routes": ranked_routes(scored, worst=False),
        "by_time_of_day": by_three_hours(scored),
        "day_type": by_day_type(scored),
    }


# --- comparison; `scored` is already limited to the test window ---


def head_to_head(scored: DataFrame) -> DataFrame:
    """MAE per source as columns, on rows all the known sources predicted."""
    rows = matched(label_filter(scored, TIGHT_LABEL_SECONDS), required=len(SOURCES))
    of = [in_minutes(F.avg(F.when(F.col("source") == s, _size()))).alias(s) for s in SOURCES]
    return (
        rows.groupBy("horizon_minutes")
        .agg(*of, F.count_if(F.col("source") == AGENCY).alias("n"))
        .orderBy("horizon_minutes")
        .withColumn("horizon", horizon_label("horizon_minutes"))
        .drop("horizon_minutes")
    )


def source_coverage(scored: DataFrame) -> DataFrame:
    return (
        coverage_by_source(label_filter(scored, TIGHT_LABEL_SECONDS), AGENCY, TREES)
        .orderBy("horizon_minutes")
        .withColumn("horizon", horizon_label("horizon_minutes"))
        .drop("horizon_minutes")
    )


def p90_by_source(scored: DataFrame) -> DataFrame:
    counted = count_values(label_filter(scored, TIGHT_LABEL_SECONDS), ["horizon_minutes", "source"], "abs_error_seconds")
    of = [in_minutes(counted_percentile(F.when(F.col("source") == s, _size()), 0.9)).alias(s) for s in SOURCES]
    return (
        counted.groupBy("horizon_minutes")
        .agg(*of)
        .orderBy("horizon_minutes")
        .withColumn("horizon", horizon_label("horizon_minutes"))
        .drop("horizon_minutes")
    )


def bias_by_source(scored: DataFrame) -> DataFrame:
    return (
        label_filter(scored, TIGHT_LABEL_SECONDS)
        .groupBy("source")
        .agg(F.avg("error_seconds").alias("bias"), F.avg(_size()).alias("mae"), _rows().alias("n"))
        .orderBy("mae", "source")
        .select("source", in_minutes("bias").alias("bias_min"), in_minutes("mae").alias("mae_min"), "n")
    )


def route_gains(scored: DataFrame, horizon: int = 10, min_n: int = 150, limit: int = 6) -> DataFrame:
    """Routes by how much the trees beat the agency, matched rows only."""
    rows = label_filter(scored, TIGHT_LABEL_SECONDS).where(F.col("horizon_minutes") == horizon)
    agency, trees = F.col("source") == AGENCY, F.col("source") == TREES
    return (
        matched(rows, required=len(SOURCES))
        .groupBy("route_id")
        .agg(F.count_if(agency).alias("n"), F.avg(F.when(agency, _size())).alias("a"), F.avg(F.when(trees, _size())).alias("b"))
        .where(F.col("n") >= min_n)
        .withColumn("gain", F.col("a") - F.col("b"))
        .orderBy(F.desc("gain"), "route_id")
        .limit(limit)
        .select(
            "route_id",
            "n",
            in_minutes("a").alias("mts_min"),
            in_minutes("b").alias("lgbm_min"),
            in_minutes("gain").alias("improvement_min"),
        )
    )


def run_provenance(runs: DataFrame) -> DataFrame:
    keep = ["trained_at", "train_from", "train_to", "test_from", "test_to", "train_rows", "test_rows", "notes"]
    newest = runs.agg(F.max_by(F.struct(*keep), "trained_at").alias("run")).where(F.col("run").isNotNull())
    return newest.select("run.*").withColumn("trained_at", F.date_trunc("second", "trained_at"))


def compare_report(scored: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    return {
        "head_to_head": head_to_head(scored),
        "coverage": source_coverage(scored),
        "p90": p90_by_source(scored),
        "bias": bias_by_source(scored),
        "route_gains": route_gains(scored),
        "provenance": run_provenance(runs),
    }


# --- collection ---


def _since(df: DataFrame, column: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last `hours`. The bare column is compared, so the bound reaches the scan, and so does the day."""
    edge = as_of - F.make_dt_interval(hours=F.lit(hours))
    recent = df.where(F.col(column) > edge)
    return recent.where(F.col("started_on") >= F.to_date(edge)) if "started_on" in df.columns and column == "started_at" else recent


def polls_by_status(polls: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return (
        _since(polls, "started_at", as_of, hours)
        .groupBy("feed", "status")
        .agg(
            _rows().alias("polls"),
            F.round(F.avg("duration_ms")).alias("avg_ms"),
            F.max("duration_ms").alias("worst_ms"),
            F.sum(F.coalesce("rows_written", F.lit(0))).alias("rows_written"),
        )
        .orderBy("feed", F.desc("polls"), "status")
    )


def success_gaps(polls: DataFrame, as_of: Column, hours: int = 24, limit_seconds: int = GAP_SECONDS) -> DataFrame:
    """Gaps between successful polls of a feed. A skip is a success: it polled and nothing was new."""
    good = _since(polls, "started_at", as_of, hours).where(F.col("status").isin("ok", "skipped_unchanged"))
    gap = (F.unix_micros("started_at") - F.unix_micros("previous_success")) / F.lit(1e6)
    return (
        lag_within_feed(good.select("feed", "started_at"), ["feed"], "started_at", "previous_success")
        .withColumn("gap", gap)
        .where(F.col("gap") > limit_seconds)
        .select("feed", "previous_success", F.col("started_at").alias("recovered_at"), "gap")
    )


def longest_gaps(polls: DataFrame, as_of: Column, hours: int = 24, limit: int = 20) -> DataFrame:
    return (
        success_gaps(polls, as_of, hours)
        .orderBy(F.desc("gap"), "feed", "recovered_at")
        .limit(limit)
        .withColumn("gap_seconds", F.round("gap"))
        .drop("gap")
    )


def compression(
    polls: DataFrame, predictions: DataFrame, positions: DataFrame, as_of: Column, hours: int = 24, feed: str = "trip_updates",
    ingested: str = "ingested_at",
) -> DataFrame:
    """Successful polls beside rows written: shows that change-only storage works. One row."""
    good = _since(polls, "started_at", as_of, hours).where((F.col("feed") == feed) & (F.col("status") == "ok"))
    return polls.sparkSession.range(1).select(
        good.agg(_rows()).scalar().alias("successful_polls"),
        _since(predictions, ingested, as_of, hours).agg(_rows()).scalar().alias("predictions_written"),
        _since(positions, ingested, as_of, hours).agg(_rows()).scalar().alias("positions_written"),
    )


def latest_polls(polls: DataFrame) -> DataFrame:
    return (
        polls.groupBy("feed")
        .agg(
            F.max("started_at").alias("last_attempt"),
            F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_success"),
        )
        .orderBy("feed")
    )


def coverage_report(polls, predictions, positions, as_of: Column, hours: int = 24) -> dict[str, DataFrame]:
    return {
        "polls": polls_by_status(polls, as_of, hours),
        "gaps": longest_gaps(polls, as_of, hours),
        "compression": compression(polls, predictions, positions, as_of, hours),
        "latest": latest_polls(polls),
    }


# --- arrivals ---


def arrivals_by_day(arrivals: DataFrame) -> DataFrame:
    """Per service day. Trips are counted from one row per trip, so a large day stays distributed."""
    method = F.col("method")
    per_trip = arrivals.groupBy("start_date", "trip_id").agg(
        _rows().alias("n"), *[F.count_if(method == m).alias(m) for m in ("dwell", "interpolated", "at_ping")]
    )
    return (
        per_trip.groupBy("start_date")
        .agg(F.sum("n").alias("arrivals"), _rows().alias("trips"), *[F.sum(m).alias(m) for m in ("dwell", "interpolated", "at_ping")])
        .orderBy(F.desc("start_date"))
    )


def label_shares(arrivals: DataFrame) -> DataFrame:
    counts = arrivals.groupBy(label_quality("ping_gap_seconds").alias("label_quality")).agg(_rows().alias("arrivals"))
    total = counts.agg(F.sum("arrivals")).scalar()
    return counts.withColumn("pct", F.round(100.0 * F.col("arrivals") / total, 1)).orderBy(F.desc("arrivals"), "label_quality")


def inference_outcomes(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("status")
        .agg(_rows().alias("trips"), F.sum("arrivals_written").alias("arrivals"), F.sum("stops_skipped").alias("stops_skipped"))
        .orderBy(F.desc("trips"), "status")
    )


def arrivals_report(arrivals: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    return {
        "by_day": arrivals_by_day(arrivals),
        "label_quality": label_shares(arrivals),
        "monotonicity": backward_arrivals(arrivals),
        "inference": inference_outcomes(log),
    }


# --- schedule ---


def size_text(size: Column | str) -> Column:
    """Bytes as text: the first unit in which the rounded number stays under 10240."""
    value = (F.col(size) if isinstance(size, str) else size).cast("double")
    text = F.when(value < 10240, F.concat(value.cast("bigint").cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), start=1):
        amount = F.round(value / 1024**power)
        shown = F.concat(amount.cast("bigint").cast("string"), F.lit(f" {unit}"))
        text = text.when((amount < 10240) | F.lit(unit == "TB"), shown)
    return text


def loaded_versions(versions: DataFrame) -> DataFrame:
    count = lambda table: F.get_json_object("row_counts", f"$.{table}").cast("int").alias(table)
    return (
        versions.where(F.col("loaded_at").isNotNull())
        .orderBy(F.desc("loaded_at"), "feed_version")
        .select(
            F.substring("feed_version", 1, 12).alias("version"),
            F.date_trunc("second", "loaded_at").alias("loaded_at"),
            "feed_start_date",
            "feed_end_date",
            size_text("content_length").alias("download_size"),
            count("stop_times"),
            count("trips"),
            count("service_dates"),
        )
    )


def load_attempts(log: DataFrame, limit: int = 15) -> DataFrame:
    return (
        log.orderBy(F.desc("started_at"), "status")
        .limit(limit)
        .select(
            F.date_trunc("second", "started_at").alias("started_at"),
            "status",
            "http_code",
            F.substring(F.coalesce("feed_version", F.lit("")), 1, 12).alias("version"),
            F.round(F.col("duration_ms") / 1000, 1).alias("seconds"),
            F.substring(F.coalesce("error", F.lit("")), 1, 60).alias("error"),
        )
    )


def schedule_currency(versions: DataFrame, as_of: Column) -> DataFrame:
    loaded = versions.where(F.col("loaded_at").isNotNull())
    return loaded.agg(F.max("feed_end_date").alias("valid_until"), F.max("loaded_at").alias("last")).select(
        schedule_status("valid_until", as_of).alias("schedule_status"),
        "valid_until",
        F.date_trunc("second", "last").alias("last_loaded"),
    )


def schedule_report(versions: DataFrame, log: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {
        "versions": loaded_versions(versions),
        "attempts": load_attempts(log),
        "currency": schedule_currency(versions, as_of),
    }
