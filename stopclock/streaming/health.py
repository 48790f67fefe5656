"""Freshness of the feeds and outages, as queries over logged checks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.fixed import FAILURES_BEFORE_ALERT, NEVER_SUCCEEDED_AGE, RENOTIFY_SECONDS, STALE_AFTER_SECONDS

SUCCESS = ("ok", "skipped_unchanged")


def freshness(polls: DataFrame, as_of: Column, stale_after: int = STALE_AFTER_SECONDS) -> DataFrame:
    """Seconds since each feed's last success. The whole is stale only when every feed is."""
    last = F.max(F.when(F.col("status").isin(*SUCCESS), F.col("started_at")))
    ages = (
        polls.groupBy("feed")
        .agg(last.alias("last_success"))
        .withColumn(
            "age",
            F.coalesce(
                (F.unix_micros(as_of) - F.unix_micros("last_success")) / F.lit(1e6), F.lit(float(NEVER_SUCCEEDED_AGE))
            ),
        )
        .withColumn("stale", F.col("age") > stale_after)
    )
    everyone = F.bool_and("stale").over(Window.partitionBy())
    return ages.select("feed", F.round("age", 1).alias("seconds_since_success"), "stale", everyone.alias("all_stale"))


def checks_from_polls(polls: DataFrame) -> DataFrame:
    return polls.select("feed", F.col("started_at").alias("checked_at"), F.col("status").isin(*SUCCESS).alias("healthy"))


def _numbered(checks: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Each check with the number of healthy checks before it (its island) and its place in the bad run.

    Running counts per feed would put a feed in one task. They are taken per time slot and
    shifted by the totals of the earlier slots, one row each.
    """
    slotted = checks.withColumn("_slot", F.floor(F.unix_micros("checked_at") / F.lit(slot_seconds * 1_000_000)))
    inside = Window.partitionBy("feed", "_slot").orderBy("checked_at").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("feed").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        slotted.groupBy("feed", "_slot")
        .agg(F.count_if("healthy").alias("_h"), F.count_if(~F.col("healthy")).alias("_b"))
        .select(
            "feed",
            "_slot",
            F.coalesce(F.sum("_h").over(across), F.lit(0)).alias("_h0"),
            F.coalesce(F.sum("_b").over(across), F.lit(0)).alias("_b0"),
        )
    )
    counted = (
        slotted.withColumn("_hin", F.count_if("healthy").over(inside))
        .withColumn("_bin", F.count_if(~F.col("healthy")).over(inside))
        .join(before, ["feed", "_slot"])
        .select(
            "feed", "checked_at", "healthy", (F.col("_hin") + F.col("_h0")).alias("island"), (F.col("_bin") + F.col("_b0")).alias("_bad")
        )
    )
    firsts = counted.where(~F.col("healthy")).groupBy("feed", "island").agg(F.min("_bad").alias("_first"))
    return (
        counted.where(~F.col("healthy"))
        .join(firsts, ["feed", "island"])
        .select("feed", "island", "checked_at", (F.col("_bad") - F.col("_first") + 1).alias("nth"))
    )


def outages(checks: DataFrame, failures: int = FAILURES_BEFORE_ALERT) -> DataFrame:
    """Runs of bad checks long enough to alert: when the alert came and how long it stayed bad."""
    bad = _numbered(checks).where(F.col("nth") >= failures)
    return bad.groupBy("feed", "island").agg(
        F.count(F.lit(1)).alias("bad_checks"),
        F.min("checked_at").alias("alerted_at"),
        F.max("checked_at").alias("last_bad_check"),
    )


def notifications(checks: DataFrame, failures: int = FAILURES_BEFORE_ALERT, again_after: int = RENOTIFY_SECONDS) -> DataFrame:
    """Bad checks that notify: the one that starts the alert, then again each time the period
    since the last notification is over. What counts is the last one sent, so this is a fold
    over one outage, at whole seconds: Spark sorts, and one pass keeps the last one sent and nothing else."""
    bad = _numbered(checks).where(F.col("nth") >= failures)
    seconds = F.floor(F.unix_micros("checked_at") / F.lit(1_000_000)).cast("bigint")
    times = bad.select("feed", F.col("island").cast("bigint").alias("island"), seconds.alias("second")).distinct()
    ordered = times.repartition("feed", "island").sortWithinPartitions("feed", "island", "second")

    def due(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outage, sent = None, 0
        for batch in batches:
            take = []
            for feed, island, second in batch.itertuples(index=False):
                take.append((feed, island) != outage or second - sent >= again_after)
                if take[-1]:
                    outage, sent = (feed, island), second
            yield batch[take]

    out = ordered.mapInPandas(due, "feed string, island bigint, second bigint")
    return out.select("feed", "island", F.timestamp_seconds("second").alias("notified_at"))
