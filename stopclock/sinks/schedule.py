"""Versioned loading of a static schedule.

Every table is written under its feed version and a load of its own first, the registry row last. Readers join the registry,
which names the load that counts: a version is either wholly there or not there, and a version that is loaded again is
the old one until the moment it is the new one. A crash leaves a load that nothing names.
"""

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopclock.fixed import OPTIONAL_FILES, REQUIRED_FILES
from stopclock.operators.alignment import scheduled_stops
from stopclock.operators.calendar import expand_service_dates
from stopclock.schemas import FEED_VERSIONS, LOAD_LOG
from stopclock.sinks.tables import append_log, log_row
from stopclock.sources.files import delete, exists, folders, stored
from stopclock.sources.gtfs_text import TABLES, check_files, feed_info, read_table

STATIC = (*TABLES, "service_dates", "trip_stops")
#: The registry as stored: the load that counts stands beside each version.
LOADS = T.StructType([*FEED_VERSIONS.fields, T.StructField("load", T.StringType())])


def _files(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in (*REQUIRED_FILES, *OPTIONAL_FILES) if exists(spark, f"{folder}/{n}")]


def fingerprint(spark: SparkSession, folder: str) -> tuple[str, int]:
    """(last modified, total length) of the files, without reading them."""
    listed = spark.read.format("binaryFile").load(_files(spark, folder)).select("modificationTime", "length")
    row = listed.agg(F.max("modificationTime").cast("string"), F.sum("length")).first()
    return row[0], row[1]


def content_version(spark: SparkSession, folder: str) -> str:
    """A version id from the content: per file, counts and sums of line hashes, in one splittable pass.

    Two folders with the same lines in each file get the same id whatever the line order.
    """
    lines = spark.read.text(_files(spark, folder)).select(
        F.input_file_name().alias("file"),
        F.xxhash64("value").cast("decimal(38,0)").alias("a"),
        F.xxhash64(F.concat(F.lit("\0"), "value")).cast("decimal(38,0)").alias("b"),
    )
    # a file, or a folder of its parts; its name is made out once for a part, not for a line
    name = F.regexp_extract("file", r"([^/]+\.txt)(/[^/]*)?$", 1).alias("name")
    per_part = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    per_file = per_part.groupBy(name).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in (("n", "long"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)"))])
    parts = F.array_sort(F.collect_list(F.concat_ws("|", *[F.col(c).cast("string") for c in ("name", "n", "a", "b")])))
    return per_file.agg(F.sha2(F.array_join(parts, "\n"), 256)).first()[0]


def _loads(spark: SparkSession, root: str) -> DataFrame:
    """Feed versions with the load that counts; the last row written for a version counts."""
    rows = stored(spark, f"{root}/feed_versions", LOADS)
    names = [f.name for f in LOADS if f.name != "feed_version"]
    return (
        rows.groupBy("feed_version")
        .agg(F.max_by(F.struct(*names), "downloaded_at").alias("_r"))
        .select("feed_version", *[F.col(f"_r.{n}").alias(n) for n in names])
        .where(F.col("loaded_at").isNotNull())
    )


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Feed versions that are loaded."""
    return _loads(spark, root).drop("load")


def read_static(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of loaded versions only. Version and load are partition columns: other loads are not read."""
    rows = spark.read.parquet(f"{root}/{table}")
    loads = _loads(spark, root).select("feed_version", "load")
    return rows.join(loads, ["feed_version", "load"], "left_semi").drop("load")


def is_unchanged(spark: SparkSession, root: str, last_modified: str | None, length: int | None) -> bool:
    """Same modification time and length as the newest load; an unknown value never matches."""
    newest = registry(spark, root).agg(F.max_by(F.struct("last_modified", "content_length"), "downloaded_at")).first()[0]
    if newest is None or last_modified is None or length is None:
        return False
    return (newest["last_modified"], newest["content_length"]) == (last_modified, length)


def load_version(spark: SparkSession, folder: str, root: str, version: str, load: str | None = None) -> dict[str, int]:
    """Write all tables of one load of a version; returns rows per table. Does not register it.

    Beside the published tables, `trip_stops` has each trip's stops in order, so that whoever resolves predictions need
    not put stop times together again.
    """
    check_files(spark, folder)
    load = load or _new_load()
    counts = {}
    for table in TABLES:
        counts[table] = _write(read_table(spark, folder, table), root, table, version, load)
    dates = expand_service_dates(read_table(spark, folder, "calendar"), read_table(spark, folder, "calendar_dates"))
    counts["service_dates"] = _write(dates, root, "service_dates", version, load, ["service_date", "service_id"])
    stop_times = spark.read.parquet(f"{root}/stop_times/feed_version={version}/load={load}")
    _write(trip_stops(stop_times), root, "trip_stops", version, load)
    return counts


def _new_load() -> str:
    return f"l{uuid.uuid4().hex}"  # never read as a number


def trip_stops(stop_times: DataFrame) -> DataFrame:
    """Per trip its stop ids and sequences in order, and its first and last scheduled second, in one pass. Stops without a
    trip have no such seconds."""
    known = F.when(F.col("trip_id").isNotNull(), F.col("arrival_seconds"))
    return scheduled_stops(stop_times, first_seconds=F.min(known), last_seconds=F.max(known))


def _write(rows: DataFrame, root: str, table: str, version: str, load: str, order: list[str] | None = None) -> int:
    """One load of a version is one folder."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").parquet(f"{root}/{table}/feed_version={version}/load={load}")
    return seen.get["n"]


def load_schedule(spark: SparkSession, folder: str, root: str, source_url: str, force: bool = False) -> str:
    """Load a schedule folder unless it is already there; returns the logged status."""
    started, clock = dt.datetime.now(dt.UTC), time.monotonic()
    version = counts = error = None
    modified = length = None
    try:
        check_files(spark, folder)
        modified, length = fingerprint(spark, folder)
        if not force and is_unchanged(spark, root, modified, length):
            status = "skipped_unchanged"
        else:
            version = content_version(spark, folder)
            known = not registry(spark, root).where(F.col("feed_version") == version).isEmpty()
            if known and not force:
                status = "skipped_already_loaded"
            else:
                load = _new_load()
                counts = load_version(spark, folder, root, version, load)
                _register(spark, folder, root, version, source_url, started, modified, length, counts, load)
                status = "ok"
    except Exception as failure:
        status, error = "parse_error", str(failure)
        raise
    finally:
        row = log_row(
            spark,
            LOAD_LOG,
            started_at=started.replace(tzinfo=None),
            duration_ms=int((time.monotonic() - clock) * 1000),
            status=status,
            http_code=None,
            feed_version=version,
            bytes=length,
            rows_loaded=_json(counts),
            error=error,
        )
        append_log(row, f"{root}/gtfs_load_log")
    return status


def _json(counts: dict[str, int] | None) -> str | None:
    import json

    return json.dumps(counts) if counts else None


def _register(spark, folder, root, version, source_url, started, modified, length, counts, load) -> None:
    info = feed_info(spark, folder).first()
    row = log_row(
        spark,
        LOADS,
        load=load,
        feed_version=version,
        source_url=source_url,
        downloaded_at=started.replace(tzinfo=None),
        loaded_at=dt.datetime.now(dt.UTC).replace(tzinfo=None),
        content_length=length,
        last_modified=modified,
        publisher_version=info["publisher_version"] if info else None,
        feed_start_date=info["feed_start_date"] if info else None,
        feed_end_date=info["feed_end_date"] if info else None,
        row_counts=_json(counts),
    )
    row.write.mode("append").parquet(f"{root}/feed_versions")


def drop_version(spark: SparkSession, root: str, version: str) -> None:
    """Unregister a version first, then remove its rows."""
    gone = log_row(
        spark, LOADS, feed_version=version, source_url="", downloaded_at=dt.datetime.now(dt.UTC).replace(tzinfo=None)
    )
    gone.write.mode("append").parquet(f"{root}/feed_versions")
    for table in STATIC:
        delete(spark, f"{root}/{table}/feed_version={version}")


def drop_old_loads(spark: SparkSession, root: str) -> int:
    """Remove the files of loads that no longer count; returns the folders removed. For times when no one reads them."""
    named = {(r["feed_version"], r["load"]) for r in _loads(spark, root).select("feed_version", "load").collect()}
    gone = 0
    for table in STATIC:
        for folder in folders(spark, f"{root}/{table}/feed_version=*/load=*"):
            version, load = (part.split("=", 1)[1] for part in folder.split("/")[-2:])
            if (version, load) not in named:
                delete(spark, folder)
                gone += 1
    return gone
