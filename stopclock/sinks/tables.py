"""Idempotent writes to Parquet tables."""

import json
import logging
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopclock.functions.labels import cut_error
from stopclock.fixed import MAX_ERROR_CHARS
from stopclock.sources.files import delete, exists, folders, put_whole, stored

log = logging.getLogger(__name__)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key in the given order, as a map-side combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def not_yet_stored(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """First write wins: rows whose key the table does not hold."""
    return batch.join(stored.select(*keys), keys, "left_anti")


def append_new(
    batch: DataFrame,
    path: str,
    keys: list[str],
    order: list[str | Column],
    partition_by: list[str] | None = None,
    days: tuple[str, str] | None = None,
) -> dict[str, int]:
    """Append rows with new keys; returns {'offered', 'inserted'}, counted in the write itself.

    `days` bounds the service days of the batch so only those partitions are compared.
    """
    spark = batch.sparkSession
    offered, inserted = Observation(), Observation()
    rows = keep_first(batch.observe(offered, F.count(F.lit(1)).alias("n")), keys, order)
    if exists(spark, path):
        known = table(spark, path, batch.schema, partition_by)
        if days is not None:
            bounds = (F.to_date(F.lit(days[0])), F.to_date(F.lit(days[1])))
            known = known.where(F.col("start_date").between(*bounds))
        rows = not_yet_stored(rows, known, keys)
    rows = rows.select(*batch.columns).observe(inserted, F.count(F.lit(1)).alias("n"))
    append(rows, path, partition_by)
    return {"offered": offered.get["n"], "inserted": inserted.get["n"]}


# A table whose partitions can be replaced keeps each replacement in a folder of its own, its generation. Rows are appended
# to the generation that counts. Which one counts is told by the newest manifest, a small file put in place by one
# rename: a reader sees a replacement of several partitions whole or not at all, and a writer that fails leaves the
# old rows as they were. A table has one writer at a time.
GENERATION, FIRST = "generation", "0"


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition to the generation that counts, for the partitions replaced so far."""
    kept = folders(spark, f"{path}/_manifest/*.json")
    return json.loads(spark.read.text(kept[-1], wholetext=True).first()[0]) if kept else {}


def _put_manifest(spark: SparkSession, path: str, counts: dict[str, str]) -> None:
    last = folders(spark, f"{path}/_manifest/*.json")
    number = int(last[-1].rsplit("/", 1)[1].removesuffix(".json")) + 1 if last else 1
    put_whole(spark, f"{path}/_manifest/{number:012d}.json", json.dumps(counts))


def _partition(partition_by: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in partition_by])


def _generation(spark: SparkSession, path: str, partition_by: list[str]) -> Column:
    counts = manifest(spark, path)
    if not counts:
        return F.lit(FIRST)
    told = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    return F.coalesce(F.try_element_at(told, _partition(partition_by)), F.lit(FIRST))


def table(spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> DataFrame:
    """A stored table as it stands, or an empty one before its first write. The generation is a partition column, so only
    files that count are read."""
    if not partition_by:
        return stored(spark, path, schema)
    rows = _generations(spark, path, schema)
    return rows.where(F.col(GENERATION) == _generation(spark, path, partition_by)).select(*schema.fieldNames())


def _generations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table whose partitions can be replaced, those that count and those that do not."""
    layout = T.StructType([f for f in schema.fields if f.name != GENERATION] + [T.StructField(GENERATION, T.StringType())])
    return stored(spark, path, layout)


def _write(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Append rows to the generations they name. AQE splits a partition value with many rows and merges those with few."""
    rows.hint("rebalance", *partition_by).write.mode("append").partitionBy(GENERATION, *partition_by).parquet(path)


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to the generations that count."""
    if not partition_by:
        rows.write.mode("append").parquet(path)
        return
    _write(rows.withColumn(GENERATION, _generation(rows.sparkSession, path, partition_by)), path, partition_by)


def replace_partitions(rows: DataFrame, path: str, partition_by: list[str], touched: list[str]) -> None:
    """Put `rows` in place of the touched partitions, all at once; a touched partition without rows is empty then.

    `rows` may be read from the table itself: its files stay, until `vacuum`.
    """
    generation = uuid.uuid4().hex
    _write(rows.withColumn(GENERATION, F.lit(generation)), path, partition_by)
    spark = rows.sparkSession
    _put_manifest(spark, path, manifest(spark, path) | dict.fromkeys(touched, generation))


def vacuum(spark: SparkSession, path: str, partition_by: list[str]) -> int:
    """Delete files that no longer count, and all manifests but the newest; for times when no one reads older ones."""
    counts, gone = manifest(spark, path), 0
    for folder in folders(spark, f"{path}/{GENERATION}=*" + "/*=*" * len(partition_by)):
        values = [part.split("=", 1)[1] for part in folder.split("/")[-len(partition_by) - 1 :]]
        key = "/".join("" if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for v in values[1:])
        if counts.get(key, FIRST) != values[0]:
            delete(spark, folder)
            gone += 1
    for old in folders(spark, f"{path}/_manifest/*.json")[:-1]:
        delete(spark, old)
    return gone


def kept_rows(stored: DataFrame, new: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Stored rows that no new row replaces.

    `within` names a key column of few values, such as a source or a service day. Its values in `new`, one for each, reach
    the driver; stored rows of other values can't be replaced and are kept without a comparison, so they are not shuffled
    for one.
    """
    kept = []
    if within is not None:
        values = [r[0] for r in new.select(within).where(F.col(within).isNotNull()).distinct().collect()]
        touched = F.coalesce(F.col(within).isin(values), F.lit(False))
        kept = [stored.where(~touched).select(*new.columns)]
        stored = stored.where(touched)
    kept.append(not_yet_stored(stored, new, keys).select(*new.columns))
    return reduce(DataFrame.unionByName, kept)


def upsert_rows(stored: DataFrame, new: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Last write wins; of `within`, see `kept_rows`."""
    return kept_rows(stored, new, keys, within).unionByName(new)


def upsert(new: DataFrame, path: str, keys: list[str], partition_by: list[str], within: str | None = None) -> None:
    """Last write wins, rewriting only the partitions the new rows fall in. Their names, one for each, reach the driver.

    The new rows are written first and read back for the comparison, so what makes them runs once. Of `within`, see
    `kept_rows`.
    """
    spark = new.sparkSession
    if not exists(spark, path):
        append(new, path, partition_by)
        return
    generation = uuid.uuid4().hex
    _write(new.withColumn(GENERATION, F.lit(generation)), path, partition_by)
    written = _generations(spark, path, new.schema).where(F.col(GENERATION) == generation)
    names = [r[0] for r in written.select(_partition(partition_by)).distinct().collect()]
    known = table(spark, path, new.schema, partition_by).where(_partition(partition_by).isin(names))
    kept = kept_rows(known, written.select(*new.columns), keys, within)
    _write(kept.withColumn(GENERATION, F.lit(generation)), path, partition_by)
    _put_manifest(spark, path, manifest(spark, path) | dict.fromkeys(names, generation))


def move_rows(corrected: DataFrame, path: str, old_day: str, day: str = "start_date") -> int:
    """Rewrite the partitions between which rows move; returns rows moved.

    `corrected` is the whole stored table with `day` corrected and the stored value beside
    it in `old_day`. A partition all rows have left is empty then. The list of days that
    reaches the driver holds one value per touched service day.
    """
    moving = corrected.where(F.col(day) != F.col(old_day))
    pairs = moving.groupBy(old_day, day).agg(F.count(F.lit(1)).alias("n")).collect()
    if not pairs:
        return 0
    days = sorted({row[old_day] for row in pairs} | {row[day] for row in pairs})
    rows = corrected.where(F.col(day).isin(days)).drop(old_day)
    replace_partitions(rows, path, [day], [d.isoformat() for d in days])
    return sum(row["n"] for row in pairs)


def merge_captures(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two captures of one table; on a shared key the first capture's row stays."""
    both = first.withColumn("_capture", F.lit(0)).unionByName(second.withColumn("_capture", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return keep_first(both, keys, ["_capture", *rest]).select(*first.columns)


def merge_counts(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after a merge, in one pass over both captures."""
    both = first.select(*keys, F.lit(1).alias("a")).unionByName(second.select(*keys, F.lit(0).alias("a")))
    per_key = both.groupBy(*keys).agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("before_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("a")), F.lit(0)).alias("offered_rows"),
        F.count(F.lit(1)).alias("after_rows"),
    )


def append_log(rows: DataFrame, path: str, partition_by: list[str] | str | None = None, once: bool = False) -> bool:
    """Append outcome rows, error text cut. A failure here is logged and never fails the job. With `once`, rows take the
    place of those written before under the same partition values: a batch that is run again is logged once."""
    try:
        if "error" in rows.columns:
            rows = rows.withColumn("error", cut_error("error", MAX_ERROR_CHARS))
        writer = rows.write.mode("overwrite" if once else "append").option("partitionOverwriteMode", "dynamic")
        names = [partition_by] if isinstance(partition_by, str) else partition_by
        (writer.partitionBy(*names) if names else writer).parquet(path)
        return True
    except Exception:
        log.exception("could not write the outcome log at %s", path)
        return False


def log_row(spark: SparkSession, schema, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)
