"""Replaying a stored table through a stream, to hold stream and batch against each other."""

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopclock.operators.changes import KEY
from stopclock.session import shared_folder
from stopclock.sources.files import stored
from stopclock.streaming.changes import changed_stream


def replay(
    table: DataFrame,
    instant: str,
    stream: Callable[[DataFrame], DataFrame],
    cuts: list[dt.datetime],
    keys: list[str],
    mode: str = "append",
    fallback: str = "/tmp",
) -> DataFrame:
    """What `stream` makes of a whole table that lands in time slices; `commit` and `batch` tell which slice each row came
    of. One run per slice, from one checkpoint: later slices meet the state of earlier ones.

    Files go to the cluster's shared folder; `fallback` serves sessions that name none.
    """
    spark = table.sparkSession
    root = f"{shared_folder(spark, fallback)}/replay-{uuid.uuid4().hex}"
    landing, kept = f"{root}/landing", f"{root}/kept"
    edges = [None, *cuts, None]
    schema = None
    for commit, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = table
        part = part if low is None else part.where(F.col(instant) >= F.lit(low))
        part = part if high is None else part.where(F.col(instant) < F.lit(high))
        part.repartition(*keys).write.mode("append").parquet(landing)
        made = stream(spark.readStream.schema(table.schema).parquet(landing))
        schema = made.schema

        def put(rows: DataFrame, batch: int, commit: int = commit) -> None:
            tagged = rows.withColumns({"commit": F.lit(commit), "batch": F.lit(batch).cast("long")})
            tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit", "batch").parquet(kept)

        query = made.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    tagged = T.StructType([*schema.fields, T.StructField("commit", T.IntegerType()), T.StructField("batch", T.LongType())])
    return stored(spark, kept, tagged)


def replay_changes(observed: DataFrame, slices: int = 3, fallback: str = "/tmp") -> DataFrame:
    """Change-only state over a whole table in equal time slices, nothing forgotten."""
    lo, hi = observed.agg(F.min("observed_at"), F.max("observed_at")).first()
    if lo is None:
        return observed.limit(0)
    cuts = [lo + (hi - lo) / slices * (i + 1) for i in range(slices - 1)]
    kept = replay(observed, "observed_at", lambda stream: changed_stream(stream, retain_days=None), cuts, KEY, fallback=fallback)
    return kept.select(*observed.columns)
