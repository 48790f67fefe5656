"""Paths on whatever file system the session uses."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders and files that match a pattern, in order of their names."""
    fs, target = _path(spark, pattern)
    return sorted(str(f.getPath().toString()) for f in fs.globStatus(target) or [])


def put_whole(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and put it in place by one rename: readers see all of it or nothing."""
    fs, target = _path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    _, hidden = _path(spark, f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.{uuid.uuid4().hex}")
    out = fs.create(hidden)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(hidden, target):
        raise FileExistsError(path)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one before its first write."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def for_days(df: DataFrame, first: str, last: str, column: str = "start_date") -> DataFrame:
    """Day-range scan; on a table partitioned by the column this prunes partitions."""
    from pyspark.sql import functions as F

    return df.where(F.col(column).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
