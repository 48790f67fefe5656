"""Session settings the operators rely on."""

import os
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import stopclock


def build_session(app: str = "stopclock", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes; `conf` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_stopclock_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="stopclock-"), "stopclock")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    # The worker that prepares a stateful stream does not see added files, so its code goes by value.
    cloudpickle.register_pickle_by_value(stopclock)
    context._stopclock_shipped = True


def use_utc(spark: SparkSession) -> None:
    """Wall-clock arithmetic here is written for a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster's shared folder, as `spark.checkpoint.dir` names it.

    `fallback` is used only where the cluster names none, which is the case in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no folder was given")
    return fallback


def written(df, name: str):
    """The rows, written once to the shared folder and read back: for what several plans read. A later loss costs no
    recomputation. Sessions that name no shared folder, which is one machine, use /tmp."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, fallback='file:///tmp/stopclock-shared')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
