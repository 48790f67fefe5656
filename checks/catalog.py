"""Registered queries: a Spark plan over whole tables and, where SQL can say it, its check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.duck import with_views
from checks.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Comparable columns: instants as epoch micros, days as text, whole numbers as bigint,
    fractions rounded to six places."""

    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.TimestampType,)):
            c = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        return c.alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def query(name: str, sql: str | None = None, *needs: str):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: present(build(Views(spark, folder)))
        if sql is not None:
            SQL[name] = with_views(sql, *needs)
        return build

    return register


def load_all() -> None:
    from checks import (  # noqa: F401
        q_collection,
        q_feeds,
        q_model,
        q_quality,
        q_reports,
        q_scalars,
        q_scoring,
        q_static,
        q_stops,
        q_streams,
        q_tracks,
    )
