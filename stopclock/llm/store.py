"""Written intermediate tables, one row per document, and connected components."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopclock.session import ship_package, shared_folder

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the cluster's shared folder and read back: a later loss costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, fallback=_test_folder())}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _test_folder() -> str:
    """Used only where no shared folder is configured, which is one machine."""
    return "file:///tmp/stopclock-shared"


def ready(spark: SparkSession) -> None:
    """The executors' Python gets this package."""
    ship_package(spark)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most `size` for the jobs run inside, so that a worker's memory does not follow long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def one_per_document(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the named columns, one row per doc_id.

    Where rows repeat a doc_id, the least of their values counts, column by column. Rows without a
    doc_id are kept as they are.
    """
    docs = docs.select("doc_id", *columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return docs
    least = docs.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    return least.unionByName(docs.where("doc_id is null"))


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows with the largest counts, at most `limit`: those of whole count levels, an eighth of a power of two
    wide. Only the sizes of the levels reach the driver."""
    level = F.floor(F.log2(column) * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().collect()  # at most 64 * 8
    taken, lowest = 0, None
    for at, n in sorted(sizes, reverse=True):
        taken += n
        if taken > limit:
            break
        lowest = at
    return counts.where(F.lit(False) if lowest is None else level >= lowest)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: the least node that each linked node reaches.

    Alternating star contraction: every round is two shuffles of the remaining edges, hot nodes are
    combined before the shuffle, and the number of rounds grows with the logarithm of the longest chain.
    """
    a, b = F.col(left), F.col(right)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, mark = stored(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of u is tied to the least node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # every smaller neighbour, and u itself, is tied to the least of them
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        edges, last = after, mark
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == last:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)
