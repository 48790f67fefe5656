"""From raw documents to a training mixture: five stages, each over all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.llm.lines import remove_repeated_lines
from stopclock.llm.near import near_duplicates
from stopclock.llm.phrases import contamination
from stopclock.llm.queries import held_out, mixture
from stopclock.llm.store import one_per_document, stored
from stopclock.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Rows without a doc_id stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, score_toxicity(docs, labels, ~held_out(5)).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows of three; those of which nothing is left go."""
    kept = remove_repeated_lines(docs).where("doc_id is not null and not (n_removed > 0 and n_removed = n_lines)")
    others = docs.select("doc_id", "lang", "source").where("doc_id is not null")
    cut = others.join(kept, "doc_id").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))
    return cut.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles at 0.8, the document with the smallest doc_id."""
    docs = one_per_document(docs, *COLUMNS[1:])
    return _without(docs, near_duplicates(docs, size=5, percent=80).where("component_id <> doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contamination(docs, items, window=13).where("contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mixture, once per epoch they are drawn in."""
    drawn = mixture(spark, docs).select("doc_id", "domain", "epoch", "n_tokens")
    return one_per_document(docs, *COLUMNS[1:]).join(drawn, "doc_id").select(*COLUMNS, "domain", "epoch", "n_tokens")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
