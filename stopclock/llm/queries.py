"""Registered queries of the pipeline operators, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.llm.alignment import align
from stopclock.llm.brown import score_texts
from stopclock.llm.fingerprints import fingerprints
from stopclock.llm.licenses import scan_licenses
from stopclock.llm.lines import remove_repeated_lines
from stopclock.llm.minhash import minhash_duplicates
from stopclock.llm.mixing import mix
from stopclock.llm.near import near_duplicates
from stopclock.llm.pages import extract_main_text
from stopclock.llm.periods import periodic_runs
from stopclock.llm.phrases import contamination
from stopclock.llm.repeats import remove_repeats
from stopclock.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(folds: int):
    """Whether crc32 of the doc_id as text leaves no remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


@query("op1_lm_scoring")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_texts(table(spark, folder, "documents"), ~held_out(10))
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


OP2_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as seq
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)
), least as (
  select seq, min(doc_id) as m from starts group by seq
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as i
  from starts join least using (seq) where doc_id > m
), removed as (
  select doc_id, list(i) as gone from gone group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w
    else [w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)] end, ' '), '')) as kept_sha256
from words left join removed using (doc_id)
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(table(spark, folder, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out(5))
    return scored.select("doc_id", held_out(5).alias("held_out"), "score", "predicted")


OP3_SQL = r"""
with clean_docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), clean_items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), phrases as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as seq
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from clean_items where len(w) > 0)
), starts as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as seq
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from clean_docs), (select distinct n from phrases)
  where i + n - 1 <= len(w)
), found as (
  select doc_id, i, n, item_id from starts join phrases using (n, seq)
), hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), owners as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from clean_docs left join hits using (doc_id) left join owners using (doc_id)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP4_SQL = r"""
with docs as (
  select doc_id, text, [x for x in string_split(text, chr(10)) if trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> ''] as lines from documents
), windows as (
  select doc_id, i, [trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) for x in lines[i:i + 2]] as seq
  from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as i from docs where len(lines) >= 3)
), firsts as (
  select seq, min(row(doc_id, i)) as first, count(*) as n from windows group by seq
), covered as (
  select doc_id, list(distinct i + k) as gone
  from windows join firsts using (seq), (values (0), (1), (2)) as t(k)
  where n > 1 and row(doc_id, i) <> first group by doc_id
)
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(case when gone is null then text else array_to_string([lines[i] for i in range(1, len(lines) + 1) if not list_contains(gone, i)], chr(10)) end) as kept_sha256
from docs left join covered using (doc_id)
"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_lines(table(spark, folder, "documents"), size=3)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The mixture of the registered query: half of all tokens, sources 0 to 4 as the domain "web".
MIX_TOTAL, MIX_SEED, MIX_EPOCHS = 0.5, 7, 2
MIX_WEIGHTS = [("web", 3.0), ("books", 2.0), ("other", 1.0), ("web/en", 4.0), ("web/de", 2.0), ("books/en", 2.0), ("books/fr", 2.0), ("other/es", 3.0)]
WEB, BOOKS = ["src0", "src1", "src2", "src3", "src4"], ["src5", "src6", "src7", "src8", "src9"]


def mixture(spark: SparkSession, docs: DataFrame) -> DataFrame:
    weights = spark.createDataFrame(MIX_WEIGHTS, "name string, weight double")
    domain = F.when(F.col("source").isin(WEB), "web").when(F.col("source").isin(BOOKS), "books").otherwise("other")
    return mix(docs, MIX_TOTAL, weights, MIX_SEED, MIX_EPOCHS, domain)


@query("op6_mixing_sources")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, table(spark, folder, "documents")).select("doc_id", "domain", "language", "source", "epoch", "n_tokens", "budget")


@query("op8_document_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    made = fingerprints(table(spark, folder, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op5_html_extraction")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_license_scans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "line", "license", "reduction", F.array_join("lacking", " ").alias("lacking"), F.array_join("added", " ").alias("added"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: where the checksum of doc_id ends in 0, the words from one place on repeat a block of them."""
    words = docs.select("doc_id", "text", F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)").alias("w"), F.expr("crc32(cast(doc_id as string))").alias("h"))
    words = words.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    words = words.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p as int))), slice(w, a + 1, (n - a) % p))")
    return words.select("doc_id", F.when(F.expr("h % 10 = 0 and n > 0"), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    runs = periodic_runs(with_periods(table(spark, folder, "documents")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    runs = runs.withColumns({"best": best, "listed": listed})
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        (-F.col("best.less")).alias("length"),
        "best.period",
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_minhash_near_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_duplicates(table(spark, folder, "documents"), size=5, percent=85)


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = align(table(spark, folder, "documents"))
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    documents = found.documents.select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    scored = documents.join(found.scores, ["block", "place"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
