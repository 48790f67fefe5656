"""The registered queries against their SQL, and the pipeline's stages against brute force, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from checks.run import TABLES, rows_of
from stopclock.llm import queries
from stopclock.llm.store import stored
from tests.llm.test_models import brute_mix
from tests.llm.test_near import brute as brute_groups
from tests.llm.test_small_operators import brute_contamination, brute_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        kept[name] = docs.collect()
    before = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    toxic = {r.doc_id for r in queries.op10(spark, FOLDER).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in before} - toxic

    lines = brute_lines([(r.doc_id, r.text) for r in kept["toxicity"]], 3)
    want = {d: text for d, (n, gone, text) in lines.items() if not 0 < gone == n}
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    groups = brute_groups([(r.doc_id, r.text) for r in kept["line_dedup"]], 5, 80)
    assert {r.doc_id for r in kept["ngram_jaccard_join"]} == {d for d, (n, c) in groups.items() if c == d}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in kept["ngram_jaccard_join"]], items, 13)
    assert {r.doc_id for r in kept["benchmark_decontamination"]} == {d for d, x in found.items() if not x[3]}

    named = {**{s: "web" for s in queries.WEB}, **{s: "books" for s in queries.BOOKS}}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept["benchmark_decontamination"]]
    domain = {r[3]: named.get(r[3], "other") for r in rows}
    weights = dict(queries.MIX_WEIGHTS)
    drawn = brute_mix(rows, queries.MIX_TOTAL, weights, queries.MIX_SEED, queries.MIX_EPOCHS, domain)
    assert sorted((r.doc_id, r.epoch) for r in kept["mixing_sources"]) == drawn
    assert {c for c in kept["mixing_sources"][0].asDict()} >= set(corpus_pipeline.COLUMNS)
