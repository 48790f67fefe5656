"""Benchmark decontamination with a positional inverted index.

The index holds a posting (term, doc_id, position) for every occurrence of a term that some test phrase is looked
up by. Each phrase is looked up by its two rarest terms: their postings, moved by the terms' offsets, meet where
the phrase may begin, and only there the words themselves are compared.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.sieve import passing, sieve_of
from stopclock.llm.store import one_per_document, ready, stored
from stopclock.llm.words import PUNCTUATION, Words, slabs, words_of

SALTS = 32


def _words(texts: pa.Array) -> Words:
    return words_of(texts, PUNCTUATION, lower=True)


def _phrases(window: int):
    """(item_id, text) to the windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slabs(batch.column(1)):
                words = _words(batch.column(1).slice(a, b - a))
                total = np.diff(words.first)
                length = np.minimum(total, window)
                windows = np.where(total > 0, total - length + 1, 0)
                row = np.repeat(np.arange(b - a), windows)
                start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                n = length[row]
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                at = np.repeat(start, n) + np.arange(ends[-1]) - np.repeat(ends[:-1], n)
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.hash[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(words.stretch(start, start + n).view(np.int64)), pa.array(n.astype(np.int32)), terms],
                    ["item_id", "phrase", "n", "terms"],
                )

    return run


def _frequencies(sieve):
    """(doc_id, text) to the terms that may be test terms and their counts in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for a, b in slabs(batch.column(1)):
                term = _words(batch.column(1).slice(a, b - a)).hash
                held.append(term[passing(sieve.value, term)])
            term, count = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], ["term", "times"])

    return run


def _postings(sieve):
    """(doc_id, text) to postings of the terms that may be looked up, and a row without a term for the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slabs(batch.column(1)):
                words = _words(batch.column(1).slice(a, b - a))
                doc = batch.column(0).slice(a, b - a)
                at = np.flatnonzero(passing(sieve.value, words.hash))
                row = words.row[at]
                term = np.concatenate([np.zeros(b - a, np.int64), words.hash[at].view(np.int64)])
                place = np.concatenate([np.diff(words.first), at - words.first[row]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term, mask=np.arange(len(term)) < b - a), pa.concat_arrays([doc, doc.take(pa.array(row))]), pa.array(place.astype(np.int32))],
                    ["term", "doc_id", "pos"],
                )

    return run


def _kept_by(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(sieve.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


def _compared(slack: int):
    """(doc_id, text, asked) to the places where a phrase stands, word for word or within `slack` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slabs(batch.column(1)):
                words = _words(batch.column(1).slice(a, b - a))
                asked = batch.column(2).slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.asarray(asked.value_lengths()))
                flat = asked.flatten()
                phrase, n, start = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                begin = words.first[row] + start
                inside = (start >= 0) & (begin + n <= words.first[row + 1])
                exact = np.zeros(len(row), bool)
                at = np.flatnonzero(inside)
                exact[at] = words.stretch(begin[at], begin[at] + n[at]).view(np.int64) == phrase[at]
                keep = exact.copy()
                if slack:
                    terms = flat.field(3)
                    for i in np.flatnonzero(~exact):
                        lo, hi = max(begin[i] - slack, words.first[row[i]]), min(begin[i] + n[i] + slack, words.first[row[i] + 1])
                        have, many = np.unique(words.hash[lo:hi].view(np.int64), return_counts=True)
                        want, least = np.unique(terms[int(i)].values.to_numpy(), return_counts=True)
                        at = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
                        keep[i] = len(have) > 0 and bool(((have[at] == want) & (many[at] >= least)).all())
                take = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)).take(take), *(pa.array(x).take(take) for x in (phrase, n, start, exact))],
                    ["doc_id", "phrase", "n", "start", "exact"],
                )

    return run


def search(docs: DataFrame, items: DataFrame, window: int = 13, slack: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches (doc_id, phrase, n, start, exact), the phrases' items (phrase, item_id), and lengths (doc_id, n_words).

    A phrase is `window` consecutive words of an item, or all its words if it has fewer. A match is exact where its
    words stand in a row from word `start`; with `slack`, all its words standing in any order from `slack` words
    before that to `slack` words after it is a match too.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    phrases = stored(items.select("item_id", "text").mapInArrow(_phrases(window), "item_id long, phrase long, n int, terms array<long>"), "phrases")
    unique = phrases.groupBy("phrase").agg(F.first("n").alias("n"), F.first("terms").alias("terms"))
    terms = unique.select(F.explode("terms").alias("term")).distinct()
    named = docs.where("doc_id is not null").select("doc_id", "text")
    counts = named.mapInArrow(_frequencies(context.broadcast(sieve_of(terms, "term"))), "term long, times long")
    counts = counts.groupBy("term").agg(F.sum("times").alias("times"))
    each = unique.select("phrase", "n", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    ranked = each.groupBy("phrase").agg(
        F.first("n").alias("n"),
        F.first("terms").alias("terms"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "term"))).alias("by"),
    )
    # a term that no document has rules its phrase out
    ranked = stored(ranked.where("by[0].times > 0"), "ranked")
    pivot = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.col("by")[0].alias("at")), F.struct(F.lit(2).alias("which"), F.col("by")[F.least(F.lit(1), F.size("by") - 1)].alias("at"))))
    pivots = ranked.select("phrase", "n", pivot.alias("pivot")).select("phrase", "n", "pivot.which", "pivot.at.term", "pivot.at.offset")
    pivots = stored(pivots, "pivots")

    index = stored(docs.select("doc_id", "text").mapInArrow(_postings(context.broadcast(sieve_of(pivots, "term"))), "term long, doc_id long, pos int"), "index")
    # a term of a widespread passage has postings in very many documents: they are dealt over SALTS tasks
    postings = index.where("term is not null and doc_id is not null").withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    begun = postings.join(salted, ["term", "salt"]).select("phrase", "n", "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "which")
    key = ["phrase", "n", "doc_id", "start"]
    if slack:
        reach = F.when(F.col("which") == 1, F.sequence(F.col("start") - slack, F.col("start") + slack)).otherwise(F.array("start"))
        begun = begun.select("phrase", "n", "doc_id", F.explode(reach).alias("start"), "which")
    met = begun.groupBy(*key).agg(F.bit_or(F.lit(1) * F.col("which")).alias("which")).where("which = 3").drop("which")
    if slack:
        met = met.join(ranked.select("phrase", "terms"), "phrase")
    asked = F.struct("phrase", "n", "start", "terms") if slack else F.struct("phrase", "n", "start")
    met = stored(met.groupBy("doc_id").agg(F.collect_list(asked).alias("asked")), "met")
    texts = named.mapInArrow(_kept_by(context.broadcast(sieve_of(met, "doc_id"))), "doc_id long, text string")
    found = texts.join(met, "doc_id").select("doc_id", "text", "asked")
    matches = stored(found.mapInArrow(_compared(slack), "doc_id long, phrase long, n int, start int, exact boolean"), "matches")
    return matches, phrases.select("phrase", "item_id").distinct(), index.where("term is null").select("doc_id", F.col("pos").cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated of every document.

    Texts are lower-cased (A-Z); words are runs of digits, letters and non-ASCII characters. A word inside an exact
    occurrence of a phrase (`search`) is hit; `items` lists the item_ids of these phrases, sorted as strings. A
    document is contaminated if hit words are a twentieth of its words or more.

    Null and empty texts have no words and no hits; items without words have no phrase. Rows without a doc_id are
    returned without hits. Rows that repeat a doc_id are one document (`one_per_document`); items may repeat, and
    those without an item_id hit words but are not listed. Further columns are ignored.
    """
    ready(docs.sparkSession)
    docs = one_per_document(docs, "text")
    matches, owners, lengths = search(docs, items, window)
    edges = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))
    hit = matches.select("doc_id", edges.alias("word")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    listed = matches.select("doc_id", "phrase").distinct().join(owners, "phrase").where("item_id is not null")
    listed = listed.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = lengths.join(hit, "doc_id", "left").join(listed, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )
