"""Exact n-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles, the tokens. Tokens of all sets have one order: known rare ones, those of
unknown frequency, frequent ones. A set's prefix is extended until any partner similar enough must share a
signature of it: a single token of the rare classes, or two frequent tokens of one bucket. Pairs that share a
signature pass a bound from their positions, a bound from parity sketches, and then an exact comparison.

Equal sets are one node from the start. Within the nodes that share a signature, each is compared with the
most central one; only nodes not connected that way are paired further.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.sieve import passing, sieve_of
from stopclock.llm.store import components, most_frequent, one_per_document, ready, small_batches, stored
from stopclock.llm.words import lean, mixed, slabs, words_of

#: Tokens in this part of the hash range are counted in full; elsewhere only what repeats within a batch.
COUNTED = 1 << 62
REPEATS = 3
BUFFER = 1 << 20
#: Bytes of text whose sets are made at once.
PART = 1 << 19
#: A token of as many sets is frequent. The table of frequent tokens holds at most FREQUENT of them, the most
#: frequent; tokens beyond it are indexed singly, so the bound costs time and no result.
MANY = 8
FREQUENT = 1 << 18


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row and token of the distinct shingles by row and hash, the rows' set sizes and their nodes."""
    words = words_of(texts, lower=True)
    total = np.diff(words.first)
    gram, whole = words.grams(size)
    row = words.row[: len(gram)][whole]
    token = gram[whole]
    short = np.flatnonzero((total > 0) & (total < size))
    if len(short):
        token = np.concatenate([token, words.stretch(words.first[short], words.first[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    n = np.bincount(row, minlength=len(total))
    sums = np.zeros(len(total), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, row, mixed(token + np.uint64(0x9E3779B9)))
        node = mixed(sums + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)).view(np.int64)
    return row, token, n, node


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1) * 2)).astype(np.int64))


def _nodes(size: int):
    """(doc_id, text) to doc_id, node, set size and the parity of tokens per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slabs(batch.column(1), PART):
                row, token, n, node = _sets(batch.column(1).slice(a, b - a), size)
                bits = np.where(n > 0, _sketch_bits(n), 0)
                base = np.concatenate([[0], np.cumsum(bits)])
                slot = base[row] + (token & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
                odd = np.bincount(slot, minlength=base[-1]) & 1
                body = np.packbits(odd.astype(np.uint8)).tobytes()
                sketch = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((base // 8).astype(np.int64)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(node, mask=n == 0), pa.array(n.astype(np.int64)), sketch.cast(pa.binary())],
                    ["doc_id", "node", "n", "sketch"],
                )

    return run


def _distinct_nodes(node: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose node is met for the first time."""
    take = np.zeros(len(node), bool)
    for i, (x, k) in enumerate(zip(node.tolist(), n.tolist(), strict=True)):
        if k and x not in seen:
            seen.add(x)
            take[i] = True
    return take


def _counts(size: int):
    """(text) to tokens with the number of distinct sets that hold them, counted for BUFFER tokens at a time."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        take = (token < COUNTED) | (count >= REPEATS)
        return pa.RecordBatch.from_arrays([pa.array(token[take].view(np.int64)), pa.array(count[take].astype(np.int32))], ["token", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, many = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for a, b in slabs(batch.column(0), PART):
                row, token, n, node = _sets(batch.column(0).slice(a, b - a), size)
                held.append(token[_distinct_nodes(node, n, seen)[row]])
                many += len(held[-1])
            if many > BUFFER:
                yield counted(held)
                seen.clear()
                held, many = held[:1], 0
        yield counted(held)

    return run


def _combined(tokens: np.ndarray, first: int, need: int, scheme: int) -> tuple[list, list]:
    """Signatures and positions of the frequent tokens: pairs within a bucket, until `need` more is covered."""
    buckets = max(1, (1 << scheme) // 4)
    bucket = tokens % np.uint64(buckets)
    order = np.lexsort((tokens, bucket))
    tokens, bucket = tokens[order], bucket[order]
    later = np.zeros(len(tokens), bool)
    later[1:] = bucket[1:] == bucket[:-1]
    covered = np.cumsum(later)
    stop = int(np.searchsorted(covered, need)) + 1
    start = np.maximum.accumulate(np.where(later, 0, np.arange(len(tokens))))[:stop]
    at = np.arange(min(stop, len(tokens)))
    partners = at - start[: len(at)]
    b = np.repeat(at, partners)
    a = np.repeat(start[: len(at)], partners) + np.arange(len(b)) - np.repeat(np.cumsum(partners) - partners, partners)
    with np.errstate(over="ignore"):
        sig = mixed(tokens[a] * np.uint64(0x9E3779B97F4A7C15) + tokens[b] * np.uint64(0xD1B54A32D192ED03) + np.uint64(scheme + 1))
    return sig, first + covered[b] - 1


def _signatures(size: int, percent: int, frequent):
    """(text) to one row per signature of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            seen: set[int] = set()
            for a, b in slabs(batch.column(0), PART):
                row, token, n, node = _sets(batch.column(0).slice(a, b - a), size)
                wanted = _distinct_nodes(node, n, seen) & (n * (100 - percent) >= percent)
                take = wanted[row]
                row, token = row[take], token[take]
                need = n - -(-percent * n // 100) + 1
                kind = np.where(token < COUNTED, 0, 1)
                if len(table):
                    near = np.minimum(np.searchsorted(table, token), len(table) - 1)
                    kind[table[near] == token] = 2
                order = np.lexsort((token, kind, row))
                row, token, kind = row[order], token[order], kind[order]
                begin = np.searchsorted(row, np.arange(b - a + 1))
                rank = np.arange(len(row)) - begin[row]
                single = (kind < 2) & (rank < need[row])
                sig, owner, place = [token[single]], [row[single]], [rank[single]]
                rare = np.bincount(row[kind < 2], minlength=b - a)
                for i in np.flatnonzero(wanted & (rare < need)):
                    common = token[begin[i] + rare[i] : begin[i + 1]]
                    for scheme in {int(n[i]).bit_length() - 1, int(n[i] * 100 // percent).bit_length() - 1}:
                        s, p = _combined(common, int(rare[i]), int(need[i] - rare[i]), scheme)
                        sig.append(s), place.append(p), owner.append(np.full(len(s), i))
                sig, owner, place = np.concatenate(sig), np.concatenate(owner), np.concatenate(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(node[owner]), pa.array(n[owner].astype(np.int32)), pa.array(place.astype(np.int32))],
                    ["sig", "node", "n", "pos"],
                )

    return run


def _plausible(percent: int):
    """(a, b, n, m, sketches) to the pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            allowed = n + m - 2 * -(-percent * (n + m) // (100 + percent))
            keep = np.zeros(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, width)) for z in (x, y))
                keep[i] = np.bitwise_count(x ^ y).sum() <= allowed[i]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _token_sets(size: int):
    """(node, text) to node and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slabs(batch.column(1), PART):
                row, token, n, _ = _sets(batch.column(1).slice(a, b - a), size)
                ends = np.concatenate([[0], np.cumsum(n)]) * 8
                body = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(token.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), body.cast(pa.binary())], ["node", "tokens"])

    return run


def _similar(percent: int):
    """(a, b, tokens, tokens) to the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = (100 + percent) * common >= percent * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _kept_by(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(sieve.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


def _links(named: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """a, b: the candidate pairs that are links, by sketches and then by the sets themselves."""
    spark = named.sparkSession
    sketch = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("one")).select("node", "one.*")
    of_a = sketch.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x"))
    of_b = sketch.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    near = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n", "m", "x", "y")
    near = stored(near.mapInArrow(lean(_plausible(percent)), "a long, b long"), f"{name}-plausible")
    needed = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sketch.select("node", "doc_id"), "node")
    needed = stored(needed.select("node", "doc_id"), f"{name}-needed")
    sieve = spark.sparkContext.broadcast(sieve_of(needed, "doc_id"))
    texts = named.mapInArrow(lean(_kept_by(sieve)), "doc_id long, text string")
    sets = stored(texts.join(needed, "doc_id").select("node", "text").mapInArrow(lean(_token_sets(size)), "node long, tokens binary"), f"{name}-sets")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(lean(_similar(percent)), "a long, b long"), f"{name}-links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents grouped by links of Jaccard similarity percent / 100 or more.

    A text is lower-cased (A-Z) and split at ASCII white space; its set holds the distinct shingles of `size`
    words, or the whole sequence as one shingle if it has fewer. component_id is the smallest doc_id that a
    document reaches over links, its own included.

    Null and empty texts have no shingles and link with nothing. Rows without a doc_id come back with a null
    component. Rows that repeat a doc_id are one document (`one_per_document`). Further columns are ignored.
    Every link is found: signatures, bounds and the frequent-token table only decide how much is compared.
    """
    spark = docs.sparkSession
    ready(spark)
    with small_batches(spark):
        return _grouped(one_per_document(docs, "text"), size, percent)


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All that runs in Python is done when this returns."""
    spark = docs.sparkSession
    named = docs.where("doc_id is not null")
    nodes = stored(docs.select("doc_id", "text").mapInArrow(lean(_nodes(size)), "doc_id long, node long, n long, sketch binary"), "nodes")
    real = nodes.where("n > 0 and doc_id is not null")

    counts = named.select("text").mapInArrow(lean(_counts(size)), "token long, sets int")
    common = counts.groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= MANY)
    common = most_frequent(stored(common, "common"), "sets", FREQUENT).select("token").toPandas()["token"]
    frequent = spark.sparkContext.broadcast(np.sort(common.to_numpy(np.int64).view(np.uint64)))

    found = named.select("text").mapInArrow(lean(_signatures(size, percent, frequent)), "sig long, node long, n int, pos int")
    per = Window.partitionBy("sig")
    shared = found.repartition("sig").withColumns(
        {"low": F.min("node").over(per), "high": F.max("node").over(per), "lead": F.min(F.struct("pos", "node", "n")).over(per)}
    )
    shared = shared.where("low < high").dropDuplicates(["sig", "node"])
    shared = stored(shared.select("sig", "node", "n", "pos", F.col("lead.node").alias("hub"), F.col("lead.n").alias("hub_n"), F.col("lead.pos").alias("hub_pos")), "shared")

    def viable(n, pos, m, other):
        return (100 + percent) * F.least(n - pos, m - other) >= percent * (n + m)

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    star = shared.where((F.col("node") != F.col("hub")) & viable(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos")))
    star = star.select(*pair(F.col("node"), F.col("hub"))).distinct()
    links = _links(named, real, star, size, percent, "star")

    of = stored(components(links, "a", "b"), "of")
    label = shared.join(of, "node", "left").select("*", F.coalesce("component", "node").alias("of_node")).drop("component")
    hubs = of.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    label = stored(label.join(hubs, "hub", "left").withColumn("of_hub", F.coalesce("of_hub", "hub")), "labelled")
    apart = label.where("of_node <> of_hub").select("sig", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "pos", "of_node")])
    # two that are both apart meet once, not from either side
    rest = label.join(apart, "sig").where(
        ((F.col("of_node") == F.col("of_hub")) | (F.col("node") > F.col("node_")))
        & (F.col("of_node") != F.col("of_node_"))
        & (F.col("node") != F.col("hub"))
        & viable(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"))
    )
    rest = rest.select(*pair(F.col("node"), F.col("node_"))).distinct()
    links = links.unionByName(_links(named, real, rest, size, percent, "rest"))

    root = nodes.select("doc_id", "n", "node").join(components(links, "a", "b"), "node", "left")
    root = stored(root.select("doc_id", "n", F.coalesce("component", "node").alias("root")), "roots")
    least = stored(root.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    placed = root.where("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return placed.unionByName(root.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
