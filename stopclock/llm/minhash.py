"""MinHash near-deduplication: minima of universal hashes, bands, verified signatures, exact sets, star components.

A document is its set of word shingles. Documents with equal sets are one node. A node's signature is the least value of its
tokens under each of many multiply-add hashes; equal values in a whole band make two nodes meet. So many bands are taken
that a link of just the wanted similarity misses all of them with probability `MISSED`. Whatever meets is compared by its
signatures, allowing an error of the same probability, and then confirmed on the full sets.

Within a bucket each node meets the bucket's hub, the node with most copies. Only what that leaves in different
components is looked at further: in buckets of at most `FEW` members pair by pair, in larger ones by how the sets differ
from the hub's. Two sets that are similar enough, one of them not similar to the hub, must differ from the hub by many of
the same tokens; so each node lists the first of its differing tokens, as many as are sure to hold a common one, and meets
those that list it too. In a large group of loose copies these are few, as each has its own changes.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.sieve import passing, sieve_of
from stopclock.llm.store import components, one_per_document, ready, small_batches, stored
from stopclock.llm.words import lean, mixed, slabs, words_of

MISSED = 1e-9
ROWS = 5
FEW = 8
#: Bytes of text whose sets are made at once.
PART = 1 << 19
#: A key is dealt over several tasks if it has more than this part of the rows and as many rows.
HOT_PART, HOT_ROWS = 1000, 2000


def bands_for(percent: int) -> int:
    """So many bands that a pair of this similarity shares one, but for odds of MISSED."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def _tail(n: int, p: float) -> int:
    """The largest k for which a binomial count of n and p is below k with odds of at most MISSED."""
    below, k = (1 - p) ** n, 0
    while below <= MISSED and k < n:
        k += 1
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers, odd, and addends of the hashes x -> a * x + b modulo 2**64."""
    rng = np.random.default_rng(0x5EED)
    a, b = rng.integers(0, 1 << 64, (2, count), np.uint64, endpoint=False)
    return a | np.uint64(1), b


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row and token of the distinct shingles, by row and token, and the size of each row's set."""
    words = words_of(texts, lower=True)
    total = np.diff(words.first)
    gram, whole = words.grams(size)
    row, token = words.row[: len(gram)][whole], gram[whole]
    short = np.flatnonzero((total > 0) & (total < size))
    row = np.concatenate([row, short])
    token = np.concatenate([token, words.stretch(words.first[short], words.first[short + 1])])
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    return row, token, np.bincount(row, minlength=len(total))


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _signed(size: int, count: int):
    """(doc_id, text) to doc_id, set size, digest of the set, and the minima unless the batch had an equal set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(count)
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for at, to in slabs(batch.column(1), PART):
                row, token, n = _shingles(batch.column(1).slice(at, to - at), size)
                filled = np.flatnonzero(n)
                h1, h2 = np.zeros(to - at, np.uint64), np.zeros(to - at, np.uint64)
                first = (np.cumsum(n) - n)[filled]
                if len(filled):
                    with np.errstate(over="ignore"):
                        h1[filled] = np.add.reduceat(mixed(token + np.uint64(0x9E3779B97F4A7C15)), first)
                        h2[filled] = np.add.reduceat(mixed(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                fresh = np.zeros(to - at, bool)
                for i, key in zip(filled.tolist(), zip(h1[filled].tolist(), h2[filled].tolist(), strict=True), strict=True):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                token = token[fresh[row]]
                starts = (np.cumsum(n[fresh]) - n[fresh]).astype(np.int64)
                least = np.zeros((len(starts), count), np.uint32)
                value = np.empty_like(token)
                if len(starts):
                    with np.errstate(over="ignore"):
                        for j in range(count):
                            np.multiply(token, a[j], out=value)
                            np.add(value, b[j], out=value)
                            least[:, j] = np.minimum.reduceat(value, starts) >> np.uint64(32)
                place = np.full(to - at, -1)
                place[fresh] = np.arange(len(starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(n.astype(np.int32)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        _binary(least).take(pa.array(place, mask=place < 0)),
                    ],
                    ["doc_id", "n", "h1", "h2", "minima"],
                )

    return run


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    """The minima of all rows of a column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + 2]
    body = column.buffers()[2]
    if not len(column):
        return np.zeros((0, count), np.uint32)
    return np.frombuffer(body, np.uint32, len(column) * count, int(offsets[0])).reshape(-1, count)


def _banded(bands: int):
    """(node, n, copies, minima) to one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                least = _matrix(part.column(3), bands * ROWS).astype(np.uint64).reshape(-1, bands, ROWS)
                sig = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), least.shape[:2])
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        sig = mixed(sig * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
                each = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(sig.reshape(-1).view(np.int64)), *[part.column(k).take(each) for k in range(3)]], ["sig", "node", "n", "copies"])

    return run


def _bits(bands: int):
    """(node, minima) to node and one bit of each minimum, in longs."""
    words = -(-bands * ROWS // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = (_matrix(batch.column(1), bands * ROWS) & np.uint32(1)).astype(np.uint8)
            packed = np.zeros((len(low), words * 8), np.uint8)
            packed[:, : -(-low.shape[1] // 8)] = np.packbits(low, axis=1)
            longs = packed.view(np.int64)
            offsets = pa.array(np.arange(len(low) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(longs.reshape(-1)))], ["node", "bits"])

    return run


def _alike(count: int, least: int):
    """(a, b, minima, minima) to the pairs that agree in enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), count) == _matrix(batch.column(3), count)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same >= least)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _token_sets(size: int):
    """(node, text) to node and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slabs(batch.column(1), PART):
                _, token, n = _shingles(batch.column(1).slice(at, to - at), size)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * 8
                body = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(ends), pa.py_buffer(token.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), body.cast(pa.binary())], ["node", "tokens"])

    return run


def _similar(percent: int):
    """(a, b, tokens, tokens) to the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _differing(percent: int):
    """(hub, node, tokens, tokens of the hub) to the node's first differing tokens as sigs of the hub.

    d tokens differ between a node and the hub, and two nodes are similar if they differ by at most c of their sizes, c =
    (100 - percent) / (100 + percent). That they do takes (d + d' - c (n + n')) / 2 common differing tokens at least. A far
    node, not similar to the hub, has d over c (n + hub). So between far nodes, and for a near node towards far ones, at
    least (d + c (hub - n)) / 2 are common; for a far node towards near ones at least d - c (n + n'), the near one having no
    fewer than that, and n' is at most n * 100 / percent. Of any two near nodes the components are one. Tokens the hub
    lacks come first in each list, as these are seldom shared, then the hub's; in each part by their hash. The places in
    the lists bound what two nodes can still have in common after their first common token.
    """
    less, whole = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, int]] = []
            for hub, node, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                own, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                token = np.concatenate([np.sort(own), np.sort(lost)])
                d, n, m = len(token), len(x), len(y)
                far = whole * d > less * (n + m)
                common = max(1, -(-(whole * d + less * (m - n)) // (2 * whole)))
                towards_near = max(1, -(-(whole * percent * d - less * n * whole) // (whole * percent)))
                parts = [(0, common), (1, towards_near)] if far else [(2, common)]
                for side, least in parts:
                    with np.errstate(over="ignore"):
                        about = np.uint64(hub & (2**64 - 1)) * np.uint64(2) + np.uint64(side > 0)
                        out.append((mixed(token[: d - least + 1] + mixed(np.array([about]))[0]), node, side, d))
                if sum(len(o[0]) for o in out[-64:]) > 1 << 16 or len(out) > 1 << 10:
                    yield _listed(out)
                    out = []
            yield _listed(out)

    return run


def _listed(out: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
    count = np.array([len(o[0]) for o in out], np.int64)
    sig = np.concatenate([np.zeros(0, np.uint64), *[o[0] for o in out]])
    place = np.arange(len(sig)) - np.repeat(np.cumsum(count) - count, count)
    each = [np.repeat(np.array([o[k] for o in out], np.int64), count) for k in (1, 2, 3)]
    columns = [sig.view(np.int64), *each, place.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "side", "d", "place"])


def _kept_by(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(sieve.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


def even_join(rows: DataFrame, table: DataFrame, keys: list[str], salted: str, how: str = "inner", count: str | None = None) -> DataFrame:
    """rows joined to the one row of each key in `table`. A key with more than a thousandth of the rows, of which there
    are fewer than a thousand, is dealt over tasks by the column `salted`, with a copy of its row for each. The
    column `count` of `table`, if named, tells the rows of each key."""
    counts = table.select(*keys, F.col(count).alias("count")) if count else rows.groupBy(*keys).count()
    total = (table.agg(F.sum(count)).first()[0] if count else rows.count()) or 0
    often = counts.where((F.col("count") > HOT_ROWS) & (F.col("count") * HOT_PART > total)).collect()
    if not often:
        return rows.join(table, keys, how)
    spark = rows.sparkSession
    parts = [(*[r[k] for k in keys], min(HOT_PART, -(-r["count"] * HOT_PART // total))) for r in often]
    schema = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys], "parts_ int"])
    hot = F.broadcast(spark.createDataFrame(parts, schema))
    dealt = rows.join(hot, keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(salted), F.col("parts_")), F.lit(0)).cast("int")).drop("parts_")
    copied = table.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return dealt.join(copied, [*keys, "salt_"], how).drop("salt_")


def _undecided(rows: DataFrame) -> DataFrame:
    """sig, low, n_rows: the sigs whose nodes lie in several components, and the least of these."""
    spread = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_rows"))
    return stored(spread.where("low < high").select("sig", "low", "n_rows"), "spread")


class _Corpus:
    """What confirming a pair needs."""

    def __init__(self, named: DataFrame, nodes: DataFrame, size: int, percent: int):
        self.named, self.nodes, self.size, self.percent = named, nodes, size, percent
        self.bands = bands_for(percent)

    def sets_of(self, wanted: DataFrame, name: str) -> DataFrame:
        """node, tokens of the wanted nodes."""
        wanted = stored(wanted, f"{name}-wanted")
        sieve = wanted.sparkSession.sparkContext.broadcast(sieve_of(wanted, "node"))
        texts = self.named.mapInArrow(lean(_kept_by(sieve)), "doc_id long, text string").withColumnRenamed("doc_id", "node")
        return stored(texts.join(wanted, "node").select("node", "text").mapInArrow(lean(_token_sets(self.size)), "node long, tokens binary"), f"{name}-sets")

    def _beside(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """a, b and the value of both; b may be in very many pairs."""
        of_a = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
        of_b = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return even_join(pairs, of_b, ["b"], "a").join(of_a, "a").select("a", "b", "x", "y")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b: the pairs that are links, by signatures and then by the sets themselves."""
        pairs = stored(pairs, f"{name}-pairs")
        count = self.bands * ROWS
        alike = self._beside(pairs, self.nodes, "minima").mapInArrow(lean(_alike(count, _tail(count, self.percent / 100))), "a long, b long")
        alike = stored(alike, f"{name}-alike")
        sets = self.sets_of(alike.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
        return stored(self._beside(alike, sets, "tokens").mapInArrow(lean(_similar(self.percent)), "a long, b long"), f"{name}-links")

    def close(self, n: str, m: str, x: str, y: str):
        """Whether set sizes and signature bits allow the similarity."""
        count = self.bands * ROWS
        differ = count - _tail(count, 1 - (1 - self.percent / 100) / 2)
        bits = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(-(-count // 64)))
        return F.expr(f"100 * least({n}, {m}) >= {self.percent} * greatest({n}, {m}) and {bits} <= {differ}")

    def enough(self):
        """Whether as many differing tokens can be common as the similarity takes; rows of no list have no d."""
        less, whole = 100 - self.percent, 100 + self.percent
        return F.expr(f"d is null or {2 * whole} * (1 + least(d - place - 1, d_ - place_ - 1)) >= {whole} * (d + d_) - {less} * (n + n_)")

    def across(self, rows: DataFrame) -> DataFrame:
        """a, b: pairs of nodes of one sig that lie in different components; rows of one component never meet, nor do
        rows of one side unless that is 0."""
        rows = stored(even_join(rows, _undecided(rows), ["sig"], "node", count="n_rows"), "across")
        apart = rows.where("component <> low").select("sig", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "bits", "component", "side", "d", "place")])
        met = rows.drop("n_rows").join(apart, "sig").where("component <> component_ and (component = low or node < node_)")
        met = met.where("side = 0 or side <> side_").where(self.enough()).where(self.close("n", "n_", "bits", "bits_"))
        return met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def minhash_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents grouped by links of Jaccard similarity percent / 100 or more.

    A text is lower-cased (A-Z) and split at ASCII white space; its set holds the distinct shingles of `size` words, or the
    whole sequence as one shingle if it has fewer. component_id is the smallest doc_id that a document reaches over links,
    its own included; `kept` marks that document.

    Null and empty texts have no shingles and link with nothing. Rows without a doc_id come back with a null component and
    are kept. Rows that repeat a doc_id are one document (`one_per_document`). Further columns are ignored. Every link
    that is used holds on the full sets; a link of just the wanted similarity goes unseen with odds of about 2 * MISSED.
    Tokens are 64-bit hashes, equal sets are told by 128 bits and their size.
    """
    spark = docs.sparkSession
    ready(spark)
    with small_batches(spark):
        return _grouped(one_per_document(docs, "text"), size, percent)


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All that runs in Python is done when this returns."""
    bands = bands_for(percent)
    signed = docs.select("doc_id", "text").mapInArrow(lean(_signed(size, bands * ROWS)), "doc_id long, n int, h1 long, h2 long, minima binary")
    signed = stored(signed, "signed")
    filled = signed.where("n > 0 and doc_id is not null")
    group = filled.groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.min(F.when(F.col("minima").isNotNull(), F.col("doc_id"))).alias("carrier")
    )
    minima = filled.where("minima is not null").select(F.col("doc_id").alias("carrier"), "minima")
    nodes = stored(group.join(minima, "carrier").select("node", "n", "copies", "minima", "h1", "h2"), "nodes")
    named = docs.where("doc_id is not null").select("doc_id", "text")
    corpus = _Corpus(named, nodes, size, percent)

    banded = nodes.select("node", "n", "copies", "minima").mapInArrow(lean(_banded(bands)), "sig long, node long, n int, copies long")
    hub = F.min(F.struct((-F.col("copies")).alias("less"), "node", "n"))
    buckets = banded.groupBy("sig").agg(hub.alias("hub"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(buckets.select("sig", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), "members"), "buckets")
    shared = stored(even_join(banded.select("sig", "node", "n"), buckets, ["sig"], "node", count="members"), "shared")

    star = shared.where(f"node <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    links = corpus.confirmed(star.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "star")
    of = stored(components(links, "a", "b"), "of")

    label = shared.join(of, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("component"), "members", "hub")
    label = stored(label.where("members > 2 and node <> hub"), "label")  # all have met the hub
    undecided = stored(even_join(label, _undecided(label).drop("low"), ["sig"], "node", count="n_rows").drop("n_rows"), "undecided")
    bits = nodes.join(undecided.select("node").distinct(), "node").select("node", "minima").mapInArrow(lean(_bits(bands)), "node long, bits array<long>")
    bits = stored(bits, "bits")
    columns = ["sig", "node", "n", "component", "bits", "side", "d", "place"]
    nothing = F.lit(None).cast("long")
    few = undecided.where(F.col("members") <= FEW).join(bits, "node").withColumns({"side": F.lit(0).cast("long"), "d": nothing, "place": nothing})
    pairs = corpus.across(few.select(columns))
    crowd = stored(undecided.where(F.col("members") > FEW).select("hub", "node", "n", "component").distinct(), "crowd")
    if not crowd.isEmpty():
        sets = corpus.sets_of(crowd.select(F.explode(F.array("hub", "node")).alias("node")).distinct(), "crowd")
        of_hub = sets.select(F.col("node").alias("hub"), F.col("tokens").alias("y"))
        both = even_join(crowd.select("hub", "node"), of_hub, ["hub"], "node").join(sets, "node").select("hub", "node", "tokens", "y")
        listed = both.mapInArrow(lean(_differing(percent)), "sig long, node long, side long, d long, place long")
        told = crowd.select("node", "n", "component").distinct().join(bits, "node")
        pairs = pairs.unionByName(corpus.across(listed.join(told, "node").select(columns))).distinct()
    links = links.unionByName(corpus.confirmed(pairs, "rest"))

    final = components(links, "a", "b")
    placed = nodes.select("node", "h1", "h2", "n", "copies").join(final, "node", "left")
    placed = stored(placed.select("h1", "h2", "n", F.coalesce("component", "node").alias("component_id"), "copies"), "placed")
    out = even_join(signed.where("n > 0").select("doc_id", "n", "h1", "h2"), placed, ["h1", "h2", "n"], "doc_id", "left", count="copies")
    out = out.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
