"""Substring deduplication by relative Lempel-Ziv parsing.

A document is parsed into factors against blocks of earlier documents. Every window of `window` words has
one anchor, the least hashed k-gram in it; the words of all windows that share an anchor are a block, and
blocks of all documents are indexed by anchor. A block that stands in an earlier document extends the
factor as a whole. Where only the anchor is known elsewhere, which is at factor boundaries, the windows of
the block are looked up singly. The covered words are the duplicate spans.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, ready, stored
from stopclock.llm.words import least_of, mixed, slabs, words_of

GRAM = 6
ASKED, SHARED, REPEATED = 0, 1, 2


def _blocks_of(words, doc: np.ndarray, window: int) -> list[np.ndarray]:
    """anchor, block, doc, first window and number of windows of each block of a slab."""
    width = window - GRAM + 1
    gram, _ = words.grams(GRAM)
    count = len(words.hash) - window + 1
    if count <= 0:
        return [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64)]
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(gram)).astype(np.uint64)
    least = least_of(gram & ~low | place & low, width)[:count]
    start = np.arange(count)
    anchor = start + ((least & low).astype(np.int64) - start) % (1 << 24)
    row = words.row
    start, anchor = (x[row[:count] == row[window - 1 :]] for x in (start, anchor))
    if not len(start):
        return [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64)]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    served = np.diff(np.append(at, len(start)))
    first, anchor = start[at], anchor[at]
    block = words.stretch(first, first + served + window - 1)
    mine = row[first]
    return [(gram[anchor] >> np.uint64(32)).astype(np.uint32).view(np.int32), block.view(np.int64), doc[mine], first - words.first[mine], served]


def _decided_here(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and doc, and which of the ordered rows repeat a smaller doc of this batch."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, doc > least


def _index(window: int):
    """Batches of (doc_id, text) to one row per block. A block met in a smaller doc of its batch is settled here,
    so that what many documents share meets once per batch and not once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            found = [_blocks_of(words_of(texts.slice(a, b - a)), doc[a:b], window) for a, b in slabs(texts)]
            anchor, block, owner, start, served = (np.concatenate(x) for x in zip(*found, strict=True))
            order, later = _decided_here(block, owner)
            anchor, block, owner, start, served = (x[order] for x in (anchor, block, owner, start, served))
            kind = np.where(later, REPEATED, ASKED)
            # an anchor with several blocks here is shared for certain: one of them says so to the other batches,
            # the rest need not meet there
            open_ = np.flatnonzero(~later)
            by = open_[np.lexsort((block[open_], anchor[open_]))]
            same = anchor[by][1:] == anchor[by][:-1]
            other = same & (block[by][1:] != block[by][:-1])
            groups = np.concatenate([[0], np.cumsum(~same)]) if len(by) else np.zeros(0, np.int64)
            several = np.zeros(int(groups[-1]) + 1 if len(by) else 0, bool)
            several[groups[1:][other]] = True
            known = several[groups] if len(by) else np.zeros(0, bool)
            kind[by[known]] = SHARED
            head = np.concatenate([[True], ~same]) if len(by) else np.zeros(0, bool)
            part = anchor.copy()
            spread = by[known & ~head]
            part[spread] = (mixed(block[spread].view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            part[later] = (mixed(owner[later].view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(block), pa.array(owner), pa.array(start.astype(np.int32)), pa.array((served * 4 + kind).astype(np.int32))],
                ["part", "block", "doc_id", "start", "served"],
            )

    return run


def _lookup(window: int):
    """Batches of (doc_id, text, blocks) to one row per window to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, asked = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            found = []
            for a, b in slabs(texts):
                words = words_of(texts.slice(a, b - a))
                piece = asked.slice(a, b - a)
                per_row = np.asarray(piece.value_lengths())
                row = np.repeat(np.arange(b - a), per_row)
                spans = piece.flatten().to_numpy(zero_copy_only=False)
                start, served = spans >> 8, spans & 255
                index = np.repeat(start, served) + np.arange(served.sum()) - np.repeat(np.cumsum(served) - served, served)
                row = np.repeat(row, served)
                gram, _ = words.grams(window)
                found.append((gram[words.first[row] + index].view(np.int64), doc[a:b][row], index))
            gram, owner, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order, later = _decided_here(gram, owner)
            gram, owner, start = gram[order], owner[order], start[order]
            part = np.where(later, mixed(owner.view(np.uint64)).view(np.int64), gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(owner), pa.array(start.astype(np.int32)), pa.array(later)], ["part", "doc_id", "start", "later"]
            )

    return run


def _cut(window: int):
    """Batches of (doc_id, text, spans) to what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2)
            for a, b in slabs(texts):
                words = words_of(texts.slice(a, b - a))
                total = np.diff(words.first)
                piece = spans.slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.asarray(piece.value_lengths().fill_null(0)))
                packed = piece.flatten().to_numpy(zero_copy_only=False)
                begin = words.first[row] + (packed >> 8)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + (packed & 255) + window - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.add.reduceat(np.append(gone, False), words.first[:-1], dtype=np.int64) * (total > 0)
                kept, cut = [], []
                for i in range(b - a):
                    lo, hi = words.first[i], words.first[i + 1]
                    if lo == hi:
                        kept.append(b"")
                    elif not removed[i]:
                        kept.append(b" ".join(words.data[words.start[lo] : words.end[hi - 1]].tobytes().split()))
                    else:
                        kept.append(b" ".join(words.text(j) for j in lo + np.flatnonzero(~gone[lo:hi])))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi], [0]])))
                    cut.append(edge.tolist())
                flat = pa.array([x for e in cut for x in e], pa.int32())
                ends = np.concatenate([[0], np.cumsum([len(e) for e in cut])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(total), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    ["doc_id", "n_words", "n_removed", "kept", "cuts"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept, cuts: every document without the words of windows that an earlier one has.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of `window` words
    covering it also starts in a document with a smaller doc_id. `kept` joins the remaining words by one space;
    `cuts` lists where runs of removed words begin and end, as word numbers.

    Null and empty texts have no words and are returned with zeros and an empty text, as are texts shorter than
    a window with all their words. Rows without a doc_id are returned whole and are no reference. Rows that
    repeat a doc_id are one document (`one_per_document`). Windows that only repeat inside one document stay.
    Further columns are ignored. `window` is from 7 to 200 words.
    """
    ready(docs.sparkSession)
    docs = one_per_document(docs, "text")
    named = docs.where("doc_id is not null")
    blocks = named.mapInArrow(_index(window), "part int, block long, doc_id long, start int, served int")
    blocks = blocks.withColumn("kind", F.col("served") % 4).withColumn("served", F.col("served").bitwiseAND(~3) / 4)
    blocks = blocks.withColumn("served", F.col("served").cast("int")).repartition("part")
    open_ = F.col("kind") < REPEATED
    per_block, per_part = Window.partitionBy("part", "block"), Window.partitionBy("part")
    placed = blocks.withColumn("first_doc", F.min(F.when(open_, F.col("doc_id"))).over(per_block)).withColumns(
        {
            "shared": F.max(F.when(F.col("kind") == SHARED, True).otherwise(False)).over(per_part),
            "low": F.min(F.when(open_, F.col("block"))).over(per_part),
            "high": F.max(F.when(open_, F.col("block"))).over(per_part),
        }
    )
    full = ~open_ | (F.col("doc_id") > F.col("first_doc"))
    factors = placed.where(full | F.col("shared") | (F.col("low") != F.col("high")))
    factors = stored(factors.select("doc_id", (F.col("start").cast("long") * 256 + F.col("served")).alias("span"), full.alias("full")), "factors")

    boundary = factors.where(~F.col("full")).groupBy("doc_id").agg(F.collect_list("span").alias("asked"))
    windows = named.join(boundary, "doc_id").select("doc_id", "text", "asked")
    windows = windows.mapInArrow(_lookup(window), "part long, doc_id long, start int, later boolean")
    least = F.min(F.when(~F.col("later"), F.col("doc_id"))).over(Window.partitionBy("part"))
    found = windows.withColumn("least", least).where(F.col("later") | (F.col("doc_id") > F.col("least")))
    spans = factors.where("full").select("doc_id", "span").unionByName(found.select("doc_id", (F.col("start").cast("long") * 256 + 1).alias("span")))
    spans = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    whole = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, cuts array<int>")
