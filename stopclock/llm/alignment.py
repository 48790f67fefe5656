"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes; where a token of either ends at the same byte, the two are linked. An inverted list holds,
for each pair of linked ids and each block of documents, the documents of the block as compressed bitmaps, one for every
binary digit of the number of links: an OR of the bitmaps, counted, says in how many documents the pair is, and the bitmaps
counted by the weight of their digit say how many links it has. Blocks hold different documents, so their counts add up. The
counts then go back along the same lists: every list adds its pair's score to the documents it names.
"""

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, ready, small_batches, stored
from stopclock.llm.words import slabs

TOKENIZERS = "/opt/tokenizers"
LEFT, RIGHT = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"

#: A block ends after so many bytes of text or so many documents: places in a block take 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 1 << 22, 1 << 16
B_BITS = 24

#: Fixed value: how the byte-level vocabulary cuts text into words.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space or a word of this length goes to the plain encoder, whose time and stack do not depend on it.
LONG_WORD = 4096

_loaded: dict[int, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, and the byte."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_bpe(spec: dict) -> bool:
    """Whether ids follow the order of merges and words are cut by WORD_PATTERN, so that ranks alone define the encoding."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return False
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return [model["vocab"][m] for m in joined] == list(range(256, 256 + len(joined)))


class _ByteLevel:
    """A byte-level vocabulary file: ids and bytes of texts, special tokens being plain text."""

    def __init__(self, body: bytes):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(body)
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.plain = Tokenizer.from_str(body.decode())
        self.plain.encode_special_tokens = True
        self.fast, self.long = None, regex.compile(r"\s{%d}|\S{%d}" % (LONG_WORD, LONG_WORD))
        if _plain_bpe(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [self.plain.encode(t, add_special_tokens=False).ids for t in texts]
        return [self.plain.encode(t, add_special_tokens=False).ids if self.long.search(t) else self.fast.encode_ordinary(t) for t in texts]


class _Pieces:
    """A piece vocabulary file: ids and bytes of texts."""

    def __init__(self, body: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=body)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _vocabulary(body: bytes):
    """The vocabulary of a file's content, loaded once in a worker."""
    key = hash(body)
    if key not in _loaded:
        made = (_ByteLevel if body.lstrip()[:1] == b"{" else _Pieces)(body)
        if max(map(len, made.bytes_of)) == 0:
            raise ValueError("the vocabulary has no tokens")
        _loaded[key] = made, np.array([len(b) for b in made.bytes_of], np.int64)
    return _loaded[key]


def _group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, shown: list[str]) -> str:
    """`a1,a2|b1;...`: the ids of both sides, group by group; `shown` has each id with each of its two followers."""
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    before_b = np.repeat(np.cumsum(size_b) - size_b, size_a)
    before_a = np.repeat(np.cumsum(size_a), size_b)
    code = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), np.int64)
    last[cut_a] = 2
    code[np.arange(len(a)) + before_b] = a * 4 + last
    last = np.zeros(len(b), np.int64)
    last[cut_b] = 2
    code[np.arange(len(b)) + before_a] = b * 4 + 1 + last
    return "".join(map(shown.__getitem__, code.tolist()))[:-1]


def _packed(pair: np.ndarray, place: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """The distinct pairs and, for each, its bitmaps by digit of the number of links a document has of it.

    A bitmap is stored as its places, two bytes each, or as bits, whichever is shorter; bits take an odd number of bytes.
    """
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    links = np.diff(np.append(first, len(pair)))
    pair, place = pair[first], place[first]
    distinct, which = np.unique(pair, return_inverse=True)
    digits = int(links.max()).bit_length() if len(links) else 0
    picked = [np.flatnonzero((links >> k) & 1) for k in range(digits)]
    key = np.concatenate([which[p] * digits + k for k, p in enumerate(picked)] or [which])
    place = np.concatenate([place[p] for p in picked] or [place])
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    present, holder, card = np.unique(key, return_inverse=True, return_counts=True)
    # a digit that no document has is an empty bitmap below a filled one
    high = np.zeros(len(distinct), np.int64)
    np.maximum.at(high, present // max(digits, 1), present % max(digits, 1) + 1)
    planes = np.cumsum(high) - high
    spot = planes[present // max(digits, 1)] + present % max(digits, 1)
    cards = np.zeros(int(high.sum()), np.int64)
    cards[spot] = card
    wide = (n_docs + 7) // 8 | 1
    dense = cards * 2 > wide
    sizes = np.where(dense, wide, cards * 2)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(offsets[-1], np.uint8)
    holder = spot[holder]
    rank = np.arange(len(place)) - (np.cumsum(cards) - cards)[holder]
    thin = ~dense[holder]
    at = offsets[holder[thin]] + 2 * rank[thin]
    body[at], body[at + 1] = place[thin] & 255, place[thin] >> 8
    at = offsets[holder[~thin]] + (place[~thin] >> 3)
    np.bitwise_or.at(body, at, (1 << (place[~thin] & 7)).astype(np.uint8))
    flat = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes())])
    return distinct, pa.ListArray.from_arrays(pa.array(np.append(planes, len(sizes)).astype(np.int32)), flat)


def _unpacked(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """list, digit and place of every bit that is set in a column of bitmaps."""
    ends = planes.offsets.to_numpy()
    flat = planes.values
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    body = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    which = np.arange(ends[0], ends[-1])
    size = offsets[which + 1] - offsets[which]
    owner = np.repeat(np.arange(len(planes)), np.diff(ends))
    digit = which - ends[owner]
    dense = size % 2 == 1
    card = size[~dense] // 2
    at = np.repeat(offsets[which[~dense]], card) + 2 * (np.arange(card.sum()) - np.repeat(np.cumsum(card) - card, card))
    thin = np.repeat(np.flatnonzero(~dense), card), body[at].astype(np.int64) | body[at + 1].astype(np.int64) << 8
    wide = size[dense]
    within = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    at = np.repeat(offsets[which[dense]], wide) + within
    byte, bit = np.nonzero(np.unpackbits(body[at][:, None], axis=1, bitorder="little"))
    thick = np.repeat(np.flatnonzero(dense), wide)[byte], within[byte] * 8 + bit
    holder, place = np.concatenate([thin[0], thick[0]]), np.concatenate([thin[1], thick[1]])
    return owner[holder], digit[holder], place


SCHEMA = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, planes array<binary>"


def _inverted(left, right):
    """(doc_id, text) to a row for each document and, block by block, a row for each pair."""

    def posted(block: int, n_docs: int, held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        if held:
            pair = np.concatenate([p for p, _ in held])
            place = np.repeat([i for _, i in held], [len(p) for p, _ in held])
            distinct, planes = _packed(pair, place, n_docs)
            n = len(distinct)
            empty = [pa.nulls(n, t) for t in (pa.int32(), *[pa.int64()] * 5, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *empty, pa.array(distinct), planes], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a_side, a_size), (b_side, b_size) = _vocabulary(left.value), _vocabulary(right.value)
        many = max(len(a_size), len(b_size))
        shown = [f"{i}{end}" for i in range(many) for end in (",", ",", "|", ";")]
        block = TaskContext.get().partitionId() << 32
        n_docs, n_bytes, held = 0, 0, []
        for batch in batches:
            for at, to in slabs(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                spaced = [" " + t for t in texts]
                told, place, blocks = [], [], []
                for text, ids_a, ids_b in zip(spaced, a_side.encode(spaced), b_side.encode(texts), strict=True):
                    row = (0, 0, 0, 0, "")
                    body = text.encode()
                    if len(body) > 1 and b"".join(map(a_side.bytes_of.__getitem__, ids_a)) == body == b"".join(map(b_side.bytes_of.__getitem__, ids_b)):
                        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
                        end_a, end_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
                        _, cut_a, cut_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
                        held.append((a[cut_a] << B_BITS | b[cut_b], n_docs))
                        row = (len(a), len(b), len(cut_a), len(cut_a), _group_text(a, b, cut_a, cut_b, shown))
                    told.append(row)
                    place.append(n_docs)
                    blocks.append(block)
                    n_docs, n_bytes = n_docs + 1, n_bytes + len(body)
                    if n_docs == BLOCK_DOCS or n_bytes >= BLOCK_BYTES:
                        yield from posted(block, n_docs, held)
                        block, n_docs, n_bytes, held = block + 1, 0, 0, []
                columns = [pa.array(blocks, pa.int64()), pa.array(place, pa.int32()), batch.column(0).slice(at, to - at)]
                columns += [pa.array([r[k] for r in told], pa.int64()) for k in range(4)]
                columns += [pa.array([r[4] for r in told], pa.string()), pa.nulls(to - at, pa.int64()), pa.nulls(to - at, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, NAMES)
        yield from posted(block, n_docs, held)

    return run


NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, planes) to the pair, its documents, by the OR of its bitmaps, and its links, by their weights."""
    for batch in batches:
        n = batch.num_rows
        owner, digit, place = _unpacked(batch.column(1))
        links = np.zeros(n, np.int64)
        np.add.at(links, owner, np.int64(1) << digit)
        merged = np.unique(owner << 16 | place) >> 16
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(merged, minlength=n).astype(np.int64)), pa.array(links)], ["pair", "docs", "links"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, planes, links, best), a block's rows together, to the summed scores of each place."""
    block, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told():
        place = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(place), block, np.int64)), pa.array(place.astype(np.int32)), pa.array(best[place]), pa.array(total[place])],
            ["block", "place", "n_best", "count_sum"],
        )

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)).tolist() if len(blocks) else []
        for at, to in zip(edges, [*edges[1:], len(blocks)], strict=True):
            if blocks[at] != block:
                if block is not None:
                    yield told()
                block, best, total = int(blocks[at]), np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
            part = batch.slice(at, to - at)
            owner, digit, place = _unpacked(part.column(1))
            links = np.int64(1) << digit
            score, is_best = part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
            np.add.at(total, place, links * score[owner])
            np.add.at(best, place, links * is_best[owner])
    if block is not None:
        yield told()


class Alignment(NamedTuple):
    """documents: block, place, doc_id, n_a, n_b, n_groups, n_links, groups. pairs: a, b, docs, links, best.
    scores: block, place, n_best, count_sum, of the documents with links."""

    documents: DataFrame
    pairs: DataFrame
    scores: DataFrame


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT) -> Alignment:
    """Every document's tokens under two vocabularies, cut into groups where tokens of both end, and the linked id pairs.

    `left` names a byte-level vocabulary, which encodes a space and the text, `right` a piece vocabulary, which adds that
    space itself. The driver reads both files and broadcasts them; their size does not depend on the data. `groups` shows
    the ids as `a1,a2|b1;a3|b2,b3`. A pair's `links` are all its links in the corpus, `docs` the documents that have one;
    `best` marks the pairs with the most links of their right id, ties included. A document's `count_sum` adds the links
    of its links' pairs, `n_best` counts its links whose pair is best.

    Null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens: zeros, an empty
    `groups` and no row in `scores`. Rows that repeat a doc_id are one document (`one_per_document`); rows without one are
    documents of their own. Further columns are ignored. A pair has one row for each block, so no pair gathers a share of
    the links in one task.
    """
    spark = docs.sparkSession
    ready(spark)
    files = []
    for path in (left, right):
        with open(path, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))
    with small_batches(spark):
        rows = stored(one_per_document(docs, "text").select("doc_id", "text").mapInArrow(_inverted(*files), SCHEMA), "inverted")
        postings = rows.where("pair is not null").select("block", "pair", "planes")
        counts = postings.select("pair", "planes").mapInArrow(_popcounts, "pair long, docs long, links long")
        counts = stored(counts.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "counts")
        counts = counts.select("pair", F.shiftright("pair", B_BITS).alias("a"), F.expr(f"pair & {(1 << B_BITS) - 1}L").alias("b"), "docs", "links")
        most = counts.groupBy("b").agg(F.max("links").alias("most"))
        pairs = stored(counts.join(most, "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")
        sent = postings.join(pairs.select("pair", "links", F.col("best").cast("long").alias("best")), "pair").select("block", "planes", "links", "best")
        scores = sent.repartition("block").sortWithinPartitions("block").mapInArrow(_scored, "block long, place int, n_best long, count_sum long")
        scores = stored(scores, "scores")
    documents = rows.where("place is not null").drop("pair", "planes")
    return Alignment(documents, pairs.drop("pair"), scores)
