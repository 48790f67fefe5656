"""Words and word n-grams of whole Arrow text columns, as 64-bit hashes, without a Python loop per word.

The functions run inside tasks, on slabs of a batch: byte-wide temporaries are held to a few megabytes,
so memory follows the longest single document and not the number of documents.
"""

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything but digits, letters and non-ASCII bytes.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[0x30:0x3A] = False
PUNCTUATION[0x61:0x7B] = False
PUNCTUATION[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SLAB = 1 << 21
PIECE = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    up, down = _powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) <= n:
        size = 1 << int(n).bit_length()
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]).cumprod(dtype=np.uint64)
            down = np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]).cumprod(dtype=np.uint64)
        _powers[base] = up, down
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span."""
    up, down = _power_tables(base, len(values))
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return (total[end] - total[start]) * down[start]


@dataclass
class Words:
    """The words of consecutive rows: byte spans in `data`, hashes, and where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one row."""
        count = len(self.hash)
        if count < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        start = np.arange(count - n + 1)
        row = self.row
        return mixed(_spans_hash(self.hash, start, start + n, _WORD_BASE)), row[: count - n + 1] == row[n - 1 :]

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words of each span; spans of different lengths differ."""
        with np.errstate(over="ignore"):
            return mixed(_spans_hash(self.hash, start, end, _WORD_BASE) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to `limit` bytes; a longer text is a range of its own."""
    _, offsets = _flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, giving the memory it no longer needs back to the machine when its task ends: a worker goes on to other
    tasks and would keep what the largest one took."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            return

    return leaner


def words_of(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of the rows of a text column, split at the separator bytes."""
    data, offsets = _flat(texts)
    if lower:
        data = LOWER[data]
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):  # a piece ends between words
            gaps = np.flatnonzero(separators[data[at:to]])
            cut = at + int(gaps[-1]) + 1 if len(gaps) else int(offsets[np.searchsorted(offsets, at, "right")])
            nexts = np.flatnonzero(separators[data[to:]]) if not len(gaps) and cut > to + PIECE else ()
            to = min(cut, to + int(nexts[0]) + 1) if len(nexts) else cut
        piece = data[at:to]
        inside = ~separators[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        hashes.append(mixed(_spans_hash(piece.astype(np.uint64) + np.uint64(1), start, end, _BYTE_BASE)))
        starts.append(start + at)
        ends.append(end + at)
        at = to
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(data, start, end, hashed, np.searchsorted(start, offsets))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
