"""Periodic runs of words within a document: stretches that repeat themselves at least four times.

Recursive frequency splitting: every word of a run of period q and length 4q or more occurs at least four times in any
segment that holds the run. A word that occurs less often in its segment therefore splits it, and the pieces are counted
anew until none changes. Only what survives is scanned lag by lag. A stretch of length 4q holds four consecutive multiples
of q, so a lag is looked at only where four words at its multiples are equal, and extended from there.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stopclock.llm.store import one_per_document, ready, small_batches, stored
from stopclock.llm.words import mixed, slabs, words_of

REPEATS, SHORTEST = 4, 6
#: Checkpoints looked at in one step; more lags take more steps.
STEP = 1 << 20

_BASE = 0x9FB21C651E98DF25


def _survivors(word: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments that no rare word splits any more; `segment` numbers the document of each word."""
    n = len(word)
    settled = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(n)
    part = segment.astype(np.int64)
    while len(at):
        _, which, count = np.unique(part * (n + 1) + word[at], return_inverse=True, return_counts=True)
        often = count[which] >= REPEATS
        opens = np.ones(len(at), bool)
        opens[1:] = part[1:] != part[:-1]
        starts = np.flatnonzero(opens)
        whole = np.logical_and.reduceat(often, starts)
        ends = np.append(starts[1:], len(at))
        long = ends - starts >= SHORTEST
        settled[0].append(at[starts[whole & long]])
        settled[1].append(at[ends[whole & long] - 1] + 1)
        again = often & ~np.repeat(whole, ends - starts)
        # the words left stand in pieces: a gap in their places, or another segment, begins a new one
        at, part = at[again], part[again]
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (part[1:] != part[:-1])
            piece = np.cumsum(new) - 1
            keep = np.bincount(piece)[piece] >= SHORTEST
            at, part = at[keep], piece[keep]
    return np.concatenate(settled[0]), np.concatenate(settled[1])


class _Reach:
    """How far equal stretches reach, by hashes of prefixes."""

    def __init__(self, word: np.ndarray):
        value = mixed(word.astype(np.uint64) + np.uint64(1))
        base = np.uint64(_BASE)
        with np.errstate(over="ignore"):
            self.up = np.concatenate([[np.uint64(1)], np.full(len(word), base)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(len(word), pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(value * self.up[:-1], dtype=np.uint64)])

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.total[a + length] - self.total[a]) * self.down[a]
            return x == (self.total[b + length] - self.total[b]) * self.down[b]

    def longest(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
        """Length, up to limit, of the equal stretches that begin at, or end before, a and b."""
        low, high = np.zeros(len(a), np.int64), limit.astype(np.int64)
        while len(a) and (low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(a, b, middle) if forward else self._same(a - middle, b - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _scan_lag(word: np.ndarray, start: int, end: int, lag: int) -> list[tuple[int, int, int]]:
    """Every stretch of one lag, word by word; used only where hashes of prefixes were wrong."""
    equal = np.concatenate([[False], word[start : end - lag] == word[start + lag : end], [False]])
    opens, closes = np.flatnonzero(equal[1:] & ~equal[:-1]), np.flatnonzero(equal[:-1] & ~equal[1:])
    least = max(SHORTEST, REPEATS * lag) - lag
    return [(start + a, start + b + lag, lag) for a, b in zip(opens.tolist(), closes.tolist(), strict=True) if b - a >= least]


def _runs(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start, end, period of every run within the segments, by start and period."""
    reach = _Reach(word)
    found = [np.zeros((0, 3), np.int64)]
    lags = (end - start) // REPEATS
    owner = np.repeat(np.arange(len(start)), lags)
    lag = np.arange(len(owner)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    points = (end[owner] - start[owner] - 1) // lag - 2
    edges = np.cumsum(points)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + STEP, "right")))
        n = points[at:to]
        pair = np.repeat(np.arange(at, to), n)
        step = lag[pair]
        here = start[owner[pair]] + (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)) * step
        hit = word[here] == word[here + step]
        for k in range(2, REPEATS):
            pair, step, here = pair[hit], step[hit], here[hit]
            hit = word[here] == word[here + k * step]
        pair, step, here = pair[hit], step[hit], here[hit]
        first, last = start[owner[pair]], end[owner[pair]]
        left = reach.longest(here, here + step, here - first, forward=False)
        right = reach.longest(here, here + step, last - here - step, forward=True)
        long = left + right + step >= np.maximum(SHORTEST, REPEATS * step)
        rows = np.stack([here - left, here + right + step, step, first, last], axis=1)[long]
        exact = []
        for s, e, q, a, b in np.unique(rows, axis=0).tolist():
            if np.array_equal(word[s : e - q], word[s + q : e]):
                exact.append((s, e, q))
            else:
                exact += _scan_lag(word, a, b, q)
        found.append(np.array(exact, np.int64).reshape(-1, 3))
        at = to
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end and period
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, n_words, runs and the collapsed text."""
    for batch in batches:
        for a, b in slabs(batch.column(1)):
            texts = batch.column(1).slice(a, b - a)
            words = words_of(texts)
            _, word = np.unique(words.hash, return_inverse=True)
            runs = _runs(word, *_survivors(word, words.row))
            drop = np.zeros(len(word) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 1], -1)
            keep = np.cumsum(drop)[:-1] == 0
            rows = np.searchsorted(words.first, runs[:, 0], "right") - 1
            changed = np.bincount(rows, minlength=b - a) > 0
            collapsed = []
            for i, text in enumerate(texts):
                body = text.as_buffer()
                parts = body.to_pybytes().split() if body is not None else []
                if changed[i]:
                    parts = [parts[k] for k in np.flatnonzero(keep[words.first[i] : words.first[i + 1]])]
                collapsed.append(b" ".join(parts))
            offsets = pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
            fields = [runs[:, 0] - words.first[rows], runs[:, 1] - runs[:, 0], runs[:, 2]]
            listed = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(words.first).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, listed),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed: the periodic runs of every document's words, and its text without the repeats.

    Words are what ASCII white space separates. A run is a stretch with smallest period q of at least max(6, 4q) words that
    no neighbouring word extends; `runs` lists start, length and period, by start and then period. `collapsed` has the
    words that are in no run beyond its first q, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty `collapsed`. A text of any length is read whole. Rows
    that repeat a doc_id are one document (`one_per_document`); rows without one come back as they are. Further columns are
    ignored. Nothing is shuffled: each document is judged alone. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ready(spark)
    with small_batches(spark):
        found = one_per_document(docs, "text").select("doc_id", "text")
        return stored(found.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"), "runs")
