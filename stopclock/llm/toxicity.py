"""Toxicity scores: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of three letters, each weighed down by its length in either string, so
letters may be spread or other characters put between them; any run of them counts as one. A sentence meets a
landmark by its best matching word, or by the best matching stretch of a word longer than a landmark can be. The machine learns from labelled sentences: those of toxic documents count as toxic only where they score
as such, and each toxic document keeps its most toxic sentence.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, ready
from stopclock.llm.words import slabs, words_of


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents per class that are learned from at most, once per text, of at most `longest` code
    points each; both bound what reaches the driver. landmarks: kernel landmarks at most.
    support: share of the toxic documents that hold a landmark, at least. decay: weight of each letter a subsequence
    spans. power: the normalised kernel is taken to this power. share: a word meets a landmark only if it holds
    this share of its distinct letters."""

    sample: int = 1500
    longest: int = 20_000
    landmarks: int = 128
    support: float = 0.01
    decay: float = 0.9
    power: int = 12
    share: float = 0.9
    penalty: float = 10.0


#: Symbols: letters, then non-ASCII letters by their last byte; 0 is any other character and matches nothing.
SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[0x61:0x7B] = np.arange(1, 27)
SYMBOLS[0x80:0xC0] = 27 + np.arange(64) % 37
DROPPED = np.zeros(256, bool)
DROPPED[0xC0:] = True
#: Symbols of a landmark at most; letters of it with one symbol between each two span less than twice as many. Longer
#: words are gone through in pieces.
WIDTH, PIECE = 24, 1 << 12
STOPS = np.zeros(256, bool)
STOPS[[0x2E, 0x21, 0x3F]] = True


@dataclass
class Units:
    """Distinct words of a slab as rows of their first symbols, and where each occurrence is. `stream` holds all symbols,
    those of a word from `start` to `end`."""

    symbols: np.ndarray
    stream: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    occurrence: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def _units(texts: pa.Array) -> Units:
    words = words_of(texts, lower=True)
    row = words.row
    count = len(row)
    # letters that stand alone in a run are one word
    alone = np.append((words.end - words.start) <= 2, False)
    alone[:count] &= (SYMBOLS[words.data[words.end - 1]] > 0) | (SYMBOLS[words.data[words.start]] > 0)
    joined = alone[:-1] & alone[1:] if count else alone[:0]
    joined[: count - 1] &= row[1:] == row[:-1]
    opens = np.ones(count, bool)
    opens[1:] = ~joined[: count - 1]
    head = np.flatnonzero(opens)
    last = np.append(head[1:], count) - 1
    # sentences end at stops and line breaks
    lines = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    breaks = np.zeros(count, bool)
    if count:
        breaks[1:] = STOPS[words.data[words.end[:-1] - 1]] | (lines[words.start[1:]] > lines[words.end[:-1]]) | (row[1:] != row[:-1])
    sentence = np.cumsum(breaks)[head] if count else head
    key = words.stretch(head, last + 1)
    key, first, occurrence = np.unique(key, return_index=True, return_inverse=True)
    start, end = words.start[head[first]], words.end[last[first]]
    # lead bytes take no room, and a run of what is no letter takes one symbol
    at = np.flatnonzero(~DROPPED[words.data])
    stream = SYMBOLS[words.data[at]]
    kept = stream > 0
    kept[1:] |= stream[:-1] > 0
    at, stream = at[kept], stream[kept]
    start, end = np.searchsorted(at, start), np.searchsorted(at, end)
    spot = start[:, None] + np.arange(WIDTH)
    inside = spot < end[:, None]
    symbols = np.zeros(inside.shape, np.uint8)
    symbols[inside] = stream[spot[inside]]
    return Units(symbols, stream, start, end, key, occurrence, row[head], sentence)


def _kernel(s: np.ndarray, t: np.ndarray, decay: float) -> np.ndarray:
    """Subsequence kernel of order 3 between rows of s and rows of t."""
    pairs, n = s.shape
    m = t.shape[1]
    t = np.ascontiguousarray(t.T)
    s = np.ascontiguousarray(s.T)
    square = np.float32(decay * decay)
    decay = np.float32(decay)
    used = np.flatnonzero(t.any(1))
    m = int(used[-1]) + 1 if len(used) else 0
    used = np.flatnonzero(s.any(1))
    n = int(used[-1]) + 1 if len(used) else 0
    # one[k], two[k]: kernels of order 1 and 2 up to here in s and k in t, weighed to the end of both
    one = np.zeros((m + 1, pairs), np.float32)
    two = np.zeros((m + 1, pairs), np.float32)
    total = np.zeros(pairs, np.float32)
    for j in range(n):
        if not s[j].any():
            one *= decay
            two *= decay
            continue
        run_one = np.zeros(pairs, np.float32)
        run_two = np.zeros(pairs, np.float32)
        before_one, before_two = one[0].copy(), two[0].copy()
        for k in range(1, m + 1):
            same = ((s[j] == t[k - 1]) & (s[j] > 0)).astype(np.float32) * square
            total += same * before_two
            run_two = decay * run_two + same * before_one
            run_one = decay * run_one + same
            before_one, before_two = one[k].copy(), two[k].copy()
            one[k] = decay * one[k] + run_one
            two[k] = decay * two[k] + run_two
    return total


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return first, np.append(first[1:], len(values))[: len(first)]


class Landmarks:
    """Kernel values of units with each landmark, between 0 and 1."""

    def __init__(self, symbols: np.ndarray, settings: Settings):
        self.symbols, self.settings = symbols, settings
        self.own = np.maximum(self._self(symbols), 1e-12)
        self.letters = self._letters(symbols)
        self.needed = np.ceil(self.letters.sum(1) * settings.share)

    def _self(self, symbols: np.ndarray) -> np.ndarray:
        return _kernel(symbols, symbols, self.settings.decay)

    @staticmethod
    def _letters(symbols: np.ndarray) -> np.ndarray:
        out = np.zeros((len(symbols), 64), np.float32)
        out[np.arange(len(symbols))[:, None], symbols] = 1
        out[:, 0] = 0
        return out

    def values(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """For each unit the number of its row of values or -1, and the rows."""
        length = units.end - units.start
        short = np.flatnonzero(length <= WIDTH)
        common = self._letters(units.symbols[short]) @ self.letters.T
        at, mark = np.nonzero(common >= self.needed)
        value = self._compared(units.symbols[short], at, mark)
        long, best = self._stretches(units, np.flatnonzero(length > WIDTH))
        met, other = np.nonzero(best)
        unit = np.concatenate([short[at], long[met]])
        mark, value = np.concatenate([mark, other]), np.concatenate([value, best[met, other]])
        which = np.full(len(length), -1)
        held = np.unique(unit)
        which[held] = np.arange(len(held))
        out = np.zeros((len(held), len(self.symbols)), np.float32)
        out[which[unit], mark] = value
        return which, out

    def _compared(self, symbols: np.ndarray, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Values of the rows `at` of symbols with one landmark each."""
        rows, inverse = np.unique(at, return_inverse=True)
        own = np.empty(len(rows), np.float32)
        value = np.empty(len(at), np.float32)
        for a in range(0, len(rows), 8192):
            own[a : a + 8192] = self._self(symbols[rows[a : a + 8192]])
        for a in range(0, len(at), 8192):
            value[a : a + 8192] = _kernel(symbols[at[a : a + 8192]], self.symbols[mark[a : a + 8192]], self.settings.decay)
        value /= np.sqrt(np.maximum(own[inverse], 1e-12) * self.own[mark])
        return value**self.settings.power

    def _stretches(self, units: Units, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given units and, per landmark, the value of the stretch that matches it best. A stretch spans less than twice
        the landmark, holds the letters it needs and has one of them at either end: to cut off others only adds to the value."""
        best = np.zeros((len(long), len(self.symbols)), np.float32)
        size = units.end[long] - units.start[long]
        pieces = -(-size // PIECE)
        of = np.repeat(np.arange(len(long)), pieces)
        first = units.start[long][of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        last = np.minimum(first + PIECE + 2 * WIDTH, units.end[long][of])
        group = np.cumsum(last - first) // (4 * PIECE)
        for a, b in zip(*_runs(group), strict=True):
            count = (last - first)[a:b]
            opens = np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(of[a:b], count)
            spot = np.arange(len(opens))
            text = units.stream[np.repeat(first[a:b], count) + spot - opens]
            met = np.zeros((64, len(text)), np.int64)  # where each symbol was last, from 1
            met[text, spot] = spot + 1
            np.maximum.accumulate(met, axis=1, out=met)
            for m in range(len(self.symbols)):
                letters = np.flatnonzero(self.letters[m])
                spare = int(len(letters) - self.needed[m])
                span = max(WIDTH, 2 * len(np.trim_zeros(self.symbols[m], "b")) - 1)
                latest = np.partition(met[letters], spare, axis=0)[spare] - 1
                mine = np.isin(text, letters)
                ends = np.flatnonzero(mine & (latest >= np.maximum(opens, spot - span + 1)))
                for c in range(0, len(ends), 1024):
                    end = ends[c : c + 1024]
                    begin = end[:, None] - np.arange(span)
                    fits = (begin >= opens[end][:, None]) & (begin <= latest[end][:, None])
                    fits &= mine[np.maximum(begin, 0)]
                    e, k = np.nonzero(fits)
                    wide = begin[e, k][:, None] + np.arange(span)
                    within = wide <= end[e][:, None]
                    stretch = np.where(within, text[np.minimum(wide, len(text) - 1)], 0).astype(np.uint8)
                    stretch, inverse = np.unique(stretch, axis=0, return_inverse=True)
                    value = self._compared(stretch, np.arange(len(stretch)), np.full(len(stretch), m))
                    np.maximum.at(best[:, m], owner[end[e]], value[inverse.ravel()])
        return long, best

    def sentences(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence and row numbers and values of the sentences that meet a landmark."""
        which, values = self.values(units)
        place = which[units.occurrence] if len(units.occurrence) else np.zeros(0, np.int64)
        take = np.flatnonzero(place >= 0)
        if not len(take):
            return take, take, np.zeros((0, len(self.symbols)), np.float32)
        first = np.flatnonzero(np.diff(units.sentence[take], prepend=-1))
        bounds = np.append(first, len(take))
        best = np.empty((len(first), len(self.symbols)), np.float32)
        for a in range(0, len(first), 4096):  # bounded copies of rows
            lo, hi = bounds[a], bounds[min(a + 4096, len(first))]
            best[a : a + 4096] = np.maximum.reduceat(values[place[take[lo:hi]]], first[a : a + 4096] - lo, axis=0)
        return units.sentence[take][first], units.row[take][first], best


@dataclass
class Model:
    landmarks: Landmarks | None
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def _machine(x: np.ndarray, y: np.ndarray, importance: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear squared-hinge support vector machine by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        margin = y * (x @ w)
        active = margin < 1
        c = penalty * importance[active]
        xa = x[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, xa.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _chosen(texts: pa.Array, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """Symbols of the landmarks: the words that tell toxic documents apart most, no two nearly alike."""
    keys, looks = [np.zeros(0, np.uint64)], [np.zeros((0, WIDTH), np.uint8)]
    seen, where = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for a, b in slabs(texts):
        units = _units(texts.slice(a, b - a))
        unit, row = np.unique(np.stack([units.occurrence, units.row]), axis=1)
        keys.append(units.key)
        looks.append(units.symbols)
        seen.append(units.key[unit])
        where.append(toxic[row + a])
    key, first = np.unique(np.concatenate(keys), return_index=True)
    looks = np.concatenate(looks)[first]
    at, where = np.searchsorted(key, np.concatenate(seen)), np.concatenate(where)
    bad, good = np.bincount(at[where], minlength=len(key)), np.bincount(at[~where], minlength=len(key))
    # toxic documents that would hold the word if it told nothing
    chance = toxic.sum() / max((~toxic).sum(), 1) * (good + 0.5)
    gain = (bad - chance) / np.sqrt(chance)
    usable = (bad >= max(3, settings.support * toxic.sum())) & (bad > 4 * chance) & ((looks > 0).sum(1) >= 3)
    table = [(gain[i], looks[i].tobytes()) for i in np.flatnonzero(usable)]
    table.sort(reverse=True)
    chosen: list[np.ndarray] = []
    for gain, k in table[: settings.landmarks * 4]:
        if gain < 3 or len(chosen) == settings.landmarks:
            break
        mark = np.frombuffer(k, np.uint8)
        if chosen:
            book = np.stack(chosen)
            same = _kernel(book, np.repeat(mark[None], len(book), 0), settings.decay)
            own = _kernel(book, book, settings.decay) * _kernel(mark[None], mark[None], settings.decay)
            if (same / np.sqrt(np.maximum(own, 1e-12))).max() > 0.95:
                continue
        chosen.append(mark)
    return np.stack(chosen) if chosen else np.zeros((0, WIDTH), np.uint8)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the texts of a bounded sample of the labels of each class, chosen by a hash of the doc_id. One task
    learns from the sample; only the model reaches the driver."""
    total = dict(labels.groupBy("toxic").count().where(F.col("toxic").isin(0, 1)).collect())
    if len(total) < 2:  # nothing to tell apart
        return Model(None, np.zeros(0), 0.0, 1.0, 8.0 if 1 in total else -8.0)
    picked = None
    for label in (0, 1):
        ids = labels.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(settings.sample)
        picked = ids.select("doc_id", "toxic") if picked is None else picked.unionByName(ids.select("doc_id", "toxic"))
    sample = docs.join(F.broadcast(picked), "doc_id")  # at most twice `sample` ids
    sample = sample.where(F.length("text") <= settings.longest).select("toxic", "text").distinct()

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("toxic", pa.int64()), ("text", pa.large_string())])).sort_by([("toxic", "ascending"), ("text", "ascending")])
        toxic = rows.column(0).to_numpy() == 1
        model = _learned(rows.column(1).combine_chunks(), toxic, total, settings)
        marks = model.landmarks.symbols if model.landmarks else np.zeros((0, WIDTH), np.uint8)
        numbers = [*model.weight.tolist(), model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary()), pa.array([numbers], pa.list_(pa.float64()))], ["marks", "numbers"])

    one = sample.select(F.col("toxic").cast("long"), "text").coalesce(1)
    made = one.mapInArrow(lambda batches: learned(_large(batches)), "marks binary, numbers array<double>").first()
    if made is None:  # no labelled text
        return Model(None, np.zeros(0), 0.0, 1.0, -8.0)
    marks, numbers = made
    symbols = np.frombuffer(marks, np.uint8).reshape(-1, WIDTH)
    return Model(Landmarks(symbols, settings) if len(symbols) else None, np.array(numbers[:-3]), *numbers[-3:])


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string())], ["toxic", "text"])


def _learned(texts: pa.Array, toxic: np.ndarray, total: dict[int, int], settings: Settings) -> Model:
    bad, clean = int(toxic.sum()), int((~toxic).sum())
    marks = _chosen(texts, toxic, settings) if bad and clean else ()
    if not len(marks):
        return Model(None, np.zeros(0), 0.0, 1.0, -8.0 if clean or not bad else 8.0)
    landmarks = Landmarks(marks, settings)
    found = [(np.zeros(0, np.int64), np.zeros((0, len(landmarks.symbols)), np.float32))]
    for a, b in slabs(texts):
        _, row, values = landmarks.sentences(_units(texts.slice(a, b - a)))
        found.append((row + a, values))
    row, values = (np.concatenate(x) for x in zip(*found, strict=True))
    # Nyström: the kernel among landmarks whitens the values
    size = len(landmarks.symbols)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(size), np.arange(size), indexing="ij"))
    gram = (_kernel(landmarks.symbols[i], landmarks.symbols[j], settings.decay) / np.sqrt(landmarks.own[i] * landmarks.own[j])).reshape(size, size)
    gram = gram**settings.power
    level, basis = np.linalg.eigh(gram.astype(np.float64))
    white = basis @ np.diag(1 / np.sqrt(np.maximum(level, 1e-3))) @ basis.T
    x = values.astype(np.float64) @ white
    y = np.where(toxic[row], 1.0, -1.0)
    # the sample takes as many of either class: each document stands for its share of the labels
    importance = np.where(toxic, total[1] / bad, total[0] / clean) / min(total[1] / bad, total[0] / clean)
    weight, bias = np.zeros(size), 0.0
    for turn in range(4):
        weight, bias = _machine(x, y, importance[row], settings.penalty)
        f = x @ weight + bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, f)
        # a toxic document keeps its best sentence; later, if no sentence bears its label out, it teaches nothing
        y = np.where(toxic[row] & ((f > 0) | (turn < 2) & (f >= best[row])), 1.0, -1.0)
        keep = ~toxic[row] | (y > 0)  # what a toxic document says besides teaches nothing
        if turn < 3:
            x, y, row = x[keep], y[keep], row[keep]
    best = np.maximum(best, bias)
    slope, shift = _calibrated(best, toxic, importance)
    return Model(landmarks, white @ weight, bias, slope, shift)


def _calibrated(f: np.ndarray, toxic: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of a document's best sentence."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    c = importance / importance.sum()
    x = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (c * (p - target)) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            texts, best = batch.column(1), np.full(batch.num_rows, fitted.bias)
            if fitted.landmarks is not None:
                for a, b in slabs(texts, 1 << 20):
                    _, row, values = fitted.landmarks.sentences(_units(texts.slice(a, b - a)))
                    np.maximum.at(best, row + a, values @ fitted.weight + fitted.bias)
            score = 1 / (1 + np.exp(-np.clip(fitted.slope * best + fitted.shift, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, training, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for every document: 0 to 1, and 1 where the score is 0.5 or more.

    The model is fitted on rows of `labels` (doc_id, toxic) for which the column condition `training` holds, and
    their texts. Only the text counts for a score.

    Null and empty texts have no sentence and get the score of a text that meets no landmark. Labels that are null
    or not 0 or 1 are ignored; with labels of one class alone every score says that class, with none 0. Rows that
    repeat a doc_id are one document (`one_per_document`); rows without one are scored, and never learned from. Of
    repeated labels the least counts. Further columns are ignored.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = one_per_document(docs, "text")
    known = one_per_document(labels, "toxic").where("doc_id is not null").where(training)
    model = spark.sparkContext.broadcast(fit(docs, known, settings))
    scored = docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
