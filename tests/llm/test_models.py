import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stopclock.llm import toxicity
from stopclock.llm.brown import Settings, score_texts
from stopclock.llm.mixing import mix
from stopclock.llm.toxicity import score_toxicity


def corpus(rng, n):
    """Two languages of nouns and verbs that take turns."""
    words = {g: ([f"{g}noun{i}" for i in range(12)], [f"{g}verb{i}" for i in range(12)]) for g in "xy"}
    out = []
    for d in range(n):
        nouns, verbs = words["xy"[d % 2]]
        out.append((d, " ".join(rng.choice(nouns).upper() if rng.random() < 0.1 else rng.choice((nouns, verbs)[i % 2]) for i in range(rng.randint(4, 40)))))
    return out


def test_scores_of_the_class_model(spark):
    rows = corpus(random.Random(1), 150) + [(900, None), (901, ""), (902, "never met words"), (None, "xnoun1")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n long, token long").repartition(3)
    training = F.col("doc_id") % 10 != 0
    settings = Settings(classes=6, clustered=64, groups=16, lexicon=20)
    got = {r.doc_id: r for r in score_texts(frame, training, settings).collect()}
    tokens = {d: (t or "").lower().encode().split() + [None] for d, t in rows if d is not None}
    counts = Counter(x for d, w in tokens.items() if d % 10 for x in w)
    total, distinct = sum(counts.values()), len(counts)
    assert set(got) == set(tokens)
    for d, w in tokens.items():
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(w)))
    held = [r for d, r in got.items() if d % 10 == 0 and d < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)


def test_scores_without_training_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(frame, F.lit(False)).collect()}
    assert {d: (r.n_tokens, r.n_known, r.train_tokens) for d, r in got.items()} == {1: (3, 0, 0), 2: (1, 0, 0)}
    assert got[1].base_score == pytest.approx(0) and math.isfinite(got[1].score)
    assert score_texts(frame.limit(0), F.lit(True)).count() == 0


def test_toxicity_learns_gapped_insults(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeiounrstlhd") for _ in range(rng.randint(3, 10))) for _ in range(300)]
    bad = ["grumblor", "flimwit", "snorkpat", "dribzel"]
    rows, labels = [], []
    for d in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((d, ". ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))))
        if d % 3:
            labels.append((d, int(toxic)))
    rows += [(1000, "you g.r.u.m.b.l.o.r there"), (1001, "F L I M W I T"), (1002, "snork-pat! and more"), (1003, None), (1004, ""), (1005, " ".join(plain)), (None, "flimwit")]
    labels += [(5000, 1), (7, None), (8, 9)]
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(frame, known, F.col("doc_id") % 5 != 0).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    wrong = [d for d in range(400) if got[d].predicted != int(d % 4 == 0)]
    assert len(wrong) <= 8
    assert [got[d].predicted for d in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 1]
    assert score_toxicity(frame.limit(0), known, F.lit(True)).count() == 0
    none = score_toxicity(frame, known.limit(0), F.lit(True)).collect()
    assert {r.predicted for r in none} == {0}


def test_toxicity_meets_widely_spaced_insults_inside_long_words():
    marks = [b"idiot", b"worthless", b"disgusting"]
    landmarks = toxicity.Landmarks(np.stack([np.frombuffer(m.ljust(toxicity.WIDTH, b" "), np.uint8) for m in marks]) % 96 % 32, toxicity.Settings())
    spread = lambda word, gap: gap.join(word)
    cases = [
        (spread("idiot", "....."), 0), (spread("idiot", "      "), 0), (spread("disgusting", "--"), 2), ("*" * 11 + spread("worthless", "."), 1),
        ("q.z." * 20 + spread("disgusting", "_-_") + ".z.q" * 20, 2), ("." * 9 + spread("youidiotgoaway" * 2, " "), 0), ("zq" * 2043 + "idiot" + "zq" * 40, 0),
    ]
    for text, mark in cases:
        units = toxicity._units(pa.array([text], pa.large_string()))
        which, values = landmarks.values(units)
        assert max(values[which[u]][mark] for u in range(len(which)) if which[u] >= 0) > 0.8, text
    alone = landmarks.values(toxicity._units(pa.array(["q.z." * 20 + "d.i.s.g.u.s.t", "x" * 4000 + "idio" + "x" * 100 + "t"], pa.large_string())))[1]
    assert not alone.size or alone.max() < 0.5


def shares(children, given):
    taken, open_ = {}, dict(children)
    while open_:
        rate = max(given - sum(taken.values()), 0) / sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c <= rate * w + 1e-9]
        if not full:
            break
        for k in full:
            taken[k] = open_.pop(k)[0]
    return taken | {k: w * rate for k, (_, w) in open_.items()}


def brute_mix(rows, total, weights, seed, epochs, domain=None):
    leaf = defaultdict(list)
    for d, t, lang, source in {r[0]: r for r in rows if r[0] is not None}.values():
        n = len((t or "").split())
        if n:
            letters = domain[source] if domain else "".join(c for c in (source or "unknown") if not c.isdigit()) or "unknown"
            leaf[(letters, lang or "unknown", source or "unknown")].append((d, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}

    def down(prefix, given, depth):
        names = {k[: depth + 1] for k in tokens if k[:depth] == prefix}
        kids = {n: (sum(epochs * c for k, c in tokens.items() if k[: depth + 1] == n), weights.get("/".join(n), 1.0)) for n in names}
        got = shares(kids, given)
        return got if depth == 2 else {k: v for n, g in got.items() for k, v in down(n, g, depth + 1).items()}

    out = []
    for k, b in down((), sum(tokens.values()) * total, 0).items():
        b = int(round(b, 3))
        whole = min(epochs, b // tokens[k])
        out += [(d, e) for e in range(whole) for d, _ in leaf[k]]
        rest = b - whole * tokens[k]
        if whole < epochs:
            for d, n in sorted(leaf[k], key=lambda x: hashlib.md5(f"{seed}|{whole}|{x[0]}".encode()).hexdigest()):
                if n > rest:
                    break
                rest -= n
                out.append((d, whole))
    return sorted(out)


@pytest.mark.parametrize("total", [0.4, 1.3, 5.0])
def test_mixture_equals_brute_force(spark, total):
    rng = random.Random(6)
    rows = [(d, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), rng.choice(["web1", "web2", "book1", "7", None])) for d in range(300)]
    rows += [(900, None, "en", "web1"), (None, "a b", "en", "web1")]
    weights = {"web": 3.0, "web/en": 5.0, "book": 0.5, "web/en/web1": 2.0}
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, lang string, source string, epoch int, bucket int")
    given = spark.createDataFrame(list(weights.items()), "name string, weight double")
    drawn = mix(frame, total, given, seed=3, epochs=2, per_bucket=7)
    assert sorted((r.doc_id, r.epoch) for r in drawn.collect()) == brute_mix(rows, total, weights, 3, 2)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixture_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mix(frame, 0.5).count() == 0
