import hashlib
import random
import zlib

import pytest

from stopclock.llm import periods, queries, words
from stopclock.llm.periods import periodic_runs


def brute(text):
    """Every maximal stretch of every period, tried one by one."""
    w = (text or "").encode().split()
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    runs = sorted((s, e - s, q) for (s, e), q in found.items())
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return n, runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x a b a b a b a b a y", "a\x0bb\x0cc a b c a b c a b c", "é é é é é é è"]
    for _ in range(160):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 60]))]
        w = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
            w += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    # nested runs, and one that rare words enclose layer by layer
    out.append(" ".join((["a"] * 6 + ["b"]) * 5))
    core = ["p", "q"] * 8
    for layer in range(6):
        core = [f"r{layer}"] + core + [f"r{layer}"] * 2
    out.append(" ".join(core))
    a, b = "a", "b"
    for _ in range(9):  # Thue-Morse: no run at all, and equal hashes for careless bases
        a, b = f"{a} {b}", f"{b} {a}"
    out.append(a)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = [(d, t, "x", 1) for d, t in enumerate(texts(seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int").repartition(4)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()}
    want = {d: brute(t) for d, t, _, _ in rows}
    assert got == want
    assert sum(len(x[1]) for x in want.values()) > 150


def test_long_texts_and_small_steps(monkeypatch):
    """Texts over a slab and a piece, and lags looked at in many steps."""
    import pyarrow as pa

    monkeypatch.setattr(periods, "STEP", 50)
    monkeypatch.setattr(words, "PIECE", 700)
    rng = random.Random(5)
    block = [f"v{rng.randrange(40)}" for _ in range(90)]
    column = [" ".join(block * 7 + ["end"]), None, " ".join(f"u{i}" for i in range(3000)), " ".join(["z"] * 900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(column)], ["doc_id", "text"])
    got = [r for out in periods._found(iter([batch])) for r in out.to_pylist()]
    assert [(r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]) for r in got] == [brute(t) for t in column]


def test_a_wrong_hash_is_found_out(monkeypatch):
    """With prefix hashes that call everything equal, the words themselves still decide."""
    import numpy as np

    monkeypatch.setattr(periods._Reach, "_same", lambda self, a, b, n: np.ones(len(a), bool))
    for text in texts(4):
        w = (text or "").split()
        codes = {x: i for i, x in enumerate(dict.fromkeys(w))}
        word = np.array([codes[x] for x in w], np.int64)
        runs = periods._runs(word, *periods._survivors(word, np.zeros(len(w), np.int64)))
        assert [(s, e - s, q) for s, e, q in runs.tolist()] == brute(text)[1]


def test_query_plants_periods_and_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = [(d, None if d % 17 == 0 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 120)))) for d in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for d, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        _, runs, kept = brute(" ".join(w))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


def test_empty_table_and_repeated_ids(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a " * 9), (1, "a " * 9), (None, "b c " * 5), (None, None)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, len(r.runs), r.collapsed) for r in got) == [("1", 9, 1, "a"), ("None", 0, 0, ""), ("None", 10, 1, "b c")]
