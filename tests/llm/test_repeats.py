import random

import pytest

from stopclock.llm.repeats import remove_repeats


def brute(rows, n):
    first = {}
    texts = {d: (t or "").split() for d, t in rows if d is not None}
    for d, w in texts.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed == 1 else 6)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = [(None, "no id " * 20), (900, None), (901, ""), (902, " \n\t ")]
    for d in range(120):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            words += p[a:b] if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        rows.append((d * 3 - 50, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(2000, " ".join(passages[0] * 30)), (2001, " ".join(passages[0] * 30))]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, spans int").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect()}
    want = brute(rows, 13)
    assert got.pop(None)[1] == 0
    assert got == want
    assert sum(x[1] for x in want.values()) > 500


def test_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    text = " ".join(f"t{i}" for i in range(30))
    got = remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.cuts) for r in got) == [(1, 30, 0, []), (2, 30, 30, [0, 30])]
