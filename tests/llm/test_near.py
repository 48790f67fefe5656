import random

import pytest

from stopclock.llm.near import near_duplicates


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 80)])
def test_equals_brute_force(spark, seed, size, percent):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (9, 12, 40, 90, 200, 200)]
    rows = [(-5, None), (-4, ""), (-3, " \n"), (-2, "One"), (-1, "one"), (-6, "one two three"), (-7, "one two three four")]
    for d in range(170):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 13])):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        rows.append((d, " ".join(w)))
    # a chain: neighbours are similar, the ends are not
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):
        rows.append((500 + k, " ".join(chain[k * 3 : k * 3 + 70])))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, node int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size, percent).collect()}
    want = brute(rows, size, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_empty_table_and_missing_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("3", 2, 3), ("None", 0, None), ("None", 2, None)]
