import random

import pytest

from stopclock.llm import minhash
from stopclock.llm.minhash import bands_for, even_join, minhash_duplicates
from stopclock.llm.queries import QUERIES
from tests.llm.test_near import brute


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (6, 9, 30, 60, 120, 200)]
    rows = [(-5, None), (-4, ""), (-3, " \n"), (-2, "One"), (-1, "one"), (-6, "one two three"), (-7, "One two\tthree")]
    for d in range(200):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        rows.append((d, " ".join(w)))
    # a chain: neighbours are similar, the ends are not
    chain = [f"c{i}" for i in range(200)]
    rows += [(500 + k, " ".join(chain[k * 3 : k * 3 + 110])) for k in range(14)]
    # many that share half of a page, none similar enough, but two pairs
    page = [f"p{i}" for i in range(80)]
    for k in range(40):
        own = [f"q{k // 2 if k < 4 else k}x{i}" for i in range(60)]
        rows.append((700 + k, " ".join(page + own + [f"e{k}"] * (k < 4))))
    return rows


@pytest.mark.parametrize("seed,size,percent,few", [(1, 5, 85, 256), (2, 4, 80, 2), (3, 5, 85, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, size, percent, few):
    """With `few` at 2 all buckets left are looked at through the differing tokens."""
    monkeypatch.setattr(minhash, "FEW", few)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2, "h") for d, t in rows], "doc_id long, text string, n int, node int, h1 string").repartition(5)
    found = minhash_duplicates(df, size, percent).collect()
    want = brute(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len({c for _, c in want.values()}) < len(rows) - 60


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_list_a_common_difference(percent):
    """Of any two similar sets, not both similar to the hub, the lists share a sig on fitting sides."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(percent)
    met = near = 0
    for _ in range(60):
        base = rng.sample(range(1, 10**9), rng.choice([7, 20, 60]))
        hub = set(rng.sample(base, rng.randint(len(base) // 2, len(base)))) | set(rng.sample(range(10**9, 2 * 10**9), rng.randint(0, 12)))
        sets = []
        for _ in range(24):
            loss = rng.choice([0, 1, 1, 2, 4, 9])
            sets.append(set(rng.sample(base, max(3, len(base) - loss))) | set(rng.sample(range(2 * 10**9, 2 * 10**9 + 40), rng.choice([0, 0, 1, 2, 5]))))
        sets = [s for s in {frozenset(s) for s in sets} if s != hub]
        body = lambda s: np.array(sorted(s), np.uint64).tobytes()
        rows = [pa.array([5] * len(sets)), pa.array(range(len(sets))), pa.array([body(s) for s in sets], pa.binary()), pa.array([body(hub)] * len(sets), pa.binary())]
        out = next(minhash._differing(percent)(iter([pa.RecordBatch.from_arrays(rows, ["hub", "node", "x", "y"])]))).to_pylist()
        listed = {}
        for r in out:
            listed.setdefault(r["node"], set()).add((r["sig"], r["side"], r["d"], r["place"]))
        like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if like(a, b) and not (like(a, hub) and like(b, hub)):
                    near += 1
                    take = (200 + 2 * percent, 100 + percent, 100 - percent)
                    met += any(
                        s == t and (x == 0 or x != y) and take[0] * (1 + min(d - p - 1, e - q - 1)) >= take[1] * (d + e) - take[2] * (len(a) + len(b))
                        for s, x, d, p in listed[i]
                        for t, y, e, q in listed[j]
                    )
    assert met == near > 100


def test_bands_bound_the_misses():
    for percent in (50, 80, 85, 99):
        assert (1 - (percent / 100) ** minhash.ROWS) ** bands_for(percent) <= minhash.MISSED
    assert minhash._tail(180, 0.85) < 130 and minhash._tail(180, 0.85) > 100


def test_even_join_deals_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 20)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    table = spark.createDataFrame([(k, k * 10) for k in range(0, 300, 2)] + [(1, 10)], "k long, x long")
    got = even_join(rows, table, ["k"], "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
    assert even_join(rows, table, ["k"], "v", "left").count() == 300


def test_empty_table_and_missing_ids(spark):
    assert minhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (4, "A b c d e f")]
    got = minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [("3", 2, 3, True), ("4", 2, 3, False), ("None", 0, None, True), ("None", 2, None, True)]
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_query_on_given_documents_equals_the_other_join(spark):
    """The registered query over whole sf0.001 against an exact join by another method."""
    from stopclock.llm.near import near_duplicates

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r.component_id for r in QUERIES["op11_minhash_near_dedup"](spark, folder).collect()}
    want = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), 5, 85).collect()
    assert got == {r.doc_id: r.component_id for r in want}
