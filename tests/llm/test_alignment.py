import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stopclock.llm import alignment
from stopclock.llm.alignment import LEFT, RIGHT, align
from stopclock.llm.queries import QUERIES


def brute(rows):
    """doc_id to the contract's figures and groups, from the two libraries and loops over bytes."""
    a_side = Tokenizer.from_file(LEFT)
    a_side.encode_special_tokens = True
    letters = alignment._byte_letters()
    b_side = sentencepiece.SentencePieceProcessor(model_file=RIGHT)

    def piece(i):
        text = b_side.id_to_piece(i)
        return bytes([int(text[1:-1], 16)]) if b_side.is_byte(i) else text.replace("▁", " ").encode()

    cut, count, docs = {}, Counter(), {}
    for d, text in rows:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False)
        b = b_side.encode(text or "")
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a.ids]
        b_bytes = [piece(i) for i in b]
        body = (" " + (text or "")).encode()
        groups, links = [], []
        if text and b"".join(a_bytes) == body == b"".join(b_bytes):
            i = j = at_a = at_b = 0
            group = ([], [])
            while i < len(a.ids) or j < len(b):
                if at_a <= at_b:
                    group[0].append(a.ids[i])
                    at_a, i = at_a + len(a_bytes[i]), i + 1
                else:
                    group[1].append(b[j])
                    at_b, j = at_b + len(b_bytes[j]), j + 1
                if at_a == at_b:
                    groups.append(group)
                    links.append((group[0][-1], group[1][-1]))
                    group = ([], [])
            n = len(a.ids), len(b)
        else:
            n = 0, 0
        cut[d] = n, groups, links
        count.update(links)
        for pair in set(links):
            docs[pair] = docs.get(pair, 0) + 1
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    out = {}
    for d, (n, groups, links) in cut.items():
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[d] = (*n, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), shown)
    return out, {p: (docs[p], c, c == most[p[1]]) for p, c in count.items()}


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "l'été", "naïve", "don't", "x1", "123456", "<s>", "</s>", "<|endoftext|>", "<0x41>", "日本", "🙂", "ÄÖ", "á", "…", "  ", "\n", "\t", "\r\n", " "]
    out = [None, "", " ", "  ", "\n", "a", "▁", "a▁b", "\x00", "zero​width", "<s>", "x" * 5000, " " * 5000, "é" * 4200, "".join(rng.choice("abcdefgh") for _ in range(6000))]
    for _ in range(90):
        out.append(rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1 << 22), (2, 600)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = [(d, t) for d, t in enumerate(texts(seed))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pair int, block string").repartition(3)
    found = align(df)
    scores = found.documents.join(found.scores, ["block", "place"], "left").collect()
    want, pairs = brute(rows)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best or 0, r.count_sum or 0, r.groups) for r in scores} == want
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in found.pairs.collect()} == pairs
    assert sum(x[0] > 0 for x in want.values()) > 80 and any(x[0] == 0 for d, x in want.items() if d > 1)


def test_query_equals_brute_force_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, _ = brute(rows)
    got = QUERIES["op12_cross_tokenizer_alignment"](spark, folder).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: (*x[:6], digest(x[6])) for d, x in want.items()}
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("n_docs", [1, 9, 300, 70000])
def test_bitmaps_round_trip(n_docs):
    """Thin and wide bitmaps, missing digits, and counts of pairs and of documents."""
    n_docs = min(n_docs, alignment.BLOCK_DOCS)
    rng = np.random.default_rng(n_docs)
    pair = rng.integers(0, 12, 4000) ** 5
    place = rng.integers(0, n_docs, 4000)
    place[pair == 0] = place[pair == 0] // 50
    order = np.argsort(place, kind="stable")
    pair, place = pair[order], place[order]
    distinct, planes = alignment._packed(pair, place, n_docs)
    links = Counter(zip(pair.tolist(), place.tolist(), strict=True))
    for part, at in ((planes, 0), (planes.slice(2, 5), 2)):
        owner, digit, spot = alignment._unpacked(part)
        seen = Counter()
        for i, k, p in zip(owner.tolist(), digit.tolist(), spot.tolist(), strict=True):
            seen[int(distinct[at + i]), p] += 1 << k
        keep = set(distinct[at : at + len(part)].tolist())
        assert seen == {x: c for x, c in links.items() if x[0] in keep}
    counted = next(alignment._popcounts(iter([pa.RecordBatch.from_arrays([pa.array(distinct), planes], ["pair", "planes"])]))).to_pylist()
    for r in counted:
        assert r["docs"] == sum(p == r["pair"] for p, _ in links) and r["links"] == sum(c for (p, _), c in links.items() if p == r["pair"])


def test_ranks_and_the_tokenizer_itself_agree_on_every_letter():
    """The fast encoder against the file's own: every assigned code point between letters and alone."""
    side = alignment._vocabulary(open(LEFT, "rb").read())[0]
    assert side.fast is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 4096):
        text = " ".join(f"x{c}y {c}{c} 7{c}" for c in points[at : at + 4096])
        assert side.fast.encode_ordinary(text) == side.plain.encode(text, add_special_tokens=False).ids, hex(at)


def test_empty_table_and_repeated_ids(spark):
    none = align(spark.createDataFrame([], "doc_id long, text string"))
    assert none.documents.count() == none.pairs.count() == none.scores.count() == 0
    rows = [(1, "one two"), (1, "one two"), (None, "one"), (None, None), (2, "")]
    found = align(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_a, r.groups != "") for r in found.documents.collect()) == [("1", 2, True), ("2", 0, False), ("None", 0, False), ("None", 1, True)]
    assert sorted(r.docs for r in found.pairs.collect()) == [1, 2]
