import math
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from foliant.llm import hmm


def model(k=3, c=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))), 0.05 * rng.random(k))


def paths(m, seq):
    table = m.table()
    for p in product(range(len(m.start)), repeat=len(seq)):
        x = m.start[p[0]] * table[seq[0], p[0]]
        for a, b, o in zip(p, p[1:], seq[1:]):
            x *= m.move[a, b] * table[o, b]
        yield p, x


def test_forward_and_counts_against_all_paths():
    m, seqs = model(), [[0, 2, 3], [1], [4, 4, 0, 2, 3]]
    flat, n = np.concatenate(seqs).astype(np.uint16), np.array([len(s) for s in seqs])
    starts = np.append(0, np.cumsum(n)[:-1])
    assert np.allclose(hmm.forward(m, flat, starts, n), [math.log10(sum(x for _, x in paths(m, s))) for s in seqs])
    flat = flat | np.array([0, 0, 1, 0, 1, 0, 0, 0, 0], np.uint16) * hmm._ONCE  # words seen once count by their class
    assert np.allclose(hmm.forward(m, flat, starts, n), hmm.forward(m, flat & (hmm._ONCE - 1), starts, n))
    a, b, e, once, total = hmm.expected_counts(m, flat, starts, n)
    a2, b2, e2, once2 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), np.zeros(3)
    for s, own in zip(seqs, np.split(flat >= hmm._ONCE, starts[1:])):
        whole = sum(x for _, x in paths(m, s))
        for p, x in paths(m, s):
            a2[p[0]] += x / whole
            for i, j in zip(p, p[1:]):
                b2[i, j] += x / whole
            for i, o, rare in zip(p, s, own):
                e2[i, o] += x / whole
                once2[i] += rare * x / whole
    assert np.allclose(a, a2) and np.allclose(b, b2) and np.allclose(e, e2) and np.allclose(once, once2)


@pytest.mark.parametrize("segment", [1, 3, 7, 64])
def test_cut_sequences_count_as_whole_ones(monkeypatch, segment):
    rng = np.random.default_rng(1)
    n = np.array([2, 40, 1, 65, 9, 64])
    flat = rng.integers(0, 5, n.sum()).astype(np.uint16) | (rng.random(n.sum()) < 0.2).astype(np.uint16) * hmm._ONCE
    starts = np.append(0, np.cumsum(n)[:-1])
    whole, score = hmm.expected_counts(model(), flat, starts, n), hmm.forward(model(), flat, starts, n)
    monkeypatch.setattr(hmm, "LONG", 1)
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "PLACES_AT_ONCE", 20)
    assert np.allclose(hmm.forward(model(), flat, starts, n), score, rtol=1e-12)
    assert all(np.allclose(a, b, rtol=1e-10) for a, b in zip(hmm.expected_counts(model(), flat, starts, n), whole))


def test_memory_is_bounded_by_places_at_once():
    flat, m = np.random.default_rng(3).integers(0, 1500, 5_000_000).astype(np.uint16), model(8, 1514)
    tracemalloc.start()
    counts = hmm.expected_counts(m, flat, np.array([0]), np.array([len(flat)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and counts[2].sum() == pytest.approx(len(flat)) and counts[1].sum() == pytest.approx(len(flat) - 1)
    assert counts[4] == pytest.approx(hmm.forward(m, flat, np.array([0]), np.array([len(flat)]))[0])


def test_long_texts_have_the_same_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f" A\u00a0b\x0bc{i}\td  e\x1cf\n" * 3 + t) for i, t in enumerate(["", "x", "y z\r\n", " "])], "doc_id long, text string")
    whole = sorted(map(tuple, hmm.score_documents(docs, states=2, rounds=1).collect()))
    monkeypatch.setattr(hmm, "LONG_TEXT", 0)
    assert sorted(map(tuple, hmm.score_documents(docs, states=2, rounds=1).collect())) == whole


def test_chances_sum_to_one():
    m = model()
    m.emit[:, hmm._UNKNOWN] = 0  # as training leaves it
    m.emit /= m.emit.sum(1, keepdims=True)
    assert np.allclose(m.table().sum(0), 1)


def test_long_sequence_does_not_underflow():
    flat = np.tile(np.array([0, 2, 3], np.uint16), 50_000)
    assert np.isfinite(hmm.forward(model(), flat, np.array([0]), np.array([150_000])))[0]


@pytest.mark.parametrize("block, common", [(16 << 20, 20_000), (600, 20_000), (600, 0), (600, 5)])
def test_contract_columns(spark, docs, rows, monkeypatch, block, common):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", block)
    monkeypatch.setattr(hmm, "COMMON_WORDS", common)
    found = hmm.score_documents(docs.unionByName(docs.where("doc_id = 7")), states=3, rounds=2).collect()
    assert len(found) == len(rows) + 1
    own = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in rows] + [(7, rows[6][1].encode().lower().split() + [b""])]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in own if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    by = {i: t for i, t in own}
    for r in found:
        t = by[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] <= 0


def test_training_helps_and_empty(spark, empty):
    rng = np.random.default_rng(2)
    words = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    texts = [" ".join(rng.choice(words[i % 2], 60)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = hmm.score_documents(docs, states=2, rounds=6).where("held_out").collect()
    assert sum(r["score"] for r in found) > 0.95 * sum(r["base_score"] for r in found)
    assert hmm.score_documents(empty).count() == 0
