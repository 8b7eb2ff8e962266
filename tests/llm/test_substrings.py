import hashlib
import random

import pytest

from foliant.llm import substrings, suffixes


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()}
    assert found == brute(rows)


def test_docs(docs):
    check(docs)


def test_many(many):
    check(many)


@pytest.mark.parametrize("most", [2_048, 3])
def test_large_groups_are_split(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_RECORDS", most)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    rows = [(i, noise(rng.randint(0, 150)) + passage[rng.randint(0, 30) : 260 - rng.randint(0, 30)] + noise(rng.randint(0, 150))) for i in range(40)]
    rows += [(100 + i, "z" * rng.randint(90, 400)) for i in range(6)] + [(200, "ab" * 300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh") for _ in range(substrings.CHUNK // 2))
    tail = "".join(rng.choice("ijkl") for _ in range(1000))
    check(spark.createDataFrame([(1, part + part + tail), (2, tail + part[:5000])], "doc_id long, text string"))


def test_repeated_rows_text_column_and_empty(docs, empty):
    once = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    twice = substrings.remove_repeats(docs.unionByName(docs), text_column=True)
    assert set(twice.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "n_removed"}
    left = {}
    for r in twice.collect():
        left.setdefault(r["doc_id"], []).append(r["n_removed"])
        assert r["n_removed"] < 100 or len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"]
    for r in docs.collect():
        n = len((r["text"] or "").encode())
        assert sorted(left[r["doc_id"]]) == sorted([once[r["doc_id"]], n if n >= 100 else 0])
    assert substrings.remove_repeats(empty).count() == 0


def test_deep_shallow_sort_orders_strings():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(50)] + [b"a" * 60] * 4
    trie = suffixes.BlindTrie(60)
    for i, t in enumerate(texts):
        trie.insert(t, i)
    got = [[texts[i] for i in g] for g in trie.groups()]
    assert [g[0] for g in got] == sorted(set(texts)) and sum(map(len, got)) == len(texts)
    import numpy as np

    runs = suffixes.equal_runs(texts, np.zeros(54, np.int64), np.arange(54), np.zeros(54, np.int64), 60)
    assert [sorted(r) for r in runs] == [[50, 51, 52, 53]]


def test_multikey_quicksort_orders_by_letters():
    import numpy as np

    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab\xff") for _ in range(3)) * 8 + bytes([rng.choice(b"xy")]) * 8 for _ in range(300)] + [b"q" * 32] * 90
    flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    for letters, group in ((3, [0] * 390), (4, [i // 130 for i in range(390)]), (0, [0] * 390)):
        order, tied = suffixes.multikey_quicksort(suffixes._eights(flat), np.arange(390) * 32, np.array(group), letters)
        key = [(group[i], texts[i][: 8 * letters]) for i in order.tolist()]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(390))
        runs, a = [], 0
        for i in range(1, 391):
            if i == 390 or key[i] != key[a]:
                runs += [(a, i)] if i - a > 1 else []
                a = i
        assert tied == runs
