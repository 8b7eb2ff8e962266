import random

import pytest

import corpus_pipeline
from foliant.llm import similar
from tests.llm.conftest import SCHEMA, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def expected_ids(rows):
    """The smallest id of each group of links at 0.8 and above, and every text without words."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def near(spark):
    """Copies edited at one to seven places of 120 to 240 words: similarities on both sides of 0.8."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = words(2000 + i, rng.randint(120, 240)).split()
        for edits in range(7):
            own = list(w)
            for at in rng.sample(range(len(own)), edits):
                own[at] = f"x{i}y{edits}z{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b")]
    rng.shuffle(rows)
    return rows


def test_pipeline_links_at_similarity(spark, near):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in near], SCHEMA).repartition(4)
    found = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(expected_ids(near))


@pytest.mark.parametrize("common, crowd", [(0, 1), (50, 64), (100_000, 3)])
def test_any_order_and_any_crowd(spark, monkeypatch, many, common, crowd):
    """Whatever counts as common, and however few sets make a crowd, the links are the same."""
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "CHUNK", 4)
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    found = similar.keep_one_of_similar(many).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(expected_ids(rows))


def test_empty(empty):
    assert similar.keep_one_of_similar(empty).count() == 0


def test_fingerprints_find_pairs_that_the_sets_decide(spark, near, monkeypatch):
    """Near fingerprints join similar texts, without a prefix that meets; what is near by fingerprint alone is not joined."""
    from foliant.llm import simhash

    share = similar.Fraction("0.8")
    docs = spark.createDataFrame(near, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS h", "text")
    prints = similar.prefixes(docs, 5, share, (similar.np.zeros(0, "uint64"), similar.np.zeros(0, "int64"))).localCheckpoint()
    texts = {r["doc_id"]: r for r in prints.select("doc_id", "node", "fp").collect()}
    bits = lambda a, b: bin((texts[a]["fp"] ^ texts[b]["fp"]) & (2**64 - 1)).count("1")
    own = dict(near)
    assert all(texts[i]["fp"] == simhash.fingerprint((own[i] or "").encode(), 5) for i in texts)
    close = {(a, b) for a in texts for b in texts if a < b and texts[a]["node"] and texts[b]["node"] and texts[a]["node"] != texts[b]["node"] and bits(a, b) <= similar.DISTANCE}
    assert close
    nodes = prints.where("node IS NOT NULL").groupBy("node").agg({"fp": "min"}).withColumnRenamed("min(fp)", "fp")
    linked = {frozenset(r) for r in similar.fingerprint_pairs(nodes).collect()}
    assert linked == {frozenset((texts[a]["node"], texts[b]["node"])) for a, b in close}
