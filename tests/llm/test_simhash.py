import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.graphs import components


def slow_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def check(df, distance, k=4):
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    fps = {i: slow_fingerprint(t, k) for i, t in texts.items()}
    expected = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= distance)
    found = {r["doc_id"]: r for r in simhash.near_components(df, k, distance).collect() if r["doc_id"] is not None}
    assert {i: r["fp"] % 2**64 for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == expected


def test_docs(docs):
    check(docs, 4)


@pytest.mark.parametrize("distance", [4, 7, 12])
def test_many(many, distance):
    check(many, distance)


@pytest.mark.parametrize("distance,parts", [(4, 3), (4, 2), (7, 4), (3, 5)])
def test_large_buckets_and_radii(spark, monkeypatch, distance, parts):
    monkeypatch.setattr(simhash, "LARGE", 4)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    fps = {centre}
    for _ in range(150):
        x = centre
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 40)}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    expected = groups(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= distance)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, parts)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert {x: found.get(x, x) for x in signed} == expected


def test_one_of_each_stays(docs, empty):
    kept = simhash.keep_one_of_each(docs.unionByName(docs), 4, 4)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert len(ids) == len(set(ids))
    assert {1, 4, 5, 6, 7, 14} <= {i for _, i in ids} and 2 not in {i for _, i in ids}
    assert simhash.near_components(empty).count() == 0 and simhash.keep_one_of_each(empty, 5, 4).count() == 0


def test_components_of_a_path(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links).select("root").distinct().collect() == [(0,)]
