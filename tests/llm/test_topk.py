import math
import random

import pytest

from foliant.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k, queries):
    clean = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in queries:
        own = [v for i, v in clean if i == q]
        if not own:
            continue
        a = min(own, key=lambda v: (sum(x * x for x in v), v))
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in clean if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("blocks,cell", [(1 << 18, 16), (16 * 64, 2), (16 * 64, 1)])
def test_against_brute_force(spark, monkeypatch, blocks, cell):
    monkeypatch.setattr(topk, "CELL_BLOCKS", cell)
    monkeypatch.setattr(topk, "CELL_QUERIES", cell)
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", blocks)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(3)
    hot = [rng.gauss(0, 0.3) for _ in range(16)]
    import numpy as np

    rows = [(i, [float(np.float32(rng.gauss(0, 0.2) * (1 + i % 5))) for _ in range(16)], 0) for i in range(400)]
    rows += [(1000 + i, [float(np.float32(x)) for x in hot], 0) for i in range(150)]
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 16, 0), (2003, [float("inf")] * 16, 0), (2004, [0.0] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = [r[0] for r in rows if r[0] is not None and r[0] % 20 == 0]
    found = topk.top_k(df, spark.createDataFrame([(q,) for q in wanted], "vec_id long"), 10)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute(rows, 10, wanted)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [0.5], 0), (2, [-1.0, 3.0], 0)], SCHEMA)
    found = topk.top_k(df, df.where("vec_id = 0"))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 2, 5 * 1024 * 1024), (2, 1, 512 * 1024)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0
