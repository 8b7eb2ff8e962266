import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import lexical


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs if i is not None]
    n_docs, n_terms = sum(1 for _, t in own if t), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        if item is None:
            continue
        scored = []
        for doc, t in own:
            tf, m = Counter(t), 75 + (25 * len(t) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_ranks_equal_brute_force(spark, rows, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, t) for i, t, *_ in rows] + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs += [(i + 1000, t) for i, t in docs[50:90] if i is not None] + [(7, "a b repeated id")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(20)] + [(50, None), (51, ""), (52, "Ünï CÖDÉ 你好 aa-AA_aa"), (None, "a"), (53, "nowhere9")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("term", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 20)
    for block, at_once in ((32 << 20, 4096), (3000, 7)):
        monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
        monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", at_once)
        assert sorted(map(tuple, lexical.rank_documents(table, asked, 20).collect())) == want


def test_empty_tables_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, asked).collect()] == [(1, 1, 1)]
    assert lexical.rank_documents(docs.limit(0), asked).count() == 0
    assert lexical.rank_documents(docs, asked.limit(0)).count() == 0


def test_reading_stops_before_the_ends_of_the_lists():
    rng = np.random.default_rng(1)
    n = 20_000
    lists = []
    for times in (1, 2):
        places = np.flatnonzero(rng.random(n) < 0.5)
        impacts = rng.integers(1, 1000, len(places))
        impacts[:30] = 5000  # the best stand high in both
        lists.append((times, lexical.ImpactList.of(places, impacts)))
    best, scores = lexical.Best(10), np.zeros(n, np.int64)
    for times, x in lists:
        scores[x.places] += times * x.impacts
    scored = lexical.best_positions(lists, np.arange(n), best)
    order = np.lexsort((np.arange(n), -scores))[:10]
    assert best.docs.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert scored < n / 20


def test_equal_scores_at_the_end_go_by_document():
    places = np.arange(5000)
    best = lexical.Best(10)
    lexical.best_positions([(1, lexical.ImpactList.of(places, np.full(5000, 7)))], places[::-1].copy(), best)
    assert best.docs.tolist() == list(range(10))
