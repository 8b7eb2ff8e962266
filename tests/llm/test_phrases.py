import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, best, least):
    """Every phrase of two or three words counted and decided."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[i : i + size])] += 1
    found = []
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, p, a, counts[lang, p[:k]], counts[lang, p[k:]], score))
    longer = [(f[0], f[1], f[2]) for f in found if len(f[1]) == 3]
    kept = [f for f in found if len(f[1]) == 3 or not any(g == f[0] and f[1] in (q[:2], q[1:]) and 100 * b >= 50 * f[2] for g, q, b in longer)]
    out = []
    for lang in sorted(totals):
        own = sorted((f for f in kept if f[0] == lang), key=lambda f: (-f[5], -f[2], " ".join(f[1]).encode()))
        out += [(lang, i + 1, " ".join(f[1]), f[2], f[3], f[4], totals[lang], f[5]) for i, f in enumerate(own[:best])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    fixed = ["Alpha beta gamma", "état de siège", "of the", "the of the", "x y x y x"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.25 else rng.choice("abcdefghijklmnopq") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in words), rng.choice(["en", "en", "fr", None])))
    return rows


def test_phrases_equal_brute_force(spark):
    rows = corpus(3, 150) + [(None, "en"), ("", None), (" \t\n. ", "xx"), ("one", "yy")]
    docs = spark.createDataFrame([(i, t, g, None, 0) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    for best, least in ((2000, 10), (5, 3), (1, 1)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, best, least).select(*COLUMNS).collect())
        assert got == sorted(brute(rows, best, least)), (best, least)


def test_bands_go_down_until_settled(spark, monkeypatch):
    """A first band that holds too few survivors is followed by lower ones, with the same phrases."""
    monkeypatch.setattr(phrases, "FIRST", 0.3)
    monkeypatch.setattr(phrases, "STEP", 200)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    rows = corpus(5, 120)
    docs = spark.createDataFrame([(i, t, g, None, 0) for i, (t, g) in enumerate(rows)], SCHEMA)
    asked, floors = [], phrases._floors
    monkeypatch.setattr(phrases, "_floors", lambda *a: asked.append(a) or floors(*a))
    got = sorted(tuple(r) for r in phrases.collocations(docs, 30, 3).select(*COLUMNS).collect())
    assert got == sorted(brute(rows, 30, 3)) and len(asked) > 1


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(phrases.Filter, "of", classmethod(lambda cls, keys, hashed: cls(np.full(1, 2**64 - 1, np.uint64))))
    rows = corpus(6, 80)
    docs = spark.createDataFrame([(i, t, g, None, 0) for i, (t, g) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 20, 3).select(*COLUMNS).collect()) == sorted(brute(rows, 20, 3))


def test_scores_past_64_bits(spark):
    big = spark.createDataFrame([(3_000_000_019, 3_000_000_019, 9_000_000_001), (10, 10, 10)], "a long, l long, r long")
    got = [r[0] for r in big.select(phrases._score("a", "l", "r")).collect()]
    assert got == [1_000_000 * 3_000_000_019**2 // (3_000_000_019 * 9_000_000_001), 1_000_000]


def test_a_long_text_a_clash_and_an_empty_table(spark, docs, empty):
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("w1", "n", "f", "score", "phrase")])
    assert sorted(map(tuple, phrases.collocations(wide, 50, 3).collect())) == sorted(map(tuple, phrases.collocations(docs, 50, 3).collect()))
    long = "very long text here. " * 100_000
    got = phrases.collocations(spark.createDataFrame([(1, long, "en", None, 0)], SCHEMA)).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [("long text here", 100_000, 400_000), ("very long text", 100_000, 400_000)]
    assert phrases.collocations(empty).count() == 0
