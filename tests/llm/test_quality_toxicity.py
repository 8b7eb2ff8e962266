import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality, toxicity


def slow_signals(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    c, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, g in enumerate(windows):
        if c[g] > 1:
            covered |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_signals(spark, docs, rows, empty):
    rng = random.Random(1)
    lines = ["a b c d", "b c", "", " ", "a|b #c", "x y z x y z"]
    more = [(100 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60))), None, None, 0) for i in range(40)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    found = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in quality.quality_signals(df).collect()}
    assert found == {i: slow_signals(t) for i, t, *_ in [*rows, *more]}
    assert quality.quality_signals(empty).count() == 0


def test_binomial(spark):
    cases = [(0, 50, 0.02), (3, 100, 0.02), (100, 100, 0.5), (20, 1000, 0.02), (5, 5, 0.02), (0, 0, 0.02), (37, 2000, 0.02)]
    for k, n, p in cases:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()["x"]
        assert abs(got - min(1.0, exact)) < 1e-9


def test_verdicts_are_controlled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 6 == 0
        words = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(6)) for _ in range(70)]
        rows.append((i, " ".join(w + ("###" if bad and rng.random() < 0.8 else "") for w in words), "en"))
        if i % 2:
            labels.append((i, int(not bad), 0))
        elif bad:
            labels.append((i, 0, 0))
    docs = spark.createDataFrame([*rows, (7001, None, "en"), (7002, "w " * 80, "xx")], "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.quality_verdicts(docs.drop("kept"), labelled).collect()}
    good = [found[i]["kept"] for i in range(6000) if i % 6]
    assert sum(good) / len(good) > 1 - quality.FALSE_REJECTION
    assert not any(found[i]["kept"] for i in range(0, 6000, 6))
    assert found[7001]["base_failed"] and found[7002]["base_failed"] and found[7002]["cutoff"] is None
    assert quality.keep_good(docs, labelled).columns == docs.columns
    none = quality.quality_verdicts(docs.drop("kept"), labelled.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_likelihood_and_gradient_against_definition():
    """The loss of every row by the definition of a cumulative link, and its slopes by differences."""
    rng = np.random.default_rng(4)
    f, grades, n = 6, 3, 40
    entries = [(i, int(x), float(rng.random() + 0.5)) for i in range(n) for x in rng.choice(f, rng.integers(0, 4), replace=False)]
    owner, index, value = (np.array(x) for x in zip(*entries))
    grade = np.append(np.arange(grades + 1), rng.integers(0, grades + 1, n - grades - 1))
    rows, p = toxicity._Rows(owner, index, value, grade), rng.normal(0, 1, f + grades)
    cuts = [p[f], p[f] + np.exp(p[f + 1]), p[f] + np.exp(p[f + 1]) + np.exp(p[f + 2])]
    slow = 0.0
    for i in range(n):
        score = sum(x * p[j] for o, j, x in entries if o == i)
        above = [1.0, *(1 / (1 + np.exp(c - score)) for c in cuts), 0.0]
        slow -= np.log(above[grade[i]] - above[grade[i] + 1]) / n
    slow += toxicity.RIDGE / 2 * sum(x * x for x in p[:f])
    found, slopes = toxicity.loss(p, rows, f, grades)
    assert found == pytest.approx(slow)
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-6
        assert slopes[i] == pytest.approx((toxicity.loss(p + step, rows, f, grades)[0] - toxicity.loss(p - step, rows, f, grades)[0]) / 2e-6, abs=1e-7)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        f = [0] * g + ([1] if rng.random() < 0.5 else [])
        i, c = np.unique(f, return_counts=True) if f else (np.zeros(0, int), np.zeros(0, int))
        rows.append((i.astype(np.int64), c.astype(float), g))
    m = toxicity.fit(rows, {b"a": 0, b"b": 1})
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] > 1 and abs(m.weights[1]) < m.weights[0] / 3
    exceed = m.exceed(np.array([0.0, m.weights[0] * 3])).sum(1)
    assert exceed[1] > exceed[0] + 1


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain, bad = [f"w{i}" for i in range(300)], ["scum", "idiot"]
    rows = []
    for i in range(1200):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(60)] + [rng.choice(bad).upper() + "!" for _ in range(rng.randint(1, 6) if toxic else 0)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (None, "", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 800], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.severity(docs.drop("grade"), model).collect()}
    wrong = [i for i, _, y in rows if i >= 800 and found[i]["toxic"] != bool(y)]
    assert len(wrong) <= 4 and not found[5000]["toxic"] and not found[None]["toxic"]
    assert {found[i]["grade"] for i, _, y in rows if i >= 800} == {0, 1, 2, 3}
    held = [(found[i]["expected_severity"], sum(w in ("SCUM!", "IDIOT!") for w in t.split())) for i, t, y in rows if i >= 800 and y]
    means = [np.mean([s for s, n in held if n in few]) for few in ((1, 2), (3, 4), (5, 6))]
    assert means[0] < means[1] < means[2]
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.severity(docs.drop("grade"), None).where("toxic").count() == 0
    assert toxicity.severity(docs.drop("grade").limit(0), model).count() == 0


def test_equal_strengths_still_reach_every_grade():
    assert toxicity.grades_of([True, False, True, True, True], [0.5, 9.0, 0.5, 0.5, 0.1], 3).tolist() == [1, 0, 2, 3, 1]
    assert toxicity.grades_of([False], [1.0], 3).tolist() == [0]
    assert toxicity.grades_of([], [], 3).tolist() == []
