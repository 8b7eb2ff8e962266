import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"aa": "the and ing tion ou".split(), "bb": "der ein sch ung ü".split(), "cc": "que ción los ñ".split()}


def table(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        text = " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if rng.random() < 0.9 else None, "s", len(text)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def test_held_out_documents_get_their_language(spark):
    docs, rows = table(spark)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [(i, g) for i, _, g, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(rows) and {i for i, r in got.items() if r["held_out"]} == {i for i, _ in held}
    right = [got[i]["lang_pred"] == g for i, g in held if g]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_languages_teach_nothing(spark):
    docs, _ = table(spark)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(other)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_counts_of_texts():
    assert not langid.ngram_counts("").any() and not langid.ngram_counts(" 12 \n!").any()
    assert langid.ngram_counts("ab").sum() == 2 + 3 + 2  # letters, pairs with bounds, triples with bounds
    assert np.array_equal(langid.ngram_counts("Ab, c"), langid.ngram_counts("aB c!"))
    assert np.array_equal(langid.ngram_counts("É你"), langid.ngram_counts("é你"))


def test_document_frequencies_count_every_training_document(spark):
    docs, rows = table(spark)
    model = langid.train(docs, sample=20)
    own = [t for i, t, g, *_ in rows if g and zlib.crc32(str(i).encode()) % 4 != 2]
    having = sum((langid.ngram_counts(t) > 0).astype(int) for t in own)
    assert np.allclose(model.idf, np.log((1 + len(own)) / (1 + having)) + 1)


def test_a_step_follows_the_gradient_and_zeroes_small_weights():
    rng = np.random.default_rng(1)
    value, at = np.array([1.5, 0.5, 1.0]), np.array([0, 2, 4])
    z, n = rng.normal(size=(5, 3)), rng.random((5, 3))
    w = langid.weights_of(z, n)

    def loss(w):
        x = value @ w[at]
        return np.log(np.exp(x).sum()) - x[1]

    slope = np.array([[(loss(w + d) - loss(w - d)) / 2e-6 for j in range(3) for d in [1e-6 * np.eye(5)[:, [i]] * np.eye(3)[[j]]]] for i in range(5)])
    z2, n2 = z.copy(), n.copy()
    langid.follow(z2, n2, at, value, 1)
    assert np.allclose(n2 - n, slope**2, atol=1e-8)
    assert np.allclose(z2 - z, slope - (np.sqrt(n2) - np.sqrt(n)) / langid.ALPHA * w, atol=1e-7)
    assert (langid.weights_of(np.array([langid.L1, -langid.L1 / 2]), np.ones(2)) == 0).all()


def test_weights_are_sparse_and_the_temperature_calibrates(spark):
    model = langid.train(table(spark)[0])
    assert (model.weights == 0).mean() > 0.5
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    lang = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid._temperature(logits * 3, lang) - 3) < 0.3 and langid._temperature(logits[:0], lang[:0]) == 1


def test_odd_rows(spark, docs, empty):
    trained, _ = table(spark)
    model = langid.train(trained)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("held_out", "score", "place", "span", "lang_pred")])
    got = langid.identify(wide, model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == docs.count() and by[4] == by[5] == by[6] == ("und", 0.0)
    assert langid.train(wide) is not None and langid.train(empty) is None
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, None).collect()} == {("und", 0.0)}
    assert langid.identify(empty, model).count() == 0
    one = langid.train(trained.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in langid.identify(trained, one).collect()} == {"aa"}
