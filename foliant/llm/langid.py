"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters of letters and word bounds fall into hashed buckets. Document frequencies count every
training document. The model learns by follow-the-regularised-leader with elastic-net penalties: shards of the training
sample run it from the same state, their accumulators are averaged, and the next round starts from there. Documents of the
sample that no shard has learned from set the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_batches, ready, written

#: Buckets of n-grams; one more holds the constant.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: About so many training documents of each language at most, chosen by a hash of their ids, fit the model.
SAMPLE_A_LANGUAGE = 5_000
#: One in so many of the sample calibrates and does not train.
CALIBRATE_ONE_IN = 5
SHARDS = 8
ROUNDS = 3
#: Follow-the-regularised-leader: step, its offset, and the penalties on sums and squares of weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
#: TF-IDF values of a document add up to this.
TOTAL = 20.0
#: Characters read at once; n-grams do not reach over such a cut.
CUT = 1 << 20
#: Buckets that are summed together over tasks.
SPAN = 4_096
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point its lower-case letter, 0 of all others."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams stand in a text; all 0 if it has no letter."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), CUT):
        points = np.frombuffer(text[at : at + CUT].encode("utf-32-le", "replace"), np.uint32)
        c = np.zeros(len(points) + 2, np.uint32)
        np.take(_letters(), points, out=c[1:-1])
        letter = c > 0
        if not letter.any():
            continue
        c = c[np.append(True, letter[1:] | letter[:-1])]  # one bound between words
        n = len(c)
        grams = np.empty(3 * n - 3, np.uint32)
        one, two, three = grams[:n], grams[n : 2 * n - 1], grams[2 * n - 1 :]
        np.multiply(c, np.uint32(0x9E3779B1), out=one)
        np.add(one[:-1], c[1:], out=two)
        np.multiply(two, np.uint32(0x85EBCA77), out=two)
        np.add(two[:-1], c[2:], out=three)
        np.multiply(three, np.uint32(0xC2B2AE3D), out=three)
        out += np.bincount(grams >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
        out[0] -= n - np.count_nonzero(c)  # bounds alone are no n-grams
    return out


def _is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a span of buckets with the documents that have each, and rows of sampled documents with their buckets."""
    having, found = np.zeros(BUCKETS, np.int64), []
    names = ["span", "having", "lang", "place", "calibrates", "buckets", "counts"]
    kinds = [pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    def rows(values: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*values), kinds)], names=names)

    for batch in batches:
        for text, lang, place, sampled, calibrates in zip(_texts(batch), *(batch.column(k).to_pylist() for k in ("lang", "place", "sampled", "calibrates"))):
            counts = ngram_counts(text)
            some = np.flatnonzero(counts)
            having[some] += 1
            if sampled and len(some):
                found.append((None, None, lang, place, calibrates, some.astype(np.int32).tobytes(), counts[some].tobytes()))
                if len(found) >= 256:
                    yield rows(found)
                    found = []
    yield rows(found + [(at // SPAN, having[at : at + SPAN].tobytes(), None, None, None, None, None) for at in range(0, BUCKETS, SPAN)])


def _summed(key: str, columns: list[str], kind: type):
    """Adds the arrays of a group's rows up."""

    def run(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(x, kind) for x in table.column(c).to_pylist()).tobytes() for c in columns]
        return pa.table([table.column(key).slice(0, 1), *(pa.array([s], pa.binary()) for s in sums)], names=[key, *columns])

    return run


@dataclass
class LanguageModel:
    """Languages, each bucket's inverse document frequency, weights by bucket (the constant last) and language, and the
    temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        value = counts * self.idf
        return (value @ self.weights[:-1]) * (TOTAL / value.sum()) + self.weights[-1]


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights out of both accumulators."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, lang: int) -> None:
    """One document's step: `at` are its buckets with the constant, both accumulators change there."""
    w = weights_of(z[at], n[at])
    p = value @ w
    p = np.exp(p - p.max())
    p /= p.sum()
    p[lang] -= 1.0
    g = value[:, None] * p
    more = n[at] + g * g
    z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
    n[at] = more


def _features(buckets: bytes, counts: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(buckets, np.int32)
    value = np.frombuffer(counts, np.int64) * idf[at]
    return np.append(at, BUCKETS), np.append(value * (TOTAL / value.sum()), 1.0)


def _learn(langs: list[str], idf: np.ndarray, z: np.ndarray, n: np.ndarray):
    """One shard's round from the state (z, n): a row per span of buckets with the accumulators after it."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(table: pa.Table) -> pa.Table:
        own_z, own_n = z.copy(), n.copy()
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("place", "lang", "buckets", "counts"))))
        for _, lang, buckets, counts in rows:
            follow(own_z, own_n, *_features(buckets, counts, idf), number[lang])
        spans = range(0, BUCKETS + 1, SPAN)
        return pa.table({
            "span": pa.array([at // SPAN for at in spans], pa.int32()),
            "z": pa.array([own_z[at : at + SPAN].tobytes() for at in spans], pa.binary()),
            "n": pa.array([own_n[at : at + SPAN].tobytes() for at in spans], pa.binary()),
        })

    return run


def _temperature(logits: np.ndarray, lang: np.ndarray) -> float:
    """What the logits are divided by for the least loss on calibrating documents, between 1/20 and 20.

    Of n documents the language counts as (n + 1) of (n + 2), the others share the rest, so no share is taken for sure.
    """
    if not len(lang) or logits.shape[1] < 2:
        return 1.0
    target = np.full(logits.shape, 1 / (len(lang) + 2) / (logits.shape[1] - 1))
    target[np.arange(len(lang)), lang] = (len(lang) + 1) / (len(lang) + 2)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        top = x.max(1)
        return float((np.log(np.exp(x - top[:, None]).sum(1)) + top - (x * target).sum(1)).mean())

    low, high, ratio = np.log(1 / 20), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample: int = SAMPLE_A_LANGUAGE) -> LanguageModel | None:
    """A model out of documents (doc_id, text, lang) that aren't held out; None if none has a letter and a language.

    Document frequencies are those of all training documents. The sample is bounded by `sample` a language: a document is
    in it if its hash falls below its language's share, so about that many are, spread over the whole table.
    """
    own = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_is_held_out())
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return None
    langs = list(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, sample / v))]), F.col("lang"))
    place = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("sample"))
    drawn = F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)
    own = own.select("text", "lang", place.alias("place"), drawn.alias("sampled"), (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE_ONE_IN)) == 0).alias("calibrates"))
    kinds = "span int, having binary, lang string, place bigint, calibrates boolean, buckets binary, counts binary"
    rows = written(map_batches(own, _statistics, kinds), "ngram_statistics")
    spans = rows.where("span IS NOT NULL").select("span", "having").groupBy("span").applyInArrow(_summed("span", ["having"], np.int64), "span int, having binary").orderBy("span").collect()
    having = np.concatenate([np.frombuffer(r["having"], np.int64) for r in spans])
    idf = np.log((1 + sum(sizes.values())) / (1 + having)) + 1.0
    learning = rows.where("span IS NULL AND NOT calibrates").select(F.pmod("place", F.lit(SHARDS)).alias("shard"), "place", "lang", "buckets", "counts")
    z, n = np.zeros((BUCKETS + 1, len(langs))), np.zeros((BUCKETS + 1, len(langs)))
    for _ in range(ROUNDS):
        shards = learning.groupBy("shard").applyInArrow(_learn(langs, idf, z, n), "span int, z binary, n binary")
        sums = shards.withColumn("shards", F.lit(1)).groupBy("span").applyInArrow(_averaged, "span int, z binary, n binary").orderBy("span").collect()
        if not sums:
            return None
        z, n = (np.concatenate([np.frombuffer(r[c], np.float64) for r in sums]).reshape(-1, len(langs)) for c in ("z", "n"))
    model = LanguageModel(langs, idf, weights_of(z, n))
    ready(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for buckets, counts in zip(batch.column("buckets").to_pylist(), batch.column("counts").to_pylist()):
                at, value = _features(buckets, counts, idf)
                found.append((value @ model.weights[at]).tobytes())
            yield pa.record_batch([batch.column("lang"), pa.array(found, pa.binary())], names=["lang", "logits"])

    tried = map_batches(rows.where("span IS NULL AND calibrates").select("lang", "buckets", "counts"), measured, "lang string, logits binary").collect()
    logits = np.array([np.frombuffer(r["logits"], np.float64) for r in tried]).reshape(-1, len(langs))
    model.temperature = _temperature(logits, np.array([langs.index(r["lang"]) for r in tried], np.int64))
    return model


def _averaged(table: pa.Table) -> pa.Table:
    out = _summed("span", ["z", "n"], np.float64)(table)
    means = [pa.array([(np.frombuffer(out.column(c)[0].as_py(), np.float64) / len(table)).tobytes()], pa.binary()) for c in ("z", "n")]
    return pa.table([out.column("span"), *means], names=["span", "z", "n"])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (doc_id, text); score is the calibrated probability.

    Null texts and texts without a letter are "und" at 0.0, as all are without a model. A null id counts as held in.
    Texts count whole, in lower case; languages of equal probability go by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, scores = [], []
            for text in _texts(batch):
                counts = ngram_counts(text)
                if model is None or not counts.any():
                    named.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                x = model.logits(counts) / model.temperature
                p = np.exp(x - x.max())
                named.append(model.langs[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", _is_held_out())
    return map_batches(own, run, "doc_id bigint, held_out boolean, lang_pred string, score double")
