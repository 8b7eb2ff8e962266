"""Phrase collocations by best-first growth of prefixes under bounds, per language.

Words are counted first, pairs of frequent words next. A pair is a candidate and the prefix of candidates: with its count c
and its first word's f, no phrase that begins with it can score above floor(1000000 * c / f), as a phrase is no more
frequent than its prefix or its rest. The frontier of prefixes is expanded from the best bounds down, a band at a
time: a band goes to a floor, which counts every phrase of three words that begins with a pair whose bound reaches the
floor, or ends with a pair whose score does (these decide whether the pair is dropped). Every candidate whose score
reaches the floor is then known and decided. A language is settled once 2000 of them survive, or nothing is left; the others
take a lower floor.

Texts are cut into blocks of one language; a block's n-grams are counted in numpy and its counts summed by Spark. Which
prefixes are expanded is told to the tasks by a Bloom filter of bounded size; what it lets through besides is
counted in full too, so it costs time and changes nothing.

Null texts are empty, null languages are "und". A phrase is 2 or 3 words. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, sent_if_small, written

#: Text bytes of one language that are counted at once; longer texts are cut where a piece ends.
BLOCK_BYTES = 4 << 20
#: Bits of a filter for each key, and the most bits (32 MB).
BITS_A_KEY = 16
MOST_BITS = 1 << 28
#: Scores of pairs are counted in steps of so much to choose a floor.
STEP = 500
#: The first band has so many times the pairs that are asked for, and each further one so many times more.
FIRST = 2
WIDER = 4

# Least count, number of phrases, scale of scores, what ends a piece and what separates words.
LEAST = 10
BEST = 2000
SCALE = 1_000_000
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(_UPPER + b"\t" + ENDS, _LOWER + b" " + b"\n" * len(ENDS))
_TURN = 21


class Filter:
    """A Bloom filter over 64-bit hashes, two bits a key."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, keys: DataFrame, hashed: Column) -> Filter:
        """Of the keys' hashes, a long column; the driver gets the bits, at most MOST_BITS of them."""
        n = keys.count()
        bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_A_KEY * n).bit_length()))
        places = F.explode(F.array(hashed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1))))
        rows = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
        got, words = rows.toArrow(), np.zeros(bits // 64, np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for places in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= ((self.words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(word).bitwiseXOR(F.xxhash64(lang))


def _pair_hash(lang: Column, first: Column, second: Column) -> Column:
    b = _word_hash(lang, second)
    return _word_hash(lang, first).bitwiseXOR(F.shiftleft(b, _TURN).bitwiseOR(F.shiftrightunsigned(b, 64 - _TURN)))


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(_TURN)) | (h >> np.uint64(64 - _TURN))


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As _word_hash has them."""
    import xxhash

    own = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) ^ own for w in words), np.uint64, len(words))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Blocks of translated text of one language; pieces end with \\n."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), encode_text(batch.column("text"))):
            data = text.translate(_TABLE)
            while len(data) > BLOCK_BYTES and (cut := data.rfind(b"\n", 0, BLOCK_BYTES)) > 0:
                yield lang, data[:cut]
                data = data[cut + 1 :]
            if sizes.get(lang, 0) + len(data) > BLOCK_BYTES and held.get(lang):
                yield lang, b"\n".join(held.pop(lang))
                sizes[lang] = 0
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sum(sizes.values()) > 4 * BLOCK_BYTES:
                for other in list(held):
                    yield other, b"\n".join(held.pop(other))
                sizes = {}
    for lang in list(held):
        yield lang, b"\n".join(held.pop(lang))


def _numbered(data: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """The number of each token, the distinct tokens, and the number that ends a piece (-1: none)."""
    tokens = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.binary()), b" ").flatten()
    tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
    end = pc.index(tokens.dictionary, pa.scalar(b"\n", pa.binary())).as_py()
    return tokens.indices.to_numpy().astype(np.int64), tokens.dictionary, end


def _rows(lang: str, words: list[pa.Array], counts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), 100_000):
        n = counts[at : at + 100_000]
        some = [w.slice(at, 100_000).cast(pa.string()) for w in words]
        yield pa.record_batch([pa.array([lang] * len(n), pa.string()), *some, pa.array(n.astype(np.int64))], names=["lang", *names, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and word, and one without a word for the block's number of words."""
    for lang, data in _pieces(batches):
        ids, words, end = _numbered(data)
        counts = np.bincount(ids, minlength=len(words))
        if end >= 0:
            counts[end] = 0
        some = np.flatnonzero(counts)
        every = pa.concat_arrays([words.take(pa.array(some)), pa.array([None], pa.binary())])
        yield from _rows(lang, [every], np.append(counts[some], counts.sum()), ["w1"])


def _pairs_of(ids: np.ndarray, n_words: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second number and count of each distinct pair, and the pair at each place (-1: none)."""
    there = ok[ids[:-1]] & ok[ids[1:]]
    keys, inverse, counts = np.unique((ids[:-1] * n_words + ids[1:])[there], return_inverse=True, return_counts=True)
    at = np.full(max(len(ids) - 1, 0), -1, np.int64)
    at[there] = inverse
    return keys // n_words, keys % n_words, counts, at


def _count_pairs(frequent: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _pieces(batches):
            ids, words, end = _numbered(data)
            ok = frequent.has(_hashes(lang, words.to_pylist()))
            if end >= 0:
                ok[end] = False
            a, b, counts, _ = _pairs_of(ids, len(words), ok)
            yield from _rows(lang, [words.take(pa.array(x)) for x in (a, b)], counts, ["w1", "w2"])

    return run


def _count_triples(frequent: Filter, begins: Filter, ends: Filter):
    """Three words of which the first two are in `begins` or the last two in `ends`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _pieces(batches):
            ids, words, end = _numbered(data)
            hashes = _hashes(lang, words.to_pylist())
            ok = frequent.has(hashes)
            if end >= 0:
                ok[end] = False
            a, b, _, at = _pairs_of(ids, len(words), ok)
            paired = hashes[a] ^ _turned(hashes[b])
            first, last = np.append(begins.has(paired), False), np.append(ends.has(paired), False)  # the place -1 has no pair
            there = (at[:-1] >= 0) & (at[1:] >= 0) & (first[at[:-1]] | last[at[1:]])
            keys, counts = np.unique((at[:-1] * len(words) + ids[2:])[there], return_counts=True)
            pair, c = keys // len(words), keys % len(words)
            yield from _rows(lang, [words.take(pa.array(x)) for x in (a[pair], b[pair], c)], counts, ["w1", "w2", "w3"])

    return run


def _counted(docs: DataFrame, task, names: list[str]) -> DataFrame:
    """Blocks' counts added up. They are dealt by phrase as they come: within a task few blocks share a phrase."""
    kinds = "lang string, " + ", ".join(f"{w} string" for w in names) + ", n bigint"
    return map_batches(docs, task, kinds).repartition("lang", *names).groupBy("lang", *names).agg(F.sum("n").alias("f"))


def _score(a: str, l: str, r: str) -> Column:
    """floor(SCALE * a * a / (l * r)), exactly; counts below 10^15."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(8, 0)) * CAST(CAST({a} AS DECIMAL(15, 0)) * {a} AS DECIMAL(30, 0))) div CAST(CAST({l} AS DECIMAL(15, 0)) * {r} AS DECIMAL(30, 0))")


def _floors(pairs: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """The score, a multiple of STEP, that so many pairs of a language reach; 0 if there are fewer."""
    steps: dict[str, list[tuple[int, int]]] = {}
    for r in pairs.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).count().collect():
        steps.setdefault(r["lang"], []).append((r["step"], r["count"]))
    out = {}
    for lang, rows in steps.items():
        out[lang], reached = 0, 0
        for step, n in sorted(rows, reverse=True):
            reached += n
            if reached >= wanted.get(lang, 0):
                out[lang] = step * STEP
                break
    return out


def _floor_of(floors: dict[str, int]) -> Column:
    pairs = [F.lit(x) for lang, floor in floors.items() for x in (lang, floor)]
    return F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(0)


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases of documents (text, lang)."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = written(_counted(docs, _count_words, ["w1"]).where((F.col("f") >= least) | F.col("w1").isNull()), "phrase_words")
    totals = counted.where("w1 IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.where("w1 IS NOT NULL")
    frequent = Filter.of(words, _word_hash(F.col("lang"), F.col("w1")))
    known = sent_if_small(words)

    def with_count(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(known.select("lang", F.col("w1").alias(word), F.col("f").alias(name)), ["lang", word])

    pairs = _counted(docs, _count_pairs(frequent), ["w1", "w2"]).where(F.col("f") >= least)
    pairs = with_count(with_count(pairs, "w1", "f1"), "w2", "f2").withColumn("score", _score("f", "f1", "f2")).withColumn("bound", F.expr(f"(CAST({SCALE} AS DECIMAL(8, 0)) * f) div f1"))
    pairs = written(pairs, "phrase_pairs")

    wanted = {lang: best * FIRST for lang in (r["lang"] for r in totals.collect())}
    floors, before, open_, triples = _floors(pairs, wanted), {}, set(wanted), None
    hashed = _pair_hash(F.col("lang"), F.col("w1"), F.col("w2"))
    while open_:
        own = pairs.where(F.col("lang").isin(sorted(open_)))
        floor, last = _floor_of(floors), _floor_of({k: before.get(k, SCALE + 1) for k in floors})
        begins = Filter.of(own.where((F.col("bound") >= floor) & (F.col("bound") < last)), hashed)
        ends = Filter.of(own.where((F.col("score") >= floor) & (F.col("score") < last)), hashed)
        found = _counted(docs.where(F.col("lang").isin(sorted(open_))), _count_triples(frequent, begins, ends), ["w1", "w2", "w3"]).where(F.col("f") >= least)
        if triples is not None:  # a phrase may be counted by two bands, the same each time
            found = found.unionByName(triples).groupBy("lang", "w1", "w2", "w3").agg(F.max("f").alias("f"))
        triples = written(found, "phrase_triples")
        survivors = written(_survivors(pairs, triples, with_count).where(F.col("score") >= floor), "phrase_survivors")
        reached = {r["lang"]: r["count"] for r in survivors.groupBy("lang").count().collect()}
        open_ = {k for k in open_ if floors.get(k, 0) > 0 and reached.get(k, 0) < best}
        if open_:
            before = dict(floors)
            wanted = {k: wanted[k] * WIDER if k in open_ else 0 for k in wanted}
            lower = _floors(own, wanted)
            floors = {k: min(lower[k], floors[k] - STEP) if k in open_ else floors[k] for k in floors}
            floors = {k: max(0, v) for k, v in floors.items()}
    if not wanted:
        survivors = _survivors(pairs, pairs.select("lang", "w1", "w2", F.col("w2").alias("w3"), "f").limit(0), with_count)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = survivors.withColumn("place", F.row_number().over(part)).where(F.col("place") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _survivors(pairs: DataFrame, triples: DataFrame, with_count) -> DataFrame:
    """lang, phrase, a, l, r, score of all triples, and of the pairs that none of them covers."""
    inner = pairs.select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("f").alias("g"))
    whole = triples.join(inner.select("lang", F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("g").alias("f12")), ["lang", "w1", "w2"])
    whole = whole.join(inner.select("lang", F.col("x").alias("w2"), F.col("y").alias("w3"), F.col("g").alias("f23")), ["lang", "w2", "w3"])
    whole = with_count(with_count(whole, "w1", "f1"), "w3", "f3").withColumn("s1", _score("f", "f1", "f23")).withColumn("s2", _score("f", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    out = whole.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    within = triples.select("lang", F.col("f").alias("g"), F.inline(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    within = within.groupBy("lang", "w1", "w2").agg(F.max("g").alias("longer"))
    alone = pairs.join(within, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("f"), F.lit(True)))
    return out.unionByName(alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score"))
