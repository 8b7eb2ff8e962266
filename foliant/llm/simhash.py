"""SimHash near-duplicates: multi-index hashing over fingerprint segments, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, sent_if_small, written
from foliant.llm.graphs import components

#: A bucket of a segment table with more fingerprints is compared in tasks of its own, so many of them at a time.
LARGE = 32
CHUNK = 512
#: With more distinct fingerprints than this, values of two segments are looked up instead of three.
FEWEST_FOR_TWO_PARTS = 1 << 27
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """64 bits: a bit is 1 if set in over half of the shingles' XXH64 (seed 42); no word: zero.

    A-Z are lower-cased; words are what white space (0x20, 0x09-0x0D) separates; shingles keep repeats and are joined
    by one space; a text of fewer words has one, its whole sequence.
    """
    return majority(shingle_hashes(text, words_per_shingle))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint() of big-endian shingle hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        some = hashes[at : at + AT_ONCE]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Big-endian XXH64 (seed 42) of each shingle of fingerprint(), in order; none without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words_per_shingle, len(words))
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in cuts], ">u8")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """docs' columns without text, and fp: the fingerprint as a signed long. Null texts have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words_per_shingle) for t in encode_text(batch.column("text"))]
            yield pa.record_batch([*(batch.column(k) for k in kept), pa.array(fps, pa.int64())], names=[*kept, "fp"])

    kept = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    return map_batches(docs, run, ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), "fp long"]))


def segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal parts."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ball(width: int, radius: int) -> list[int]:
    """Differences of at most `radius` bits in `width`."""
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def radii(distance: int, parts: int) -> list[int]:
    """Per segment, such that any two fingerprints within `distance` agree that closely in one of them at least.

    With distance = parts * s + a, either one of the first a + 1 segments differs by s bits at most, or one of the
    others by s - 1: if not, the differences would exceed the distance. A radius of -1 needs no probes.
    """
    s, a = divmod(distance, parts)
    return [s if i <= a else s - 1 for i in range(parts)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, distance: int = 4, parts: int = 3) -> DataFrame:
    """a, b: links that join all distinct fingerprints (fp) within `distance` bits into the right groups.

    Multi-index hashing: every fingerprint stands in one table per segment, under the segment's value, and probes each
    table with the values in a small Hamming ball around its own; whole distances decide. A bucket of up to LARGE
    fingerprints gives its matches by a join. A larger one is cut into chunks of CHUNK; chunk by chunk its probes are compared
    in a task, which sends on a spanning forest of the links it finds, never all pairs; every pair is still compared.
    """
    tables = [
        F.struct(F.lit(i).alias("i"), _segment(F.col("fp"), *s).alias("v")) for i, s in enumerate(segments(64, parts))
    ]
    table = prints.select("fp", F.inline(F.array(*tables)))
    probes = None
    for i, ((shift, width), r) in enumerate(zip(segments(64, parts), radii(distance, parts))):
        if r < 0:
            continue
        flips = F.array(*map(F.lit, ball(width, r)))
        some = prints.select(
            "fp", F.lit(i).alias("i"), F.explode(F.transform(flips, lambda x: _segment(F.col("fp"), shift, width).bitwiseXOR(x.cast("long")))).alias("v")
        )
        probes = some if probes is None else probes.unionByName(some)
    sizes = table.groupBy("i", "v").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > LARGE).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "large-buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    small = table.join(large, ["i", "v"], "left_anti").select("i", "v", F.col("fp").alias("b"))
    links = (
        probes.withColumnRenamed("fp", "a").join(small, ["i", "v"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    )
    if large.isEmpty():
        return links

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        held, asked = (pdf.fp[pdf.side == k].to_numpy() for k in (0, 1))
        group = {x: x for x in [*held.tolist(), *asked.tolist()]}

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        out = []
        for at in range(0, len(asked), 1024):
            some = asked[at : at + 1024]
            a, b = np.nonzero(np.bitwise_count(some.view(np.uint64)[:, None] ^ held.view(np.uint64)[None, :]) <= distance)
            for x, y in zip(some[a].tolist(), held[b].tolist()):
                if (p := root(x)) != (q := root(y)):
                    group[max(p, q)] = min(p, q)
                    out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    salt = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    held = table.join(large, ["i", "v"]).select("i", "v", salt.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "fp", F.lit(0).alias("side"))
    asked = probes.join(large, ["i", "v"]).select("i", "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), salt.alias("part"), "fp", F.lit(1).alias("side"))
    more = held.unionByName(asked).groupBy("i", "v", "chunk", "part").applyInPandas(forest, "a long, b long")
    return links.unionByName(more)


def near_groups(prints: DataFrame, distance: int = 4) -> DataFrame:
    """fp, root of every distinct fingerprint of prints: equal roots are one group of links."""
    distinct = written(prints.select("fp").distinct(), "distinct-fingerprints")
    parts = 2 if distinct.count() > FEWEST_FOR_TWO_PARTS else 3 if distance < 6 else 4
    groups = components(near_links(distinct, distance, parts))
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_components(docs: DataFrame, words_per_shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable, itself included) of every row of docs.

    docs: doc_id, text. Rows of one fingerprint are linked whatever their text, so empty texts are one group; the
    steps between groups see distinct fingerprints only. A null doc_id is a member, but gives its group no id unless
    no member has one. Repeated rows come out as often as they come in; an empty table gives no rows.
    """
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words_per_shingle), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = written(near_groups(prints, distance).join(least, "fp"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, words_per_shingle: int = 5, distance: int = 4) -> DataFrame:
    """docs' rows, one of each near-duplicate group: the smallest doc_id (null last), then by a hash of the text.

    docs: doc_id, text and any other columns, all of which stay. Texts without words are copies of nothing: they stay,
    once per doc_id and text.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    prints = written(fingerprints(keyed, words_per_shingle), "fingerprints")
    rows = prints.where("fp <> 0").join(near_groups(prints.where("fp <> 0"), distance), "fp")
    return one_of_each(docs, prints, rows)


def one_of_each(docs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """docs' rows but those of rows that are not first of their root; once per doc_id and text.

    prints: doc_id, h (xxhash64 of the text) of all docs; rows: doc_id, h, root of those in a group. The texts meet the
    keys of what goes by a broadcast if those are few, else by a shuffle.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    firsts = rows.groupBy("root").agg(F.min(rank).alias("first"))
    losers = written(rows.withColumn("rank", rank).join(firsts, "root").where("rank <> first").select("doc_id", "h").distinct(), "losers")
    again = written(prints.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "repeated")

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = sent_if_small(keys)
        return df.join(keys, df["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(df["text"]) == keys["h"]), how)

    kept = among(docs, losers, "left_anti")
    if again.isEmpty():
        return kept
    return among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))
