"""Near-duplicates: SimHash fingerprints by multi-index hashing, exact Jaccard similarity of shingle sets, connected components.

Pairs of near fingerprints come first; their sets decide. As sets that are similar enough may differ in more bits than can be
looked up, a pair of sets that is not joined yet also meets under a shared shingle of their prefixes, is held against what its sizes, places and histograms
allow, and only then by the sets themselves. Each test drops pairs that can't be similar, never one that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, sent_if_small, written
from foliant.llm.graphs import components
from foliant.llm.simhash import majority, near_links, one_of_each, shingle_hashes

#: Shingles that count as common; they stand last in the order of shingles, and any order gives the same links.
COMMON = 100_000
#: A task names the shingles that so many of its texts have, and at most so many of them.
LEAST_COUNT = 3
NAMED = 20_000
#: Shingles that a task counts at once.
COUNTED_AT_ONCE = 1 << 21
#: The sets that have a shingle are compared in tasks of their own if they are more, so many at a time.
CROWD = 64
CHUNK = 512
#: Bits that fingerprints may differ in to be looked up.
DISTANCE = 4
#: Cells of a set's histogram; a cell holds 255 at most.
CELLS = 128


def shingle_set(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles; none without a word."""
    return np.unique(shingle_hashes(text, words_per_shingle).astype(np.uint64))


def set_id(values: np.ndarray) -> int:
    """One 64-bit hash, signed, for all texts of one shingle set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(values.tobytes(), 42)).astype(np.int64))


def least_overlap(n: int, share: Fraction) -> int:
    """The least number not below share * n."""
    return -(-n * share.numerator // share.denominator)


def common_shingles(docs: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks from 1) of the COMMON shingles that most texts have, the most common last; ascending hashes.

    Every text is counted. A task names what LEAST_COUNT of its texts have, so a shingle that is rare everywhere has no
    count, which costs nothing: it stands among the rare ones.
    """

    def merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return hashes[first], np.add.reduceat(counts, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for t in encode_text(batch.column("text")):
                new.append(shingle_set(t, words_per_shingle))
                size += len(new[-1])
                if size > COUNTED_AT_ONCE:
                    held, counts = merged(np.concatenate([held, *new]), np.append(counts, np.ones(size, np.int64)))
                    if len(held) > 4 * COUNTED_AT_ONCE:
                        held, counts = held[counts > 1], counts[counts > 1]
                    new, size = [], 0
        if size:
            held, counts = merged(np.concatenate([held, *new]), np.append(counts, np.ones(size, np.int64)))
        most = np.flatnonzero(counts >= LEAST_COUNT)
        most = most[np.argsort(-counts[most], kind="stable")[:NAMED]]
        yield pa.record_batch([pa.array(held[most].view(np.int64)), pa.array(counts[most])], names=["h", "n"])

    named = map_batches(docs.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = named.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(rows), 0, -1)[order]


def prefixes(docs: DataFrame, words_per_shingle: int, share: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs' columns without text, and node (the set's id, null without words), n (its size), cells (its histogram),
    prefix (array of hashes), fp (the text's fingerprint).

    Shingles are ordered by rank among the common ones, the rest first, then by hash. Two sets of a similarity of
    `share` or more have a member in common among their first n - ceil(share * n) + 1.
    """
    known, ranks = common

    def own(text: bytes) -> tuple:
        hashes = shingle_hashes(text, words_per_shingle)
        values = np.unique(hashes.astype(np.uint64))
        n = len(values)
        if not n:
            return None, 0, None, [], 0
        rank = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            rank = np.where(known[at] == values, ranks[at], 0)
        first = np.lexsort((values, rank))[: n - least_overlap(n, share) + 1]
        cells = np.minimum(np.bincount((values % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)
        return set_id(values), n, cells.tobytes(), values[first].view(np.int64), majority(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [own(t) for t in encode_text(batch.column("text"))]
            node, n, cells, prefix, fp = zip(*rows) if rows else ((), (), (), (), ())
            found = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(cells, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
            yield pa.record_batch([*(batch.column(k) for k in kept), *found], names=[*kept, "node", "n", "cells", "prefix", "fp"])

    kept = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    return map_batches(docs, run, ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), "node long, n int, cells binary, prefix array<long>, fp long"]))


def alike(pairs: DataFrame, nodes: DataFrame, share: Fraction) -> DataFrame:
    """Those of pairs (a, b: set ids) whose histograms allow a similarity of `share`.

    Sets of n and m members and of that similarity differ in at most (n + m)(1 - share) / (1 + share) members, and the
    cells of their histograms together by no more than the sets.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for k in ("x", "y"))
            apart = np.abs(x - y).sum(1, dtype=np.int64)
            total = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            keep = apart * (share.denominator + share.numerator) <= total * (share.denominator - share.numerator)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(nodes.select(F.col("node").alias("a"), "n", F.col("cells").alias("x")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("cells").alias("y")), "b")
    return map_batches(both.select("a", "b", "n", "m", "x", "y"), compare, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, share: Fraction) -> DataFrame:
    """Those of pairs (a, b: set ids) whose sets are of a similarity of `share` or more; texts: text, one of each set that is in a pair."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words_per_shingle) for t in encode_text(batch.column("text"))]
            yield pa.record_batch([pa.array(map(set_id, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(shared * share.denominator >= share.numerator * (len(x) + len(y) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = written(map_batches(texts.select("text"), sets, "node long, members binary"), "members")
    both = pairs.join(members.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(members.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return map_batches(both, compare, "a long, b long")


def crowd_pairs(rows: DataFrame, share: Fraction) -> DataFrame:
    """a, b: pairs of sets of different roots under one shingle that sizes, places and histograms allow to be similar.

    rows: s, g (the sets that have s), node, n, pos, root, cells. A crowd is cut into chunks of CHUNK; every two chunks
    meet in a task, which compares all their sets and sends on what may be similar, never all pairs. A pair that meets
    in several crowds is sent on by the first.
    """
    import pandas as pd

    num, den = share.numerator, share.denominator

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        both = [pdf[pdf.side == k] for k in (0, 1)]
        if not len(both[1]):
            both[1] = both[0]
        x, y = ([f[c].to_numpy() for c in ("node", "n", "pos", "root")] for f in both)
        cx, cy = (np.frombuffer(b"".join(f.cells), np.uint8).reshape(-1, CELLS).astype(np.int16) for f in both)
        crowds = [[frozenset(c.tolist()) for c in f.crowds] for f in both]
        own, out = int(pdf.s.iloc[0]), []
        for k in range(len(x[0])):
            node, n, pos, root = (int(c[k]) for c in x)
            other, m, at, apart = y
            may = (apart != root) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
            may &= (np.minimum(pos, at) + 1 + np.minimum(n - pos - 1, m - at - 1)) * (num + den) >= num * (n + m)
            may = np.flatnonzero(may)
            close = np.abs(cy[may] - cx[k]).sum(1, dtype=np.int64) * (den + num) <= (n + m[may]) * (den - num)
            first = [i for i in may[close].tolist() if min(crowds[0][k] & crowds[1][i]) == own]
            out += [(min(node, o), max(node, o)) for o in other[first].tolist()]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    chunks = F.ceil(F.col("g") / CHUNK).cast("int")
    several = rows.groupBy("node").agg(F.collect_set("s").alias("crowds"))
    cut = rows.join(several, "node").select("*", chunks.alias("chunks"), F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int").alias("own"))
    fields = ["node", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "root", "cells", "crowds"]
    left = cut.select("s", F.col("own").alias("i"), F.explode(F.expr("sequence(own, chunks - 1)")).alias("j"), F.lit(0).alias("side"), *fields)
    right = cut.where("own > 0").select("s", F.explode(F.expr("sequence(0, own - 1)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *fields)
    return left.unionByName(right).groupBy("s", "i", "j").applyInPandas(compare, "a long, b long")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """node, b: pairs of sets (node, fp) that join all sets whose fingerprints differ in at most DISTANCE bits, not yet held against their sets.

    Sets of one fingerprint are paired with the least of them, which also stands for them in pairs of fingerprints.
    """
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    same = nodes.join(least, "fp").where("node <> b").select("node", "b")
    near = near_links(least.select("fp"), DISTANCE)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("b").alias("node")), "a").drop("a")
    return same.unionByName(near.withColumnRenamed("b", "fp").join(least, "fp").select("node", "b"))


def similar_groups(docs: DataFrame, prints: DataFrame, words_per_shingle: int, share: Fraction) -> DataFrame:
    """node, root of every distinct set of prints: equal roots are joined by links of a similarity of `share` or more.

    prints: h (hash of the text), node, n, cells, prefix, fp; docs: h, text. Sets of near fingerprints, and sets that share a
    shingle of their prefixes, may be similar. First the former are held against one another, and each of the latter is held against the least and the greatest set under that shingle, which joins large groups
    by few links; then every pair under one shingle that is not joined yet, large groups of them in crowd_pairs(). No
    similar pair is left out, but pairs within a group need no links of their own.
    """
    with_words = prints.where("node IS NOT NULL")
    nodes = written(with_words.groupBy("node").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.min("h").alias("h"), F.min("fp").alias("fp")), "sets")
    once = with_words.groupBy("node", "n").agg(F.first("prefix").alias("prefix"))
    every = once.select("node", "n", F.posexplode("prefix").alias("pos", "s")).repartition("s")  # dealt once for both uses
    ends = every.groupBy("s").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = written(every.join(ends, "s"), "shared-shingles")
    total = F.lit(share.numerator / (share.numerator + share.denominator) - 1e-9)

    def sized(n: str, m: str):  # what a similar pair must satisfy, by its sizes
        return F.least(n, m) * share.denominator >= F.greatest(n, m) * share.numerator

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()

    def linked(near: DataFrame) -> DataFrame:
        return written(verified(near, _texts(docs, nodes, near), words_per_shingle, share), "similar")

    sizes = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"))
    stars = shared.select("node", "n", F.explode(F.array("low", "high")).alias("b")).where("node <> b").distinct()
    met = fingerprint_pairs(nodes.select("node", "fp")).join(nodes.select("node", "n"), "node").select("node", "n", "b").unionByName(stars)
    tested = written(alike(ordered(met.join(sizes, "b").where(sized("n", "m"))), nodes, share), "alike")
    links = linked(tested)
    roots = components(links)
    now = shared.select("s", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = now.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("g")).where("least < most").select("s", "g")
    open_rows = written(now.join(open_, "s").select("s", "g", "node", "n", "pos", "root"), "open-shingles")
    crowds = open_rows.where(F.col("g") > CROWD)
    few = open_rows.where(F.col("g") <= CROWD)
    other = few.select("s", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other"))
    # members before a common one are common at most as far as the shorter way, and so are those after it
    most = F.least("pos", "at") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("at") - 1)
    pairs = few.join(other, "s").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & sized("n", "m") & (most >= total * (F.col("n") + F.col("m"))))
    pairs = alike(pairs.select(F.col("node").alias("a"), "b").distinct(), nodes, share)
    crowded = crowd_pairs(crowds.join(nodes.select("node", "cells"), "node"), share)
    near = written(pairs.unionByName(crowded).distinct().join(tested, ["a", "b"], "left_anti"), "open-pairs")
    if not near.isEmpty():
        roots = components(links.unionByName(linked(near)))
    return nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """A text of every set that is in a pair."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("h").distinct()
    return docs.join(sent_if_small(written(wanted, "wanted")), "h", "left_semi").dropDuplicates(["h"])


def keep_one_of_similar(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' rows, one of each group of texts of a Jaccard similarity of `similarity` or more: the smallest doc_id (null
    last), then by a hash of the text.

    docs: doc_id, text and any other columns, all of which stay. Texts without words are copies of nothing: they stay,
    once per doc_id and text. Shingles are told apart by 64-bit hashes.
    """
    share = Fraction(str(similarity))
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    prints = written(prefixes(keyed, words_per_shingle, share, common_shingles(docs, words_per_shingle)), "prefixes")
    rooted = similar_groups(keyed.select("h", "text"), prints, words_per_shingle, share)
    rows = prints.select("doc_id", "h", "node").join(rooted, "node")
    return one_of_each(docs, prints, rows)
