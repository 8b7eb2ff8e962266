"""Ranked lexical search by the Best Position Algorithm over impact lists of blocks of documents.

A block of documents has an impact list for each term of the query items: its documents by falling impact. An item reads
its terms' lists from their heads, a stretch of each at a time; every document met is scored whole by direct accesses to
the other lists, which also mark its places there as seen. What is still unseen in a list stands behind its first unseen
place, the best position, so the impacts there add up to a bound of every document not met yet. Reading ends when that
bound is strictly below the k-th score, so documents of equal scores are all met. The k-th score is carried from block to
block of a task, and the tasks' best documents meet in one ranking an item.

Documents without an id and items without an id take no part; null texts have no terms. Rows that repeat a document's id are
documents of their own. Of items that share an id the smallest text counts. An item without a known term has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, written

#: Text bytes of a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Query items that are held against all documents at once, on average.
ITEMS_AT_ONCE = 4096
#: Places of every list that are read first; each further stretch is twice as long.
FIRST_STRETCH = 32

# What separates terms, and the weights of the score.
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_NO_TERM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TERMS = bytes.maketrans(_UPPER + _NO_TERM, _LOWER + b" " * len(_NO_TERM))
SLOPE = 25


def terms_of(text: bytes) -> list[bytes]:
    """A text's terms in order, of UTF-8 bytes."""
    return text.translate(_TERMS).split()


def _postings(ids: dict[bytes, int]):
    """A row per block: its documents with their numbers of terms, and of every query term the places of its documents and
    how often each has it, terms one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, held, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            place = np.repeat(np.arange(len(held)), [len(h) for h in held])
            term = np.fromiter((t for h in held for t in h), np.int64, len(place))
            times = np.fromiter((n for h in held for n in h.values()), np.int64, len(place))
            order = np.argsort(term, kind="stable")
            known, starts = np.unique(term[order], return_index=True)
            number = np.array(lengths, np.int64)
            arrays = [np.array(docs, np.int64), number, known, np.append(starts, len(order)), place[order].astype(np.int32), times[order]]
            return pa.record_batch(
                [*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([int((number > 0).sum())], pa.int64()), pa.array([int(number.sum())], pa.int64())],
                names=["docs", "lengths", "terms", "starts", "places", "times", "n_docs", "n_terms"],
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), encode_text(batch.column("text"))):
                if docs and size + len(text) > BLOCK_BYTES:
                    yield block()
                    docs, lengths, held, size = [], [], [], 0
                own = terms_of(text)
                docs.append(doc)
                lengths.append(len(own))
                held.append(Counter([ids[t] for t in own if t in ids]))
                size += len(text)
        if docs:
            yield block()

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
            yield pa.record_batch([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], names=["term", "n"])


@dataclass
class ImpactList:
    """One term's documents in a block: their places in order, the impacts there, the impacts falling, the place at each
    rank, and the rank of each place."""

    places: np.ndarray
    impacts: np.ndarray
    falling: np.ndarray
    ranked: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, impacts: np.ndarray) -> ImpactList:
        order = np.argsort(-impacts, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return cls(places, impacts, impacts[order], places[order], ranks)


class Best:
    """The k best (score, document) so far, equal scores by the smaller document."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.floor)
        scores, docs = np.append(self.scores, scores[some]), np.append(self.docs, docs[some])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def best_positions(lists: list[tuple[int, ImpactList]], docs: np.ndarray, best: Best) -> int:
    """Adds a block's documents to `best`; lists are the item's terms' with how often it has each. How many were scored."""
    seen = [np.zeros(len(x.ranked) + 1, bool) for _, x in lists]  # one place more, never seen, ends each
    at = [0] * len(lists)  # the best positions: all places before are seen
    met = np.zeros(len(docs), bool)
    read, stretch, scored = 0, FIRST_STRETCH, 0
    while True:
        bound = sum(times * int(x.falling[p]) for (times, x), p in zip(lists, at) if p < len(x.falling))
        if bound == 0 or bound < best.floor:
            return scored
        new = np.unique(np.concatenate([x.ranked[read : read + stretch] for _, x in lists]))
        new = new[~met[new]]
        met[new] = True
        scores = np.zeros(len(new), np.int64)
        for (times, x), own in zip(lists, seen):
            place = np.minimum(np.searchsorted(x.places, new), len(x.places) - 1)
            hit = x.places[place] == new
            scores[hit] += times * x.impacts[place[hit]]
            own[x.ranks[place[hit]]] = True
        best.add(scores, docs[new])
        scored += len(new)
        read, stretch = read + stretch, 2 * stretch
        at = [p + int(np.argmin(own[p:])) for own, p in zip(seen, at)]


def _search(items: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """item_id, doc_id, score: the k best of a task's blocks for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, terms, starts, times = (np.frombuffer(row[c], np.int64) for c in ("docs", "lengths", "terms", "starts", "times"))
                places = np.frombuffer(row["places"], np.int32)
                slot = {t: i for i, t in enumerate(terms.tolist())}
                m = 100 - SLOPE + (SLOPE * lengths * n_docs) // n_terms if n_terms else lengths
                lists: dict[int, ImpactList] = {}

                def impacts(term: int) -> ImpactList:
                    if term not in lists:
                        own = slice(starts[slot[term]], starts[slot[term] + 1])
                        tf, where = times[own], places[own]
                        lists[term] = ImpactList.of(where, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[where])))
                    return lists[term]

                for (_, own), best in zip(items, found):
                    if here := [(times_, impacts(t)) for t, times_ in own if t in slot]:
                        best_positions(here, docs, best)
        for (item, _), best in zip(items, found):
            if len(best.docs):
                yield pa.record_batch([pa.array([item] * len(best.docs), pa.int64()), pa.array(best.docs), pa.array(best.scores)], names=["item_id", "doc_id", "score"])

    return run


def _ranked(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The k best documents of each item of one query block."""
    ids: dict[bytes, int] = {}
    asked = [(item, sorted(Counter(ids.setdefault(t, len(ids)) for t in terms_of(text)).items())) for item, text in items]
    kinds = "docs binary, lengths binary, terms binary, starts binary, places binary, times binary, n_docs bigint, n_terms bigint"
    blocks = written(map_batches(docs, _postings(ids), kinds), "impact_blocks")
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    weights = np.zeros(len(ids), np.int64)
    for r in map_batches(blocks.select("terms", "starts"), _term_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df")).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    return map_batches(blocks, _search(asked, weights, total["n"], total["l"], k), "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents (doc_id, text) for items (item_id, text)."""
    items = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rounds = max(1, -(-items.count() // ITEMS_AT_ONCE))
    found = None
    for number in range(rounds):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number).orderBy("item_id").collect()
        some = _ranked(docs, [(r["item_id"], (r["text"] or "").encode()) for r in own], k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
