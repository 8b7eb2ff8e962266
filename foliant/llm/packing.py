"""Best-fit packing of token pieces into sequences of bounded length, in hierarchical rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_batches, partitions, written
from foliant.llm.tokens import encoder

#: A bin with at most this many free places per thousand is emitted; others are items of the next round.
FREE_PER_MILLE = 2
#: Items a task gets at most, and from which a task of its own is worth its while.
ITEMS_PER_TASK = 100_000
ITEMS_WORTH_A_TASK = 10_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 (and the ids as little-endian bytes) of every document.

    docs: doc_id and text, null texts empty. Each document is its ids and end_id; only longer ones than `length` are
    cut, the first piece taking the remainder. row_key tells rows of equal or null doc_id apart.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            encoded = enc.encode_all([t or "" for t in batch.column("text").to_pylist()])
            for doc, key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), encoded):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n % length or length) if piece == 0 else length
                    own = ids[4 * at : 4 * (at + size)]
                    out.append((doc, key, piece, at, size, zlib.crc32(own), own))
                    at, piece = at + size, piece + 1
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns[: 6 + with_ids], kinds)]
            yield pa.record_batch(arrays, names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids])

    keyed = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_key"), "text")
    schema = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
    return map_batches(keyed, cut, schema + ", ids binary" * with_ids)


class _Bins:
    """Best fit by free places: for each number of free places the open bins that have it."""

    def __init__(self, length: int):
        self.length, self.open, self.mask = length, [[] for _ in range(length + 1)], 0
        self.members: list[list[int]] = []

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self.open[free].pop()
            if not self.open[free]:
                self.mask &= ~(1 << free)
            self.members[bin_].append(item)
        else:
            free, bin_ = self.length, len(self.members)
            self.members.append([item])
        left = free - size
        self.open[left].append(bin_)
        self.mask |= 1 << left


def _round(length: int, number: int):
    """A task of one round: its items, packed. An item has arrays of its members' keys and lengths."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items = [r for b in batches for r in zip(b.column("size").to_pylist(), b.column("keys").to_pylist(), b.column("sizes").to_pylist())]
        items.sort(key=lambda r: (-r[0], r[1][0]))
        bins = _Bins(length)
        for i, r in enumerate(items):
            bins.put(i, r[0])
        task = TaskContext.get().partitionId()
        rows = []
        for k, members in enumerate(bins.members):
            total = sum(items[m][0] for m in members)
            done = 1000 * (length - total) <= FREE_PER_MILLE * length
            rows.append(((number << 56) | (task << 32) | k, total, done, [x for m in members for x in items[m][1]], [x for m in members for x in items[m][2]]))
        for at in range(0, len(rows), 5000):
            ids, totals, dones, keys, sizes = zip(*rows[at : at + 5000])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(dones, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))],
                names=["sequence_id", "size", "done", "keys", "sizes"],
            )

    return pack


def pack_pieces(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """row_key, sequence_id, offset of every piece shorter than `length`; pieces: row_key (unique) and length.

    Each task packs its items by best fit, longest first; bins that are nearly full are emitted, the others are items
    of the next round, which has an eighth of the tasks, or as many as keep a task within ITEMS_PER_TASK items. Items
    are dealt by a hash, so tasks are alike. A bin that the smallest bin left doesn't fit into fits with none and is
    emitted as well, so the rounds end with one task or when no two bins of the whole table fit together. Best fit
    leaves a task one bin of half a sequence or less at most: from the second round on there are no more such bins than
    tasks, and the smallest fits with every bin it meets, so every round joins some. A bin holds at most `length`
    members, so no row grows.
    """
    schema = "sequence_id long, size long, done boolean, keys array<long>, sizes array<long>"
    items = pieces.select(F.col("length").alias("size"), F.array("row_key").alias("keys"), F.array("length").alias("sizes"))
    n, emitted, number = pieces.count(), [], 0
    tasks = max(1, min(partitions(pieces), n // ITEMS_WORTH_A_TASK), -(-n // ITEMS_PER_TASK))
    while True:
        spread = items.repartition(tasks, F.xxhash64(F.col("keys")[0], F.lit(number))) if tasks > 1 else items.repartition(1)
        bins = written(map_batches(spread, _round(length, number), schema), "bins")
        smallest = bins.where("not done").agg(F.min("size")).first()[0] if tasks > 1 else None
        fits = ~F.col("done") & (F.col("size") <= (length - smallest if smallest is not None else -1))
        n = bins.where(fits).count() if smallest is not None else 0
        if n < 2:
            emitted.append(bins)
            break
        emitted.append(bins.where(~fits))
        items, number = bins.where(fits).select("size", "keys", "sizes"), number + 1
        tasks = max(1, -(-tasks // 8), -(-n // ITEMS_PER_TASK))
    bins = emitted[0]
    for more in emitted[1:]:
        bins = bins.unionByName(more)
    ends = F.expr("slice(aggregate(sizes, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size(sizes))")
    return bins.select("sequence_id", F.explode(F.arrays_zip("keys", ends.alias("ends"))).alias("m")).select(
        F.col("m.keys").alias("row_key"), "sequence_id", F.col("m.ends").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every piece of token_pieces with its sequence_id and offset; null or empty texts are one piece, the end id.

    A piece of the full length is a sequence of its own. An empty table gives no rows; repeated rows are packed as
    often as they come.
    """
    pieces = written(token_pieces(docs, tokenizer_path, end_id, length, with_ids), "pieces")
    full = pieces.where(F.col("length") == length).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    short = pieces.where(F.col("length") < length)
    placed = short.join(pack_pieces(short, length), "row_key")
    return full.unionByName(placed).drop("row_key")
