"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import map_batches, written

#: Components of a block of candidates, rows of a block of queries, and candidates that are bounded at once.
BLOCK_COMPONENTS = 1 << 18
QUERY_ROWS = 1024
AT_ONCE = 512
#: Rows that the rotation is fitted on.
SAMPLE_ROWS = 65_536
#: Blocks of the longest vectors that give each query its first threshold.
HEAD_BLOCKS = 2
#: Neighbouring blocks of candidates that a task holds, and query tasks whose blocks stream past them. Powers of two.
CELL_BLOCKS = 16
CELL_QUERIES = 8
#: Leading rotated dimensions, as shares of all, after which bounds are tested.
CHECKS = (0.125, 0.25, 0.5)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of every component, x as double.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, take no part.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors get zeros, which leave inner products as they are."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def rotation(vectors: DataFrame, width: int, rows: int) -> np.ndarray:
    """Orthonormal directions, strongest first: the right singular vectors of a sample, from its Gram matrix.

    About SAMPLE_ROWS of the `rows` vectors, chosen by a hash of their id, are looked at. Any orthonormal directions
    give the same results; these let partial sums come close to the whole early.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["gram"])

    every = max(1, rows // SAMPLE_ROWS)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").repartition(8)
    parts = map_batches(sample, gram, "gram binary").collect() if width else []
    total = sum((np.frombuffer(r["gram"]).reshape(width, width) for r in parts), np.zeros((width, width)))
    return np.linalg.eigh(total)[1][:, ::-1] if width else total


def _blocks(vectors: DataFrame, width: int, rows: int, tasks: int | None = None) -> DataFrame:
    """block, top (its longest vector's length), n, ids, matrix (int64 bytes) of vectors taken longest first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, ids, parts, held
            m = np.concatenate(parts)
            top = float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
            out = pa.record_batch(
                [pa.array([number]), pa.array([top]), pa.array([len(m)]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                names=["block", "top", "n", "ids", "matrix"],
            )
            number, ids, parts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            m, own = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            for at in range(0, len(m), rows):
                ids.append(own[at : at + rows])
                parts.append(m[at : at + rows])
                held += len(parts[-1])
                if held >= rows:
                    yield block()
        if held:
            yield block()

    by = (F.col("length").desc(), F.col("vec_id"))
    ranged = (vectors.repartitionByRange(tasks, *by) if tasks else vectors.repartitionByRange(*by)).sortWithinPartitions(F.col("length").desc(), "vec_id")
    return map_batches(ranged.select("vec_id", "v"), pack, "block long, top double, n long, ids binary, matrix binary")


def _exact(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of q's rows a with c's rows b; beyond 64 bits they are held at the ends of the range."""
    small = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0**62
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(a), 65536):
        x, y = q[a[i : i + 65536]], c[b[i : i + 65536]]
        if small:
            out.append(np.einsum("ij,ij->i", x, y))
        else:
            out.append(np.clip((x.astype(object) * y.astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64))
    return np.concatenate(out)


def _survivors(rq, rc, left_q, left_c, margin: float, floor: np.ndarray, steps: list[int]):
    """Pairs whose score may reach the query's floor.

    Partial sums over the leading rotated dimensions plus the product of what is left of both lengths bound a score
    from above; a pair with a lower bound than its query's floor is dropped before the next dimensions are added.
    """
    at = steps[0]
    bound = rq[:, :at] @ rc[:, :at].T
    a, b = np.nonzero(bound + np.outer(left_q[:, at], left_c[:, at]) + margin >= floor[:, None])
    partial, done = bound[a, b], at
    for at in steps[1:]:
        partial = partial + np.einsum("ij,ij->i", rq[a, done:at], rc[b, done:at])
        keep = partial + left_q[a, at] * left_c[b, at] + margin >= floor[a]
        a, b, partial, done = a[keep], b[keep], partial[keep], at
    return a, b


@dataclass
class Side:
    """Rows with their ids, the same rows rotated, and what is left of each one's length before every dimension."""

    ids: np.ndarray
    rows: np.ndarray
    rotated: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(ids: bytes, matrix: bytes, basis: np.ndarray) -> Side:
        own = np.frombuffer(ids, np.int64)
        rows = np.frombuffer(matrix, np.int64).reshape(len(own), len(basis))
        rotated = rows.astype(float) @ basis
        return Side(own, rows, rotated, np.sqrt(np.pad((rotated**2)[:, ::-1].cumsum(1)[:, ::-1], ((0, 0), (0, 1)))))


def _search(q: Side, blocks: Iterable[Side], floor: np.ndarray, k: int):
    """(query row, candidate's id, score) of the k best of every query against the blocks, none below its floor.

    Candidates come longest first; the k-th best score so far raises a query's floor for the shorter ones. The margin
    covers rounding, so a bound is never too low; scores are exact integers.
    """
    width, floor = q.rows.shape[1], floor.copy()
    steps = sorted({max(1, int(width * s)) for s in CHECKS}) if width else [0]
    kept_a, kept_id, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in blocks:
        margin = 1e-9 * (q.left[:, 0].max(initial=0) * c.left[:, 0].max(initial=0)) + 1e-6
        for start in range(0, len(c.ids), AT_ONCE):
            end = start + AT_ONCE
            may = np.flatnonzero(q.left[:, 0] * c.left[start:end, 0].max() + margin >= floor)
            if not len(may):
                continue
            a, b = _survivors(q.rotated[may], c.rotated[start:end], q.left[may], c.left[start:end], margin, floor[may], steps)
            a, b = may[a], b + start
            other = q.ids[a] != c.ids[b]
            a, b = a[other], b[other]
            score = _exact(q.rows, c.rows, a, b)
            a, ids, score = np.append(kept_a, a), np.append(kept_id, c.ids[b]), np.append(kept, score)
            order = np.lexsort((ids, -score, a))
            a, ids, score = a[order], ids[order], score[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            full = rank == k - 1
            floor[a[full]] = np.maximum(floor[a[full]], score[full])
            keep = (rank < k) & (score >= floor[a])
            kept_a, kept_id, kept = a[keep], ids[keep], score[keep]
    return kept_a, kept_id, kept


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    vectors: vec_id, embedding (array of a numeric type); queries: vec_id, the rows of vectors to search for. A query
    never meets its own id; of several rows with its id the least vector is the query. Rows that integer_vectors() leaves out are neither queries nor candidates; repeated rows
    are candidates each; vectors of other lengths count as filled with zeros; empty tables give no rows. Scores beyond
    64 bits are held at the ends of the range.

    Vectors are ranged by length into blocks. The longest blocks give each query its first floor. CELL_BLOCKS blocks of
    neighbours and the query blocks of CELL_QUERIES tasks meet on a key of their own, if some score can reach a floor:
    a task holds the candidates and lets query blocks stream past, so a block is copied once for many of the others.
    """
    spark = vectors.sparkSession
    clean = integer_vectors(vectors, scale)
    norms = clean.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    size = clean.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width = size["w"] or 0
    basis = rotation(clean, width, size["n"])
    rows = max(64, BLOCK_COMPONENTS // max(1, width))
    blocks = written(_blocks(norms, width, rows), "vector-blocks")
    asked = (
        norms.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
        .groupBy("vec_id").agg(F.min(F.struct("length", "v")).alias("x")).select("vec_id", "x.*")
    )
    tasks = -(-asked.count() // QUERY_ROWS) or 1
    q_blocks = written(_blocks(asked, width, QUERY_ROWS, tasks), "query-blocks").select("block", "ids", "matrix")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell first the candidates, which are held, then the query blocks."""
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {x: batch.column(x)[i].as_py() for x in ("cell", "q_cell", "ids", "matrix", "floors")}
                if cell != (r["cell"], r["q_cell"]):
                    cell, held = (r["cell"], r["q_cell"]), []
                side = Side.of(r["ids"], r["matrix"], basis)
                if r["floors"] is None:
                    held.append(side)
                    continue
                a, ids, score = _search(side, held, np.frombuffer(r["floors"], np.float64), k)
                yield pa.record_batch([pa.array(side.ids[a]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query block with its floors against the longest blocks, and the least floor over length."""
        for batch in batches:
            for r in batch.to_pylist():
                q = Side.of(r["ids"], r["matrix"], basis)
                ends = [Side.of(h["ids"], h["matrix"], basis) for h in r["heads"]]
                a, _, score = _search(q, ends, np.full(len(q.ids), -np.inf), k)
                floor, last = np.full(len(q.ids), -np.inf), np.arange(len(a)) - np.searchsorted(a, a) == k - 1
                floor[a[last]] = score[last]
                lengths = q.left[:, 0]
                needs = np.where(lengths > 0, floor / np.maximum(lengths, 1e-300), np.where(floor <= 0, -np.inf, np.inf))
                yield pa.record_batch(
                    [pa.array([r["block"]]), pa.array([floor.tobytes()], pa.binary()), pa.array([float(needs.min(initial=np.inf))])],
                    names=["block", "floors", "needs"],
                )

    ends = blocks.orderBy(F.col("top").desc(), "block").limit(HEAD_BLOCKS)
    heads = ends.agg(F.collect_list(F.struct("ids", "matrix")).alias("heads")).withColumn("one", F.lit(1))
    floors = written(
        map_batches(q_blocks.withColumn("one", F.lit(1)).join(F.broadcast(heads), "one"), first_floors, "block long, floors binary, needs double"),
        "floors",
    )
    # a block's number is its task's, in order of length, and its place there
    cell, q_cell = F.floor(F.col("block") / CELL_BLOCKS).alias("cell"), F.floor(F.col("block") / (CELL_QUERIES << 32)).alias("q_cell")
    tops, needs = blocks.groupBy(cell).agg(F.max("top").alias("top")), floors.groupBy(q_cell).agg(F.min("needs").alias("needs"))
    # which cells may hold a hit for which: a few numbers each
    needs = F.broadcast(needs) if floors.count() <= 100_000 else needs
    wanted = written(tops.join(needs, F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("needs")).select("cell", "q_cell"), "cells")
    block = ["cell", "q_cell", "block", "ids", "matrix"]
    held = wanted.join(blocks.select(cell, "block", "ids", "matrix"), "cell").select(*block, F.lit(None).cast("binary").alias("floors"))
    passing = q_blocks.join(floors.select("block", "floors"), "block").select(q_cell, "block", "ids", "matrix", "floors").join(wanted, "q_cell")
    met = held.unionByName(passing.select(*block, "floors")).repartition("cell", "q_cell")
    found = map_batches(met.sortWithinPartitions("cell", "q_cell", F.col("floors").isNotNull(), "block"), search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
