"""Rows of pages held against their page's boxes: neighbouring rows travel as one pack of columns, and arrays do the rest.

A page's packs meet in one task. What its rows are held against is in memory, a page at a time; the rows themselves stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from foliant.functions.session import importable

PAGE = ["document_id", "page"]
KINDS = {DoubleType(): pa.float64(), LongType(): pa.int64(), IntegerType(): pa.int32(), StringType(): pa.string()}
#: Rows that are held against boxes at once, pairs of them at once, and rows of a batch that leaves a task; any numbers give the same results.
AT_ONCE, PAIRS, LEAVING = 256, 1 << 20, 8192
#: So many pairs of rows and boxes are compared without a look at what may touch what.
FEW_PAIRS = 1 << 15
#: Pages are answered together up to so many rows; any number gives the same results.
TOGETHER = 1 << 15


def _columns(df: DataFrame) -> pa.Schema:
    return pa.schema([(f.name, KINDS[f.dataType]) for f in df.schema if f.name not in PAGE])


def _unlisted(batch: pa.RecordBatch, name: str | None, columns: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """The columns of a batch, with a row for every element of its list `name` if there is one, and where each of its rows begins and the last ends."""
    own, at = {c: batch.column(c) for c in columns.names if c in batch.schema.names}, np.arange(batch.num_rows + 1)
    if name:
        lists = batch.column(name)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        of, elements = pa.array(np.repeat(np.arange(batch.num_rows), counts)), lists.flatten()
        own = {c: x.take(of) for c, x in own.items()} | {f.name: x for f, x in zip(elements.type, elements.flatten())}
        at = np.append(0, np.cumsum(counts))
    return pa.RecordBatch.from_arrays([own[c].cast(columns.field(c).type) for c in columns.names], schema=columns), at


def packed(df: DataFrame, kind: int, lists: dict[str, pa.Schema] | None = None) -> DataFrame:
    """PAGE, kind, size, pack: a row for every run of df's rows of one page; rows without a page go.

    lists: columns of df that are lists of structs, and what is kept of their elements and of df's own columns; the elements of each are packed as rows
    of a kind of their own, from `kind` on. Lists reach Python several times faster than as many rows.
    """
    tables = lists or {None: _columns(df)}
    out = pa.schema([("document_id", pa.string()), ("page", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("pack", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in PAGE]
            apart = [pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in keys]
            starts = np.append(0, np.flatnonzero(apart[0] | apart[1]) + 1)
            for own_kind, (name, columns) in enumerate(tables.items(), kind):
                rows, at = _unlisted(batch, name, columns)
                first, last = at[starts], at[np.append(starts[1:], n)]
                some = np.flatnonzero(first < last)
                raw = [rows.slice(a, b - a).serialize() for a, b in zip(first[some].tolist(), last[some].tolist())]
                packs = [pa.compress(x, "zstd", asbytes=True) for x in raw]
                own = [k.take(pa.array(starts[some])) for k in keys]
                yield pa.RecordBatch.from_arrays([own[0].cast(pa.string()), own[1].cast(pa.int64()), pa.array([own_kind] * len(raw), pa.int32()), pa.array([len(x) for x in raw], pa.int32()), pa.array(packs, pa.binary())], schema=out)

    importable(df.sparkSession)
    rows = df.where("document_id IS NOT NULL AND page IS NOT NULL").select(*PAGE, *[c for c in df.columns if c not in PAGE])
    return rows.mapInArrow(run, "document_id string, page long, kind int, size int, pack binary")


def by_page(rows: DataFrame, held: list[DataFrame], prepare: Callable, answer: Callable, names: str) -> DataFrame:
    """PAGE and `names` (columns with types): what `answer` has for the rows of each page.

    prepare(tables of `held`, without PAGE) gives what a page's rows are held against, or None to drop them;
    answer(that, some of its rows) gives the columns of `names`, all of one length.
    """
    shapes = [_columns(df) for df in [*held, rows]]
    kinds, packs = len(held), packed(rows, len(held))
    for k, df in enumerate(held):
        packs = packs.unionByName(packed(df, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, tables, against, ready = None, [], None, False
        out: list[tuple] = []
        size = 0

        for batch in batches:
            for document, number, kind, length, pack in zip(*(batch.column(k).to_pylist() for k in (*PAGE, "kind", "size", "pack"))):
                if page != (document, number):
                    page, tables, ready = (document, number), [[] for _ in range(kinds)], False
                some = pa.ipc.read_record_batch(pa.decompress(pack, length, "zstd"), shapes[kind])
                if kind < kinds:
                    tables[kind].append(some)
                    continue
                if not ready:
                    against = prepare(*map(_table, tables, shapes))
                    tables, ready = [[] for _ in range(kinds)], True
                if against is None:
                    continue
                found = answer(against, some)
                out.append((page, found))
                size += len(found[0])
                if size >= LEAVING:
                    yield _leaving(out, names)
                    out, size = [], 0
        if out:
            yield _leaving(out, names)

    return _dealt(packs).mapInArrow(run, f"document_id string, page long, {names}")


def whole_pages(rows: DataFrame, lists: dict[str, list[str]], answer: Callable, names: str) -> DataFrame:
    """PAGE and `names` (columns with types): what `answer` has for the pages of rows.

    lists: columns of rows that are lists of structs, and the columns of rows that go with their elements. A page's elements of each list are a table,
    and several small pages are answered together: answer(tables, the page's number of each row of each table, pages) gives the page's
    number of each row of its own, and columns. A page is in memory as a whole.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    shapes = {name: pa.schema([(c, KINDS[kinds[c]]) for c in beside] + [(x.name, KINDS[x.dataType]) for x in kinds[name].elementType]) for name, beside in lists.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        own: list[list] = [[] for _ in shapes]
        of: list[list] = [[] for _ in shapes]
        size = 0

        def answered() -> pa.RecordBatch:
            which = [np.repeat(np.array([x for x, _ in o], np.int64), [n for _, n in o]) for o in of]
            page, columns = answer([_table(t, s) for t, s in zip(own, shapes.values())], which, len(found))
            keys = [pa.array([x[i] for x in found], t).take(pa.array(page)) for i, t in ((0, pa.string()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([*keys, *columns], names=[*PAGE, *[x.split()[0] for x in names.split(", ")]])

        for batch in batches:
            for document, number, kind, length, pack in zip(*(batch.column(k).to_pylist() for k in (*PAGE, "kind", "size", "pack"))):
                if not found or found[-1] != (document, number):
                    if size >= TOGETHER:
                        yield answered()
                        found, size = [], 0
                        own, of = [[] for _ in shapes], [[] for _ in shapes]
                    found.append((document, number))
                some = pa.ipc.read_record_batch(pa.decompress(pack, length, "zstd"), list(shapes.values())[kind])
                own[kind].append(some)
                of[kind].append((len(found) - 1, some.num_rows))
                size += some.num_rows
        if found:
            yield answered()

    return _dealt(packed(rows, 0, shapes)).mapInArrow(run, f"document_id string, page long, {names}")


def _dealt(packs: DataFrame) -> DataFrame:
    """All packs of a page in one task, by kind."""
    return packs.repartition(*PAGE).sortWithinPartitions(*PAGE, "kind")


def _table(packs: list[pa.RecordBatch], shape: pa.Schema) -> pa.RecordBatch:
    if len(packs) == 1:
        return packs[0]
    return pa.Table.from_batches(packs, shape).combine_chunks().to_batches()[0] if packs else pa.RecordBatch.from_pylist([], shape)


def _leaving(out: list[tuple], names: str) -> pa.RecordBatch:
    """A batch of pages' answers: (page, columns) each."""
    counts = [len(x[1][0]) for x in out]
    which = pa.array(np.repeat(np.arange(len(out)), counts))
    keys = [pa.array([x[0][i] for x in out], t).take(which) for i, t in ((0, pa.string()), (1, pa.int64()))]
    columns = [pa.concat_arrays([x[1][i] for x in out]) for i in range(len(out[0][1]))]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=[*PAGE, *[x.split()[0] for x in names.split(", ")]])


def numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of doubles; what is no number stands above all, as in Spark's order, and a null is no number."""
    values = rows.column(name).to_numpy(zero_copy_only=False)
    lacks = np.isnan(values)
    return np.where(lacks, np.inf, values) if lacks.any() else values


def complete(rows: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Rows none of whose columns `names` is null."""
    out = np.ones(rows.num_rows, bool)
    for c in names:
        if rows.column(c).null_count:
            out &= pc.is_valid(rows.column(c)).to_numpy(zero_copy_only=False)
    return out


class Ranges:
    """Ranges (low, high) in classes of like length, each sorted by its low ends: those that may touch a range are a slice of each class."""

    def __init__(self, low: np.ndarray, high: np.ndarray, unit: float = 1.0):
        self.low, self.high, self.size, self.unit = low, high, len(low), unit

    @cached_property
    def classes(self) -> list[tuple[np.ndarray, float, np.ndarray]]:
        length, out = np.maximum(np.nan_to_num(self.high - self.low, nan=np.inf), self.unit), []
        classes = np.ceil(np.log2(length) / 2)
        for c in np.unique(classes):
            own = np.flatnonzero(classes == c)
            own = own[np.argsort(self.low[own], kind="stable")]
            out.append((self.low[own], length[own].max(), own))
        return out

    def near(self, first: float, last: float) -> np.ndarray:
        """Places of all ranges that touch (first, last), and some others."""
        out = []
        for low, longest, own in self.classes:
            a = np.searchsorted(low, first - longest - 1.0) if longest < np.inf else 0
            b = np.searchsorted(low, last, side="right")
            if a < b:
                out.append(own[a:b])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Places:
    """Where a pair of whole numbers stands in two columns of a table."""

    def __init__(self, rows: pa.RecordBatch, *names: str):
        self.names, self.known = names, [rows.column(c).to_numpy() for c in names]
        self.least = [int(x.min()) for x in self.known]
        first, second = (int(x.max()) - low + 1 for x, low in zip(self.known, self.least))
        self.times = second if first * second < 1 << 62 else None
        if self.times:
            key = self._key(self.known)
            self.order = np.argsort(key, kind="stable")
            self.keys = key[self.order]
        else:
            self.found = {k: i for i, k in enumerate(zip(*(x.tolist() for x in self.known)))}

    def _key(self, pair: list[np.ndarray]) -> np.ndarray:
        return (pair[0] - self.least[0]) * self.times + (pair[1] - self.least[1])

    def of(self, rows: pa.RecordBatch) -> np.ndarray:
        """The place of each row's pair, -1 without one."""
        pair = [rows.column(c).to_numpy().astype(np.int64) for c in self.names]
        if not self.times:
            return np.array([self.found.get(k, -1) for k in zip(*(x.tolist() for x in pair))], np.int64)
        at = self.order[np.minimum(np.searchsorted(self.keys, self._key(pair)), len(self.keys) - 1)]
        return np.where((self.known[0][at] == pair[0]) & (self.known[1][at] == pair[1]), at, -1)


def no_number_last(values: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), np.inf, values)


def first_of(ranges: Ranges, low: np.ndarray, high: np.ndarray, holds: Callable, across: tuple[np.ndarray, np.ndarray], beside: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row the least place of the boxes that hold it, -1 without one.

    ranges: of all boxes in one direction; low, high: the rows' in the same; across: the boxes' ends in the other direction and
    beside: the rows'. A box that holds a row touches it in both. holds(slice of rows, places): which do, a row of flags for each.
    """
    n = len(low)
    if 0 < n * ranges.size <= FEW_PAIRS:
        flags = holds(slice(0, n), slice(None))
        first = flags.argmax(1)
        return np.where(flags[np.arange(n), first], first, -1)
    best = np.full(n, -1)
    at = 0
    while at < n:
        some = slice(at, min(at + AT_ONCE, n))
        near = ranges.near(low[some].min(), high[some].max())
        near = near[(across[0][near] <= beside[1][some].max() + 1) & (across[1][near] >= beside[0][some].min() - 1)]
        some = slice(at, min(at + AT_ONCE, at + max(1, PAIRS // max(len(near), 1)), n))
        if len(near):
            near.sort()
            flags = holds(some, near)
            first = flags.argmax(1)
            best[some] = np.where(flags[np.arange(len(first)), first], near[first], -1)
        at = some.stop
    return best


#: The sides of boxes: x0, y0, x1, y1.
Sides = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Heights:
    """Rows in order of their page and height (low, high) and, within one, from left to right: `order` puts them there, `of` is each one's height.

    page: the number of each row's page, ascending; pages: how many there are.
    """

    def __init__(self, page: np.ndarray, pages: int, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray):
        cuts = np.append(0, np.flatnonzero((page[1:] != page[:-1]) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1])) + 1)
        order = np.lexsort((y1[cuts], y0[cuts], page[cuts]))
        number, low, high = page[cuts][order], y0[cuts][order], y1[cuts][order]
        new = np.append(True, (number[1:] != number[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        self.page, self.low, self.high, self.pages = number[new], low[new], high[new], pages
        which = np.empty(len(cuts), np.int64)
        which[order] = np.cumsum(new) - 1
        of = np.repeat(which, np.diff(np.append(cuts, len(x0))))
        self.order = np.lexsort((x0, of))
        self.of = of[self.order]

    def met(self, page: np.ndarray, holds: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a height and a box of its page, in order; page: of each box, ascending; holds(heights, boxes): a flag for each of these pairs."""
        ends = np.searchsorted(page, np.arange(self.pages + 1))
        first, counts = ends[self.page], np.diff(ends)[self.page]
        height, box = [], []
        for some, own in _expanded(first, counts):
            flags = holds(some, own)
            height.append(some[flags])
            box.append(own[flags])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *height]), np.concatenate([none, *box])


def _expanded(first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i]), (i, first[i] + 1), ... of counts[i] pairs for each i, about PAIRS at once."""
    done = np.cumsum(counts)
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
        n = counts[at:stop]
        begins = np.cumsum(n) - n
        yield np.repeat(np.arange(at, stop), n), np.arange(int(n.sum())) + np.repeat(first[at:stop] - begins, n)
        at = stop


def first_around(rows: Heights, page: np.ndarray, boxes: Sides, x0: np.ndarray, x1: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row (in order) the least place of its page's boxes that reach around (x0, x1) and its height's (low, high), -1 without one.

    page: of each box, ascending. Only rows whose left end lies within a box are held against it.
    """
    b_x0, b_y0, b_x1, b_y1 = boxes
    best = np.full(len(x0), len(b_x0))
    height, box = rows.met(page, lambda h, b: (b_y0[b] <= low[h]) & (b_y1[b] >= high[h]))
    lefts, place = np.unique(x0, return_inverse=True)
    times = len(lefts) + 1
    keys = rows.of * times + place
    first = np.searchsorted(keys, height * times + np.searchsorted(lefts, b_x0)[box])
    if (x0 > x1).any():
        last = np.searchsorted(keys, (height + 1) * times)
    else:
        last = np.searchsorted(keys, height * times + np.searchsorted(lefts, b_x1, side="right")[box])
    for pair, row in _expanded(first, np.maximum(last - first, 0)):
        around = x1[row] <= b_x1[box[pair]]
        np.minimum.at(best, row[around], box[pair[around]])
    return np.where(best < len(b_x0), best, -1)


def nearest_beside(rows: Heights, page: np.ndarray, boxes: Sides, x0: np.ndarray, x1: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (in order) the nearest left end at or behind x1 and right end at or before x0, of its page's boxes that reach into
    its height's (low, high); infinite without one."""
    behind, before = np.full(len(x0), np.inf), np.full(len(x0), -np.inf)
    for side, out in ((0, behind), (2, before)):
        order = np.lexsort((boxes[side], page))
        b_y0, b_y1, of = boxes[1][order], boxes[3][order], page[order]
        height, box = rows.met(of, lambda h, b: (b_y0[b] < high[h]) & (b_y1[b] > low[h]))
        edges = boxes[side][order][box]
        ends, place = np.unique(edges, return_inverse=True)
        times = len(ends) + 1
        keys = np.append(height * times + place, np.iinfo(np.int64).max)
        if side == 0:
            at = np.searchsorted(keys, rows.of * times + np.searchsorted(ends, x1))
            found = keys[at] < (rows.of + 1) * times
        else:
            at = np.searchsorted(keys, rows.of * times + np.searchsorted(ends, x0, side="right")) - 1
            found = (at >= 0) & (keys[at] >= rows.of * times)
        out[found] = edges[at[found]]
    return behind, before


def nearest_under(rows: Heights, page: np.ndarray, boxes: Sides, x0: np.ndarray, x1: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row (in order) the least top of its page's boxes that reach into (x0, x1) and begin at its height's `low` or below; infinite without one.

    Boxes are drawn from the lowest top up over the line of all their ends and what lies between, so what is seen of each place is the
    nearest; the heights, from the lowest up, look at it in between: the lowest ones of all pages first, then the next ones.
    """
    out = np.full(len(x0), np.inf)

    def compared(some: np.ndarray, which: np.ndarray) -> None:
        own = page[which]
        first, last = (np.searchsorted(own, rows.page[rows.of[some]], side=side) for side in ("left", "right"))
        for pair, at in _expanded(first, last - first):
            row, box = some[pair], which[at]
            over = (boxes[1][box] >= low[rows.of[row]]) & (boxes[0][box] < x1[row]) & (boxes[2][box] > x0[row])
            np.minimum.at(out, row[over], boxes[1][box[over]])

    turned = boxes[0] > boxes[2]
    plain = np.flatnonzero(~turned)
    plain = plain[np.lexsort((-boxes[1][plain], page[plain]))]
    b_x0, tops, b_x1, b_page = boxes[0][plain], boxes[1][plain], boxes[2][plain], page[plain]
    # the ends of each page's boxes, page by page
    xs, place = np.unique(np.concatenate([b_x0, b_x1]), return_inverse=True)
    ends, at = np.unique(np.concatenate([b_page, b_page]) * (len(xs) + 1) + place, return_inverse=True)
    seen = np.full(2 * len(ends) + 2, np.inf)  # an end, what lies up to the next one, and so on
    begins, stops = (2 * at[: len(plain)]).tolist(), (2 * at[len(plain) :] + 1).tolist()
    own_page = rows.page[rows.of]
    start = np.searchsorted(ends, own_page * (len(xs) + 1))
    left = np.searchsorted(ends, own_page * (len(xs) + 1) + np.searchsorted(xs, x0, side="right"))
    right = np.searchsorted(ends, own_page * (len(xs) + 1) + np.searchsorted(xs, x1))
    spans = np.column_stack([np.maximum(2 * left - 1, 2 * start), 2 * right])
    spans[:, 1] = np.where(right == start, spans[:, 0], spans[:, 1])
    cuts = np.searchsorted(rows.of, np.arange(len(rows.low) + 1))
    # how many of all boxes, in their order, begin at a height or below, up to its page's last such one
    ys, y_place = np.unique(np.concatenate([-tops, -low]), return_inverse=True)
    keys = b_page * (len(ys) + 1) + y_place[: len(tops)]
    upto = np.searchsorted(keys, rows.page * (len(ys) + 1) + y_place[len(tops) :], side="right")
    order = np.lexsort((-low, rows.page))
    first = np.append(True, rows.page[order][1:] != rows.page[order][:-1])
    step = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    since = np.where(first, np.searchsorted(b_page, rows.page[order]), np.append(0, upto[order][:-1]))
    values = tops.tolist()
    by_step = np.argsort(step, kind="stable")
    turns = np.append(np.flatnonzero(np.diff(step[by_step], prepend=-1)), len(by_step))
    for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
        here = by_step[a:b]
        for i, j in zip(since[here].tolist(), upto[order[here]].tolist()):
            for k in range(i, j):
                seen[begins[k] : stops[k]] = values[k]
        heights = order[here]
        row = np.concatenate([r for _, r in _expanded(cuts[heights], cuts[heights + 1] - cuts[heights])])
        own = spans[row]
        near = np.minimum.reduceat(seen, own.ravel())[::2]
        out[row] = np.where(own[:, 0] < own[:, 1], near, np.inf)
    # what has no width of its own lies between no two ends
    compared(np.flatnonzero(x0 >= x1), np.arange(len(page)))
    compared(np.arange(len(x0)), np.flatnonzero(turned))
    return out
