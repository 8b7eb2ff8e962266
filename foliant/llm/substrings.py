"""Removal of repeated byte strings across a corpus by sorting suffixes.

A window is `length` bytes of one document. Each window's anchor is the rightmost k-gram of least hash in it, which
depends on the window's bytes alone, so equal windows have equal anchors at equal places. Consecutive windows of one
anchor make a record. Records of one k-gram meet in one group: if all their bytes are alike, every record but the
first is repeated as a whole; else the records that differ are compared window by window, by deep-shallow sorting of
the windows. Groups too large for that are split by longer shared strings first. Every step keeps the first of equal
records and tells the rest apart on the spot, so copies never gather.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, partitions, written
from foliant.llm.suffixes import equal_runs

LENGTH = 100
GRAM = 24
#: Bytes hashed at once.
CHUNK = 1 << 18
#: Records of a group that a task sorts; larger groups are split.
MOST_RECORDS = 2_048
#: Windows sorted at once.
WINDOWS_AT_ONCE = 200_000
_NULL_ID = -(2**63)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """64-bit polynomial hashes of ranges of a buffer: sums of random byte values times powers of an odd base."""

    def __init__(self, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
        base = int(rng.integers(1, 2**62)) * 4 + 3
        self.up, self.down = _powers(base, most), _powers(pow(base, -1, 2**64), most)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((sums[b] - sums[a]) * self.down[a])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


_HASHES: list[RangeHash] = []


def _hashes() -> list[RangeHash]:
    if not _HASHES:
        _HASHES.extend(RangeHash(seed, 2 * CHUNK + 2 * LENGTH) for seed in (11, 12))
    return _HASHES


def records_of(data: np.ndarray, ends: np.ndarray):
    """(first window, last window, anchor, k-gram hash, hash of all bytes) of each record of a buffer of pieces."""
    grams, ranges = _hashes()
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, _U), np.zeros(0, _U))
    sums = grams.sums(data)
    m = n - GRAM + 1
    h = _mixed((sums[GRAM:] - sums[:-GRAM]) * grams.down[:m])
    mask = _U((1 << 20) - 1)
    least = (h & ~mask) | (mask - np.arange(m, dtype=_U))  # of equal hashes the rightmost is least
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if w > size:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    anchor = (mask - (least & mask)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(valid & np.append(True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]))
    stops = np.flatnonzero(valid & np.append((anchor[1:] != anchor[:-1]) | ~valid[1:], True))
    at = anchor[starts]
    whole = ranges.of(ranges.sums(data), starts, stops + LENGTH)
    whole = _mixed(whole + (at - starts).astype(_U) * _U(0x9E3779B97F4A7C15) + (stops - starts).astype(_U) * _U(0xD1B54A32D192ED03))
    return starts, stops, at, h[at], whole


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about CHUNK bytes: data, ends of pieces, and each piece's text and its place in it."""
    parts, ends, owners, places, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), CHUNK) if len(t) >= LENGTH else ():
            part = t[s : s + CHUNK + LENGTH - 1]
            if size and size + len(part) > CHUNK + LENGTH:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(owners), np.array(places)
                parts, ends, owners, places, size = [], [], [], [], 0
            size += len(part)
            parts.append(part)
            ends.append(size)
            owners.append(i)
            places.append(s)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(owners), np.array(places)


def _merge(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges that touch or overlap, made one per owner."""
    if not len(owner):
        return owner, lo, hi
    by = np.lexsort((lo, owner))
    owner, lo, hi = owner[by], lo[by], hi[by]
    shift = owner * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, (lo + shift)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return owner[first], lo[first], np.maximum.reduceat(hi, first)


_RECORD = "h long, c long, k long, k2 long, pack long"


def _pack(lo: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First window, bytes from it to the anchor, and windows after it, in one number that sorts by the first."""
    return lo << 14 | before << 7 | more


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of the texts, of equal ones in a batch the first alone; ranges of the others as c to -pack."""
    for batch in batches:
        k, k2 = (batch.column(x).to_numpy() for x in ("k", "k2"))
        texts = encode_text(batch.column("text"))
        found: list[list[np.ndarray]] = []
        for data, ends, owners, places in _pieces(texts):
            starts, stops, at, h, c = records_of(data, ends)
            piece = np.searchsorted(ends, starts, side="right")
            begin = np.append(0, ends[:-1])[piece]
            found.append([owners[piece], starts - begin + places[piece], at - starts, stops - starts, h.view(np.int64), c.view(np.int64)])
        if not found:
            continue
        owner, lo, before, more, h, c = map(np.concatenate, zip(*found))
        rank = np.empty(len(k), np.int64)
        rank[np.lexsort((k2, k))] = np.arange(len(k))
        by = np.lexsort((lo, rank[owner], c, h))
        owner, lo, before, more, h, c = (x[by] for x in (owner, lo, before, more, h, c))
        again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]))
        o, a, b = _merge(owner[again], lo[again], lo[again] + more[again] + LENGTH)
        one = ~again
        yield _batch(h[one], c[one], k[owner[one]], k2[owner[one]], _pack(lo[one], before[one], more[one]))
        if len(o):
            yield _batch(_mixed((a + b * 7919).astype(_U)).view(np.int64), a, k[o], k2[o], -b)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns], names=["h", "c", "k", "k2", "pack"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()):
    """Of rows in (h, c, k, k2, pack) order: (columns, repeated, mixed) per batch.

    repeated: not the first of its h and c. mixed: the first of its c, in an h that has several. Only one row, the
    first of an h whose other rows are still to come, is held back from one batch to the next.
    """
    names = ["h", "c", "k", "k2", "pack", *extra]
    held, last, several = None, None, False
    for batch in batches:
        columns = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
        n = batch.num_rows
        if not n:
            continue
        if held is not None:
            columns = {x: np.append(held[x], columns[x]) for x in names}
            n += 1
        h, c = columns["h"], columns["c"]
        new_h = np.append(True, h[1:] != h[:-1])
        new = new_h | np.append(True, c[1:] != c[:-1])
        goes_on = held is None and last is not None and last[0] == h[0]
        if goes_on:
            new[0] = last[1] != c[0]
        group = np.cumsum(new_h) - 1
        kinds = np.bincount(group, new)
        if goes_on:
            kinds[0] += 2 if several else 1
        mixed = new & (kinds[group] > 1)
        wait = None
        if kinds[-1] == 1 and not (goes_on and group[-1] == 0):
            wait = int(np.flatnonzero(new & (group == group[-1]))[0])
        several = bool(kinds[-1] > 1)
        last = (h[-1], c[-1])
        held = {x: columns[x][wait : wait + 1] for x in names} if wait is not None else None
        yield columns, ~new, mixed


def _judge(extra: tuple[str, ...] = ()):
    """Ranges to remove as (c, -pack), and the records that differ within their group as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, repeated, mixed in _sorted_groups(batches, extra):
            pack = columns["pack"]
            done = pack < 0
            mixed, again = mixed & ~done, repeated & ~done
            lo = pack >> 14
            hi = lo + (pack & 127) + LENGTH
            pick = lambda x, c=columns, at=np.concatenate([np.flatnonzero(y) for y in (mixed, done, again)]): c[x][at]
            ranges = [np.concatenate([x[mixed], x[done], y[again]]) for x, y in ((columns["c"], lo), (pack, -hi))]
            out = _batch(pick("h"), ranges[0], pick("k"), pick("k2"), ranges[1])
            for x in extra:
                out = out.append_column(x, pa.array(pick(x).tolist(), pa.binary()))
            yield out

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each record that is asked for."""
    for batch in batches:
        rows = []
        for k, k2, text, asked in zip(*(batch.column(x).to_pylist() for x in ("k", "k2", "text", "asked"))):
            text = (text or "").encode()
            for r in asked:
                lo = r["pack"] >> 14
                rows.append((r["h"], 0, k, k2, r["pack"], text[lo : lo + (r["pack"] & 127) + LENGTH]))
        yield from _record_batches(rows)


def _record_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 20_000):
        *numbers, held = zip(*rows[at : at + 20_000])
        yield _batch(*(np.array(x, np.int64) for x in numbers)).append_column("bytes", pa.array(held, pa.binary()))


def _split(size: int):
    """Cut records at every `size` windows counted from the anchor; a part's group is what all windows there share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for h, k, k2, pack, held in zip(*(batch.column(x).to_pylist() for x in ("h", "k", "k2", "pack", "bytes"))):
                lo, most, more = pack >> 14, (pack >> 7) & 127, pack & 127
                for part in range((most - more) // size, most // size + 1):
                    near, far = max(part * size, most - more), min(part * size + size - 1, most)
                    shared = held[most - part * size : most - (part * size + size - 1) + LENGTH]
                    own = held[most - far : most - near + LENGTH]
                    key = xxh64_intdigest(shared, xxh64_intdigest(f"{h} {size} {part}"))
                    whole = xxh64_intdigest(own, xxh64_intdigest(f"{near} {far}"))
                    rows.append((_signed(key), _signed(whole), k, k2, (lo + most - far) << 14 | far << 7 | (far - near), own))
            yield from _record_batches(rows)

    return run


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to remove out of whole groups: all their windows sorted, of equal ones all but the first."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h, k, k2, pack, held = zip(*rows)
        pack_, bucket = np.array(pack, np.int64), np.unique(np.array(h, np.int64), return_inverse=True)[1]
        lo, more = pack_ >> 14, pack_ & 127
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((lo, np.array(k2, np.int64), np.array(k, np.int64)))] = np.arange(len(rows))
        owners = np.repeat(np.arange(len(rows)), more + 1)
        starts = np.arange(len(owners)) - np.repeat(np.append(0, np.cumsum(more + 1)[:-1]), more + 1)
        owner_list, start_list, rank_list = owners.tolist(), starts.tolist(), rank.tolist()
        gone: list[int] = []
        for run in equal_runs(list(held), starts, owners, bucket[owners], LENGTH):
            first = min(run, key=lambda i: (rank_list[owner_list[i]], start_list[i]))
            gone += [i for i in run if i != first]
        at = np.array(gone, np.int64)
        o, a, b = _merge(owners[at], lo[owners[at]] + starts[at], lo[owners[at]] + starts[at] + LENGTH)
        return _batch(np.zeros(len(o)), a, np.array(k, np.int64)[o], np.array(k2, np.int64)[o], -b)

    rows, windows, begun = [], 0, 0  # rows[begun:] are of the group that may go on
    for batch in batches:
        for r in zip(*(batch.column(x).to_pylist() for x in ("h", "k", "k2", "pack", "bytes"))):
            if rows and r[0] != rows[-1][0]:
                begun = len(rows)
                if windows > WINDOWS_AT_ONCE:
                    yield solve(rows)
                    rows, windows, begun = [], 0, 0
            rows.append(r)
            windows += (r[3] & 127) + 1
    if rows:
        yield solve(rows)


def _by_group(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df), "h").sortWithinPartitions("h", "c", "k", "k2", "pack")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """k, k2, lo, hi: ranges of bytes that a window covers which also starts earlier; docs: k, k2 (unique), text."""
    with_bytes = f"{_RECORD}, bytes binary"
    judged = written(map_batches(_by_group(map_batches(docs, _records, _RECORD)), _judge(), _RECORD), "judged")
    found = [judged.where("pack < 0").select("k", "k2", F.col("c").alias("lo"), (-F.col("pack")).alias("hi"))]
    asked = judged.where("pack >= 0").groupBy("k", "k2").agg(F.collect_list(F.struct("h", "pack")).alias("asked"))
    records = written(map_batches(docs.join(asked, ["k", "k2"]), _contexts, with_bytes), "contexts")
    size = 64
    while True:
        large = written(records.groupBy("h").count().where(F.col("count") > MOST_RECORDS).select("h"), "large-groups")
        none = large.isEmpty()
        small = records if none else records.join(large, "h", "left_anti").select(*records.columns)
        sorted_ = written(map_batches(_by_group(small), _sort_groups, _RECORD), "sorted")
        found.append(sorted_.select("k", "k2", F.col("c").alias("lo"), (-F.col("pack")).alias("hi")))
        if none:
            break
        size //= 2
        parts = map_batches(records.join(large, "h", "left_semi").select(*records.columns), _split(size), with_bytes)
        judged = written(map_batches(_by_group(parts), _judge(("bytes",)), with_bytes), "judged")
        found.append(judged.where("pack < 0").select("k", "k2", F.col("c").alias("lo"), (-F.col("pack")).alias("hi")))
        records = judged.where("pack >= 0")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, text_column: bool = False) -> DataFrame:
    """docs' columns, and n_bytes, n_removed, n_spans, kept_sha256 (unless docs has such a column) of every row: each byte that is covered by a window
    of LENGTH bytes which also starts earlier (smaller doc_id, or same document, earlier start) is removed.

    docs: doc_id, text and any columns. Windows are judged on the input. A null text is empty; a null doc_id comes
    first; rows of equal doc_id go by a hash of their text. A row that repeats another's doc_id and text comes later:
    all of it goes if it has a window. text_column: text becomes what is left, without characters that lost a byte;
    otherwise text is left out.
    """
    others = [c for c in docs.columns if c != "text"]
    added = [c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256") if c not in docs.columns]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    repeats = not docs.select(key.alias("k")).groupBy("k").count().where("count > 1").isEmpty()
    # docs' other columns are set aside in one, so that their names meet no others
    keyed = docs.select(
        key.alias("k"), (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("k2"), "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")
    )
    lean = keyed.select("k", "k2", "text")
    ranges = repeated_ranges(lean.dropDuplicates(["k", "k2"]) if repeats else lean)
    ranges = ranges.groupBy("k", "k2").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    whole = keyed.join(ranges, ["k", "k2"], "left")
    copy = F.row_number().over(Window.partitionBy("k", "k2").orderBy(F.xxhash64("others"))) if repeats else F.lit(1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, copy in zip(encode_text(batch.column("text")), batch.column("ranges").to_pylist(), batch.column("copy").to_pylist()):
                pairs = [(0, len(text))] if copy > 1 and len(text) >= LENGTH else [(s["lo"], s["hi"]) for s in spans or ()]
                left, at, runs = [], 0, 0
                for lo, hi in pairs:
                    if lo > at or not runs:
                        left.append(text[at:lo])
                        runs += 1
                    at = max(at, hi)
                left.append(text[at:])
                kept = b"".join(left)
                rows.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in left) if text_column else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)]
            yield pa.record_batch([batch.column("others"), *columns], names=["others", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    kind = dict(keyed.dtypes)["others"]
    out = map_batches(
        whole.select("others", "text", "ranges", copy.alias("copy")), cut, f"others {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )
    return out.select(*[F.col("others").getField(c).alias(c) for c in others], *added, *(["text"] if text_column else []))
