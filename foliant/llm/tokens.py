"""Byte-level BPE token ids of whole texts, and their ORC files.

The `tokenizers` library encodes; a memory of words already encoded keeps the cost near that of splitting a text. The
library's own pre-tokenizer never joins a space to what stands before it, so a text may be cut before each single
space that has other characters than white space on both sides, and the pieces be encoded alone. Added tokens within a
text, such as <|endoftext|>, become their ids as the library has it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import map_batches, shared_folder

#: Where any text may be cut: before a space with other characters than white space on both sides.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words kept per Python worker before it starts afresh: about 180 MB.
REMEMBERED_WORDS = 800_000
#: Characters of the texts that are encoded together.
CHARS_AT_ONCE = 1_000_000


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._remembered = remembered
        self._known: dict[str, bytes] = {}
        # byte-level vocabularies write the space as U+0120, so such a token begins a word
        vocabulary = self._tokenizer.get_vocab()
        self._begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_words(self, plain: list[str]) -> dict[str, bytes]:
        """Each word's ids with the space before it: words go together, and the ids are cut where words begin."""
        out: dict[str, bytes] = {}
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self._tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(self._begins[ids]), len(ids)).tolist()
            packed = ids.tobytes()
            found = [packed[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
            out.update(zip(some, found if len(found) == len(some) else self._encoded([" " + w for w in some])))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; a few texts at a time, so that what is new in them is encoded together."""
        out, start, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size > CHARS_AT_ONCE or end == len(texts):
                out += self._encode_some(texts[start:end])
                start, size = end, 0
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        known = self._known
        cut = [t.split(" ") for t in texts]
        firsts = {w[0] for w in cut}
        new = set().union(*(w[1:] for w in cut)).difference(known)
        odd = _odd(firsts | new)
        if odd:
            cut = [w if odd.isdisjoint(w) else _CUT.split(t) for t, w in zip(texts, cut)]
            firsts = {w[0] for w in cut}
            new = set().union(*(w[1:] for w in cut)).difference(known)
        if len(known) > self._remembered:
            known.clear()
            new = set().union(*(w[1:] for w in cut))
        head = dict(zip(firsts, self._encoded(list(firsts))))
        odd = _odd(new) if odd else set()
        known.update(self._encoded_words(list(new - odd)))
        alone = dict(zip(odd, self._encoded([" " + w for w in odd]))) if odd else odd
        get = (lambda w: alone[w] if w in alone else known[w]) if odd else known.__getitem__
        return [head[w[0]] + b"".join(map(get, w[1:])) for w in cut]


def _odd(words: set[str]) -> set[str]:
    """Those that are empty, begin or end with white space, or have a space within: these are encoded alone."""
    return words.difference(map(str.strip, words)) | {w for w in words if " " in w or not w}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def id_lists(packed: list[bytes]) -> pa.Array:
    """A list<int32> column out of packed ids."""
    ends = [0]
    for p in packed:
        ends.append(ends[-1] + len(p) // 4)
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write (doc_id, part, pos, n_tokens, ids) as ORC files in ascending doc_id order, one range of ids per file.

    docs: doc_id and text; other columns are left out. Null texts count as empty, a null doc_id sorts first; rows of
    equal doc_id go by a hash of their text and then the text. part ascends from file to file and pos within one.
    Integers are run-length encoded by the format; row indexes and Bloom filters on doc_id let a reader skip stripes.
    An empty table leaves files without rows.
    """
    from pyspark import TaskContext

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids = [x + end for x in enc.encode_all([t or "" for t in batch.column("text").to_pylist()])]
            n = len(ids)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(pos, pos + n), pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    id_lists(ids),
                ],
                names=["doc_id", "part", "pos", "n_tokens", "ids"],
            )
            pos += n

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    out = map_batches(
        ranged.select("doc_id", "text"), encode, "doc_id long, part int, pos long, n_tokens long, ids array<int>"
    )
    (
        out.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(32 << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_token_files; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, pos long, n_tokens long, ids array<int>").orc(path)


def token_starts(tokens: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """tokens with start: the ids of all documents before each, in (part, pos) order, without one task for all.

    sizes: where part and n_tokens can be had more cheaply. Rows are summed within their part; the sums of the parts, one small row each, are added up on their own.
    """
    by_part = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes or tokens).groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    within = tokens.withColumn("inside", F.coalesce(F.sum("n_tokens").over(by_part), F.lit(0)))
    return within.join(base, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "part", "pos")


def crc_of_ids(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """keep and ids_crc32: the unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_pylist(), memoryview(ids.values.cast(pa.int32()).to_numpy(zero_copy_only=False).tobytes())
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(crcs, pa.int64())], names=[*keep, "ids_crc32"])

    kinds = dict(tokens.dtypes)
    return map_batches(tokens.select(*keep, "ids"), digest, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "ids_crc32 long"]))


def orc_token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write docs' ids as ORC, read the files back: doc_id, start, n_tokens, ids_crc32 of every document."""
    import uuid

    path = path or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    files = read_token_files(docs.sparkSession, path)
    tokens = crc_of_ids(files, ["doc_id", "part", "pos", "n_tokens"])
    return token_starts(tokens, files).select("doc_id", "start", "n_tokens", "ids_crc32")
