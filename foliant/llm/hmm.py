"""A hidden Markov language model over word classes, trained by Baum-Welch on counts summed over partitions.

P(text) = sum over state paths of prod P(state | last state) P(class | state) P(word | class). A word's class follows
from the word: frequent words are their own class, the others are classed by their form, and words that training
hasn't seen are one symbol of one class. How often a state emits that class is learned from the words that training
has seen once, as if they were unseen at that place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import encode_text, map_batches, partitions, written

#: Text bytes of a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words that are classes of their own (the most frequent), and classes of all others by their form.
OWN_CLASSES = 1_000
FORM_CLASSES = 512
STATES = 8
ROUNDS = 3
#: Words found in the most blocks, whose counts every task has: those of at most so many bytes, so a few MB in all.
COMMON_WORDS = 20_000
COMMON_BYTES = 100
#: Token places that are run forward and backward at once.
PLACES_AT_ONCE = 1 << 19
#: Longer sequences are cut into segments of so many places, which run side by side once the states between them are known.
LONG = 1 << 15
SEGMENT = 1 << 10
#: Texts of more bytes are read word by word.
LONG_TEXT = 1 << 20
#: Weight of each state's starting emissions against what training counts.
PRIOR = 10.0
#: The end of a text, which no word equals.
END = b""
_KNOWN_END, _UNKNOWN = 0, 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Set in the number of a class where the word is one that training has seen once.
_ONCE = 1 << 15


def form_class(word: bytes) -> int:
    """A class out of a word's last two bytes, and whether it has signs, digits or bytes beyond ASCII."""
    bare = word.rstrip(b".,;:!?\"')]}")
    shape = (len(bare) != len(word)) | (not bare.isalpha()) << 1 | (not bare.isascii()) << 2
    return zlib.crc32(bare[-2:] + bytes([shape])) % FORM_CLASSES


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: documents, their token numbers, and the block's words with their counts in training texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    docs, held, lengths, tokens, size = [], [], [], [], 0
    words: dict[bytes, int] = {}

    def block() -> pa.RecordBatch:
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        train = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(flat[train], minlength=len(words)).astype(np.int64)
        return pa.record_batch(
            [
                pa.array([number]),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([flat.astype(np.int32).tobytes()], pa.binary()),
                pa.array([b" ".join(words)], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()),
            ],
            names=["block", "docs", "held", "lengths", "tokens", "words", "counts"],
        )

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), encode_text(batch.column("text"))):
            if docs and size + len(text) > BLOCK_BYTES:
                yield block()
                number += 1
                docs, held, lengths, tokens, size = [], [], [], [], 0
                words = {}
            found = text.lower().split() if len(text) <= LONG_TEXT else (m[0] for m in _WORD.finditer(text.lower()))
            own = array("i", (words.setdefault(w, len(words)) for w in found))
            own.append(words.setdefault(END, len(words)))
            docs.append(doc)
            held.append(zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1)
            lengths.append(len(own))
            tokens.append(np.frombuffer(own, np.int32))
            size += len(text)
    if docs:
        yield block()


def _block_words(but: frozenset[bytes] = frozenset()):
    """A row per block and word, without the words of `but`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, counts in zip(*(batch.column(x).to_pylist() for x in ("block", "words", "counts"))):
                own, n = words.split(b" "), np.frombuffer(counts, np.int64)
                places = np.array([i for i, w in enumerate(own) if w not in but] if but else range(len(own)), np.int32)
                for at in range(0, len(places), 50_000):
                    some = places[at : at + 50_000]
                    yield pa.record_batch(
                        [pa.array([own[i] for i in some.tolist()], pa.binary()), pa.array([number] * len(some), pa.int64()), pa.array(some), pa.array(n[some])],
                        names=["word", "block", "place", "n"],
                    )

    return run


@dataclass
class Counts:
    """What is known of the training corpus: tokens, distinct tokens, tokens seen once, and the words of own classes."""

    tokens: int
    distinct: int
    once: int
    own: dict[bytes, int]
    class_weight: np.ndarray

    @property
    def classes(self) -> int:
        return 2 + OWN_CLASSES + FORM_CLASSES

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def class_of(word: bytes, own: dict[bytes, int]) -> int:
    """The class of a word that training has seen."""
    if word == END:
        return _KNOWN_END
    return own.get(word) or 2 + OWN_CLASSES + form_class(word)


def _classed(own: dict[bytes, int]):
    """Distinct training words' count and number of words by class: a word weighs its count and a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([class_of(w, own) for w in batch.column("word").to_pylist()], np.int64)
            c = batch.column("c").to_numpy()
            n = np.bincount(of, minlength=1)
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at), pa.array(np.bincount(of, c + 0.5)[at])], names=["class", "weight"])

    return run


@dataclass
class Hmm:
    """start, move (state to state), emit (state by class; rows sum to 1) and unseen, a state's chance of an unseen word."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    unseen: np.ndarray

    def table(self) -> np.ndarray:
        """A row per class, a column per state; the class of unseen words takes its share from the others."""
        out = self.emit.T * (1 - self.unseen)
        out[_UNKNOWN] = self.unseen
        return out

    def flagged(self) -> np.ndarray:
        """table() for classes that may have _ONCE set: such a word counts by its class."""
        table = self.table()
        out = np.zeros((_ONCE + len(table), table.shape[1]))
        out[: len(table)] = out[_ONCE:] = table
        return out


def _padded(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of sequences by length, longest first, in groups whose padded places stay bounded."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, PLACES_AT_ONCE // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def _row_shares(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


@dataclass
class _Cut:
    """A long sequence without its first place, as segments: their beginnings and lengths, the states before each by what
    went before, and the chances of all that follows by the state at each one's last place (scaled); first: the states
    at the first place, log10 of their scale, and the chances of what follows them."""

    starts: np.ndarray
    lengths: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    first: tuple[np.ndarray, float, np.ndarray]


def _cut(hmm: Hmm, table: np.ndarray, classes: np.ndarray, start: int, length: int) -> _Cut:
    """The states between the segments of a sequence of two places or more. Each segment's transfer, from every state before it to every
    state at its end, is multiplied up for all segments side by side; then the transfers are chained forth and back."""
    k = len(hmm.start)
    starts = np.arange(start + 1, start + length, SEGMENT)
    lengths = np.minimum(SEGMENT, start + length - starts)
    transfer = np.broadcast_to(np.eye(k), (len(starts), k, k)).copy()
    for t in range(int(lengths[0])):
        n = len(starts) - int(lengths[-1] <= t)  # the last one alone may be shorter
        x = (transfer[:n] @ hmm.move) * table[classes[starts[:n] + t]][:, None, :]
        transfer[:n] = x / x.sum((1, 2), keepdims=True)
    alpha = hmm.start * table[classes[start]]
    scale, alpha = float(np.log10(alpha.sum())), _row_shares(alpha)
    before, behind = np.empty((len(starts), k)), np.ones((len(starts), k))
    state, beta = alpha, np.ones(k)
    for i in range(len(starts)):
        before[i] = state
        state = _row_shares(state @ transfer[i])
    for i in range(len(starts) - 1, -1, -1):
        behind[i] = beta
        beta = _row_shares(transfer[i] @ beta)
    return _Cut(starts, lengths, before, behind, (alpha, scale, beta))


def _forward(hmm: Hmm, table: np.ndarray, classes: np.ndarray, at: np.ndarray, own: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """log10 P of sequences, longest first, after the states `before` each (none: from the start)."""
    alpha, total = before, np.zeros(len(own))
    for t in range(int(own[0]) if len(own) else 0):
        n = int(np.searchsorted(-own, -t, side="left"))  # sequences with a token at t
        emitted = table[classes[at[:n] + t]]
        alpha = hmm.start * emitted if alpha is None else (alpha[:n] @ hmm.move) * emitted
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log10(scale)
    return total


def forward(hmm: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P of each sequence of classes by the scaled forward recursion; memory doesn't grow with their length, but for a
    few numbers a segment of a long one."""
    table, out = hmm.flagged(), np.zeros(len(lengths))
    short = np.flatnonzero(lengths <= LONG)
    for group in _padded(lengths[short]):
        group = short[group]
        out[group] = _forward(hmm, table, classes, starts[group], lengths[group])
    for i in np.flatnonzero(lengths > LONG):
        cut = _cut(hmm, table, classes, int(starts[i]), int(lengths[i]))
        out[i] = cut.first[1]
        for g in _padded(cut.lengths):
            out[i] += _forward(hmm, table, classes, cut.starts[g], cut.lengths[g], cut.before[g]).sum()
    return out


class _Expected:
    """Sums of Baum-Welch: expected starts, moves, emissions by class, emissions of words seen once, and log10 P."""

    def __init__(self, hmm: Hmm):
        self.hmm, self.table = hmm, hmm.flagged()
        k, self.c = hmm.emit.shape
        self.start, self.move, self.emit, self.once, self.total = np.zeros(k), np.zeros((k, k)), np.zeros((k, self.c)), np.zeros(k), 0.0

    def emitted(self, gamma: np.ndarray, of: np.ndarray) -> None:
        self.once += gamma[of >= _ONCE].sum(0)
        of = of & (_ONCE - 1)
        for s in range(len(self.start)):
            self.emit[s] += np.bincount(of, gamma[:, s], minlength=self.c)

    def add(self, classes: np.ndarray, at: np.ndarray, own: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> None:
        """Count sequences, longest first; before, behind: of segments, as _Cut has them."""
        hmm, k = self.hmm, len(self.start)
        alphas, scales, emits, firsts = [], [], [], []
        alpha = before
        for t in range(int(own[0]) if len(own) else 0):
            n = int(np.searchsorted(-own, -t, side="left"))
            of = classes[at[:n] + t]
            emitted = self.table[of]
            alpha = hmm.start * emitted if alpha is None else (alpha[:n] @ hmm.move) * emitted
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            alphas.append(alpha)
            scales.append(scale)
            emits.append(emitted)
            firsts.append(of)
            self.total += float(np.log10(scale).sum())
        beta, gammas = np.ones((0, k)), []
        for t in range(len(alphas) - 1, -1, -1):
            n, m = len(alphas[t]), len(beta)
            full = np.ones((n, k))
            if behind is not None:  # scaled as the recursion has it: states' chances sum to 1
                full[m:] = behind[m:n] / (alphas[t][m:] * behind[m:n]).sum(1)[:, None]
            if m:
                ahead = emits[t + 1] * beta / scales[t + 1][:, None]
                self.move += (alphas[t][:m].T @ ahead) * hmm.move
                full[:m] = ahead @ hmm.move.T
            beta = full
            gammas.append(alphas[t] * beta)
        if gammas:
            if before is None:
                self.start += gammas[-1].sum(0)
            else:
                self.move += (before.T @ (emits[0] * beta / scales[0][:, None])) * hmm.move
            self.emitted(np.concatenate(gammas[::-1]), np.concatenate(firsts))


def expected_counts(hmm: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Baum-Welch: expected starts, moves, emissions by class, emissions of words seen once, and log10 P, summed over
    the sequences. What is kept at a time is bounded by PLACES_AT_ONCE, and a few numbers a segment of a long sequence."""
    sums = _Expected(hmm)
    short = np.flatnonzero(lengths <= LONG)
    for group in _padded(lengths[short]):
        group = short[group]
        sums.add(classes, starts[group], lengths[group])
    for i in np.flatnonzero(lengths > LONG):
        cut = _cut(hmm, sums.table, classes, int(starts[i]), int(lengths[i]))
        alpha, scale, beta = cut.first
        gamma = _row_shares(alpha * beta)
        sums.start += gamma
        sums.total += scale
        sums.emitted(gamma[None, :], classes[starts[i] : starts[i] + 1])
        for g in _padded(cut.lengths):
            sums.add(classes, cut.starts[g], cut.lengths[g], cut.before[g], cut.behind[g])
    return sums.start, sums.move, sums.emit, sums.once, sums.total


def train(classed: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """An Hmm, and the training texts' log10 P before each round. classed: held, lengths, classes (uint16) by block.

    Every round sums what tasks have counted over all training texts; the model itself is of fixed size. A state's
    share of unseen words is its share of words seen once, drawn to that of all states by PRIOR tokens.
    """
    c = counts.classes
    weight = np.maximum(counts.class_weight, 1e-9)
    weight[_UNKNOWN] = 0
    usual = weight / weight.sum()
    rng = np.random.default_rng(5)
    emit = usual * rng.gamma(2.0, size=(states, c))
    emit /= emit.sum(1, keepdims=True)
    stay = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    unseen = min(0.5, max(counts.once, 0.5) / max(1, counts.tokens))
    hmm, seen = Hmm(np.full(states, 1 / states), stay, emit, np.full(states, unseen)), []
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], hmm: Hmm = hmm) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * states + states * states + states * c + 1)
            for batch in batches:
                for held, lengths, classes in zip(*(batch.column(x).to_pylist() for x in ("held", "lengths", "classes"))):
                    of, n = np.frombuffer(classes, np.uint16), np.array(lengths, np.int64)
                    starts = np.append(0, np.cumsum(n)[:-1])
                    own = ~np.array(held, bool)
                    a, b, e, o, p = expected_counts(hmm, of, starts[own], n[own])
                    total += np.concatenate([a, b.ravel(), e.ravel(), o, [p]])
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "x"])

        summed = map_batches(classed.select("held", "lengths", "classes"), count, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
        total = np.zeros(2 * states + states * states + states * c + 1)
        for r in summed.collect():  # as many rows as the model has numbers
            total[r["at"]] = r["x"]
        a, b, e, once = np.split(total[:-1], [states, states + states * states, states + states * states + states * c])
        seen.append(float(total[-1]))
        move, emit = b.reshape(states, states) + 0.1, e.reshape(states, c) + PRIOR * usual
        rare = np.minimum(0.5, (once + PRIOR * unseen) / (e.reshape(states, c).sum(1) + PRIOR))
        hmm = Hmm((a + 0.1) / (a + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), rare)
    return hmm, seen


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Texts whose crc32(doc_id as text) mod 5 is not 1 train (a null doc_id counts as an empty text, so it trains). A null
    text is empty, and is one token, the end. Rows count as often as they come; without rows there are none. score is
    the model's log10 probability of the whole text: of its class sequence, times each word's share of its class.
    Documents are kept in blocks. Words are counted with partial sums; the counts of COMMON_WORDS words found in the most
    blocks are sent to every task, and a block's other words meet theirs by one shuffle and come back by block.
    """
    blocks = written(
        map_batches(
            docs.select(F.col("doc_id").cast("long"), "text"),
            _blocks,
            "block long, docs array<bigint>, held array<boolean>, lengths array<bigint>, tokens binary, words binary, counts binary",
        ),
        "blocks",
    )
    words, asked = blocks.select("block", "words", "counts"), "word binary, block long, place int, n long"
    counted = written(
        map_batches(words, _block_words(), asked).groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")), "words"
    )
    known = counted.where("c > 0").select("word", "c")
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.count_if(F.col("c") == 1).alias("once")).first()
    # a word of many blocks would gather a row per block in one task: such words never meet the others' shuffle
    short = counted.where(F.length("word") <= COMMON_BYTES)
    common = {bytes(r["word"]): r["c"] for r in short.orderBy(F.col("blocks").desc(), "word").limit(COMMON_WORDS).select("word", "c").collect()}
    frequent = known.where(F.length("word") > 0).orderBy(F.col("c").desc(), "word").limit(OWN_CLASSES).collect()
    own = {bytes(r["word"]): 2 + i for i, r in enumerate(frequent)}
    counts = Counts(sums["tokens"], sums["distinct"], sums["once"], own, np.zeros(2 + OWN_CLASSES + FORM_CLASSES))
    for r in map_batches(known, _classed(own), "class long, weight double").groupBy("class").agg(F.sum("weight").alias("w")).collect():
        counts.class_weight[r["class"]] = r["w"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's documents with base scores, the words' shares of their classes, and the class sequence."""
        for batch in batches:
            for r in batch.to_pylist():
                words = r["words"].split(b" ")
                c = np.array([common.get(w, 0) for w in words], np.int64)
                c[np.frombuffer(r["places"] or b"", np.int32)] = np.frombuffer(r["found"] or b"", np.int64)
                of = np.array([class_of(w, own) if n else _UNKNOWN for w, n in zip(words, c.tolist())], np.uint16)
                flagged = of | ((c == 1) * _ONCE).astype(np.uint16)
                inside = np.where(of == _UNKNOWN, 0.0, np.log10((c + 0.5) / np.maximum(counts.class_weight[of], 0.5)))
                tokens, n = np.frombuffer(r["tokens"], np.int32), np.array(r["lengths"], np.int64)
                starts = np.append(0, np.cumsum(n)[:-1])
                sums = [np.add.reduceat(x[tokens], starts) for x in (counts.base(c), inside, (c > 0).astype(np.int64))]
                yield pa.record_batch(
                    [
                        pa.array([r["docs"]], pa.list_(pa.int64())),
                        pa.array([r["held"]], pa.list_(pa.bool_())),
                        pa.array([r["lengths"]], pa.list_(pa.int64())),
                        *(pa.array([s.tolist()]) for s in sums),
                        pa.array([flagged[tokens].tobytes()], pa.binary()),
                    ],
                    names=["docs", "held", "lengths", "base", "inside", "known", "classes"],
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of block, as one row of places and counts per block."""
        block, places, found = None, [], []

        def row() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([block]), pa.array([np.concatenate(places).astype(np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(found).astype(np.int64).tobytes()], pa.binary())],
                names=["block", "places", "found"],
            )

        for batch in batches:
            b, p, c = (batch.column(x).to_numpy() for x in ("block", "place", "c"))
            cuts = np.append(0, np.flatnonzero(b[1:] != b[:-1]) + 1) if len(b) else []
            for a, z in zip(cuts, [*cuts[1:], len(b)]):
                if block is not None and b[a] != block:
                    yield row()
                    places, found = [], []
                block = int(b[a])
                places.append(p[a:z])
                found.append(c[a:z])
        if block is not None:
            yield row()

    others = map_batches(words, _block_words(frozenset(common)), asked)
    answers = others.select("word", "block", "place").join(known, "word")
    per_block = map_batches(
        answers.select("block", "place", "c").repartition(partitions(docs), "block").sortWithinPartitions("block"), gathered, "block long, places binary, found binary"
    )
    classed = written(
        map_batches(
            blocks.select("block", "docs", "held", "lengths", "tokens", "words").join(per_block, "block", "left").drop("block"),
            answer,
            "docs array<bigint>, held array<boolean>, lengths array<bigint>, base array<double>, inside array<double>, known array<bigint>, classes binary",
        ),
        "classed",
    )
    hmm, _ = train(classed, counts, states, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["lengths"], np.int64)
                path = forward(hmm, np.frombuffer(r["classes"], np.uint16), np.append(0, np.cumsum(n)[:-1]), n)
                yield pa.record_batch(
                    [
                        pa.array(r["docs"], pa.int64()),
                        pa.array(r["held"], pa.bool_()),
                        pa.array(n),
                        pa.array(r["known"], pa.int64()),
                        pa.array([counts.tokens] * len(n), pa.int64()),
                        pa.array(r["base"], pa.float64()),
                        pa.array(path + np.array(r["inside"])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return map_batches(
        classed, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
