"""N-best piece segmentation: forward Viterbi scores guide a backward A-star search over the piece lattice."""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_batches

#: The sign that stands for a space.
SPACE = "▁"
#: Segmentations of a text, and words kept per Python worker before it starts afresh.
BEST = 4
REMEMBERED_WORDS = 800_000
#: Cost of a byte piece over the rarest piece.
BYTE_COST = 2.0
#: Words of more characters are not remembered.
LONGEST_REMEMBERED = 64
_NEVER = 1 << 62
#: Costs are whole numbers of this part of one, so sums are exact and ties are ties.
UNIT = 1 << 24


class PieceModel:
    """Pieces with costs (negative log probabilities, in units of 1 / UNIT) out of a SentencePiece model file.

    A unigram model's scores are log probabilities and are taken as they are. A BPE model's scores are ranks; the piece
    of rank r costs log(r + 2), as by Zipf's law. Characters without a piece are written as byte pieces, and so is the
    space sign where it stands in a text, so decoding gives back every text.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranks = all(s == int(s) for s in scores.values())
        self.costs = {i: round((math.log(2 - s) if ranks else -s) * UNIT) for i, s in scores.items()}
        most = max(self.costs.values(), default=0) + round(BYTE_COST * UNIT)
        self.pieces = {model.id_to_piece(i): i for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.costs.update(dict.fromkeys(self.bytes.values(), most))
        self.texts = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        #: Pieces sign by sign: each sign has the piece's cost, or -1 where only longer pieces begin so, and the signs that may follow.
        self.signs: dict[str, list] = {}
        for p, i in self.pieces.items():
            node, after = [-1, {}], self.signs
            for sign in p:
                node = after.setdefault(sign, [-1, {}])
                after = node[1]
            node[0] = self.costs[i]
        #: Neighbours within a piece; no piece reaches over any other two signs.
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces), default=1)

    def _signs(self, word: str) -> str:
        return word.replace(SPACE, "\0").replace(" ", SPACE)

    def _byte_cost(self, sign: str) -> int:
        return sum(self.costs[self.bytes[b]] for b in sign.encode())

    def _ids(self, word: str, signs: str, start: int, end: int) -> list[int]:
        """The piece from start to end, or the bytes of a character without one."""
        i = self.pieces.get(signs[start:end])
        return [i] if i is not None else [self.bytes[b] for b in word[start:end].encode()]

    def forward(self, word: str, signs: str) -> tuple[list[int], list[int], list[int]]:
        """Viterbi: for each place the least cost of reaching it, the next one (_NEVER: no other way), and where the last piece of the best begins."""
        n, signs_of_pieces = len(word), self.signs
        best, second, back = [_NEVER] * (n + 1), [_NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0
        for start in range(n):
            a, b, after = best[start], second[start], signs_of_pieces
            for end in range(start + 1, n + 1):
                node = after.get(signs[end - 1])
                if node is not None:
                    cost, after = node
                    if cost < 0:
                        if end > start + 1:
                            continue
                        cost = self._byte_cost(word[start])
                elif end > start + 1:
                    break
                else:
                    cost, after = self._byte_cost(word[start]), {}
                x, least = a + cost, best[end]
                if x < least:
                    y = b + cost
                    second[end] = least if least < y else y
                    best[end], back[end] = x, start
                elif x < second[end]:
                    second[end] = x
                if not after:
                    break
        return best, second, back

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n cheapest segmentations, cheapest first.

        Forward Viterbi gives the least cost of reaching each place. A backward search from the end that adds it to
        what it has spent knows the exact cost of the best completion, so it leaves the heap in order of whole cost, of
        equal ones the one that has come further. Every step off the best way begins a set of segmentations of its own,
        so a step dearer than n sets known by then can't be among the n cheapest. Ways are linked lists that share
        their ends, so time and memory grow with the length of the word.
        """
        signs, get, costs = self._signs(word), self.pieces.get, self.costs
        least = self.forward(word, signs)[0]
        heap: list[tuple] = [(least[-1], len(word), 0, 0, None)]
        known, pushed = [-least[-1]], 0  # the n least whole costs of sets, negated
        out: list[tuple[int, list[int]]] = []
        while heap and len(out) < n:
            whole, at, _, spent, way = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                end = 0
                while way is not None:
                    begin, (end, way) = end, way
                    ids += self._ids(word, signs, begin, end)
                out.append((spent, ids))
                continue
            goes_on = False
            for start in range(at - 1, max(at - self.longest, 0) - 1, -1):
                i = get(signs[start:at])
                if i is not None:
                    cost = costs[i]
                elif start == at - 1:
                    cost = self._byte_cost(word[start])
                else:
                    continue
                total = least[start] + cost + spent
                if total == whole and not goes_on:
                    goes_on = True
                elif len(known) < n:
                    heapq.heappush(known, -total)
                elif total >= -known[0]:
                    continue
                else:
                    heapq.heapreplace(known, -total)
                pushed += 1
                heapq.heappush(heap, (total, start, pushed, cost + spent, (at, way)))
        return out

    def best_two(self, word: str) -> tuple[int, list[int], int]:
        """The cheapest segmentation's cost and ids, and what the next costs beyond it (_NEVER without one), by the forward pass alone."""
        signs = self._signs(word)
        best, second, back = self.forward(word, signs)
        get, end, ids = self.pieces.get, len(word), []
        while end:
            start = back[end]
            i = get(signs[start:end])
            if i is None:
                ids += [self.bytes[b] for b in reversed(word[start].encode())]
            else:
                ids.append(i)
            end = start
        ids.reverse()
        return best[-1], ids, second[-1] - best[-1] if second[-1] < _NEVER else _NEVER

    def parts(self, word: str) -> list[str]:
        """word, cut wherever no piece reaches over two neighbours: its lattice is its parts' lattices in a row."""
        signs, pairs = self._signs(word), self.pairs
        cuts = [k for k in range(1, len(word)) if signs[k - 1 : k + 1] not in pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before the first word goes."""
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _words(text: str) -> list[str]:
    """Words with the spaces before them, the text begun by one: no piece reaches over a boundary."""
    if text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [" " + w for w in text.split(" ")]
    out, held = [], ""
    for part in text.split(" "):
        if part:
            out.append(f"{held} {part}")
            held = ""
        else:
            held += " "
    if held:
        out.append(held)
    return out


class Segmenter:
    """N-best segmentations of texts; of words that have been seen the best and what the next costs are remembered."""

    def __init__(self, path: str, best: int = BEST):
        self.model, self.best = PieceModel(path), best
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.changes: dict[str, list[tuple[int, bytes]]] = {}

    def _learn(self, word: str) -> tuple[bytes, int, int]:
        parts = self.model.parts(word)
        if len(parts) > 1:
            own = [self.known.get(p) or self._learn(p) for p in parts]
            out = (b"".join([x[0] for x in own]), sum([x[1] for x in own]), min([x[2] for x in own]))
        else:
            cost, ids, more = self.model.best_two(word)
            out = (array("I", ids).tobytes(), cost, more)
        if len(word) <= LONGEST_REMEMBERED:
            self.known[word] = out
        return out

    def segment(self, text: str) -> tuple[int, float, list[tuple[float, bytes]]]:
        """(words, cost of the best, [(cost beyond the best, little-endian 32-bit ids)]) of the cheapest segmentations.

        No piece reaches over the beginning of a word, so the text's lattice is its words' lattices in a row: forward
        scores add up, and a segmentation's cost beyond the best is the sum of its words'. The n cheapest change only
        the n - 1 words with the least to add, and the backward search runs over those; the search over the changes
        leaves the heap in order of cost, then of the changed words' places.
        """
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
            self.changes.clear()
        words, get, learn = _words(text), self.known.get, self._learn
        own = [get(w) or learn(w) for w in words]
        parts = [x[0] for x in own]
        cost = sum([x[1] for x in own])
        least = heapq.nsmallest(self.best - 1, zip([x[2] for x in own], range(len(own))))
        change = []
        for extra, k in least:
            if extra < _NEVER:
                found = self.changes.get(words[k])
                if found is None:
                    found = [(c, array("I", i).tobytes()) for c, i in self.model.n_best(words[k], self.best)]
                    found = [(c - found[0][0], i) for c, i in found]
                    if len(words[k]) <= LONGEST_REMEMBERED:
                        self.changes[words[k]] = found
                parts[k] = found[0][1]
                change.append((k, found[1:]))
        heap: list[tuple[int, tuple[tuple[int, int], ...], int]] = [(0, (), 0)]
        out = []
        while heap and len(out) < self.best:
            extra, taken, at = heapq.heappop(heap)
            swapped = [(change[j][0], change[j][1][m][1]) for j, m in taken]
            before = [(k, parts[k]) for k, _ in swapped]
            for k, ids in swapped:
                parts[k] = ids
            out.append((extra / UNIT, b"".join(parts)))
            for k, ids in before:
                parts[k] = ids
            # the next ones: a further word changed, or the last change made dearer
            for j in range(at, len(change)):
                heapq.heappush(heap, (extra + change[j][1][0][0], (*taken, (j, 0)), j + 1))
            if taken and taken[-1][1] + 1 < len(change[taken[-1][0]][1]):
                j, m = taken[-1]
                dearer = change[j][1]
                heapq.heappush(heap, (extra - dearer[m][0] + dearer[m + 1][0], (*taken[:-1], (j, m + 1)), at))
        return len(words), cost / UNIT, out


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, best: int = BEST) -> Segmenter:
    """One per Python worker, model file and number of segmentations."""
    if (path, best) not in _SEGMENTERS:
        _SEGMENTERS[path, best] = Segmenter(path, best)
    return _SEGMENTERS[path, best]


def encode_documents(docs: DataFrame, path: str, best: int = BEST) -> DataFrame:
    """doc_id, text, score, ids, n_best array<struct<score, ids>> of every row: its `best` likeliest segmentations.

    docs: doc_id, text. score is the natural log probability of the best one, ids its pieces; n_best holds all, in
    descending score. A null or empty text has no pieces, a score of 0 and one segmentation. Fewer than `best` are
    returned only where there are no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, best)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                rows = []
                for text in some.column("text").to_pylist():
                    _, cost, found = own.segment(text or "")
                    rows.append([{"score": -cost - extra, "ids": memoryview(ids).cast("I").tolist()} for extra, ids in found])
                yield pa.record_batch(
                    [some.column("doc_id"), some.column("text"), pa.array([r[0]["score"] for r in rows]), pa.array([r[0]["ids"] for r in rows], pa.list_(pa.int32())), pa.array(rows, kind)],
                    names=["doc_id", "text", "score", "ids", "n_best"],
                )

    lean = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(lean, run, "doc_id long, text string, score double, ids array<int>, n_best array<struct<score: double, ids: array<int>>>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids): bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(path).model
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str, best: int = BEST) -> DataFrame:
    """doc_id, n_words, n_pieces, score, ids_crc32 of the best segmentation, n_best array<struct<extra, n_pieces,
    ids_crc32>> (extra: natural log probability lost against the best), decoded (whether the ids give the text back).

    Texts and their defined cases are as in encode_documents(); only digests leave the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, best)
        texts_of = own.model.texts
        kind = pa.list_(pa.struct([("extra", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n_words, cost, found = own.segment(text)
                n_best = [{"extra": extra, "n_pieces": len(ids) // 4, "ids_crc32": zlib.crc32(ids)} for extra, ids in found]
                back = b"".join(map(texts_of.__getitem__, memoryview(found[0][1]).cast("I"))).decode("utf-8", "replace")[1:]
                rows.append((n_words, n_best[0]["n_pieces"], -cost, n_best[0]["ids_crc32"], n_best, back == text))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), kind, pa.bool_()]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_pieces", "score", "ids_crc32", "n_best", "decoded"],
            )

    lean = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_words long, n_pieces long, score double, ids_crc32 long, n_best array<struct<extra: double, n_pieces: long, ids_crc32: long>>, decoded boolean"
    return map_batches(lean, run, schema)
