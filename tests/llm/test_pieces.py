import pytest

from foliant.llm import pieces
from foliant.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return pieces.Segmenter(PATH, 5)


def brute(model, word, n):
    """Every segmentation into pieces, with bytes only for characters that no piece is, by cost."""
    signs = word.replace("▁", "\0").replace(" ", "▁")

    def ways(start):
        if start == len(word):
            yield 0.0, ()
        for end in range(start + 1, len(word) + 1):
            if signs[start:end] in model.pieces:
                ids = (model.pieces[signs[start:end]],)
            elif end == start + 1:
                ids = tuple(model.bytes[b] for b in word[start].encode())
            else:
                continue
            for c, rest in ways(end):
                yield sum(model.costs[i] for i in ids) / pieces.UNIT + c, ids + rest

    return sorted(ways(0))[:n]


@pytest.mark.parametrize("text", ["thanor", "a  b", "é你 x", "▁é", "to be or", "\n\n", " ", "tion tion"])
def test_n_best_of_texts(own, text):
    expected = brute(own.model, " " + text, 5)
    _, cost, found = own.segment(text)
    assert [round(cost + e, 6) for e, _ in found] == [round(c, 6) for c, _ in expected]
    assert all(own.model.decode(list(memoryview(ids).cast("I"))) == text for _, ids in found)


def test_n_best_of_words(own):
    for word in (" thandor", " ering,", " a", "   lead"):
        got, expected = own.model.n_best(word, 6), brute(own.model, word, 6)
        assert len({tuple(ids) for _, ids in got}) == len(got) and all(sum(own.model.costs[i] for i in ids) == c for c, ids in got)
        assert [round(c / pieces.UNIT, 6) for c, _ in got] == [round(c, 6) for c, _ in expected]


@pytest.mark.parametrize("text", ["a" * 100_000, "tionering" * 10_000 + "é你" * 500])
def test_long_texts_without_spaces(own, text):
    _, cost, found = own.segment(text)
    assert len(found) == 5 and len({ids for _, ids in found}) == 5
    for extra, ids in found:
        ids = list(memoryview(ids).cast("I"))
        assert own.model.decode(ids) == text
        assert sum(own.model.costs[i] for i in ids) / pieces.UNIT == pytest.approx(cost + extra, abs=1e-6)


def test_documents(spark, docs, rows, empty):
    encoded = pieces.encode_documents(docs, PATH)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    digests = {r["doc_id"]: r for r in pieces.piece_digests(docs, PATH).collect()}
    assert all(r["decoded"] for r in digests.values())
    for r in encoded.collect():
        d = digests[r["doc_id"]]
        assert len(r["ids"]) == d["n_pieces"] and r["score"] == pytest.approx(d["score"])
        scores = [x["score"] for x in r["n_best"]]
        assert scores == sorted(scores, reverse=True) and len(scores) == len(d["n_best"])
    assert pieces.piece_digests(empty, PATH).count() == 0


def test_words_are_learned_by_their_parts(monkeypatch):
    """Words of many marks are put together from parts that stand alone, with the cost, pieces and next cost of the whole word."""
    own = pieces.Segmenter(PATH)
    words = [" hello,", " (hello)", " hello,world", " Straße…x1", " 日本語abc", "  ▁a", " a1b2,,hello", " \U0001f600hello"]
    for w in words:
        assert "".join(own.model.parts(w)) == w
        cost, ids, more = own.model.best_two(w)
        assert own._learn(w) == (pieces.array("I", ids).tobytes(), cost, more)
    asked = []
    monkeypatch.setattr(own.model, "best_two", asked.append)
    known = [p for w in words for p in own.model.parts(w)]
    assert len(set(known)) < len(known)
    own._learn(" hello,,")
    assert asked == []


def test_changed_words_are_searched_once(own, monkeypatch):
    """The word of the least to add is searched when first met; its texts' segmentations stay the same."""
    first = own.segment("some hello words")
    asked = []
    monkeypatch.setattr(own.model, "n_best", lambda *a: asked.append(a))
    assert own.segment("some hello words") == first and asked == []
