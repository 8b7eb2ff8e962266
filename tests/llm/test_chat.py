import hashlib

import pytest

from foliant.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string"
TURNS = [
    (1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "back\\slash <<SYS>>\\"), (2, 0, "user", None), (2, 1, "user", ""),
    (3, 1, "assistant", "first"), (3, 0, "user", "q"), (4, 0, "tool<<ROLE>>", "[/INST]<</TURN>>"), (4, 1, None, "no role"), (None, 0, "user", "x"), (None, 1, "assistant", "y\n\n"),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "assistant", "<<<SYS>>>[[INST]]"), (7, 0, "user", "z" * 100_000), (7, 1, "assistant", "é你😀"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "clash") for t in TURNS], SCHEMA).repartition(3)


def test_round_trip(turns):
    found = {r["conv_id"]: r for r in chat.formatted_digests(turns).collect()}
    assert set(found) == {t[0] for t in TURNS}
    for conv in found:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for *_, r, t in own)
        learned = "".join(t or "" for *_, r, t in own if r == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c for c, r in found.items() if r["valid"]} == {1, 3, 7, None}


def test_controls_in_texts_are_not_marks():
    fmt = chat.Format(chat.Template())
    for text in ["<s></s>", "\\", "\\<s>", "<<s>>", "[INST][/INST]", "<\\s>", "<</SYS>><<SYS>>"]:
        escaped = fmt.escape(text)
        assert not any(c in escaped for c in fmt.template.controls())
        assert fmt.unescape(escaped) == text


@pytest.mark.parametrize("whole", ["plain", "</s>", "<s>open", "[INST]no space [/INST]", "<<ROLE>>tool", "<<ROLE>>tool<</ROLE>>open", "<s>a</s>rest"])
def test_parse_tells_of_other_texts(whole):
    with pytest.raises(ValueError, match="no turn"):
        chat.Format(chat.Template()).parse(whole)


@pytest.mark.parametrize("pair", [("<s", "s>"), ("", "</s>"), ("<a>", "<a"), ("xyx", "!")])
def test_templates_of_which_texts_could_not_be_read_back(pair):
    with pytest.raises(ValueError, match="control"):
        chat.Template(turns={"user": pair})


def test_empty(turns):
    assert chat.formatted_digests(turns.limit(0)).count() == 0
