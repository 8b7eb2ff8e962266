"""Chat formatting by a finite-state machine over roles, from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_batches, partitions, written


@dataclass(frozen=True)
class Template:
    """What stands before and after each role's text, which roles are learned from, and which role may follow which.

    A role not listed in `turns` is written between other[0] and other[1], before its text, and never learned from.
    `follows` maps a state (the last role, or "" at the start) to the roles allowed next; `accepts` are final states.
    """

    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST] ", " [/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    accepts: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        controls = self.controls()
        inside = [(a, b) for a in controls for b in controls for i in range(a == b, len(b)) if b.startswith(a, i) or a.startswith(b[i:])]
        if not all(controls) or inside:
            raise ValueError(f"a control string is empty or begins within another or itself: {inside[:1] or controls}")

    def controls(self) -> list[str]:
        """The control strings, without the spaces around them; none is empty or begins within another or itself."""
        found = [x.strip() for pair in self.turns.values() for x in pair] + list(self.other)
        return sorted(set(found), key=lambda x: (-len(x), x))


class Format:
    """The template's escapes and its parser. A backslash in a text is doubled; one goes after a control's first character."""

    def __init__(self, template: Template):
        self.template = template
        controls = "|".join(map(re.escape, template.controls()))
        self._escape = re.compile(rf"\\|(?:{controls})")
        self._unescape = re.compile(r"\\(.)", re.S)
        self._control = re.compile(controls)

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1", text) if "\\" in text else text

    def segments(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        """(text, learned from) of one turn."""
        t = self.template
        if role in t.turns:
            before, after = t.turns[role]
            return [(before, False), (self.escape(text), role in t.learned), (after, False)]
        name = "\\0" if role is None else self.escape(role)
        return [(t.other[0] + name + t.other[1], False), (self.escape(text), False), (t.other[2], False)]

    def parse(self, whole: str) -> list[tuple[str | None, str]]:
        """(role, text) of every turn of a formatted conversation: a control opens, the next that may end it closes.

        A ValueError tells of a text that segments() can't have made, and from which character on.
        """
        t, turns, at = self.template, [], 0
        opens = {before.strip(): (role, before, after) for role, (before, after) in t.turns.items()}
        while at < len(whole):
            found = self._control.match(whole, at)
            control = found[0] if found else None
            start, end = -1, -1
            if control == t.other[0]:
                middle = whole.find(t.other[1], at)
                raw = whole[at + len(control) : middle]
                role = None if raw == "\\0" else self.unescape(raw)
                start, after = middle + len(t.other[1]), t.other[2]
                end = whole.find(after, start) if middle >= 0 else -1
            elif control in opens and whole.startswith(opens[control][1], at):
                role, before, after = opens[control]
                start = at + len(before)
                end = whole.find(after, start)
            if end < 0:
                raise ValueError(f"no turn of this template from character {at} on")
            turns.append((role, self.unescape(whole[start:end])))
            at = end + len(after)
        return turns


def _by_turn(df: DataFrame, *order: str) -> DataFrame:
    """Each conversation whole in one partition, in order; tasks stream over it, so its length doesn't matter."""
    return df.repartition(partitions(df), "conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, role, segments array<struct<text, loss>>, valid of every turn.

    conversations: conv_id, turn, role, text. Turns go by turn, then role and text, nulls first; null texts are empty;
    a null conv_id is a conversation. valid says whether the machine allows the role there; turns that it doesn't allow
    are formatted too, so nothing is lost. Memory holds one batch, whatever a conversation's length.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, last, state, number = Format(template), object(), "", 0
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            numbers, segments, valid = [], [], []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if conv != last:
                    last, state, number = conv, "", 0
                valid.append(role in template.follows.get(state, ()))
                numbers.append(number)
                segments.append([{"text": t, "loss": x} for t, x in fmt.segments(role, text or "")])
                state, number = role or "", number + 1
            yield pa.record_batch(
                [batch.column("conv_id"), pa.array(numbers, pa.int64()), batch.column("role"), pa.array(segments, kind), pa.array(valid, pa.bool_())],
                names=["conv_id", "turn_no", "role", "segments", "valid"],
            )

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return map_batches(
        _by_turn(turns, "turn", "role", "text"),
        run,
        "conv_id long, turn_no long, role string, segments array<struct<text: string, loss: boolean>>, valid boolean",
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """From format_conversations' output alone, per conversation: n_turns, valid (turn order and last role), and digests.

    turns_sha256: of role, newline, text, newline per turn (a null role as empty); loss_chars and loss_sha256: the
    unescaped text of the segments to learn from; formatted_chars: code points of all segments.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, open_, done = Format(template), None, []

        def close() -> None:
            if open_ is not None:
                turns, loss = open_[2].hexdigest(), open_[4].hexdigest()
                done.append((open_[0], open_[1], turns, open_[3], loss, open_[5], open_[6] and open_[7] in template.accepts))

        for batch in batches:
            for conv, segments, valid in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segments", "valid"))):
                if open_ is None or open_[0] != conv:
                    close()
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, None]
                whole = "".join(s["text"] for s in segments)
                for role, text in fmt.parse(whole):
                    open_[1] += 1
                    open_[2].update(f"{role or ''}\n{text}\n".encode())
                    open_[7] = role
                for s in segments:
                    if s["loss"]:
                        learned = fmt.unescape(s["text"])
                        open_[3] += len(learned)
                        open_[4].update(learned.encode())
                open_[5] += len(whole)
                open_[6] = open_[6] and valid
            yield _digests(done)
            done.clear()
        close()
        yield _digests(done)

    return map_batches(
        _by_turn(formatted, "turn_no"),
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)


def formatted_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Format, write, read the written segments back."""
    return read_back(written(format_conversations(conversations, template), "chat"), template)
