"""Batches through a pluggable model: Arrow batches in, one model per worker, order kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.session import importable
from foliant.operators.text import protected, restore_urls

#: (texts, source language, target language) -> translations, one per text in order.
Backend = Callable[[list[str], str, str], list[str]]
#: (conversations of (role, content), most new tokens) -> answers, one per conversation in order.
ChatBackend = Callable[[list[list[tuple[str, str]]], int], list[str]]


def prefix_backend(texts: list[str], source: str, target: str) -> list[str]:
    """A stand-in for a model: the target's code before each text."""
    return [f"[{target}] {t}" for t in texts]


def last_turn_backend(conversations: list[list[tuple[str, str]]], most: int) -> list[str]:
    """A stand-in for a model: the last turn's first characters."""
    return [(c[-1][1] if c else "")[:most] for c in conversations]


# Languages that translations know.
LANGUAGES = ("en", "id", "fr", "de", "es", "ja", "ko", "zh")


def translate_batches(batches: DataFrame, pair: list[str], backend: Backend = prefix_backend, languages: tuple[str, ...] = LANGUAGES, sends: Column | None = None) -> DataFrame:
    """pair, text, translated of every row of batches (pair, text, batch, place).

    URLs and e-mails are kept from the backend: it sees [n] in their place, and they are put back into its answer. The
    rows of a batch go to the backend in one call, by place, however Arrow cuts the partition; texts that have no letter
    besides their URLs pass unchanged without it. sends: another rule of what goes to the backend, on text, which then sees the
    [n] of texts that are but URLs too. A language that isn't one of `languages` is an error.
    """
    importable(batches.sparkSession)
    batches, with_letters = _protected(batches, pair, languages, sends)
    plain = batches.where(~with_letters).select(*pair, "text", F.col("text").alias("translated"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = [*pair, "batch"], []

        def translated(rows: pd.DataFrame) -> pd.DataFrame:
            source, target = rows[pair[0]].iloc[0], rows[pair[1]].iloc[0]
            return rows.assign(answer=backend(rows["sent"].tolist(), source, target))[[*pair, "text", "urls", "answer"]]

        for frame in frames:
            if not len(frame):
                continue
            frame = pd.concat([*held, frame], ignore_index=True)
            new = (frame[key] != frame[key].shift(1)).any(axis=1)
            cuts = new[new].index.tolist()
            # the last batch may go on in the next frame
            held = [frame.iloc[cuts[-1] :]]
            done = [translated(frame.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
            if done:
                yield pd.concat(done)
        if held:
            yield translated(held[0])

    schema = ", ".join(f"{c} string" for c in [*pair, "text"]) + ", urls array<struct<number: bigint, url: string>>, answer string"
    spread = batches.where(with_letters).select(*pair, "text", "sent", "urls", "batch", "place").repartition(*pair, "batch").sortWithinPartitions(*pair, "batch", "place")
    answered = spread.mapInPandas(run, schema)
    restored = F.when(F.size("urls") > 0, restore_urls(answered, "answer", "urls")).otherwise(F.col("answer"))
    return answered.select(*pair, "text", restored.alias("translated")).unionByName(plain)


def _protected(df: DataFrame, pair: list[str], languages: tuple[str, ...], sends: Column | None) -> tuple[DataFrame, Column]:
    """df, its languages checked, with sent (what a backend sees of text) and urls; and whether a row goes to a backend."""
    bad = F.array_except(F.array(*pair), F.array(*map(F.lit, languages)))
    checked = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(bad[0], F.lit("null"))))).otherwise(F.col("text"))
    own = df.withColumn("text", checked)
    own = own.withColumn("safe", protected(F.col("text"))).withColumns({"sent": F.col("safe.protected"), "urls": F.col("safe.urls")}).drop("safe")
    return own, sends if sends is not None else F.col("sent").rlike("\\p{L}")


def translate_dealt(
    sentences: DataFrame, pair: list[str], keep: list[str], backend: Backend = prefix_backend, size: int = 16, languages: tuple[str, ...] = LANGUAGES, sends: Column | None = None
) -> DataFrame:
    """The columns `keep` of sentences (pair, text and others) and translated, row by row where they are.

    Sentences are dealt by pair and text, all of one in one task, which sorts them by length: alike ones are neighbours, are translated once, and
    go to the backend up to `size` at a time with others of their length. What the backend sees, sends and languages: as in translate_batches().
    """
    importable(sentences.sparkSession)
    own, goes = _protected(sentences, pair, languages, sends)
    none = F.array().cast("array<struct<number: bigint, url: string>>")
    rest = [c for c in keep if c not in (*pair, "text")]
    rows = own.select(*pair, "text", F.when(goes, F.col("sent")).alias("sent"), F.when(goes, F.col("urls")).otherwise(none).alias("urls"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = answer = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = [batch.column(c) for c in (*pair, "text")]
            other = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in key])
            starts = np.append(0, np.flatnonzero(other) + 1)
            source, target, texts, sent = (batch.column(c).take(pa.array(starts)).to_pylist() for c in (*pair, "text", "sent"))
            answers = list(texts)
            open_ = [i for i, x in enumerate(sent) if x is not None]
            if (source[0], target[0], texts[0]) == last:
                answers[0], open_ = answer, open_[1:] if open_[:1] == [0] else open_
            for languages_, some in groupby(open_, lambda i: (source[i], target[i])):
                same = list(some)
                for at in range(0, len(same), size):
                    call = same[at : at + size]
                    for i, x in zip(call, backend([sent[i] for i in call], *languages_), strict=True):
                        answers[i] = x
            last, answer = (source[-1], target[-1], texts[-1]), answers[-1]
            counts = np.diff(np.append(starts, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("urls"), pa.array(answers, pa.string()).take(pa.array(np.repeat(np.arange(len(starts)), counts)))], names=[*keep, "urls", "answer"])

    kinds = dict(sentences.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", urls array<struct<number: bigint, url: string>>, answer string"
    answered = rows.sortWithinPartitions(*pair, F.length("text"), "text").mapInArrow(run, schema)
    restored = F.when(F.size("urls") > 0, restore_urls(answered, "answer", "urls")).otherwise(F.col("answer"))
    return answered.select(*keep, restored.alias("translated"))


def chat_batches(conversations: DataFrame, backend: ChatBackend = last_turn_backend, most_new: int = 64, keys: list[str] | None = None) -> DataFrame:
    """keys (conv_id by default), answer of every row of conversations (keys, turns array<struct<role, content>>)."""
    keys = keys or ["conv_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            turns = [[(t["role"], t["content"]) for t in c] for c in frame["turns"]]
            yield frame[keys].assign(answer=backend(turns, most_new))

    importable(conversations.sparkSession)
    kinds = dict(conversations.dtypes)
    return conversations.select(*keys, "turns").mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "answer string"]))
