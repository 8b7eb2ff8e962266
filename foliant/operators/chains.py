"""Chains of model calls over chunks of documents: extraction, and summaries in two steps.

Each step's conversations are batches for a chat backend and its answers are written once, so a lost task asks again for its
own batch alone and no later step asks the model twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.session import stored
from foliant.operators.inference import ChatBackend, chat_batches
from foliant.operators.text import MODEL_FIELDS, chunk_paragraphs, ground_values, parse_bullets, trimmed

#: New tokens of an extraction, of each point of a chunk, and of an overview or a merged list.
EXTRACTION_TOKENS, POINT_TOKENS, SUMMARY_TOKENS = 512, 60, 384


def _turns(system: Column, user: Column) -> Column:
    said = [F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", system), ("user", user))]
    return F.array(*said).alias("turns")


def extract_by_chat(chunks: DataFrame, document: str, backend: ChatBackend, fields: list[str] = MODEL_FIELDS) -> DataFrame:
    """document, field, value, pos: what a model finds in each chunk (document, chunk, text) and the chunk has."""
    ask = F.lit("Read the text and answer with one JSON object of these keys: " + ", ".join(fields) + ". Each holds a list of texts, copied as they stand there.")
    answers = chat_batches(chunks.select(document, "chunk", "text", _turns(ask, F.col("text"))), backend, EXTRACTION_TOKENS, [document, "chunk", "text"])
    return ground_values(stored(answers, "answers"), document, "answer", "text", fields, "chunk")


def summarize_by_chat(paragraphs: DataFrame, document: str, order: str, text: str, backend: ChatBackend, points: int = 5) -> DataFrame:
    """document, overview, key_points, truncated of every document with text.

    Each kept chunk is asked for its points: `points` if it is the document's only one, else half of that and one, two at
    least. The notes of all chunks go to the model again for an overview, and, only where there are more than `points`, for
    the `points` that matter; else they are the key points as they stand.
    """
    chunks = chunk_paragraphs(paragraphs, document, order, text).where("kept")
    about = chunks.groupBy(document).agg(F.count("*").alias("n_chunks"), F.max("truncated").alias("truncated"))
    chunks = stored(chunks.join(about.drop("truncated"), document).withColumn("wanted", F.greatest(F.lit(2), F.when(F.col("n_chunks") == 1, points).otherwise(points // 2 + 1))), "chunks")
    ask = F.concat(F.lit("List the "), F.col("wanted").cast("string"), F.lit(" points of the text that matter most, a line each, after a dash."))
    keys = [document, "chunk", "truncated"]
    notes = stored(chat_batches(chunks.select(*keys, _turns(ask, F.col("text"))), backend, POINT_TOKENS * max(2, points), keys), "notes")
    parsed = parse_bullets(notes.withColumn("place", F.struct(document, "chunk", "truncated")), "place", "answer").select("place.*", "points")
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "points"))), lambda x: x["points"]))
    all_points = stored(parsed.groupBy(document).agg(ordered.alias("points"), F.max("truncated").alias("truncated")), "points")
    noted = F.array_join(F.transform("points", lambda x: F.concat(F.lit("- "), x)), "\n")
    over = F.lit(f"From notes on a document, write a paragraph of 2 to {points // 2 + 3} sentences on what it is about.")
    merge = F.lit(f"Merge the notes into the {points} points that matter most, a line each, after a dash.")
    step = F.inline(F.filter(F.array(F.struct(F.lit("overview").alias("step"), over.alias("ask")), F.struct(F.when(F.size("points") > points, "merge").alias("step"), merge.alias("ask"))), lambda x: x["step"].isNotNull()))
    second = all_points.select(document, noted.alias("notes"), step).select(document, "step", _turns(F.col("ask"), F.col("notes")))
    answers = stored(chat_batches(second, backend, SUMMARY_TOKENS, [document, "step"]), "summaries")
    merged = parse_bullets(answers.where("step = 'merge'"), document, "answer").select(document, F.slice("points", F.lit(1), F.lit(points)).alias("merged"))
    overview = answers.where("step = 'overview'").select(document, trimmed(F.col("answer")).alias("overview"))
    out = all_points.join(overview, document).join(merged, document, "left")
    return out.select(document, "overview", F.coalesce("merged", "points").alias("key_points"), "truncated")
