"""Translation memory: distinct sentences, reuse of stored translations, length-sorted batches, joining back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.session import stored
from foliant.operators.inference import Backend, prefix_backend, translate_dealt
from foliant.sources.store import GrowingTable

#: Sentences from this many occurrences on get their translation sent to every task in join_back().
FREQUENT = 1_000
#: At most so many of them, the most frequent: a few MB.
MOST_FREQUENT = 10_000


def unique_sentences(sentences: DataFrame, pair: list[str], order: list[str]) -> DataFrame:
    """pair, text, first (the struct of order columns of its first occurrence), occurrences of each distinct sentence."""
    return sentences.where("text <> ''").groupBy(*pair, "text").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("occurrences"))


def reuse(unique: DataFrame, memory: DataFrame, pair: list[str]) -> DataFrame:
    """unique with translated: the stored translation of the same pair and sentence, or null; memory: pair, text, translated, id.

    Of several stored translations the newest (largest id) counts. Both sides shuffle on pair and text; skewed keys are
    single rows by then, as both sides are distinct.
    """
    latest = memory.groupBy(*pair, "text").agg(F.max_by("translated", "id").alias("translated"))
    return unique.join(latest, [*pair, "text"], "left")


def stored_memory(spark: SparkSession, name: str, path: str, pair: list[str], buckets: int | None = None) -> GrowingTable:
    """The memory as a table of pair, text, translated, bucketed by pair and text."""
    schema = ", ".join(f"{c} STRING" for c in [*pair, "text", "translated"])
    return GrowingTable(spark, name, path, schema, [*pair, "text"], buckets)


def stored_unique(spark: SparkSession, name: str, path: str, unique: DataFrame, pair: list[str], buckets: int | None = None) -> DataFrame:
    """pair, text, occurrences of unique_sentences() as a table bucketed as stored_memory() is, so that neither side of their joins is shuffled."""
    schema = ", ".join(f"{c} STRING" for c in [*pair, "text"])
    table = GrowingTable(spark, name, path, f"{schema}, occurrences BIGINT", [*pair, "text"], buckets)
    table.append(unique, 1, dealt=True)
    return table.rows()


def remember(table: GrowingTable, translations: DataFrame, pair: list[str], version: int) -> bool:
    """Appends translations (pair, text, translated, id), the newest of each, that the memory lacks, as a version."""
    latest = translations.groupBy(*pair, "text").agg(F.max_by("translated", "id").alias("translated"))
    return table.append(table.joined(latest, "left_anti", before=version), version, dealt=True)


def translate_through(unique: DataFrame, table: GrowingTable, pair: list[str], version: int, backend: Backend = prefix_backend, size: int = 16, sends: Column | None = None) -> DataFrame:
    """unique with translated and hit: stored translations first, the rest by the backend.

    What the memory lacks is sorted by length and translated in the tasks that hold the buckets, and appended as a version, from which it is then
    served; the same sentences never reach the backend again. sends: as in translate_batches(). A repeated call of one version finds what that version has stored.
    """
    if version not in table.versions():
        misses = table.joined(unique, "left_anti", before=version)
        table.append(translate_dealt(misses, pair, [*pair, "text"], backend, size, sends=sends), version, dealt=True)
    before = table.joined(unique, "left_semi", before=version).select(*pair, "text").withColumn("hit", F.lit(True))
    served = table.joined(unique, "left")
    return served.join(before.hint("merge"), [*pair, "text"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def length_sorted_batches(unique: DataFrame, pair: list[str], order: list[str], size: int = 16) -> DataFrame:
    """unique with batch and place: per language pair, by length, `size` at a time.

    Ranks are global per pair without one task for all: rows are ranked within buckets of equal length, and the
    buckets' offsets are added up over their counts.
    """
    length = F.length("text")
    ranked = unique.withColumn("chars", length).withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(64)))
    own = Window.partitionBy(*pair, "chars", "bucket").orderBy(*order)
    counts = ranked.groupBy(*pair, "chars", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*pair).orderBy("chars", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = ranked.withColumn("rank", F.row_number().over(own) - 1).join(offsets, [*pair, "chars", "bucket"])
    at = F.col("offset") + F.col("rank")
    return placed.select("*", F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("place")).drop("offset", "rank", "bucket")


def batch_waste(batches: DataFrame, pair: list[str]) -> DataFrame:
    """pair, batches, rows, padded (characters that padding to the longest of each batch adds)."""
    each = batches.groupBy(*pair, "batch").agg(F.count("*").alias("n"), F.max("chars").alias("most"), F.sum("chars").alias("sum"))
    return each.groupBy(*pair).agg(
        F.count("*").alias("batches"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("most") - F.col("sum")).cast("long").alias("padded")
    )


def join_back(sentences: DataFrame, translated: DataFrame, pair: list[str], keys: list[str]) -> DataFrame:
    """keys, text: each unit's translated sentences in order, joined by a space, empty ones skipped.

    translated: pair, text, translated (one row per distinct sentence), and occurrences where known. Sentences of at least
    FREQUENT occurrences, MOST_FREQUENT at most, are broadcast, so that their occurrences stay where they are; all
    others meet theirs by a shuffle, which no key dominates.
    """
    own = sentences.where("text <> ''")
    columns = [*pair, "text", "translated"]
    if "occurrences" in translated.columns:
        often = translated.where(F.col("occurrences") >= FREQUENT).orderBy(F.desc("occurrences"), *pair, "text").limit(MOST_FREQUENT)
        sent = F.broadcast(often.select(*pair, "text", F.col("translated").alias("own")))
        marked = own.join(sent, [*pair, "text"], "left")
        rest = marked.where("own IS NULL").drop("own").join(translated.select(*columns), [*pair, "text"])
        joined = marked.where("own IS NOT NULL").withColumnRenamed("own", "translated").unionByName(rest)
    else:
        joined = own.join(translated.select(*columns), [*pair, "text"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "translated"))), lambda x: x["translated"])
    return joined.where("translated <> ''").groupBy(*keys).agg(F.array_join(ordered, " ").alias("text"))


def translate_units(sentences: DataFrame, pair: list[str], keys: list[str], backend: Backend = prefix_backend, size: int = 16, sends: Column | None = None) -> DataFrame:
    """keys, text: each unit's sentences translated, in order, joined by a space, empty ones skipped. sends: as in translate_batches().

    All occurrences of a sentence meet in one task, which translates it once and gives it to them; no table of sentences is written or joined
    back. Those of at least FREQUENT occurrences, MOST_FREQUENT at most, are translated apart and broadcast as in join_back(), so that no
    key dominates a task; which may be so frequent is told by counts of hashes. sentences is read two or three times.
    """
    own = sentences.where("text <> ''")
    code = F.xxhash64(*pair, "text")
    counts = own.groupBy(code.alias("code")).agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    often = [r["code"] for r in counts.orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).collect()]
    done = None
    if often:
        codes = F.broadcast(own.sparkSession.createDataFrame([(x,) for x in often], "code long"))
        texts = own.join(codes, code == F.col("code"), "left_semi").select(*pair, "text").distinct()
        sent = stored(translate_dealt(texts, pair, [*pair, "text"], backend, size, sends=sends), "often")
        marked = own.join(F.broadcast(sent.withColumnRenamed("translated", "own")), [*pair, "text"], "left")
        done = marked.where("own IS NOT NULL").select(*keys, "pos", F.col("own").alias("translated"))
        own = marked.where("own IS NULL").drop("own")
    joined = translate_dealt(own.repartition(*pair, "text"), pair, [*keys, "pos"], backend, size, sends=sends)
    joined = joined if done is None else joined.unionByName(done)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "translated"))), lambda x: x["translated"])
    return joined.where("translated <> ''").groupBy(*keys).agg(F.array_join(ordered, " ").alias("text"))
