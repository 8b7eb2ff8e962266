"""Edits of stored segments: checks, application, differences, inserted blocks and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.text import named
from foliant.sources.store import VersionedStore

KEYS = ["document_id", "key"]


def normalize_edits(edits: DataFrame) -> DataFrame:
    """edits with valid (runs, where sent, join to the text) and style, an empty one as null."""
    joined = F.array_join("runs", "")
    return edits.withColumns({
        "valid": F.col("runs").isNull() | F.col("text").eqNullSafe(joined),
        "style": F.when(F.col("style") != "", F.col("style")),
    })


def unknown_segment_keys(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Edited keys that the document doesn't have."""
    return edits.select(*KEYS).distinct().join(segments.select(*KEYS), KEYS, "left_anti")


def apply_segment_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """segments (with style and runs, where stored) with translated_text, style, runs and edited.

    edits: keys, text, style, runs, and flags sent_style and sent_runs; without a flag column a value that is set counts
    as sent. A null text keeps the stored one. A sent style replaces the stored one, null or empty clears it; a style
    that isn't sent stays. Sent runs replace, null or an empty list clears them; a text that changes without runs clears
    them too. Segments without an edit stay as they are.
    """
    kinds = dict(edits.dtypes)
    flag = {n: F.col(f"sent_{n}") if f"sent_{n}" in kinds else F.col(n).isNotNull() if n in kinds else F.lit(False) for n in ("style", "runs")}
    value = {n: F.col(n) if n in kinds else F.lit(None) for n in ("style", "runs")}
    e = edits.select(
        *KEYS, F.col("text").alias("e_text"), *[value[n].alias(f"e_{n}") for n in value], *[F.coalesce(flag[n], F.lit(False)).alias(f"e_sent_{n}") for n in flag], F.lit(True).alias("sent")
    )
    own = segments.withColumns({n: F.lit(None).cast(t) for n, t in (("style", "string"), ("runs", kinds.get("runs", "array<string>"))) if n not in segments.columns})
    text, sent = F.coalesce("e_text", "translated_text"), F.coalesce("sent", F.lit(False))
    renewed = F.coalesce("e_sent_runs", F.lit(False)) | (sent & ~text.eqNullSafe(F.col("translated_text")))
    return own.join(e, KEYS, "left").select(
        *KEYS, "ord",
        text.alias("translated_text"),
        F.when(F.coalesce("e_sent_style", F.lit(False)), F.when(F.col("e_style") != "", F.col("e_style"))).otherwise(F.col("style")).alias("style"),
        F.when(renewed, F.when(F.col("e_sent_runs") & (F.size("e_runs") > 0), F.col("e_runs"))).otherwise(F.col("runs")).alias("runs"),
        sent.alias("edited"),
    )


def changed_segments(segments: DataFrame, saved: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of segments of which a column differs from the saved version, nulls alike; or that aren't saved."""
    s = saved.select(*KEYS, *[F.col(c).alias(f"saved_{c}") for c in columns], F.lit(True).alias("is_saved"))
    same = F.col("is_saved").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"saved_{c}"))
    return segments.join(s, KEYS, "left").where(~same).select(*KEYS)


def missing_media(insertions: DataFrame, media: DataFrame) -> DataFrame:
    """Image blocks' sources that aren't stored."""
    wanted = insertions.where("type = 'image' AND src IS NOT NULL").select("document_id", F.col("src").alias("name")).distinct()
    return wanted.join(media.select("document_id", "name"), ["document_id", "name"], "left_anti")


def set_insertions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the block lists of new's documents replaced."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def set_stored_insertions(store: VersionedStore, table: str, new: DataFrame) -> int:
    """set_insertions() on a stored table: the partitions of new's documents are rewritten. The new version."""
    return store.change({table: (new, lambda old: set_insertions(old, new.select(*old.columns)))})


def _block(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c not in ("document_id", "ord")]))


def insertion_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, changes: the larger of blocks added and removed, or 1 when only their order moved."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("document_id", _block(df).alias("block")).agg(F.count("*").alias(name))

    diff = counted(old, "before").join(counted(new, "after_n"), ["document_id", "block"], "full")
    d = F.coalesce("after_n", F.lit(0)) - F.coalesce("before", F.lit(0))
    moved = diff.groupBy("document_id").agg(F.sum(F.greatest(d, F.lit(0))).alias("added"), F.sum(F.greatest(-d, F.lit(0))).alias("removed"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        blocks = F.transform(F.array_sort(F.collect_list(F.struct("ord", _block(df).alias("b")))), lambda x: x["b"])
        return df.groupBy("document_id").agg(F.xxhash64(blocks).alias(name))

    out = moved.join(listed(old, "o"), "document_id", "left").join(listed(new, "n"), "document_id", "left")
    changes = F.greatest("added", "removed")
    return out.select("document_id", F.when((changes == 0) & ~F.col("o").eqNullSafe(F.col("n")), F.lit(1)).otherwise(changes).cast("long").alias("changes"))


def numbered_runs(insertions: DataFrame) -> DataFrame:
    """Paragraph blocks with list_id: a numbered list restarts unless the block before is numbered with the same anchor."""
    order = Window.partitionBy("document_id").orderBy("ord")
    numbered = F.col("kind").eqNullSafe(F.lit("numbered"))
    goes_on = F.lag(numbered).over(order) & (F.lag("after").over(order) == F.col("after"))
    starts = F.when(numbered & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)
    return insertions.withColumn("list_id", F.when(numbered, F.sum(starts).over(order)).cast("long"))


def place_insertions(segments: DataFrame, insertions: DataFrame) -> DataFrame:
    """document_id, place, is_insert, ord: body and blocks in final order; a block follows the body up to its anchor.

    Blocks of one anchor go by their list order; -1 comes first, an anchor past the end last.
    """
    body = segments.select("document_id", F.col("ord").alias("anchor"), F.lit(0).alias("is_insert"), "ord")
    ends = segments.groupBy("document_id").agg(F.max("ord").alias("last"))
    blocks = insertions.join(ends, "document_id", "left").select(
        "document_id", F.least("after", F.coalesce("last", F.lit(-1))).alias("anchor"), F.lit(1).alias("is_insert"), "ord"
    )
    order = Window.partitionBy("document_id").orderBy("anchor", "is_insert", "ord")
    return body.unionByName(blocks).select("document_id", (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("is_insert").cast("long").alias("is_insert"), "ord")


def coalesce_adjacent(units: DataFrame, keys: list[str], runs: str = "runs") -> DataFrame:
    """keys, run, style, text: neighbouring runs of one style made one.

    units: keys and runs, array<struct<text, style>> in order. Each unit is read within its row, so no run is shuffled or
    sorted.
    """

    def joined(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | ~x["style"].eqNullSafe(F.get(all_, i - 1)["style"]), i)), lambda i: i.isNotNull())

        def whole(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(all_))
            return F.transform(at, lambda s, j: F.struct(
                F.get(all_, s)["style"].alias("style"), F.array_join(F.transform(F.slice(all_, s + 1, end(j) - s), lambda x: x["text"]), " ").alias("text")
            ))

        return named(starts, whole)

    found = units.select(*keys, F.posexplode(named(F.col(runs), joined)).alias("run", "joined"))
    return found.select(*keys, F.col("run").cast("long").alias("run"), "joined.style", "joined.text")


def intern_styles(units: DataFrame, document: str = "document_id", order: str = "ord", runs: str = "runs") -> DataFrame:
    """document, style, style_id: styles numbered by first appearance.

    units: document, order and runs, array<struct<style>> in order. A unit sends on its first run of each style alone, and
    what is kept per style are two numbers.
    """
    placed = F.sort_array(F.transform(runs, lambda x, i: F.struct(x["style"].alias("style"), i.alias("place"))))
    firsts = named(placed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~x["style"].eqNullSafe(F.get(all_, i - 1)["style"])))
    each = units.select(document, order, F.inline(firsts)).groupBy(document, "style").agg(F.min(order).alias("first"), F.min_by("place", order).alias("place"))
    number = F.row_number().over(Window.partitionBy(document).orderBy("first", "place")) - 1
    return each.select(document, "style", number.cast("long").alias("style_id"))


def dominant_format(runs: DataFrame, keys: list[str], fmt: str) -> DataFrame:
    """keys, format: the format of most characters that aren't blank, ties to the first seen."""
    sums = runs.groupBy(*keys, fmt).agg(F.sum(F.length(F.regexp_replace("text", "\\s", ""))).alias("n"), F.min("ord").alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return sums.withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, F.col(fmt).alias("format"))
