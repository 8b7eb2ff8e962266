"""Queries and changes over record tables: look-ups, pages, searches, counts, updates, deletes, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.store import VersionedStore


def get_by(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; the filter reaches the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, *order: Column | str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page in a total order; the last sort key must be unique."""
    return df.orderBy(*order).offset(skip).limit(limit)


def by_language_pair(df: DataFrame, source: str, target: str) -> DataFrame:
    return get_by(df, source_language=source, target_language=target)


def recent(df: DataFrame, as_of: str, hours: int = 24, limit: int = 100) -> DataFrame:
    """Rows created within `hours` before as_of, newest first."""
    since = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return page(df.where(F.col("created_at") >= since), F.desc("created_at"), "id", limit=limit)


def search_text(df: DataFrame, column: str, text: str, escape: bool = False) -> DataFrame:
    """Case-insensitive substring; % and _ are wildcards unless escape is set."""
    if escape:
        return df.where(F.contains(F.lower(column), F.lower(F.lit(text))))
    return df.where(F.col(column).ilike(f"%{text}%"))


def search_all_words(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text has every word of the query, in any case; an empty query keeps all."""
    words = [w for w in query.lower().split() if w]
    for w in words:
        df = df.where(F.contains(F.lower(column), F.lit(w)))
    return df


def page_meta(df: DataFrame, page_number: int, limit: int = 20) -> DataFrame:
    """page, limit, total_count, total_page for a table; the page is 1 or more, the limit 1 to 100."""
    limit, page_number = min(100, max(1, limit)), max(1, page_number)
    return df.agg(F.count("*").alias("total_count")).select(
        F.lit(page_number).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("limit"),
        "total_count",
        F.ceil(F.col("total_count") / limit).cast("long").alias("total_page"),
    )


def update_partial(df: DataFrame, updates: DataFrame, key: str, fields: list[str], now: str) -> DataFrame:
    """df with the fields that were sent; updates: key, and per field the value and a flag sent_<field>.

    A sent null overwrites. updated_at is renewed on rows that an update names and stays on all others; a table without
    it has created_at there.
    """
    renamed = updates.select(F.col(key).alias("u_key"), *[F.col(f).alias(f"u_{f}") for f in fields], *[F.col(f"sent_{f}") for f in fields])
    joined = df.join(renamed, F.col(key) == F.col("u_key"), "left")
    out = {f: F.when(F.col(f"sent_{f}"), F.col(f"u_{f}")).otherwise(F.col(f)) for f in fields}
    out["updated_at"] = F.when(F.col("u_key").isNotNull(), F.to_timestamp(F.lit(now))).otherwise(F.col("updated_at" if "updated_at" in df.columns else "created_at"))
    return joined.withColumns(out).drop("u_key", *[f"u_{f}" for f in fields], *[f"sent_{f}" for f in fields])


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def update_stored(store: VersionedStore, table: str, updates: DataFrame, key: str, fields: list[str], now: str) -> int:
    """update_partial() on a stored table: the partitions of the updated keys are rewritten. The new version."""
    return store.change({table: (updates, lambda old: update_partial(old, updates, key, fields, now).select(*old.columns))})


def delete_stored(store: VersionedStore, table: str, ids: DataFrame, key: str) -> int:
    """delete() on a stored table. The new version."""
    return store.change({table: (ids, lambda old: delete(old, ids, key))}, spread=False)


def purge_stored(store: VersionedStore, tables: list[str], ids: DataFrame, key: str = "document_id") -> int:
    """Takes the documents in ids out of all these tables in one version: all of them or, if the job is lost, none."""
    return store.change({name: (ids, lambda old: delete(old, ids, key)) for name in tables}, spread=False)


def purge_counts(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> DataFrame:
    """table_name, removed, remaining of every table when the documents in ids go from all of them."""
    gone = ids.select(key).distinct().withColumn("gone", F.lit(True))
    out = None
    for name, df in tables.items():
        counts = df.join(gone, key, "left").agg(
            F.count_if(F.col("gone").isNotNull()).alias("removed"), F.count_if(F.col("gone").isNull()).alias("remaining")
        ).select(F.lit(name).alias("table_name"), "removed", "remaining")
        out = counts if out is None else out.unionByName(counts)
    return out


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def job_progress(items: DataFrame) -> DataFrame:
    """total, processed, failed, share and days of each job out of its items."""
    return items.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if("processed").alias("processed"),
        F.count_if("failed").alias("failed"),
        F.round(F.count_if("processed") / F.count("*"), 4).alias("share"),
        F.datediff(F.max("finished_at"), F.min("finished_at")).cast("long").alias("days"),
    )


def tag_names(df: DataFrame, id_column: str, tags: str, names: DataFrame) -> DataFrame:
    """id, pos, code, name of every comma-separated tag; names: code, name; unknown codes are 'Unknown'."""
    codes = df.select(id_column, F.posexplode(F.split(tags, ",")).alias("pos", "code")).where(F.col("code") != "")
    return codes.join(names, "code", "left").select(
        id_column, F.col("pos").cast("long").alias("pos"), "code", F.coalesce("name", F.lit("Unknown")).alias("name")
    )
