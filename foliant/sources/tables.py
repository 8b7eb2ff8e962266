"""Reading, appending and exporting record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schemas of the record tables.
SCHEMAS = {
    "translation_records": "id long, source_text string, translated_text string, source_language string, target_language string, "
    "emotion_tags string, voice_tags string, model_name string, created_at timestamp, updated_at timestamp",
    "translation_jobs": "id long, job_id string, status string, total_records int, processed_records int, failed_records int, "
    "error_message string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "translated_documents": "id long, document_id string, file_name string, file_size long, document_type string, source_language string, target_language string, "
    "emotion_tags string, voice_tags string, status string, created_at timestamp, updated_at timestamp, content binary",
    "segments": "document_id string, ord long, key string, source_text string, translated_text string, style string, runs array<string>",
    "insertions": "document_id string, ord long, type string, after long, kind string, src string",
    "media": "document_id string, name string, content_type string, data binary",
}

#: Field checks of a new translation record: least and most characters.
RECORD_LENGTHS = {
    "source_text": (1, None), "translated_text": (1, None), "source_language": (2, 10), "target_language": (2, 10), "model_name": (0, 255),
    "emotion_tags": (0, 255), "voice_tags": (0, 255),
}
OPTIONAL = ("emotion_tags", "voice_tags")


def read_records(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """A record table by its fixed schema; fmt is any file source."""
    return spark.read.schema(SCHEMAS[kind]).format(fmt).load(path)


def by_pair(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df in ranges of language pair and id, sorted within, so that a filter on the pair skips most files and row groups.

    A frequent pair spreads over several ranges, as the id is part of them.
    """
    order = ["source_language", "target_language", "id"]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def read_records_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A live store's table, read in ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts)


#: Field checks, numbers that must be positive, and defaults of a new job.
JOB_LENGTHS = {"job_id": (0, 50)}
JOB_POSITIVE = ("total_records",)
JOB_DEFAULTS = {"status": "pending", "processed_records": 0, "failed_records": 0}


def checked(df: DataFrame, lengths: dict[str, tuple[int, int | None]], positive: tuple[str, ...] = (), optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """df with `reject`: the first field whose length is out of bounds, that isn't positive, or that is null though it must not be, or null."""
    tests: list[Column] = []
    for name, (least, most) in lengths.items():
        n = F.length(name)
        bad = (n < least) | (F.lit(False) if most is None else n > most)
        tests.append(F.when((F.col(name).isNull() & F.lit(name not in optional)) | bad, F.lit(name)))
    tests += [F.when(F.coalesce(F.col(name) <= 0, F.lit(True)), F.lit(name)) for name in positive]
    return df.withColumn("reject", F.coalesce(*tests))


def with_defaults(df: DataFrame, defaults: dict[str, str | int]) -> DataFrame:
    """df with these columns, the default where a value is null or the column is missing."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(x)) if n in df.columns else F.lit(x) for n, x in defaults.items()})


def append(df: DataFrame, path: str, rejects: str, lengths: dict[str, tuple[int, int | None]], positive: tuple[str, ...] = (), defaults: dict | None = None) -> None:
    """Rows that pass go to path, the others with their reason to rejects."""
    out = checked(with_defaults(df, defaults or {}), lengths, positive)
    out.where("reject IS NULL").drop("reject").write.mode("append").parquet(path)
    out.where("reject IS NOT NULL").write.mode("append").parquet(rejects)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes within values are doubled."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def csv_line(*columns: Column) -> Column:
    """A CSV line: values with a quote, comma or line break are quoted, quotes doubled."""
    quoted = [
        F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns
    ]
    return F.concat_ws(",", *quoted)
