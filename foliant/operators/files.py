"""Rules over file and image inventories: upload checks, names, merge, split, resize and conversion plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.sources.heads import read_heads

MB = 1024 * 1024
# What each tool accepts and its size cap in MB.
TOOL_RULES = {"ai_document": (("pdf", "docx"), 5), "pdf_tool": (("pdf",), 10), "image_tool": (("jpeg", "png", "webp"), 10)}
MERGE_FILES = (2, 20)
MERGE_MB = 50
# Output sizes suggested for the web.
PRESETS = [("og", 1200, 630), ("square", 1080, 1080), ("story", 1080, 1920), ("hd", 1920, 1080), ("thumbnail", 400, 300)]
# Conversions between image formats, and limits in pixels.
CONVERSIONS = {"jpeg": ("webp", "png", "svg"), "png": ("webp", "svg"), "webp": ("png", "jpeg")}
MOST_SIDE, MOST_PIXELS, MOST_VECTOR_PIXELS = 10_000, 50_000_000, 25_000_000


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; without a dot nothing."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(name: Column, default: str = "document") -> Column:
    """What precedes the last dot, or the default where that is nothing."""
    cut = F.regexp_replace(name, "\\.[^.]*$", "")
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def validate_uploads(files: DataFrame) -> DataFrame:
    """file_id, extension, outcome: ok, or the first of unsupported type, too large and empty that applies."""
    ext = extension(F.col("file_name"))
    allowed, cap = F.lit(False), F.lit(None).cast("long")
    norm = ext
    for tool, (kinds, mb) in TOOL_RULES.items():
        is_tool = F.col("tool") == tool
        if "jpeg" in kinds:
            norm = F.when(is_tool & (ext == "jpg"), "jpeg").otherwise(norm)
        cap = F.when(is_tool, F.lit(mb * MB)).otherwise(cap)
    for tool, (kinds, _) in TOOL_RULES.items():
        allowed = allowed | ((F.col("tool") == tool) & norm.isin(*kinds))
    outcome = F.when(~allowed, "unsupported").when(F.col("size") > cap, "too_large").when(F.col("size") == 0, "empty").otherwise("ok")
    return files.select("file_id", norm.alias("extension"), outcome.alias("outcome"))


def output_names(files: DataFrame) -> DataFrame:
    """file_id, stem, safe_stem, collisions (files of the request with the same safe stem)."""
    base = F.substring_index(F.replace(F.col("file_name"), F.lit("\\"), F.lit("/")), "/", -1)
    safe = F.regexp_replace(F.regexp_replace(stem(base, "image"), "[\\x00-\\x1f\\x7f/\\\\]", "_"), "^[ .]+|[ .]+$", "")
    safe = F.substring(safe, 1, 120)
    named = files.select("file_id", "request_id", stem(F.col("file_name")).alias("stem"), F.when(safe == "", "image").otherwise(safe).alias("safe_stem"))
    return named.select("file_id", "stem", "safe_stem", F.count("*").over(Window.partitionBy("request_id", "safe_stem")).alias("collisions"))


def merge_plan(files: DataFrame) -> DataFrame:
    """request_id, n_files, bytes, outcome: the count is checked first, then the first file at which the sum is too much."""
    order = Window.partitionBy("request_id").orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = files.withColumn("running", F.sum("size").over(order))
    over = F.min(F.when(F.col("running") > MERGE_MB * MB, F.col("file_id")))
    out = summed.groupBy("request_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), over.alias("first_over"))
    count_ok = F.col("n_files").between(*MERGE_FILES)
    return out.withColumn("outcome", F.when(~count_ok, "bad_count").when(F.col("first_over").isNotNull(), "too_large").otherwise("ok"))


def split_plan(files: DataFrame) -> DataFrame:
    """file_id, part, first, last, name, output of every part that a split request gives; name is null in a single output.

    A request whose ranges can't be read, lie outside the document or are none at all is one row with its reject reason.
    """
    parts = F.filter(F.split("ranges", ","), lambda x: F.trim(x) != "")
    pattern = "^\\s*(\\d+)\\s*(?:-\\s*(\\d+)\\s*)?$"
    number = lambda x: F.when(x != "", F.coalesce(x.try_cast("long"), F.lit(2**63 - 1)))  # noqa: E731 - beyond 64 bits is outside as well

    def read(x: Column) -> Column:
        first = F.regexp_extract(x, pattern, 1)
        last = F.regexp_extract(x, pattern, 2)
        return F.struct(number(first).alias("first"), number(F.when(last == "", first).otherwise(last)).alias("last"))

    pages = F.transform(F.sequence(F.lit(1).cast("long"), F.col("pages")), lambda p: F.struct(p.alias("first"), p.alias("last")))
    asked = F.trim("ranges") != ""
    plan = files.withColumn("parts", F.when(asked, F.transform(parts, read)).otherwise(pages))
    outside = F.exists("parts", lambda x: (x["first"] < 1) | (x["last"] < x["first"]) | (x["last"] > F.col("pages")))
    reason = (
        F.when(F.exists("parts", lambda x: x["first"].isNull()), "syntax").when(outside, "outside").when(F.size("parts") == 0, "empty")
    )
    fine = F.col("reject").isNull()
    plan = plan.withColumn("reject", reason).withColumn("parts", F.when(fine, F.col("parts")))
    one = F.col("single_file") | (F.size("parts") == 1)
    rows = plan.select("file_id", "file_name", "reject", F.when(fine, F.when(one, "pdf").otherwise("zip")).alias("output"), F.posexplode_outer("parts").alias("part", "p"))
    label = F.when(F.col("p.first") == F.col("p.last"), F.col("p.first").cast("string")).otherwise(F.concat(F.col("p.first").cast("string"), F.lit("-"), F.col("p.last").cast("string")))
    name = F.when(F.col("output") == "zip", F.concat(stem(F.col("file_name")), F.lit("_pages_"), label, F.lit(".pdf")))
    return rows.select("file_id", F.col("part").cast("long").alias("part"), F.col("p.first").alias("first"), F.col("p.last").alias("last"), name.alias("name"), "output", "reject")


def resize_plan(images: DataFrame) -> DataFrame:
    """image_id, out_width, out_height, outcome: sizes by fit, or by the ratio where one side is asked for."""
    w, h, iw, ih = (F.col(c) for c in ("want_width", "want_height", "width", "height"))
    none = (F.coalesce(w, F.lit(0)) == 0) & (F.coalesce(h, F.lit(0)) == 0)
    bad = ((w < 1) | (w > MOST_SIDE)) | ((h < 1) | (h > MOST_SIDE))
    one_w, one_h = h.isNull(), w.isNull()
    half_even = lambda x: F.greatest(F.bround(x, 0).cast("long"), F.lit(1).cast("long"))
    ratio = iw / ih
    contain = F.col("fit") == "contain"
    wider = ratio > w / h
    out_w = F.when(one_h, half_even(h * ratio)).when(one_w, w).when(contain & ~wider, half_even(h * ratio)).otherwise(w)
    out_h = F.when(one_w, half_even(w / ratio)).when(one_h, h).when(contain & wider, half_even(w / ratio)).otherwise(h)
    outcome = F.when(none, "no_size").when(F.coalesce(bad, F.lit(False)), "bad_size").when(iw.isNull() | ih.isNull(), "unknown_size").otherwise("ok")
    ok = outcome == "ok"
    return images.select("image_id", F.when(ok, out_w).alias("out_width"), F.when(ok, out_h).alias("out_height"), outcome.alias("outcome"))


def bounded_plan(images: DataFrame) -> DataFrame:
    """image_id, format, outcome, out_width, out_height, saved_pixels: images of which a side exceeds max_dimension shrink to it
    by their ratio, a pixel at least; others, and those without a bound, keep their size."""
    most, w, h = F.col("max_dimension"), F.col("width"), F.col("height")
    side = lambda x: F.greatest(F.bround(x, 0).cast("long"), F.lit(1).cast("long"))
    larger = F.coalesce(F.greatest(w, h) > most, F.lit(False))
    out_w = F.when(~larger, w).when(w >= h, most).otherwise(side(w / h * most))
    out_h = F.when(~larger, h).when(h >= w, most).otherwise(side(h / w * most))
    outcome = F.when((most < 1) | (most > MOST_SIDE), "bad_size").when(w.isNull() | h.isNull(), "unknown_size").otherwise("ok")
    ok = outcome == "ok"
    return images.select(
        "image_id", "format", outcome.alias("outcome"), F.when(ok, out_w).alias("out_width"), F.when(ok, out_h).alias("out_height"), F.when(ok, w * h - out_w * out_h).otherwise(0).alias("saved_pixels")
    )


def pixels_by_format(images: DataFrame) -> DataFrame:
    """format, files, shrunk, saved_pixels of bounded_plan()."""
    return bounded_plan(images).groupBy("format").agg(F.count("*").alias("files"), F.count_if(F.col("saved_pixels") > 0).alias("shrunk"), F.sum("saved_pixels").alias("saved_pixels"))


def resolution_suggestions(images: DataFrame) -> DataFrame:
    """image_id, preset of every preset that the image exceeds on a side; unknown sizes keep all."""
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(w).alias("w"), F.lit(h).alias("h")) for n, w, h in PRESETS])
    unknown = (F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)
    return images.select("image_id", "width", "height", F.inline(presets)).where(unknown | (F.col("width") > F.col("w")) | (F.col("height") > F.col("h"))).select("image_id", "preset")


def conversion_support(images: DataFrame) -> DataFrame:
    """image_id, outcome: ok, or why the conversion to the target is refused."""
    ext = F.when(F.lower("extension") == "jpg", "jpeg").otherwise(F.lower("extension"))
    supported = F.lit(False)
    for source, targets in CONVERSIONS.items():
        supported = supported | ((F.col("format") == source) & F.col("target").isin(*targets))
    pixels = F.col("width") * F.col("height")
    outcome = (
        F.when((F.col("width") > MOST_SIDE) | (F.col("height") > MOST_SIDE), "too_wide")
        .when(pixels > MOST_PIXELS, "too_many_pixels")
        .when(ext != F.col("format"), "extension_mismatch")
        .when(~supported, "unsupported")
        .when((F.col("target") == "svg") & (pixels > MOST_VECTOR_PIXELS), "too_large_to_trace")
        .otherwise("ok")
    )
    return images.select("image_id", outcome.alias("outcome"))


def compression_savings(images: DataFrame) -> DataFrame:
    """image_id, format, kept_original, out_size, saved_percent (rounded half up): a result of the same format that isn't
    smaller is dropped for the original, unless a largest side was asked for (max_dimension); without an original size
    nothing is saved."""
    keep = (F.col("format") == F.col("target")) & (F.col("output_size") >= F.col("original_size"))
    if "max_dimension" in images.columns:
        keep = keep & (F.coalesce("max_dimension", F.lit(0)) == 0)
    own = images.select("image_id", "format", keep.alias("kept_original"), "original_size", F.when(keep, F.col("original_size")).otherwise(F.col("output_size")).alias("out_size"))
    saved = F.when(F.col("original_size") > 0, F.floor((1 - F.col("out_size") / F.col("original_size")) * 100 + 0.5)).otherwise(0).cast("long")
    return own.select("image_id", "format", "kept_original", "out_size", saved.alias("saved_percent"))


def savings_by_format(images: DataFrame) -> DataFrame:
    """format, files, kept_original, saved_bytes of compression_savings()."""
    own = compression_savings(images).join(images.select("image_id", "original_size"), "image_id")
    return own.groupBy("format").agg(F.count("*").alias("files"), F.count_if("kept_original").alias("kept_original"), F.sum(F.col("original_size") - F.col("out_size")).alias("saved_bytes"))


def image_kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes, else none."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise("none")
    )


def image_format_audit(spark: SparkSession, path: str) -> DataFrame:
    """extension, kind, files of the images in a folder: what their first bytes say against their names.

    Only heads are read. Files that are empty or cut off before their kind shows, and those of another kind, are `none`.
    """
    found = read_heads(spark, path)
    ext = extension(F.substring_index("path", "/", -1))
    return found.select(F.when(ext == "jpg", "jpeg").otherwise(ext).alias("extension"), image_kind(F.col("head")).alias("kind")).groupBy("extension", "kind").agg(F.count("*").alias("files"))
