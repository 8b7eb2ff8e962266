"""Rules on literal rows."""

from pyspark.sql import functions as F

from foliant.operators import edits, files, layout, memory, records, text
from foliant.sources import tables


def test_placement_order(spark):
    body = spark.createDataFrame([("d", 0), ("d", 1)], "document_id string, ord long")
    blocks = spark.createDataFrame([("d", 0, -1), ("d", 1, 0), ("d", 2, 0), ("d", 3, 1), ("d", 4, 9)], "document_id string, ord long, after long")
    placed = edits.place_insertions(body, blocks).orderBy("place").collect()
    assert [(r["is_insert"], r["ord"]) for r in placed] == [(1, 0), (0, 0), (1, 1), (1, 2), (0, 1), (1, 3), (1, 4)]


def test_numbered_lists_restart(spark):
    rows = [("d", 0, "numbered", 0), ("d", 1, "numbered", 0), ("d", 2, "numbered", 1), ("d", 3, "bullet", 1)]
    found = edits.numbered_runs(spark.createDataFrame(rows, "document_id string, ord long, kind string, after long")).orderBy("ord").collect()
    assert [r["list_id"] for r in found] == [1, 1, 2, None]


def test_runs_join_to_text(spark):
    df = spark.createDataFrame([("ab", ["a", "b"], ""), ("ab", ["a"], "x"), ("ab", None, None), (None, ["a"], None)], "text string, runs array<string>, style string")
    assert [(r["valid"], r["style"]) for r in edits.normalize_edits(df).collect()] == [(True, None), (False, "x"), (True, None), (False, None)]


def test_sentences(spark):
    cases = ["Dr. Who came. He left! “Why?” No. 5 e.g. this", "一。二！三", "", "A. B. c", "End.  (Next) one"]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    found = {}
    for r in text.split_sentences(df, ["id"], "t").orderBy("id", "pos").collect():
        found.setdefault(r["id"], []).append(r["text"])
    assert found == {
        0: ["Dr. Who came.", "He left!", "“Why?” No. 5 e.g. this"], 1: ["一。", "二！", "三"], 3: ["A. B. c"], 4: ["End. (Next) one"],
    }


def test_chunks_concatenate_and_cut(spark):
    lines = [("d", i, "x" * n) for i, n in enumerate([3000, 999, 1, 9000, 10, 4000] + [3900] * 14)]
    df = spark.createDataFrame(lines, "d string, o long, t string")
    found = text.chunk_paragraphs(df, "d", "o", "t").orderBy("chunk").collect()
    # 3000 + 999 and a break fill a chunk but for one; 9000 is cut in three, of which the last takes the next ten
    assert [len(r["text"]) for r in found] == [4000, 1, 4000, 4000, 1011, 4000] + [3900] * 14
    assert "".join(r["text"] for r in found).replace("\n", "") == "".join(t for *_, t in lines)
    assert all(r["truncated"] and r["kept"] == (r["chunk"] < 12) for r in found)


def test_hyphens_wraps_bullets_markers(spark):
    lines = [("d", 0, "a co-"), ("d", 1, "operation of"), ("d", 2, "Semi-"), ("d", 3, "Final"), ("d", 4, "")]
    units = spark.createDataFrame(lines, "document_id string, pos long, line string")
    assert text.dehyphenate(units).first()["text"] == "a cooperation of Semi- Final"
    assert [r["line"] for r in text.merge_wrapped_lines(units).orderBy("pos").collect()] == ["a co- operation of", "Semi-", "Final", ""]
    answers = spark.createDataFrame([(1, "- one\n2) two\n- one\nplain"), (2, "plain line\nab\n plain line ")], "id long, t string")
    assert [r["points"] for r in text.parse_bullets(answers, "id", "t").orderBy("id").collect()] == [["one", "two"], ["plain line"]]
    marked = spark.createDataFrame([("1. x",), ("a) ",), ("• y z",), ("no",)], "t string")
    assert [r["stripped"] for r in text.strip_list_marker(marked, "t").collect()] == ["x", "a) ", "y z", "no"]


def test_urls_come_back(spark):
    cases = ["see https://a.org/x, and [1] b@c.de!", "[2] www.x.y", "none", "https://a.org https://a.org"]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    safe = text.protect_urls(df, "id", "t")
    assert [r["x"] for r in safe.orderBy("id").select(text.restore_urls(safe, "protected", "urls").alias("x")).collect()] == cases
    assert safe.where("id = 0").first()["protected"] == "see [2], and [1] [3]!"
    pairs = "array<struct<number: long, url: string>>"
    lost = spark.createDataFrame([("URL 1 ok", [(1, "u")]), ("[16] ok", [(1, "u")]), ("gone", [(1, "u"), (2, "w")])], f"t string, urls {pairs}")
    assert [r["x"] for r in lost.select(text.restore_urls(lost, "t", "urls").alias("x")).collect()] == ["u ok", "u ok", "gone u w"]


def test_contacts(spark):
    df = spark.createDataFrame([(1, "Mail A.B@c.org or a.b@C.org, call (021) 555-1234 not 2024-01-02, https://x.y/z.")], "id long, t string")
    assert sorted((r["field"], r["value"]) for r in text.extract_contacts(df, "id", "t").collect()) == [
        ("emails", "A.B@c.org"), ("phone_numbers", "(021) 555-1234"), ("urls", "https://x.y/z")
    ]


def test_uploads_names_conversions(spark):
    rows = [(1, 1, "a.PDF", 1, "ai_document"), (2, 1, "b.jpg", 10 * files.MB + 1, "image_tool"), (3, 1, "c.gif", 1, "image_tool"), (4, 1, "d.docx", 0, "ai_document"), (5, 1, "x/..", 5, "pdf_tool")]
    df = spark.createDataFrame(rows, "file_id long, request_id long, file_name string, size long, tool string")
    assert [r["outcome"] for r in files.validate_uploads(df).orderBy("file_id").collect()] == ["ok", "too_large", "unsupported", "empty", "unsupported"]
    assert [r["safe_stem"] for r in files.output_names(df).orderBy("file_id").collect()] == ["a", "b", "c", "d", "image"]
    pairs = [("png", "webp", "png"), ("jpeg", "webp", "JPG"), ("webp", "png", "webp"), ("webp", "jpeg", "webp"), ("png", "png", "png"), ("webp", "webp", "webp"), ("gif", "png", "gif"), ("png", "webp", "jpg")]
    images = spark.createDataFrame([(i, 10, 10, *p) for i, p in enumerate(pairs)], "image_id long, width long, height long, format string, target string, extension string")
    assert [r["outcome"] for r in files.conversion_support(images).orderBy("image_id").collect()] == ["ok"] * 4 + ["unsupported"] * 3 + ["extension_mismatch"]


def test_record_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], "id long, v string, c string").withColumn("created_at", F.to_timestamp("c"))
    sent = spark.createDataFrame([(1, None, True), (2, "z", False)], "id long, v string, sent_v boolean")
    assert [(r["v"], str(r["updated_at"])[:4]) for r in records.update_partial(df, sent, "id", ["v"], "2025-02-02").orderBy("id").collect()] == [(None, "2025"), ("b", "2025")]
    assert [r["id"] for r in records.delete(df, spark.createDataFrame([(1,)], "id long"), "id").collect()] == [2]
    assert records.search_text(df, "v", "%", escape=True).count() == 0 and records.search_text(df, "v", "%").count() == 2
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    tables.append(df.select("id", "v"), good, bad, {"v": (2, None)})
    assert spark.read.schema("id long, v string").parquet(good).count() == 0 and spark.read.parquet(bad).count() == 2


def test_exports_quote(spark, tmp_path):
    df = spark.createDataFrame([("emails", 'a "b", c'), ("urls", "d")], "field string, value string")
    tables.export_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    assert spark.read.text(f"file://{tmp_path}/csv").count() == 3
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert [r["x"] for r in df.select(tables.csv_line(F.col("field"), F.col("value")).alias("x")).collect()] == ['emails,"a ""b"", c"', "urls,d"]


def test_batches_are_a_permutation_by_length(spark):
    df = spark.createDataFrame([("en", "id", "x" * (i * 37 % 50 + 1) + str(i)) for i in range(200)], "s string, t string, text string")
    out = memory.length_sorted_batches(df, ["s", "t"], ["text"], 16).orderBy("batch", "place").collect()
    assert [(r["batch"], r["place"]) for r in out] == [(i // 16, i % 16) for i in range(200)]
    assert [len(r["text"]) for r in out] == sorted(len(r["text"]) for r in out)


def test_columns_and_spaces(spark):
    spans = spark.createDataFrame([("d", 0, 0, "Acme", 10.0, 0.0, 50.0), ("d", 0, 1, "Inc", 10.0, 55.0, 80.0), ("d", 0, 2, "2024", 10.0, 300.0, 340.0)],
                                  "document_id string, line long, span long, text string, size double, x0 double, x1 double")
    assert [(r["text"], r["right_aligned"]) for r in layout.split_line_columns(spans).orderBy("column").collect()] == [("Acme Inc", False), ("2024", True)]
    assert layout.restore_spaces(spans).first()["text"] == "Acme Inc 2024"
    rules = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 1.0), (2, 0.01, 0.0, 100.0, 1.0), (3, 0.0, 0.0, 10.0, 10.0), (4, 0.0, 0.0, 1.0, 0.0)],
                                  "shape_id long, x0 double, y0 double, x1 double, y1 double").selectExpr("'d' AS document_id", "0L AS page", "*")
    assert [r["shape_id"] for r in layout.filter_rules(rules).orderBy("shape_id").collect()] == [1, 4]


def test_long_rows_in_linear_time(spark):
    """Sixty thousand matches, JSON tokens, addresses or lines in one row."""
    import time

    n = 60_000
    one = spark.createDataFrame([(1, "the x " * n, '{"l": [' + ",".join(["1"] * n) + '], "token": {"a": [' + "[]," * 1000 + '1]}, "s": "' + "y\\\\" * 20_000 + '"}', "see a@b.cd [2] " * (n // 3))], "id long, t string, j string, u string")
    started = time.time()
    found = text.find_matches(one, ["id"], "t", "the").agg(F.count("*"), F.sum("start")).first()
    assert tuple(found) == (n, sum(6 * i for i in range(n)))
    masked = one.select(text.mask_json(F.col("j")).alias("m")).first()["m"]
    assert masked.startswith('{"l": [1,1,') and '"token": "[REDACTED]", "s": "y' in masked
    safe = text.protect_urls(one, "id", "u").first()
    assert safe["protected"].startswith("see [1] [2] see [3] [2] see [4]") and len(safe["urls"]) == n // 3
    lines = spark.range(n).selectExpr("'d' AS document_id", "id AS pos", "'ab-' AS line")
    assert text.dehyphenate(lines).first()["text"] == "ab" * n + "-"
    assert text.chunk_paragraphs(lines, "document_id", "pos", "line").count() == n // 1000
    assert time.time() - started < 60


def test_case_is_folded(spark):
    rows = [(1, x) for x in ("Straße", "STRASSE", "strasse ", "ΣΑΣ", "σας", "ı", "I", "ẞ")]
    values = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(rows)], "k long, value string, pos long")
    assert sorted(r["value"] for r in text.dedupe_values(values, ["k"]).collect()) == sorted(["Straße", "ΣΑΣ", "ı", "I", "ẞ"])
    upper = spark.createDataFrame([(1, "İİ the THE")], "id long, t string")
    assert [(r["start"], r["end"]) for r in text.find_matches(upper, ["id"], "t", "the", case=False).collect()] == [(3, 6), (7, 10)]


def test_only_texts_of_answers_are_grounded(spark):
    answers = spark.createDataFrame([(1, 0, 'x {"people": [3, {"a": 1}, "bob", null, "STRASSE"], "dates": "no"} y', 'Bob 3 straße {"a": 1}'), (1, 1, '{"people": ["BOB", "eve"]}', "bob Eve")], "id long, n long, a string, c string")
    found = text.ground_values(answers, "id", "a", "c", order="n").collect()
    assert sorted((r["field"], r["value"], r["pos"]) for r in found) == [("people", "STRASSE", 4), ("people", "bob", 2), ("people", "eve", 2**32 + 1)]


def test_largest_sides(spark):
    images = spark.createDataFrame([(1, "png", "png", 4000, 1000, 800, 10, 20), (2, "png", "png", 10, 4000, 100, 10, 20), (3, "png", "png", 10, 20, None, 10, 20), (4, "png", "png", None, None, 5, 10, 5)],
                                   "image_id long, format string, target string, width long, height long, max_dimension long, original_size long, output_size long")
    assert [(r["out_width"], r["out_height"], r["outcome"]) for r in files.bounded_plan(images).orderBy("image_id").collect()] == [(800, 200, "ok"), (1, 100, "ok"), (10, 20, "ok"), (None, None, "unknown_size")]
    assert [r["kept_original"] for r in files.compression_savings(images).orderBy("image_id").collect()] == [False, False, True, False]
