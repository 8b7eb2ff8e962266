"""Reads of record tables: from a live database in ranges, and from files of which filters skip most."""

import uuid

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliant.operators import files
from foliant.sources import heads, tables


def test_a_database_is_read_in_ranges(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(1000).selectExpr("id", "concat('job_', id) AS job_id", "CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status")
    rows.write.option("createTableColumnTypes", "job_id VARCHAR(50), status VARCHAR(20)").jdbc(url, "jobs", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    found = tables.read_records_jdbc(spark, url, "jobs", "id", 0, 1000, 5)
    found = found.toDF(*[c.lower() for c in found.columns])
    assert found.rdd.getNumPartitions() == 5
    spread = found.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in spread) == [200] * 5
    assert sorted(map(tuple, found.where("status = 'pending'").collect())) == sorted(map(tuple, rows.where("status = 'pending'").collect()))


def test_filters_on_a_pair_skip_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'en' WHEN id % 8 = 1 THEN 'fr' ELSE 'de' END AS source_language", "'id' AS target_language", "'t' AS source_text")
    tables.by_pair(rows, 8).write.parquet(f"file://{tmp_path}/records")
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "records").glob("part-*.parquet")]
    ends = [(g.column(1).statistics.min, g.column(1).statistics.max) for g in groups]
    assert len(ends) == 8 and sum(a <= "fr" <= b for a, b in ends) <= 2 and sum(a <= "en" <= b for a, b in ends) >= 3
    read = tables.read_records(spark, f"file://{tmp_path}/records", "translation_records").where("source_language = 'fr'")
    assert read.count() == 500 and "EqualTo(source_language,fr)" in read._jdf.queryExecution().executedPlan().toString()


def test_heads_of_files_alone_are_read(spark, tmp_path):
    png, webp = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rrest of it", b"RIFF\x00\x00\x00\x00WEBPmore"
    rows = [("a/one.png", png), ("a/b/two.JPG", b"\xff\xd8\xff\xe0"), ("three.webp", webp), ("cut.webp", webp[:9]), ("a/empty.png", None), ("wrong.jpeg", png), ("none", b"text")]
    folder = f"file://{tmp_path}/images"
    assert heads.write_files(spark.createDataFrame(rows, "path string, content binary"), folder) == 7
    (tmp_path / "images" / "a" / ".half-written.png").write_bytes(png)
    found = {r["path"].split("/images/")[1]: (r["length"], bytes(r["head"])) for r in heads.read_heads(spark, folder).collect()}
    assert found == {p: (len(c or b""), (c or b"")[:12]) for p, c in rows}
    assert heads.read_heads(spark, str(tmp_path / "images"), 3).agg(F.max(F.length("head"))).first()[0] == 3
    audit = sorted(tuple(r) for r in files.image_format_audit(spark, folder).collect())
    assert audit == [("", "none", 1), ("jpeg", "jpeg", 1), ("jpeg", "png", 1), ("png", "none", 1), ("png", "png", 1), ("webp", "none", 1), ("webp", "webp", 1)]


def test_no_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert heads.read_heads(spark, str(tmp_path / "empty")).count() == 0
    assert heads.write_files(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "none")) == 0


def test_page_numbers_of_any_length(spark):
    asked = spark.createDataFrame([(i, "x.pdf", r, 9, False) for i, r in enumerate(["1234567890", "1-99999999999999999999", "x", "2-3"])], "file_id long, file_name string, ranges string, pages int, single_file boolean")
    assert [r["reject"] for r in files.split_plan(asked).orderBy("file_id").collect()] == ["outside", "outside", "syntax", None]
