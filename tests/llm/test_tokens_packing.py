import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from foliant.llm import packing, tokens
from foliant.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_memory_gives_the_librarys_ids(reference):
    texts = ["a   b", " x y", "a \n b", "\n", "q  ", "é　 z", "", " ", "a\n  b c d Ġ aĠ", "\x1c a \x1d b", "b\n", "b\n c", "x<|endoftext|> y", "a <|endoftext|>", "a  <|endoftext|>b <|endoftext|> <|endoftext|>", "don't stop 12 34", "a b"] * 2
    enc = tokens.WordEncoder(PATH, remembered=3)
    assert enc.encode_all(texts) == [array("I", reference(t)).tobytes() for t in texts]


def test_orc_digests(docs, rows, reference):
    found = {r["doc_id"]: r for r in tokens.orc_token_digests(docs, PATH).collect()}
    start = 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*reference(text), 0]
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_orc_files_ascend_and_prune(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokens.write_token_files(docs, path, PATH)
    back = tokens.read_token_files(spark, path)
    ids = [r["doc_id"] for r in back.orderBy("part", "pos").collect()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert back.where("doc_id = 7").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in back.where("doc_id = 7")._jdf.queryExecution().toString()


def test_items_over_half_a_sequence_and_many_rounds(spark, monkeypatch):
    """Every piece is placed once, without overlap, however many rounds and tasks there are."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    monkeypatch.setattr(packing, "ITEMS_WORTH_A_TASK", 10)
    for sizes in ([600 + i % 50 for i in range(500)], [1 + 37 * i % 1023 for i in range(700)], [1] * 300, []):
        pieces = spark.createDataFrame(list(enumerate(sizes)), "row_key long, length long")
        found = packing.pack_pieces(pieces).collect()
        assert sorted(r["row_key"] for r in found) == list(range(len(sizes)))
        by = {}
        for r in found:
            by.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["row_key"]]))
        for rows in by.values():
            at = 0
            for offset, size in sorted(rows):
                assert offset == at
                at += size
            assert at <= 1024
        assert len(by) <= 1.35 * max(-(-sum(sizes) // 1024), sum(2 * x > 1024 for x in sizes)) + 1


def test_repeated_rows_and_empty_table(docs, empty):
    twice = docs.unionByName(docs)
    found = tokens.orc_token_digests(twice, PATH)
    assert found.count() == 2 * docs.count() and found.select("start").distinct().count() == found.count()
    assert tokens.orc_token_digests(empty, PATH).count() == 0


def test_packing_holds_every_token_once(docs, rows, reference):
    found = packing.pack_documents(docs, PATH).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids, at = [*reference(text), 2], 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            assert n == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_in_rounds_is_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 300)
    items = spark.range(3000).select(F.col("id").alias("row_key"), (1 + F.col("id") * 7919 % 900).alias("length"))
    found = packing.pack_pieces(items).join(items, "row_key")
    assert found.count() == 3000
    total = items.agg(F.sum("length")).first()[0]
    assert found.select("sequence_id").distinct().count() <= 1.02 * total / 1024 + 1


def test_packing_empty_and_repeated(docs, empty):
    assert packing.pack_documents(empty, PATH).count() == 0
    assert packing.pack_documents(docs.unionByName(docs), PATH).count() == 2 * packing.pack_documents(docs, PATH).count()


def test_orc_stripes_have_indexes_and_filters_that_skip_rows(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('a b c ', id) AS text")  # odd ids lie within the files' ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_token_files(docs, path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    stripes = 0
    for file in sorted((tmp_path / "tokens").glob("part-*.orc")):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{file}"), orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            kinds = [(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()]
            assert ("ROW_INDEX", 1) in kinds and ("BLOOM_FILTER_UTF8", 1) in kinds  # column 1 is doc_id
            assert footer.getColumns(1).getKind().toString() == "DIRECT_V2"  # run lengths
        rows.close()
        reader.close()
    assert stripes >= 4

    def scanned(value):
        """Rows that the scan hands on for one id, and those that are left."""
        df = tokens.read_token_files(spark, path).where(F.col("doc_id") == value)
        left, plan = df.collect(), df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value(), len(left)

    rows, left = scanned(20_000)
    assert left == 1 and rows <= 1000  # one group of rows of one file
    found = [scanned(i) for i in (1001, 15_001, 22_223, 39_001)]
    assert all(left == 0 for _, left in found) and sum(rows == 0 for rows, _ in found) >= 3  # the filters know that these ids aren't there


def test_packing_ends_when_no_two_sequences_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 50)
    for lengths in ([600] * 400 + [424] * 3 + [1], [700] * 300, [513] * 200 + [511] * 9, [900] * 250 + [100] * 130 + [24] * 2):
        items = spark.createDataFrame(list(enumerate(lengths)), "row_key long, length long")
        sums = [r["n"] for r in packing.pack_pieces(items).join(items, "row_key").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        assert sum(sums) == sum(lengths) and max(sums) <= 1024
        least = sorted(sums)[:2]
        # bins nearly full are emitted at once; no other two could be one
        assert sum(least) > 1024
