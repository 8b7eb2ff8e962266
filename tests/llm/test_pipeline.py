import corpus_pipeline
from foliant.llm import queries


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns and 0 < out.count() <= before
        docs, before = out, out.count()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
