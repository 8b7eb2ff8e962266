from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import hmm, packing, pieces, quality, simhash, substrings, tokens, toxicity
from foliant.llm.queries import tokenizer_path

NAMES = ["k", "k2", "h", "c", "fp", "root", "rank", "ranges", "copy", "n_bytes", "toxic", "kept", "quality", "badness", "n_words", "ids", "part", "pos", "row_key", "length", "count", "others"]


def test_columns_that_clash(spark, docs):
    wide = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit("x").alias("text"))
    n = docs.count()
    assert substrings.remove_repeats(wide).where("n_bytes = 'n_bytes' AND k = 'k'").count() == n
    assert simhash.near_components(wide).count() == n
    assert simhash.keep_one_of_each(wide).columns == wide.columns
    assert quality.keep_good(wide, labels).columns == wide.columns
    assert toxicity.severity(wide, toxicity.train(wide, labels)).where("k = 'k'").count() == n
    assert hmm.score_documents(wide, 2, 1).count() == n
    assert tokens.orc_token_digests(wide, tokenizer_path("byte_bpe_50k.json")).count() == n
    assert packing.pack_documents(wide, tokenizer_path("byte_bpe_50k.json")).count() >= n
    assert pieces.piece_digests(wide, tokenizer_path("piece_bpe_32k.model")).count() == n


def test_stages_keep_columns_that_clash(spark, docs, monkeypatch):
    wide = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, sf).columns == wide.columns, name
        assert stage(spark, wide.limit(0), sf).count() == 0, name
