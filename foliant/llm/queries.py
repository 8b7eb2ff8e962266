"""Queries of this subpackage: each applies its operator to whole tables; SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, hmm, langid, lexical, packing, phrases, pieces, quality, simhash, substrings, tokens, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0).select("vec_id"))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.orc_token_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_piece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness", "cutoff")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted_digests(rows.unionByName(more))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Terms of a text, and its words of pieces, as SQL has them.
_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_PIECES = "unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk_search, op2_orc_tokens, op3_piece_n_best, op4_hmm_scores, op5_ordinal_toxicity, op6_quality_rules, op7_simhash_dedup, op8_suffix_dedup, op9_bestfit_packing, op10_chat_format, op11_phrase_collocations, op12_lexical_search, op13_language_id, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_phrase_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, {_PIECES} AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        grams AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM places),
        f1 AS (SELECT lang, x, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
        f2 AS (SELECT lang, x, y, CAST(count(*) AS HUGEINT) AS f FROM grams WHERE y IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, x, y, z, CAST(count(*) AS HUGEINT) AS f FROM grams WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
        twos AS (
            SELECT p.lang, p.x, p.y, p.f AS a, b.f AS l, c.f AS r, 1000000 * p.f * p.f // (b.f * c.f) AS score
            FROM f2 p JOIN f1 b ON b.lang = p.lang AND b.x = p.x JOIN f1 c ON c.lang = p.lang AND c.x = p.y WHERE p.f >= 10
        ), cuts AS (
            SELECT t.lang, t.x, t.y, t.z, t.f AS a, b.f AS l1, c.f AS r1, 1000000 * t.f * t.f // (b.f * c.f) AS s1,
                d.f AS l2, e.f AS r2, 1000000 * t.f * t.f // (d.f * e.f) AS s2
            FROM f3 t JOIN f1 b ON b.lang = t.lang AND b.x = t.x JOIN f2 c ON c.lang = t.lang AND c.x = t.y AND c.y = t.z
            JOIN f2 d ON d.lang = t.lang AND d.x = t.x AND d.y = t.y JOIN f1 e ON e.lang = t.lang AND e.x = t.z
        ), longer AS (
            SELECT lang, x, y, max(f) AS g FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
        ), alive AS (
            SELECT lang, x || ' ' || y || ' ' || z AS phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM cuts
            UNION ALL SELECT t.lang, t.x || ' ' || t.y, a, l, r, score FROM twos t LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y
            WHERE g.g IS NULL OR 100 * g.g < 50 * a
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alive)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT CAST(count_if(len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY ALL),
        p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
        i AS (SELECT p.k, p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS impact FROM p JOIN w USING (term), s),
        r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, k, doc_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
    """,
}
