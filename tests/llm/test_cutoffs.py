import math

from pyspark.sql import functions as F

from foliant.llm import quality


def tail(k, n, p):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    return math.fsum(math.exp(log(i)) for i in range(k + 1))


def test_all_labelled_rows_count(spark):
    """More labelled rows in one stratum than fit in a sample of 40,000: usual values and tests are those of all of them."""
    ids = spark.range(90_000).withColumn("z", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).cast("long"))
    signals = ids.select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "b").otherwise("a").alias("lang"), F.lit(100).cast("long").alias("n_words"), (500 + F.col("id") % 7).alias("word_chars"),
        (F.when(F.col("z") < 18, 40 + F.col("id") % 31).otherwise(F.col("z") % 3)).alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"),
        (F.col("id") % 11).alias("n_repeat_words"), F.when(F.col("z") > 994, 100 + F.col("id") % 201).otherwise(F.col("id") % 9).alias("upper"), (F.col("z") % 13).alias("marks"),
    )
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = signals.select(F.col("lang").alias("stratum"), F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(2)).alias("half"), *[c.alias(n) for n, c in quality._scores().items()])
    usual = rows.where("half = 0").groupBy("stratum").agg(*[F.greatest(F.percentile(n, F.lit(quality.USUAL_SHARE)), F.lit(x)).alias(f"usual_{n}") for n, x in quality.SCORES.items()])
    counts = rows.where("half = 1").join(usual, "stratum").withColumn("badness", quality.badness()).groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("badness") > m).alias(f"k{i}") for i, m in enumerate(quality.MULTIPLES)]
    )
    wanted = {r["stratum"]: {n: r[n] for n in usual.columns} for r in usual.collect()}
    level = quality.ERROR / 2
    for r in counts.collect():
        cutoff = None
        for i in reversed(range(len(quality.MULTIPLES))):
            if tail(r[f"k{i}"], r["n"], quality.FALSE_REJECTION) > level:
                break
            cutoff = quality.MULTIPLES[i]
        wanted[r["stratum"]]["cutoff"] = cutoff
    found = {r["stratum"]: r.asDict() for r in quality.cutoffs(signals, labels).collect()}
    assert found == wanted


def test_long_binomial_sums(spark):
    for k, n in ((4095, 200_000), (4096, 210_000), (9000, 460_000)):
        got = spark.range(1).select(quality.at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02).alias("x")).first()["x"]
        assert abs(got - tail(k, n, 0.02)) < 1e-9
