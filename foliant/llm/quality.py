"""Quality rules with risk-controlled cutoffs: Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import sent_if_small, written

#: White space between words, as a Java character class.
_SPACE = r"\x20\x09-\x0D"
#: Texts with fewer words, or with more than this percentage of words in repeated windows, fail whatever the labels say.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Share of good documents that the cutoff of a stratum may reject, and the chance that any stratum's bound is wrong.
FALSE_REJECTION = 0.02
ERROR = 0.05
#: Cutoffs tried, as multiples of what all but a few good documents of the stratum reach.
MULTIPLES = (1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 4.0)
USUAL_SHARE = 0.995
#: Scores are ranked within so many buckets a unit, the scores from MOST_RANKED up within one.
BUCKETS = 4096
MOST_RANKED = 16.0
#: What is counted of every text.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "marks")
#: Terms of a binomial sum that are listed at once.
TERMS = 4096
#: Scores of which higher is worse, and the least value that a stratum's usual score counts as.
SCORES = {"symbols_per_word": 0.02, "upper_share": 0.02, "marks_per_word": 0.05, "dup_line_share": 0.05, "repeat_share": 0.05}


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator keeps them out of later expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _has(sorted_values: Column, x: Column) -> Column:
    """Whether x is in an ascending array: a scan of short arrays, a binary search of long ones."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_values))).cast("int") + 1)
    ends = F.struct(F.lit(1).alias("lo"), F.size(sorted_values).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        low = F.element_at(sorted_values, middle) < x
        return F.struct(F.when(low, F.least(middle + 1, at["hi"])).otherwise(at["lo"]).alias("lo"), F.when(low, at["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(steps, ends, halve, lambda at: F.element_at(sorted_values, at["lo"]) == x)
    return F.when(F.size(sorted_values) <= 16, F.array_contains(sorted_values, x)).otherwise(found)


def quality_signals(docs: DataFrame) -> DataFrame:
    """docs' columns but text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, marks (long).

    Columns of docs with one of these names are left out. A null text has no words. Windows of three words are told apart by 64-bit hashes. Every step stays in the row, so
    neither a hot source nor a long text gathers anything; the cost of a text of n words is about n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    count = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")
    kept = [c for c in docs.columns if c not in ("text", *SIGNALS)]
    one = _once(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("q_none")]).alias("q_kept"), "text"),
        q_words=words,
        q_lines=lines,
        n_symbols=count("#*$%&|<>"),
        upper=count("A-Z"),
        marks=count("!?"),
    ).drop("text")
    one = _once(
        one.withColumn("n_words", F.size("q_words").cast("long")),
        word_chars=F.length(F.array_join("q_words", "")).cast("long"),
        n_dup_lines=(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        q_windows=F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("q_words") - 2, F.lit(1))),
                lambda i: F.xxhash64(F.get("q_words", i - 1), F.get("q_words", i), F.get("q_words", i + 1)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("q_words", "q_lines")
    one = _once(one, q_sorted=F.sort_array("q_windows"))
    one = _once(one, q_twice=F.array_distinct(F.filter("q_sorted", lambda x, i: (i > 0) & (x == F.get("q_sorted", i - 1))))).drop("q_sorted")
    starts = F.filter(F.transform("q_windows", lambda x, i: F.when(_has(F.col("q_twice"), x), i)), lambda i: i.isNotNull())
    one = _once(one, q_starts=F.when(F.size("q_twice") > 0, starts).otherwise(F.array().cast("array<int>"))).drop("q_windows", "q_twice")
    # a window covers three words, less those that the window before it covers
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("q_starts", none, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return one.withColumn("n_repeat_words", covered).select(*[F.col("q_kept").getField(c).alias(c) for c in kept], *SIGNALS)


def _scores() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("upper") / chars,
        "marks_per_word": F.col("marks") / words,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def at_most(k: Column, n: Column, p: float) -> Column:
    """The chance of k or fewer hits in n trials of chance p: the sum of the exact binomial terms."""
    first = F.struct((n * F.log(F.lit(1.0 - p))).alias("term"), F.exp(n * F.log(F.lit(1.0 - p))).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i * F.lit(p / (1 - p)))
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    def add_block(a: Column, b: Column) -> Column:
        return F.aggregate(F.sequence(b, F.least(k, b + TERMS - 1)), a, add)

    blocks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k, F.lit(TERMS).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.aggregate(blocks, first, add_block, lambda a: a["sum"]))


def usual_values(rows: DataFrame) -> DataFrame:
    """stratum, usual_<score>: the exact USUAL_SHARE percentile of all rows, interpolated, or the score's least value.

    Equal values are counted before they are ranked: first by buckets of values, then within the buckets of the rank.
    """
    each = rows.select("stratum", F.inline(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("value")) for n in SCORES])))
    counts = written(each.groupBy("stratum", "score", "value").agg(F.count("*").alias("n")), "score-counts")
    counts = counts.withColumn("bucket", F.floor(F.least("value", F.lit(MOST_RANKED)) * BUCKETS).cast("long"))
    own = Window.partitionBy("stratum", "score")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("stratum", "score", "bucket").agg(F.sum("n").alias("held")).select(
        "*", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), (F.sum("held").over(own) - 1).alias("last")
    )
    sums = sums.withColumn("position", F.col("last") * F.lit(USUAL_SHARE)).withColumns({"low": F.floor("position"), "high": F.ceil("position")})
    sums = sums.where("before <= high AND before + held > low").drop("held", "last")
    within = Window.partitionBy("stratum", "score", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(sums, ["stratum", "score", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("at") <= F.col(rank)) & (F.col("at") + F.col("n") > F.col(rank)), F.col("value")))
    found = ranked.groupBy("stratum", "score", "position", "low", "high").agg(at("low").alias("x"), at("high").alias("y"))
    between = (F.col("high") - F.col("position")) * F.col("x") + (F.col("position") - F.col("low")) * F.col("y")
    found = found.withColumn("value", F.when((F.col("low") == F.col("high")) | (F.col("x") == F.col("y")), F.col("x")).otherwise(between))
    return found.groupBy("stratum").agg(
        *[F.greatest(F.max(F.when(F.col("score") == n, F.col("value"))), F.lit(least)).alias(f"usual_{n}") for n, least in SCORES.items()]
    )


def cutoffs(signals: DataFrame, labels: DataFrame, stratum: str = "lang", false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """stratum, the usual_<score>s, cutoff (null where no cutoff is safe) per stratum.

    All good documents (label quality 1; the worst of several labels counts) are halved by a hash. One half gives each
    score's usual value; a document's badness is its highest score as a multiple of that. On the other half every
    multiple is tested: it is safe if as few rejections as were seen would be a rare event at a rejection rate of
    `false_rejection`, by the exact binomial, at a level of `error` shared among all strata. Within a stratum multiples
    are tested in a fixed order, the largest first, until one is not safe, so that each may take the whole level. The
    last safe one is the cutoff. Strata are joined as one row each, which is broadcast while they are few.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("good_id"))
    rows = signals.where(~base_failed()).join(good, F.col("doc_id") == F.col("good_id")).select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64("doc_id").alias("h"), *[c.alias(n) for n, c in _scores().items()]
    )
    rows = written(rows, "labelled")
    half = F.pmod(F.shiftright("h", 20), F.lit(2))
    usual = written(usual_values(rows.where(half == 0)), "usual-values")
    tested = (
        rows.where(half == 1)
        .join(sent_if_small(usual), "stratum")
        .withColumn("badness", badness())
        .groupBy("stratum")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("badness") > m).alias(f"k{i}") for i, m in enumerate(MULTIPLES)])
    )
    level = error / max(1, rows.select("stratum").distinct().count())
    safe = [at_most(F.col(f"k{i}"), F.col("n"), false_rejection) <= level for i in range(len(MULTIPLES))]
    tested = tested.select("stratum", F.array(*safe).alias("safe"))
    # the lowest multiple that is safe with all above it
    first = F.coalesce(*[F.when(F.forall(F.slice("safe", i + 1, len(MULTIPLES)), lambda x: x), F.lit(m)) for i, m in enumerate(MULTIPLES)])
    return usual.join(tested.select("stratum", first.alias("cutoff")), "stratum", "left")


def badness() -> Column:
    return F.greatest(*[F.col(n) / F.col(f"usual_{n}") for n in SCORES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the stratum, `others`, the signals, badness, cutoff, base_failed, and kept: neither failed nor beyond the
    cutoff.

    docs: doc_id, text, the stratum's column and others; labels: doc_id, quality (0 or 1). A stratum (null: one of its own)
    without enough labelled documents for a safe cutoff rejects by the base rules alone; so does an empty table of
    labels. Rows come out as often as they come in, each with its verdict; no text is shuffled.
    """
    signals = written(quality_signals(docs.select(*dict.fromkeys(("doc_id", stratum, *others)), "text")), "signals")
    named = signals.withColumn("q_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    found = written(cutoffs(signals, labels, stratum).withColumnRenamed("stratum", "q_stratum"), "cutoffs")
    scored = named.join(sent_if_small(found), "q_stratum", "left")
    for n, c in _scores().items():
        scored = scored.withColumn(n, c)
    scored = scored.withColumns({"badness": badness(), "base_failed": base_failed()})
    kept = ~F.col("base_failed") & F.coalesce(F.col("badness") <= F.col("cutoff"), F.lit(True))
    return scored.withColumn("kept", kept).drop("q_stratum", *[f"usual_{n}" for n in SCORES])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs' rows, all columns, that quality_verdicts() keeps."""
    rows = docs.select("doc_id", stratum, "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"))
    kept = quality_verdicts(rows, labels, stratum, ("q_row",)).where("kept")
    return kept.select(*[F.col("q_row").getField(c).alias(c) for c in docs.columns])
