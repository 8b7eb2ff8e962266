"""Sentences move once on their way through the memory and back to their units."""

import uuid

import pytest
from pyspark.sql import functions as F

from foliant.operators import inference, memory, text
from foliant.plans import views

PAIR = ["s", "t"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def units(spark):
    """Forty units of up to five sentences, many alike, in two languages, some empty or but an address."""
    texts = ["often", "see https://a.org/x now", "a.b@c.org", "12", "", "two words", "Three more words."]
    rows = [(u, pos, ("en", "fr")[u % 2], "id", texts[(u * 3 + pos) % len(texts)] if pos else f"own {u % 11}") for u in range(40) for pos in range(u % 6)]
    return spark.createDataFrame(rows, "u long, pos long, s string, t string, text string").repartition(3)


@pytest.mark.parametrize("frequent, batch", [(1_000, 10_000), (5, 10_000), (1_000, 3)])
def test_units_are_translated_back_with_one_move_of_sentences(spark, monkeypatch, units, frequent, batch):
    monkeypatch.setattr(memory, "FREQUENT", frequent)
    calls, longest = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(texts, source, target):
        calls.add(len(texts))
        longest.add(len(texts) > 4)
        assert len(set(texts)) == len(texts) and not any("://" in x for x in texts)
        return [f"[{target}] {x}" for x in texts]

    unique = memory.unique_sentences(units, PAIR, ["u", "pos"])
    want = memory.join_back(units, inference.translate_batches(memory.length_sorted_batches(unique, PAIR, ["text"]), PAIR).join(unique, [*PAIR, "text"]), PAIR, ["u"])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        found = memory.translate_units(units, PAIR, ["u"], counting, 4)
        rows = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set(name, before)
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) == 33
    # a sentence goes to the backend once, but for addresses alone and numbers, however its rows are cut; frequent ones are among them
    assert calls.value == unique.where("text NOT IN ('12', 'a.b@c.org')").count() and longest.value == 0
    moved = [x for x in plan(found).split("Initial Plan")[0].split("\n") if "Exchange hashpartitioning" in x]
    assert len(moved) == 2 and sum("text" in x.split("Exchange")[1] for x in moved) == 1


def test_a_stored_list_of_sentences_and_the_memory_meet_without_a_move(spark, units, tmp_path):
    table = memory.stored_memory(spark, f"memory_{uuid.uuid4().hex}", f"file://{tmp_path}/memory", PAIR)
    own = memory.stored_unique(spark, f"unique_{uuid.uuid4().hex}", f"file://{tmp_path}/unique", memory.unique_sentences(units, PAIR, ["u", "pos"]), PAIR)
    memory.remember(table, units.where("text = 'often'").selectExpr("*", "'known' AS translated", "u AS id"), PAIR, 1)
    found = memory.translate_through(own, table, PAIR, 2)
    assert "Exchange" not in plan(found)
    rows = {(r["s"], r["text"]): (r["translated"], r["hit"], r["occurrences"]) for r in found.collect()}
    counts = {(r["s"], r["text"]): r["count"] for r in units.where("text <> ''").groupBy("s", "text").count().collect()}
    assert {k: x[2] for k, x in rows.items()} == counts and rows[("en", "often")][:2] == ("known", True) and rows[("fr", "two words")][:2] == ("[id] two words", False)
    files = spark.table(table.name).where("version = 2").select(F.input_file_name().alias("f")).distinct()
    buckets = [r["f"].split("_")[-1].split(".")[0] for r in files.collect()]
    assert len(buckets) == len(set(buckets))


def test_a_backend_must_answer_every_text(spark, units):
    with pytest.raises(Exception, match="zip"):
        memory.translate_units(units, PAIR, ["u"], lambda texts, source, target: texts[1:]).collect()


def test_lines_are_keyed_within_their_row(spark):
    docs = spark.createDataFrame([("a", "One\n\n12\nTwo 3\n"), ("b", None), ("c", "...\n"), ("d", "é")], "document_id string, text string")
    units = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = text.keyed_lines(docs, ["document_id"], "text")
    want = text.assign_segment_keys(units, "document_id", "pos", "line").select("document_id", "ord", "key", "line")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) == [("a", 0, "para_0", "One"), ("a", 1, "para_1", "Two 3"), ("d", 0, "para_0", "é")]
    assert "Exchange" not in plan(found) and "Exchange" not in plan(views.segments(spark, "/root/testdata/sf0.001"))
