"""Operators that must not shuffle, sort or read twice what they can read within a row or in one pass: results and plans."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import edits, outline, text
from foliant.plans import catalog

RUNS = "runs array<struct<text: string, style: string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def units(spark):
    rows = [("d", 1, [("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "y"), ("f", "x")]), ("d", 0, [("g", "y")]), ("e", 0, []), ("f", 0, [("h", None)])]
    return spark.createDataFrame(rows, f"document_id string, ord long, {RUNS}")


def test_runs_are_coalesced_within_their_row(units):
    found = edits.coalesce_adjacent(units, ["document_id", "ord"])
    assert [tuple(r) for r in found.orderBy("document_id", "ord", "run").collect()] == [
        ("d", 0, 0, "y", "g"), ("d", 1, 0, "x", "a b"), ("d", 1, 1, None, "c d"), ("d", 1, 2, "y", "e"), ("d", 1, 3, "x", "f"), ("f", 0, 0, None, "h")
    ]
    assert "Exchange" not in plan(found) and "Aggregate" not in plan(found)


def test_styles_are_interned_without_a_sort_of_runs(units):
    found = edits.intern_styles(units)
    assert [tuple(r) for r in found.orderBy("document_id", "style_id").collect()] == [("d", "y", 0), ("d", "x", 1), ("d", None, 2), ("f", None, 0)]
    assert "SortAggregate" not in plan(found)


def test_spans_are_measured_within_their_row(spark):
    chars = [[(0.0, 4.0, 8.0), (4.0, 8.0, 8.0)], [(0.0, 4.0, 8.0)], [(0.0, 8.0, 8.0), (8.0, 16.0, 8.0)], [(0.0, 7.9, 8.0), (7.9, 15.9, 8.0)]]
    spans = spark.createDataFrame([("d", 0, i, c) for i, c in enumerate(chars)], "document_id string, line long, span long, chars array<struct<x0: double, x1: double, natural: double>>")
    found = outline.span_char_spacing(spans)
    assert [tuple(r) for r in found.orderBy("span").collect()] == [("d", 0, 0, -4.0), ("d", 0, 3, -0.05)]
    assert "Exchange" not in plan(found)


def test_styles_of_runs_are_grouped_by_numbers(spark):
    styles = spark.createDataFrame([("a", None, "f"), ("b", "a", None)], "style string, based_on string, font string")
    uses = spark.range(20).select(F.col("id").cast("string").alias("run"), F.lit(1).alias("layer"), F.when(F.col("id") % 2 == 0, "b").otherwise("gone").alias("style"))
    found = outline.resolve_styles(styles, uses, ["font"])
    assert {r["run"]: r["font"] for r in found.collect()} == {str(i): "f" if i % 2 == 0 else None for i in range(20)}
    assert "SortAggregate" not in plan(found)


def test_a_long_line_is_bridged_in_one_pass(spark):
    chars = spark.range(3000).selectExpr("'d' AS document_id", "0L AS line", "id AS ord", "CASE WHEN id % 3 = 1 THEN ' ' ELSE 'x' END AS text", "CASE WHEN id % 3 <> 1 THEN 'l' || (id DIV 6) END AS target")
    found = outline.bridge_link_spaces(chars)
    assert [r["target"] for r in found.orderBy("ord").collect()] == [f"l{i // 6}" for i in range(3000)]
    assert "unboundedfollowing" not in plan(found)


def test_a_chunk_is_folded_once(spark):
    answers = spark.createDataFrame([(1, '{"people": ["Ann", "BOB", "Cy"], "dates": ["ann"]}', "ann  and Bob")], "id long, a string, chunk_text string")
    found = text.ground_values(answers, "id", "a", "chunk_text")
    assert sorted((r["field"], r["value"]) for r in found.collect()) == [("dates", "ann"), ("people", "Ann"), ("people", "BOB")]
    above = plan(found).split("Generate inline")[0]
    assert "Generate posexplode" in above and "chunk_text" not in above


def test_spaces_are_bridged_within_their_row(spark):
    """The same as by windows over characters that are rows, without moving them."""
    lines = [
        [("a", "x"), (" ", None), ("b", "x"), ("  ", None), (" ", None), ("c", "y"), (" ", None), ("d", None), (" ", None), ("e", None)],
        [(" ", None), ("", None), ("a", "x"), (" ", "own"), (" ", None), (None, None), ("b", "x"), (" ", None)], [(" ", None), (" ", "z")], [("a", "x")], [(None, "x"), (" ", None), ("a", "x")], [],
    ]
    rows = [("d", i, [(j, t, target) for j, (t, target) in enumerate(x)]) for i, x in enumerate(lines)]
    own = spark.createDataFrame([*rows, ("d", 9, None)], "document_id string, line long, chars array<struct<ord: long, text: string, target: string>>")
    found = own.select("document_id", "line", F.inline(outline.bridged_spaces(F.col("chars"))))
    want = outline.bridge_link_spaces(own.select("document_id", "line", F.inline("chars")))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.select(found.columns).collect())) and found.count() == sum(map(len, lines))
    assert [r["target"] for r in found.where("line = 0").orderBy("ord").collect()] == ["x", "x", "x", None, None, "y", None, None, None, None]
    query = catalog.QUERIES["bridge_link_spaces"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(query) and "Sort" not in plan(query) and "Window" not in plan(query)
