"""Stored tables that change, the translation memory, and streams into them."""

import uuid

import pytest
from pyspark.sql import functions as F

from foliant.operators import edits, inference, memory, records
from foliant.sources import store as stores
from foliant.streaming import requests

PAIR = ["s", "t"]


@pytest.fixture
def store(spark, tmp_path):
    out = stores.VersionedStore(spark, f"file://{tmp_path}/store", 8)
    rows = spark.range(100).selectExpr("concat('d', id) AS document_id", "id AS n", "TIMESTAMP '2024-06-06 00:00:00' AS updated_at")
    out.create({name: (rows, "document_id") for name in ("documents", "segments", "insertions", "media")} | {"none": (rows.limit(0), "document_id")})
    return out


def gone(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def test_an_update_rewrites_the_partitions_it_touches_and_no_time_of_others(spark, store):
    before = store.parts("documents")
    sent = spark.createDataFrame([("d7", None, True)], "document_id string, n long, sent_n boolean")
    records.update_stored(store, "documents", sent, "document_id", ["n"], "2025-01-01 00:00:00")
    after = store.parts("documents")
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert store.parts("segments") == store.parts("segments", 1)
    rows = {r["document_id"]: (r["n"], str(r["updated_at"])[:10]) for r in store.read("documents").collect()}
    assert rows == {f"d{i}": (i, "2024-06-06") for i in range(100) if i != 7} | {"d7": (None, "2025-01-01")}
    assert store.read("documents", 1).where("document_id = 'd7'").first()["n"] == 7
    assert store.lookup("documents", "document_id", "d9").first()["n"] == 9


def test_a_purge_takes_all_tables_or_none(spark, store, monkeypatch):
    tables = ["documents", "segments", "insertions", "media"]
    put, calls = stores.VersionedStore._put, []

    def breaks(self, df, name, *rest):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return put(self, df, name, *rest)

    monkeypatch.setattr(stores.VersionedStore, "_put", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        records.purge_stored(store, tables, gone(spark, "d1", "d2", "d3"))
    monkeypatch.undo()
    assert store.version() == 1 and all(store.read(t).count() == 100 for t in tables)
    assert records.purge_stored(store, tables, gone(spark, "d1", "d2", "d3", "nobody")) == 2
    assert all(store.read(t).count() == 97 and store.read(t).where("document_id IN ('d1', 'd2', 'd3')").count() == 0 for t in tables)
    assert store.read("documents", 1).count() == 100
    assert store.forget() > 0 and store.version() == 2 and store.read("media").count() == 97


def test_two_changes_at_once_conflict(spark, store, monkeypatch):
    put = stores.VersionedStore._put

    def overtaken(self, *a):
        monkeypatch.setattr(stores.VersionedStore, "_put", put)
        records.delete_stored(store, "media", gone(spark, "d5"), "document_id")
        return put(self, *a)

    monkeypatch.setattr(stores.VersionedStore, "_put", overtaken)
    with pytest.raises(stores.Conflict):
        records.delete_stored(store, "media", gone(spark, "d6"), "document_id")
    assert sorted({f"d{i}" for i in range(100)} - {r[0] for r in store.read("media").select("document_id").collect()}) == ["d5"]


def test_empty_tables_emptied_partitions_and_strange_rows(spark, store):
    assert store.read("none").count() == 0 and records.delete_stored(store, "none", gone(spark, "d1"), "document_id") == 2
    records.delete_stored(store, "media", store.read("media"), "document_id")
    assert store.parts("media") == {} and store.read("media").count() == 0
    new = spark.createDataFrame([("d1", 5, None), ("new", 6, None)], "document_id string, n long, updated_at timestamp")
    edits.set_stored_insertions(store, "insertions", new)
    assert store.read("insertions").count() == 101 and store.read("insertions").where("document_id = 'd1'").first()["n"] == 5
    with pytest.raises(ValueError, match="didn't name"):
        store.change({"segments": (gone(spark, "d1"), lambda old: old.withColumn("document_id", F.concat("document_id", F.lit("x"))))})


def sentences(spark, texts):
    return spark.createDataFrame([("en", "id", x) for x in texts], "s string, t string, text string")


def test_a_second_run_translates_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts, source, target):
        calls.add(len(texts))
        return [f"[{target}] {t}" for t in texts]

    table = memory.stored_memory(spark, f"memory_{uuid.uuid4().hex}", f"file://{tmp_path}/memory", PAIR)
    old = spark.createDataFrame([("en", "id", "a", "old", 1), ("en", "id", "a", "newer", 2)], "s string, t string, text string, translated string, id long")
    assert memory.remember(table, old, PAIR, 1) and not memory.remember(table, old, PAIR, 1)
    unique = sentences(spark, ["a", "b", "c", "12"])
    first = {r["text"]: (r["translated"], r["hit"]) for r in memory.translate_through(unique, table, PAIR, 2, counting).collect()}
    assert first == {"a": ("newer", True), "b": ("[id] b", False), "c": ("[id] c", False), "12": ("12", False)} and calls.value == 2
    again = memory.translate_through(unique, table, PAIR, 3, counting).collect()
    assert calls.value == 2 and all(r["hit"] for r in again) and len(again) == 4
    more = memory.translate_through(sentences(spark, ["c", "d"]), table, PAIR, 4, counting).collect()
    assert calls.value == 3 and {r["text"]: r["hit"] for r in more} == {"c": True, "d": False}
    plan = table.joined(unique, "left")._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.rindex("Sort [", 0, plan.index("Bucketed: true")) : plan.index("Bucketed: true")]
    assert "SortMergeJoin" in plan and "Exchange" not in stored_side


def test_the_backend_sees_no_url(spark):
    seen = "see https://a.org/x now"
    rows = [("en", "id", t, 0, i) for i, t in enumerate([seen, "https://only.org/y", "mail a@b.cd or [1]"])]
    batches = spark.createDataFrame(rows, "s string, t string, text string, batch long, place long")

    def strict(texts, source, target):
        assert not any("://" in t or "@" in t for t in texts)
        return [t.upper().replace("[1]", "[ 1 ]") if "SEE" in t.upper() else "lost" for t in texts]

    found = {r["text"]: r["translated"] for r in inference.translate_batches(batches, PAIR, strict).collect()}
    assert found == {seen: "SEE https://a.org/x NOW", "https://only.org/y": "https://only.org/y", "mail a@b.cd or [1]": "lost a@b.cd"}


def test_frequent_sentences_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(memory, "FREQUENT", 3)
    own = spark.createDataFrame([(i, 0, "en", "id", "often" if i % 2 else f"x{i}") for i in range(10)] + [(0, 1, "en", "id", "often")], "u long, pos long, s string, t string, text string")
    translated = memory.unique_sentences(own, PAIR, ["u", "pos"]).withColumn("translated", F.upper("text"))
    found = {r["u"]: r["text"] for r in memory.join_back(own, translated, PAIR, ["u"]).collect()}
    assert found == {i: "OFTEN" if i % 2 else f"X{i}" for i in range(1, 10)} | {0: "X0 OFTEN"}


def test_edits_keep_stored_styles_and_clear_runs(spark):
    runs = "array<string>"
    segments = spark.createDataFrame([("d", f"k{i}", i, "t", "bold", ["t"]) for i in range(7)], f"document_id string, key string, ord long, translated_text string, style string, runs {runs}")
    sent = [("k1", "new", None, None, False, False), ("k2", "t", "italic", None, True, False), ("k3", None, None, None, True, False), ("k4", "u", "", ["u"], True, True), ("k5", "t", None, [], False, True), ("k6", "t", None, None, False, False)]
    changes = spark.createDataFrame([("d", *x) for x in sent], f"document_id string, key string, text string, style string, runs {runs}, sent_style boolean, sent_runs boolean")
    found = [(r["translated_text"], r["style"], r["runs"], r["edited"]) for r in edits.apply_segment_edits(segments, changes).orderBy("ord").collect()]
    assert found == [
        ("t", "bold", ["t"], False), ("new", "bold", None, True), ("t", "italic", ["t"], True), ("t", None, ["t"], True), ("u", None, ["u"], True), ("t", "bold", None, True), ("t", "bold", ["t"], True),
    ]


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    table = stores.GrowingTable(spark, f"sentences_{uuid.uuid4().hex}", f"file://{tmp_path}/sentences", "lang STRING, text STRING", ["lang", "text"])
    add = requests.sentence_sink(table)
    docs = lambda *texts: spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    add(docs("Dr. Who came. He left.\n\n12\nHe left.", None), 0)
    assert sorted(r["text"] for r in table.rows().collect()) == ["Dr. Who came.", "He left."]
    add(docs("He left. She stayed."), 1)
    add(docs("Something else."), 1)
    assert table.versions() == [0, 1] and sorted(r["text"] for r in table.rows().collect()) == ["Dr. Who came.", "He left.", "She stayed."]


def test_flags_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Requests arrive in three files, some late within the watermark; the last file closes all minutes before it."""
    own = spark.range(400).selectExpr("id AS request_id", "timestamp_seconds(1700000000 + id * 3) AS ts", "CAST(id % 3 AS STRING) AS client", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS route")
    late, end = own.where("request_id % 10 = 3 AND request_id > 250"), own.where("request_id = 0").selectExpr("-1L AS request_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "'x' AS client", "route")
    path = f"file://{tmp_path}/in"
    for part in (own.join(late, "request_id", "left_anti"), late, end):
        part.select(own.columns).coalesce(1).write.mode("append").parquet(path)
    quotas = spark.createDataFrame([("a", 1), ("b", 5)], "route string, quota int")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(path)
        requests.run_once(requests.rate_limit_stream(stream, quotas, "10 minutes"), spark, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    finally:
        spark.conf.unset(name)
    found = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").where("request_id >= 0").collect())
    assert found == sorted(tuple(r) for r in requests.rate_limit_flags(own, quotas).collect())


def test_a_purge_writes_rows_where_it_reads_them(spark, tmp_path, monkeypatch):
    """Rows that stay aren't dealt again, and all of them stay."""
    store = stores.VersionedStore(spark, f"file://{tmp_path}/purge", 4)
    store.create({"t": (spark.range(1000).selectExpr("concat('d', id % 100) AS document_id", "id"), "document_id")})
    kind = type(spark.range(1))
    dealt, hint = [], kind.hint
    monkeypatch.setattr(kind, "hint", lambda df, name, *p: dealt.append(name) or hint(df, name, *p))
    records.purge_stored(store, ["t"], spark.range(30).selectExpr("concat('d', id) AS document_id"))
    assert dealt == [] and sorted(r["id"] for r in store.read("t").collect()) == [i for i in range(1000) if i % 100 >= 30]
    store.create({"u": (spark.range(10).selectExpr("concat('d', id) AS document_id", "id"), "document_id")})
    assert dealt == ["rebalance"]
