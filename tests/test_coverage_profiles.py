import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from noteloom.functions.properties import PropertyFilter, presets_from_json, presets_to_json
from noteloom.operators import graph as G
from noteloom.operators import retrieval as R
from noteloom.operators.chunking import chunk_notes
from noteloom.operators.coverage import span_coverage
from noteloom.operators.embedding import HashingEmbedder
from noteloom.operators.profiles import PROFILES, QueryVectors, StaleQuery, profile
from noteloom.streaming import changes as C


def test_chunks_of_any_text_cover_it(spark):
    texts = ["", "  \n ", "one", "# a\n\nb\n\n## c\n\nd 😀 e\n" * 40, "x" * 5000, "é😀\n" * 700, "- a\n  - b\n\n```\ncode\n```\n" * 60]
    notes = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    e = HashingEmbedder(context_limit=128)
    found = span_coverage(chunk_notes(notes, "id", "text", e.context_limit, e.count), notes, "id", "text").collect()
    assert len(found) == len(texts) and all(r.contiguous and r.complete and r.lines for r in found)


def test_faults_of_coverage_are_told_apart(spark):
    notes = spark.createDataFrame([(n, "a😀\nb") for n in ("good", "gap", "lost", "line", "none", "unit")] + [("null", None)], "id string, text string")
    rows = [
        ("good", 0, "a😀\n", 0, 4, 0, 1), ("good", 1, "b", 4, 5, 1, 1),
        ("gap", 0, "a😀\n", 0, 4, 0, 1), ("gap", 1, "b", 5, 6, 1, 1),
        ("lost", 0, "a😀\n", 0, 4, 0, 1),
        ("line", 0, "a😀\n", 0, 4, 0, 1), ("line", 1, "b", 4, 5, 0, 0),
        ("unit", 0, "a😀\n", 0, 3, 0, 1), ("unit", 1, "b", 3, 4, 1, 1),
    ]
    passages = spark.createDataFrame(rows, "note_id string, passage_index int, body string, start int, end int, start_line int, end_line int")
    got = {r.note_id: (r.spans, r.contiguous, r.complete, r.lines) for r in span_coverage(passages, notes, "id", "text").collect()}
    assert got == {
        "good": (2, True, True, True), "gap": (2, False, True, True), "lost": (1, True, False, True), "line": (2, True, True, False),
        "none": (0, True, False, True), "unit": (2, False, True, True), "null": (0, True, True, True),
    }
    assert span_coverage(passages.limit(0), notes.limit(0), "id", "text").count() == 0


def test_placed_edges(spark):
    places = spark.createDataFrame([(1, 1), (2, 2)], "n long, rank int")
    at = G.ring_layout(places, "n")
    edges = spark.createDataFrame([(1, 2, 0.5)], "source long, target long, cosine double")
    row = G.placed_edges(edges, at, "n").first()
    assert (row.x1, row.y1, row.x2, row.y2) == pytest.approx((180, 35, 180, 245))
    star = spark.createDataFrame([(0, 2, 0.5)], "source long, target long, cosine double")
    row = G.placed_edges(star, at, "n", anchor=0).first()
    assert (row.x1, row.y1) == (180, 140) and row.y2 == pytest.approx(245)
    with pytest.raises(Exception, match="without a place"):
        G.placed_edges(star, at, "n").collect()


def test_fresh_titles(spark):
    listed = spark.createDataFrame([("a", "old a", 1), ("b", "old b", 2), ("c", None, 3)], "note string, title string, rank int")
    files = spark.createDataFrame([("a", "new a"), ("a", "new a"), ("z", "z"), ("b", None)], "note string, title string")
    assert [tuple(r) for r in R.fresh_titles(listed, files, "note", "title").orderBy("rank").collect()] == [("a", "new a", 1), ("b", "old b", 2), ("c", None, 3)]
    with pytest.raises(ValueError):
        R.fresh_titles(spark.range(31).select(F.col("id").alias("note"), F.lit("t").alias("title")), files, "note", "title")


def test_next_deadline_and_invalidation(spark):
    queue = spark.createDataFrame([("a", 30), ("b", 10), ("c", None)], "path string, due int")
    purges = spark.createDataFrame([("p",)], "path string")
    assert tuple(C.next_deadline(queue, "due").first()) == (3, 10)
    assert tuple(C.next_deadline(queue, "due", purges).first()) == (4, None)
    assert tuple(C.next_deadline(queue, "due", purges.limit(0)).first()) == (3, 10)
    assert tuple(C.next_deadline(queue.limit(0), "due").first()) == (0, None)
    work = spark.createDataFrame([(i,) for i in range(5)], "revision int")
    assert sorted(r[0] for r in C.after_invalidation(work, work.where("revision in (1, 2)"), "revision").collect()) == [3, 4]
    assert C.after_invalidation(work, work.limit(0), "revision").count() == 5


def test_presets_survive_a_round_trip():
    at = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
    presets = {"b": [PropertyFilter("due", "date", "lt", at), PropertyFilter("at", "textArray", "containsAny", ["x", "y"])], "a": [], "ä": [PropertyFilter("n", "number", "missing")]}
    assert presets_from_json(presets_to_json(presets)) == presets
    with pytest.raises(ValueError):
        presets_to_json({" ": []})
    for kind, operator in (("text", "gt"), ("colour", "eq")):
        with pytest.raises(ValueError):
            presets_from_json(presets_to_json({"a": [PropertyFilter("k", kind, operator, 1)]}))


def test_profiles():
    assert len({profile(n).fingerprint for n in PROFILES}) == len(PROFILES) == 3
    contextual = [n for n in PROFILES if PROFILES[n].contextual]
    assert len(contextual) == 1 and profile(contextual[0], late=True).fingerprint != profile(contextual[0]).fingerprint
    with pytest.raises(ValueError):
        profile("Xenova/all-MiniLM-L6-v2", late=True)
    with pytest.raises(LookupError):
        profile("unheard-of")


def test_query_vectors():
    calls = []

    class Counting(HashingEmbedder):
        def embed(self, texts):
            calls.extend(texts)
            return super().embed(texts)

    e = Counting(dims=8, context_limit=20)
    held = QueryVectors(e)
    with pytest.raises(StaleQuery):
        held.vector("one", e.fingerprint)
    held.ask("one")
    first = held.vector("one", e.fingerprint)
    held.ask("one")
    assert held.vector("one", e.fingerprint) == first and calls == ["one"] and math.sqrt(sum(x * x for x in first)) == pytest.approx(1)
    held.ask("two")
    with pytest.raises(StaleQuery):
        held.vector("one", e.fingerprint)
    with pytest.raises(StaleQuery):
        held.vector("two", "another")
    held.vector("two", e.fingerprint)
    held.use(Counting(dims=8, context_limit=20, fingerprint="next"))
    with pytest.raises(StaleQuery):
        held.vector("two", "next")
    held.ask("  ")
    with pytest.raises(StaleQuery):
        held.vector("  ", "next")
    held.ask("x" * 21)
    with pytest.raises(ValueError):
        held.vector("x" * 21, "next")


def test_open_bursts_complete_a_stopped_stream(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 500, 4), ("b", 495, 5), ("c", 100, 6), (None, 498, 7)]
    events = spark.createDataFrame(rows, "k string, s int, n int").select("k", F.timestamp_seconds("s").alias("ts"), "n")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "5 seconds")
    bursts = C.debounce_sessions(stream, "k", "ts", 30, "n")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    bursts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    closed, still = spark.read.schema(bursts.schema).parquet(out), C.open_bursts(spark, state, "k", "n")
    want = C.debounce_sessions(events, "k", "ts", 30, "n")
    assert still.count() and closed.count() and still.columns == want.columns
    assert sorted(map(repr, closed.unionByName(still).collect())) == sorted(map(repr, want.collect()))
