"""The keyword and vector indexes against a scan of the same rows, through commits that replace and drop notes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import keyword_index, vector_index
from noteloom.operators.keyword_index import KeywordIndex
from noteloom.operators.retrieval import keyword_scores, nearest
from noteloom.operators.vector_index import VectorIndex, chosen_pivots
from noteloom.sources.store import SnapshotStore

NOTES = "note_id string, snapshot_id string, vector array<double>"
PASSAGES = "note_id string, snapshot_id string, passage_index int, passage_id string, title string, heading string, body string, vector array<double>"
WORDS = ["root", "Root", "leaf", "tree", "soil", "rain", "éclat", "x1", "the", "the", "the", "of", "of"]
QUERIES = [("the root", 3), ("ROOT, rain éclat; missing x1!", 6), ("missing", 3), ("", 3), ("of", 500)]


def vault(rng: random.Random, ids: range, version: int, dims: int = 6):
    notes, passages = [], []
    for i in ids:
        centre = np.eye(dims)[i % dims] * 3
        vector = lambda: [float(x) for x in centre + np.array([rng.gauss(0, 0.4) for _ in range(dims)])]
        notes.append((f"n{i}", f"s{i}.{version}", vector()))
        for j in range(rng.randint(1, 5)):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 2, 8, 40])))
            passages.append((f"n{i}", f"s{i}.{version}", j, f"p{j}", f"note {i}", rng.choice(["", "Tree", "Rain / Soil"]), text, vector()))
    return notes, passages


def write(store, spark, rows, purge=None):
    store.upsert(1, spark.createDataFrame(rows[0], NOTES), spark.createDataFrame(rows[1], PASSAGES), None if purge is None else spark.createDataFrame([(p,) for p in purge], "note_id string"))


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(keyword_index, "BUCKETS", 3)
    monkeypatch.setattr(vector_index, "RINGS", 2)
    monkeypatch.setattr(vector_index, "PIVOTS", 6)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A generation of four commits: many notes, some replaced, some dropped and new ones, and one that only drops."""
    rng = random.Random(4)
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("index")))
    write(store, spark, vault(rng, range(60), 1))
    write(store, spark, vault(rng, range(0, 30, 3), 2), [])
    write(store, spark, vault(rng, range(70, 80), 3), ["n1", "n3"])
    write(store, spark, ([], []), ["n4", "n70"])
    return store


def plain(store, query, k, where=None):
    passages = store.read("passages", 1)
    found = keyword_scores(passages, query)
    found = found if where is None else found.where(where)
    return [(r["note_id"], r["passage_id"], round(r["score"], 9)) for r in found.orderBy(F.desc("score"), "passage_id", "note_id").limit(k).collect()]


def held(hits):
    return [(r["note_id"], r["passage_id"], round(r["score"], 9)) for r in hits.orderBy(F.desc("score"), "passage_id", "note_id").collect()]


@pytest.mark.parametrize("query, k", QUERIES)
def test_keyword_index_equals_the_scan(store, monkeypatch, query, k):
    monkeypatch.setattr(keyword_index, "LOT_BITS", 1)
    assert held(KeywordIndex(store, 1).search(query, k).hits) == plain(store, query, k)


def test_keyword_index_skips_lots_and_reads_only_the_buckets_of_the_query(store, monkeypatch):
    monkeypatch.setattr(keyword_index, "LOT_BITS", 1)
    index = KeywordIndex(store, 1)
    found = index.search("the root", 2)
    assert 0 < found.scored < found.lots / 2
    table = index.table("blocks", index.refresh())
    plan = index._of_terms(table, ["root"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_keyword_index_of_allowed_passages(store, monkeypatch):
    monkeypatch.setattr(keyword_index, "LOT_BITS", 1)
    allowed = store.read("passages", 1).where("heading = 'Tree'").select("note_id", "passage_id")
    assert held(KeywordIndex(store, 1).search("the root", 7, allowed).hits) == plain(store, "the root", 7, F.col("heading") == "Tree")


def test_indexes_follow_a_compaction_and_forget_old_segments(spark, tmp_path):
    rng = random.Random(5)
    store = SnapshotStore(spark, str(tmp_path))
    write(store, spark, vault(rng, range(12), 1))
    keywords, vectors = KeywordIndex(store, 1), VectorIndex(store, 1)
    assert keywords.refresh() == vectors.refresh() and keywords.refresh() == store.commits(1)
    write(store, spark, vault(rng, range(4), 2), ["n7"])
    before = held(keywords.search("the root", 9).hits)
    store.compact(1)
    assert held(keywords.search("the root", 9).hits) == before == plain(store, "the root", 9)
    assert len(keywords.vacuum()) == 2 and store.names(keywords.root) == store.commits(1)
    with pytest.raises(ValueError):
        keywords.search("the", 0)
    with pytest.raises(ValueError):
        vectors.nearest([0.0] * 6, 3)


@pytest.mark.parametrize("kind", ["notes", "passages"])
def test_vector_index_equals_the_scan_and_skips_parts(store, spark, kind):
    index = VectorIndex(store, 1, kind)
    keys = index.keys
    read = total = 0
    for query in ([1.0, 0, 0, 0, 0, 0], [-1.0] * 6):
        scanned = nearest(store.read(kind, 1), query, "vector").orderBy(F.desc("score"), *keys)
        for k in (1, 5) if query[1] == 0 else (1000,):
            found = index.nearest(query, k)
            want = [(*(r[c] for c in keys), round(r["score"], 12)) for r in scanned.limit(k).collect()]
            assert sorted((*(r[c] for c in keys), round(r["score"], 12)) for r in found.hits.collect()) == sorted(want)
            if k == 1:
                read, total = read + found.scored, total + found.vectors
    assert read < total / 2
    if kind == "notes":
        return
    some = index.nearest([1.0, 0, 0, 0, 0, 0], 4, where=F.col("note_id") > "n4")
    want = nearest(store.read(kind, 1), [1.0, 0, 0, 0, 0, 0], "vector").where("note_id > 'n4'").orderBy(F.desc("score"), *keys).limit(4)
    assert {tuple(r[c] for c in keys) for r in some.hits.collect()} == {tuple(r[c] for c in keys) for r in want.collect()}


def test_vector_index_of_unusable_and_equal_vectors(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    vectors = [[1.0, 0.0]] * 5 + [[0.0, 0.0], None, [float("nan"), 1.0], [0.0, 1.0]]
    notes = spark.createDataFrame([(f"n{i}", "s", v) for i, v in enumerate(vectors)], NOTES)
    passages = spark.createDataFrame([(f"n{i}", "s", 0, "p0", "", "", "", None) for i in range(len(vectors))], PASSAGES)
    store.publish(1, notes, passages)
    found = VectorIndex(store, 1).nearest([2.0, 0.0], 6)
    assert [(r["note_id"], r["score"]) for r in found.hits.orderBy(F.desc("score"), "note_id").collect()] == [*((f"n{i}", 1.0) for i in range(5)), ("n8", 0.0)]
    assert VectorIndex(store, 1, "passages").nearest([2.0, 0.0], 6).hits.count() == 0


def test_pivots_are_apart():
    rng = np.random.default_rng(0)
    sample = np.repeat(rng.normal(size=(10, 3)), 5, axis=0)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    assert len(chosen_pivots(sample, 64)) == 10 and len(chosen_pivots(sample, 4)) == 4
