"""Fences at the store's commit, reuse of vectors in reconcile, and a stream that keeps a store up to date."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from noteloom.functions.properties import explode_properties, typed_columns
from noteloom.operators.embedding import HashingEmbedder
from noteloom.plans import indexing as I
from noteloom.sources.store import Fence, SnapshotStore, StaleWork
from noteloom.streaming.maintenance import maintain

NOTES = "note_id string, snapshot_id string"
PASSAGES = "note_id string, snapshot_id string, passage_index int, body string"


@dataclass(frozen=True)
class CountingEmbedder(HashingEmbedder):
    """Writes each text that meets the model to a file of its own."""

    folder: str = ""

    def embed(self, texts):
        for t in texts:
            with open(os.path.join(self.folder, f"{os.urandom(8).hex()}"), "w") as f:
                f.write(t)
        return super().embed(texts)

    def seen(self):
        names = os.listdir(self.folder)
        texts = sorted(open(os.path.join(self.folder, n)).read() for n in names)
        for n in names:
            os.unlink(os.path.join(self.folder, n))
        return texts


def rows(spark, *notes):
    return spark.createDataFrame([(n, s) for n, s in notes], NOTES), spark.createDataFrame([(n, s, 0, "x") for n, s in notes], PASSAGES)


def served(store):
    return sorted((r["note_id"], r["snapshot_id"]) for r in store.read("notes", 1).select("note_id", "snapshot_id").collect())


def test_fence_refuses_the_older_of_two_writers_and_leaves_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(1, *rows(spark, ("a", "1")), fence=Fence(0, 1))
    early = store.fence(1)
    store.upsert(1, *rows(spark, ("a", "3")), fence=Fence(0, 3))
    folders = sorted(os.listdir(tmp_path / "notes/generation=1"))
    for stale in (Fence(early.epoch, 2), Fence(0, 3)):
        with pytest.raises(StaleWork):
            store.upsert(1, *rows(spark, ("a", "2")), fence=stale)
    assert served(store) == [("a", "3")] and sorted(os.listdir(tmp_path / "notes/generation=1")) == folders
    assert store.invalidate(1) == 1 and store.generations() == [1]
    with pytest.raises(StaleWork):
        store.upsert(1, *rows(spark, ("a", "9")), fence=Fence(0, 9))
    store.upsert(1, *rows(spark, ("b", "0")), fence=Fence(1, 0))
    store.upsert(1, *rows(spark, ("c", "-")))  # without a fence, as before
    assert served(store) == [("a", "3"), ("b", "0"), ("c", "-")] and store.fence(1) == Fence(1, 0)
    store.compact(1)
    assert store.fence(1) == Fence(1, 0)


def test_reconcile_calls_the_model_once_a_text_and_not_for_unchanged_passages(spark, tmp_path):
    vault, calls = tmp_path / "vault", tmp_path / "calls"
    vault.mkdir()
    calls.mkdir()
    part = lambda name: f"## {name}\n\n" + f"{name} " * 130 + "\n\n"
    (vault / "n.md").write_text(part("alpha") + part("beta") + part("gamma"))
    (vault / "other.md").write_text("Short.\n")
    store, e = SnapshotStore(spark, str(tmp_path / "store")), CountingEmbedder(dims=8, folder=str(calls))
    I.reconcile(spark, str(vault), store, e)
    texts = e.seen()
    assert len(texts) == len(set(texts)) + sum(texts.count(t) > 1 for t in set(texts)) and sum("beta" in t for t in texts) <= 2
    old = {r["body"]: r["vector"] for r in store.read("passages", 1).collect()}
    (vault / "n.md").write_text(part("alpha") + part("delta") + part("gamma"))
    assert I.reconcile(spark, str(vault), store, e) == {"noop": 1, "embed": 1, "purge": 0}
    bodies = {r["body"]: r["vector"] for r in store.read("passages", 1).collect()}
    again = e.seen()
    kept = set(bodies) & set(old)
    assert kept and all(bodies[b] == old[b] for b in kept)
    note = [t for t in again if "alpha" in t and "gamma" in t]
    assert len(note) == 1 and sorted(t for t in again if t not in note) == sorted(set(bodies) - kept)


def test_purge_leaves_no_file_with_a_purged_body(spark, tmp_path):
    from noteloom.operators.keyword_index import KeywordIndex

    store = SnapshotStore(spark, str(tmp_path))
    notes = lambda *ids: spark.createDataFrame([(i, "s") for i in ids], NOTES)
    passages = lambda *ids: spark.createDataFrame([(i, "s", 0, "p", f"secret {i}", "", f"secret{i}") for i in ids], f"{PASSAGES[: PASSAGES.index('body')]}passage_id string, body string, heading string, title string")
    store.upsert(1, notes("a", "b"), passages("a", "b"))
    store.upsert(1, notes("b", "c"), passages("b", "c"))
    index = KeywordIndex(store, 1)
    assert index.search("secretb", 5).hits.count() == 1
    assert store.purge(1, spark.createDataFrame([("b",), ("unknown",)], "note_id string")) == 1
    assert served(store) == [("a", "s"), ("c", "s")] and len(store.commits(1)) == 1
    assert index.search("secretb", 5).hits.count() == 0 and index.search("secretc", 5).hits.count() == 1
    tables = [t for kind in ("notes", "passages") for t in (tmp_path / kind / "generation=1").iterdir()]
    assert len(tables) == 2 and len(list((tmp_path / "keywords/generation=1").iterdir())) == 1
    assert spark.read.parquet(*map(str, tables)).where("note_id = 'b'").isEmpty()
    assert index.table("blocks", index.refresh()).where("term = 'secretb'").isEmpty()
    store.drop(1)
    assert not (tmp_path / "keywords/generation=1").exists()


def test_mixed_lists_hold_canonical_json(spark):
    text = '{"m": [1, "x", {"b": 1, "a": 2.50}, null], "n": [1, null], "s": ["a", null], "t": ["a", "b"], "k": [1, 2], "z": [null]}'
    notes = spark.createDataFrame([(1, text), (2, '{"m": ["plain", "text"]}'), (3, "{}")], "id long, j string")
    fields = [(r["key"], r["kind"], r["physical_name"]) for r in explode_properties(notes, "id", "j").where("kind is not null").select("key", "kind", "physical_name").distinct().collect()]
    names = {(k, kind): name for k, kind, name in fields}
    assert {k: kind for k, kind, _ in fields} == {"m": "textArray", "n": "textArray", "s": "textArray", "t": "textArray", "k": "numberArray", "z": "textArray"}
    first, second, third = typed_columns(notes, "j", fields).orderBy("id").collect()
    of = lambda row, key: row[names[key, "textArray"]]
    assert of(first, "m") == ["1", '"x"', '{"a":2.5,"b":1}', "null"] and of(second, "m") == ["plain", "text"] and of(third, "m") is None
    assert of(first, "n") == ["1", "null"] and of(first, "s") == ['"a"', "null"] and of(first, "t") == ["a", "b"] and of(first, "z") == ["null"]


def test_stream_keeps_the_store_up_to_date_through_a_restart(spark, tmp_path):
    vault, notices, checkpoint = tmp_path / "vault", tmp_path / "notices", tmp_path / "checkpoint"
    vault.mkdir()
    notices.mkdir()
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)

    def run(number: int) -> None:
        (notices / f"{number}.txt").write_text("changed")
        maintain(spark.readStream.text(str(notices)), str(vault), store, e, str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    paths = lambda: sorted(r["path"] for r in store.read("notes", 1).collect())
    (vault / "a.md").write_text("A\n")
    (vault / "b.md").write_text("B\n")
    run(0)
    assert paths() == ["a.md", "b.md"] and store.fence(1) == Fence(0, 0)
    (vault / "a.md").unlink()
    (vault / "c.md").write_text("C\n")
    run(1)
    assert paths() == ["b.md", "c.md"] and store.fence(1) == Fence(0, 1)
    # The stream dies after its batch was stored and before it noted that: the batch comes again and changes nothing.
    commits, before = store.commits(1), sorted(map(str, store.read("passages", 1).collect()))
    for name in os.listdir(checkpoint / "commits"):
        if name.strip(".").startswith("1"):
            os.unlink(checkpoint / "commits" / name)
    run(2)
    assert sorted(map(str, store.read("passages", 1).collect())) == before and store.commits(1)[: len(commits)] == commits
    assert store.read("notes", 1).where(F.col("path") == "c.md").count() == 1
