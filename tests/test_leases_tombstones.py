"""Readers' leases, notes buried until all generations are clean, and rows that break a rule."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from noteloom.operators.embedding import HashingEmbedder
from noteloom.plans import indexing as I
from noteloom.sources import store as S
from noteloom.sources.store import ReadersRemain, SnapshotError, SnapshotStore
from noteloom.sources.tombstones import Tombstones
from noteloom.streaming.changes import apply_changes
from noteloom.streaming.maintenance import maintain

NOTES = "note_id string, snapshot_id string"
PASSAGES = "note_id string, snapshot_id string, passage_index int, body string"


def rows(spark, *ids, snapshot="s"):
    return spark.createDataFrame([(i, snapshot) for i in ids], NOTES), spark.createDataFrame([(i, snapshot, 0, f"secret {i}") for i in ids], PASSAGES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "note_id string")


def served(store, generation=1):
    return sorted(r[0] for r in store.read("notes", generation).select("note_id").collect())


def test_leased_commits_outlive_compaction_and_sweep(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(1, *rows(spark, "a", "b"))
    with store.reading(1) as lease:
        frame = lease.read("passages")
        store.upsert(1, *rows(spark, "b", "c", snapshot="t"))
        store.compact(1)
        kept = store.sweep(1)
        assert set(kept).isdisjoint(lease.commits) and sorted(r["snapshot_id"] for r in frame.collect()) == ["s", "s"]
        first = lease.commits
        lease.renew()
        assert len(store.names(f"{tmp_path}/leases/generation=1")) == 1
    assert store.names(f"{tmp_path}/leases/generation=1") == [] and store.sweep(1) == sorted(first)
    assert served(store) == ["a", "b", "c"]


def test_purge_waits_for_readers_and_forgets_leases_that_ran_out(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(1, *rows(spark, "a", "b"))
    with store.reading(1) as lease:
        with pytest.raises(ReadersRemain):
            store.purge(1, ids(spark, "a"), wait=0.0)
        assert served(store) == ["b"] and store.holds(1, ids(spark, "a"))
        assert sorted(r["note_id"] for r in lease.read("notes").collect()) == ["a", "b"]
        done = threading.Timer(2.0, lease.end)
        done.start()
        assert store.purge(1, ids(spark, "a"), wait=60.0) == 0
        done.join()
    assert not store.holds(1, ids(spark, "a")) and served(store) == ["b"]
    short = S.Lease(store, 1, 0.1)
    time.sleep(0.2)
    with pytest.raises(SnapshotError):
        short.renew()
    assert store.leased(1) == set() and store.names(f"{tmp_path}/leases/generation=1") == []


def test_buried_notes_are_not_written_and_leave_every_generation(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path))
    stones = Tombstones(store)
    assert stones.settle() == {} and stones.pending().count() == 0
    for generation in (1, 2, 3):
        store.publish(generation, *rows(spark, *("ab" if generation < 3 else "b")))
    commit = store.commits(3)
    stones.bury(ids(spark, "a", "a", "unknown", None))
    stones.bury(ids(spark, "z"))
    assert sorted(r[0] for r in stones.pending().collect()) == ["a", "unknown", "z"]
    store.upsert(1, *rows(spark, "a", "c", snapshot="t"))
    assert served(store) == ["a", "b", "c"] and store.read("notes", 1).where("snapshot_id = 't'").count() == 1

    # A crash after the first generation leaves the batches, and the next call goes on with the others.
    purge, seen = SnapshotStore.purge, []

    def crash(self, generation, *args, **kwargs):
        if seen:
            raise RuntimeError("lost")
        seen.append(generation)
        return purge(self, generation, *args, **kwargs)

    monkeypatch.setattr(SnapshotStore, "purge", crash)
    with pytest.raises(RuntimeError):
        stones.settle()
    monkeypatch.setattr(SnapshotStore, "purge", purge)
    assert len(stones.batches()) == 2
    assert set(stones.settle()) == {1, 2} - set(seen) and stones.batches() == []
    assert store.commits(3) == commit  # it held none of them
    assert not any(store.holds(g, ids(spark, "a")) for g in (1, 2, 3)) and served(store) == ["b", "c"] and served(store, 2) == ["b"]
    store.upsert(1, *rows(spark, "a", snapshot="new"))
    assert served(store) == ["a", "b", "c"]


def test_notes_that_break_a_rule_go_to_quarantine_and_leave_it_when_purged(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for name in "abc":
        (vault / f"{name}.md").write_text(f"Text of {name}.\n")
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    result = I.index_vault(spark, str(vault), store, e)
    assert store.quarantined("notes", 1) is None and len(served(store)) == 3
    notes, passages = result.notes.cache(), result.passages.cache()
    by_path = {r["path"]: r["note_id"] for r in notes.collect()}
    new = F.concat("snapshot_id", F.lit("2"))
    long = notes.withColumn("snapshot_id", new).withColumn("vector", F.when(F.col("path") == "a.md", F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector")))
    text = passages.withColumn("snapshot_id", new).withColumn("body", F.when(F.col("path") != "b.md", F.col("body")))
    store.upsert(1, long, text, dims=8)
    current = {r["note_id"]: r["snapshot_id"] for r in store.read("notes", 1).collect()}
    assert set(current) == set(by_path.values()) and [p for p, i in by_path.items() if len(current[i]) == 65] == ["c.md"]
    faults = {(r["path"], tuple(r["faults"])) for r in store.quarantined("notes", 1).collect()}
    assert faults == {("a.md", ("vector",)), ("b.md", ())}
    assert {(r["path"], tuple(r["faults"])) for r in store.quarantined("passages", 1).collect()} == {("a.md", ()), ("b.md", ("body",))}
    store.purge(1, ids(spark, by_path["a.md"]), wait=0.0)
    assert {r["path"] for r in store.quarantined("passages", 1).collect()} == {"b.md"} and not store.holds(1, ids(spark, by_path["a.md"]))
    store.publish(2, notes.limit(0), passages.limit(0), dims=8)
    assert served(store, 2) == [] and store.quarantined("notes", 2) is None
    store.drop(1)
    assert store.quarantined("notes", 1) is None


def test_stream_settles_tombstones_before_it_indexes(spark, tmp_path):
    vault, notices = tmp_path / "vault", tmp_path / "notices"
    vault.mkdir()
    notices.mkdir()
    for name in "ab":
        (vault / f"{name}.md").write_text(f"Text of {name}.\n")
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    I.index_vault(spark, str(vault), store, e)
    I.index_vault(spark, str(vault), store, e, generation=2)
    gone = store.read("notes", 1).where("path = 'a.md'").select("note_id").cache()
    gone.count()
    Tombstones(store).bury(gone)
    os.unlink(vault / "a.md")
    (notices / "1.txt").write_text("changed\n")
    query = maintain(spark.readStream.text(str(notices)), str(vault), store, e, str(tmp_path / "checkpoint"), wait=0.0).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None and Tombstones(store).batches() == []
    assert not any(store.holds(g, gone) for g in (1, 2)) and len(served(store)) == len(served(store, 2)) == 1


def test_creates_alike_but_for_their_note_give_the_least(spark):
    changes = spark.createDataFrame([("p", "create", None, 1, n) for n in ("n2", "n1", "n3")], "path string, op string, old_path string, revision long, note_id string")
    none = spark.createDataFrame([], "path string, note_id string")
    assert [tuple(r) for r in apply_changes(none, changes).collect()] == [("p", "n1")]
