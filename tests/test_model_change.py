"""A change of the model: two generations side by side, crashes at each step, purges in all of them."""

from __future__ import annotations

import pytest

from noteloom.operators.embedding import HashingEmbedder
from noteloom.plans import indexing as I
from noteloom.sources.store import SnapshotError, SnapshotStore, StaleWork
from noteloom.plans.indexing import IndexState


class Crash(Exception):
    pass


@pytest.fixture
def vault(tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("A\n")
    (folder / "b.md").write_text("B\n")
    return folder


def test_states():
    s = IndexState(fingerprint="m1")
    assert s.begun("m1") == s and s.begun("m2") == IndexState(1, [1, 2], "m1", 2, "m2")
    assert s.begun("m2").begun("m2") == s.begun("m2") and s.begun("m2").switched() == IndexState(2, [1, 2], "m2")
    assert s.begun("m2").begun("m3") == IndexState(1, [1, 2, 3], "m1", 3, "m3")  # numbers are not given twice
    assert s.begun("m2").begun("m1") == IndexState(1, [1, 2], "m1")


def test_state_lies_in_the_manifest_beside_the_generations(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "new"))
    assert store.state() == {} and I.stored_state(store) == IndexState()
    assert store.change_state(lambda s: s | {"active": 3}) == {"active": 3} == store.state() and store.generations() == []

    def fail(state):
        raise Crash

    with pytest.raises(Crash):
        store.change_state(fail)
    assert store.state() == {"active": 3}


@pytest.mark.parametrize("crash", ["publish", "switch", "drop"])
def test_crash_at_each_step_leaves_a_whole_generation(spark, vault, tmp_path, monkeypatch, crash):
    store, old, new = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8), HashingEmbedder(dims=16, fingerprint="hashing-v2")
    assert old.fingerprint != new.fingerprint
    state = I.update_index(spark, str(vault), store, old)
    assert state.fingerprint == old.fingerprint and store.generations() == [state.active]
    first = state.active
    (vault / "c.md").write_text("C\n")

    def fail(*_, **__):
        raise Crash

    real = SnapshotStore.change_state
    broken = {"publish": ("publish", fail), "drop": ("drop", fail), "switch": ("change_state", lambda self, change: real(self, change) if not self.state().get("building") else fail())}[crash]
    with monkeypatch.context() as m, pytest.raises(Crash):
        m.setattr(SnapshotStore, *broken)
        I.update_index(spark, str(vault), store, new)
    active = new if crash == "drop" else old
    rows = I.served(store, "notes", "vault", active.fingerprint).collect()
    assert len(rows) == (3 if crash == "drop" else 2) and {len(r["vector"]) for r in rows} == {active.dims}
    with pytest.raises(SnapshotError):
        I.served(store, "notes", "vault", (old if crash == "drop" else new).fingerprint)
    state = I.update_index(spark, str(vault), store, new)
    assert state == IndexState(first + 1, state.known, new.fingerprint) and store.generations() == [first + 1]
    assert not any(p.name == f"generation={first}" for p in (tmp_path / "store/notes").iterdir())
    assert sorted(r["path"] for r in I.served(store, "notes", "vault", new.fingerprint).collect()) == ["a.md", "b.md", "c.md"]


def test_purge_reaches_all_generations_and_stops_work_begun_before(spark, vault, tmp_path, monkeypatch):
    store, old, new = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8), HashingEmbedder(dims=16, fingerprint="hashing-v2")
    first = I.update_index(spark, str(vault), store, old).active
    gone = store.read("notes", first).where("path = 'b.md'").select("note_id")
    ids = spark.createDataFrame([tuple(r) for r in gone.collect()], "note_id string")
    real = SnapshotStore._write

    def purged_while_written(self, generation, notes, passages):
        commit = real(self, generation, notes, passages)
        if generation != first:
            monkeypatch.setattr(SnapshotStore, "_write", real)
            (vault / "b.md").unlink()
            assert I.purge_everywhere(store, ids) == {first: 1}
        return commit

    monkeypatch.setattr(SnapshotStore, "_write", purged_while_written)
    with pytest.raises(StaleWork):
        I.update_index(spark, str(vault), store, new)
    assert [r["path"] for r in I.served(store, "notes", "vault", old.fingerprint).collect()] == ["a.md"]
    I.update_index(spark, str(vault), store, new)
    assert [r["path"] for r in I.served(store, "notes", "vault", new.fingerprint).collect()] == ["a.md"]
