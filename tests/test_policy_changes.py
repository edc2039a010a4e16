"""Ignore files read from a folder, and changes of the policy that reach only what they concern."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.errors import StreamingQueryException

from noteloom.operators import admission as A
from noteloom.operators.admission import IgnoreFile, PathPolicy, affected, readmit
from noteloom.operators.embedding import HashingEmbedder
from noteloom.plans import indexing as I
from noteloom.sources import notes as N
from noteloom.sources.store import Fence, SnapshotStore, StaleWork
from noteloom.streaming.maintenance import watch_policy


def policy(controls=(), **more):
    return PathPolicy(controls=tuple(IgnoreFile(d, f"{d}/.gitignore" if d else ".gitignore", tuple(lines)) for d, lines in controls), **more)


def test_affected_names_the_least_directories():
    a = policy([("", ["x"]), ("d", ["y"]), ("d/e", ["z"])])
    assert affected(a, a) == [] and affected(a, policy([("", ["x"]), ("d", ["y"])])) == ["d/e"]
    assert affected(a, policy([("", ["x"]), ("d", ["q"])])) == ["d"] and affected(a, policy([("", ["q"]), ("d", ["y"])])) == [""]
    assert affected(PathPolicy(("f",), ("g.md",)), PathPolicy(("f", "h"), ("g.md",))) == ["f", "h"]
    assert affected(PathPolicy(), PathPolicy(failed=("k",))) == ["k"] and affected(PathPolicy(), PathPolicy(("",))) == [""]
    assert affected(PathPolicy(), PathPolicy(valid=False)) == [""]


def test_readmission_equals_a_full_admission_after_random_changes(spark):
    rng = random.Random(5)
    folders = ["", "a", "a/b", "c", "ab"]
    paths = [f"{d}/{n}.md" if d else f"{n}.md" for d in folders for n in "xyz"] + ["a/../x.md", "", None]
    notes = spark.createDataFrame([(p, i % 5 != 0, i % 7 != 0, ["private"] if i % 6 == 0 else []) for i, p in enumerate(paths)], "path string, metadata_ready boolean, ai_index boolean, tags array<string>")

    def some():
        controls = [(d, rng.sample(["x.md", "!x.md", "*.md", "b/", "!z.md", "/y.md"], rng.randint(1, 3))) for d in folders if rng.random() < 0.4]
        return policy(controls, folders=tuple(rng.sample(folders[1:], rng.randint(0, 2))), files=tuple(rng.sample(["a/x.md", "c/y.md"], rng.randint(0, 2))), failed=tuple(d for d in folders[1:] if rng.random() < 0.1))

    show = lambda df: sorted((str(r["path"]), r["admitted"], r["deferred"], str(r["reason"])) for r in df.collect())
    held = some()
    for _ in range(6):
        new = some() if rng.random() < 0.6 else PathPolicy(held.folders, held.files, held.controls[:-1], held.failed)
        judged = A.admission(notes, held)
        assert show(readmit(judged, held, new)) == show(A.admission(notes, new))
        held = new


def test_ignore_files_of_a_folder_and_their_caps(spark, tmp_path, monkeypatch):
    for d in ("", "a", "a/deep er", "b", "none"):
        (tmp_path / d).mkdir(exist_ok=True)
        if d != "none":
            (tmp_path / d / "n.md").write_text("N")
    (tmp_path / ".gitignore").write_text("x.md\n")
    (tmp_path / "a/deep er/.gitignore").write_text("y.md\n")
    (tmp_path / "none/.gitignore").write_text("nothing below\n")
    (tmp_path / "a/.gitignore").write_text("")
    (tmp_path / "b/.gitignore").mkdir()
    root = str(tmp_path)
    assert N.read_controls(spark, root) == {".gitignore": b"x.md\n", "a/deep er/.gitignore": b"y.md\n", "b/.gitignore": None}
    held = N.vault_policy(spark, root, ["priv"])
    assert held.failed == ("b",) and [c.directory for c in held.controls] == ["", "a/deep er"] and held.folders == ("priv",)
    monkeypatch.setattr(N, "IGNORE_TOTAL_BYTES", 7)
    assert N.read_controls(spark, root)["a/deep er/.gitignore"] is None
    (tmp_path / "empty").mkdir()
    assert N.read_controls(spark, str(tmp_path / "empty")) == {}


def test_changed_ignore_file_reaches_the_store_and_reads_only_its_folder(spark, tmp_path):
    vault = tmp_path / "vault"
    for p in ("a/one.md", "a/two.md", "b/three.md"):
        (vault / p).parent.mkdir(parents=True, exist_ok=True)
        (vault / p).write_text(p)
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    before = N.vault_policy(spark, str(vault))
    I.update_index(spark, str(vault), store, e, before)
    paths = lambda: sorted(r["path"] for r in I.served(store, "notes", "vault", e.fingerprint).collect())
    (vault / "a/.gitignore").write_text("two.md\n")
    (vault / "b/three.md").write_text("edited, but not looked at by this change")
    after = N.vault_policy(spark, str(vault))
    assert I.follow_policy(spark, str(vault), store, e, before, before) == {}
    assert I.follow_policy(spark, str(vault), store, e, before, after) == {"noop": 1, "purge": 1}
    assert paths() == ["a/one.md", "b/three.md"]
    os.unlink(vault / "a/.gitignore")
    assert I.follow_policy(spark, str(vault), store, e, after, N.vault_policy(spark, str(vault))) == {"noop": 1, "embed": 1, "purge": 0}
    assert paths() == ["a/one.md", "a/two.md", "b/three.md"]
    assert I.follow_policy(spark, str(vault), store, e, after, PathPolicy(valid=False))["purge"] == 3 and paths() == []


def test_watched_ignore_files_reach_the_store_through_a_crash_and_stop_older_work(spark, tmp_path, monkeypatch):
    vault, notices = tmp_path / "vault", tmp_path / "notices"
    notices.mkdir()
    for p in ("a/one.md", "a/two.md", "b/three.md"):
        (vault / p).parent.mkdir(parents=True, exist_ok=True)
        (vault / p).write_text(p)
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    paths = lambda: sorted(r["path"] for r in store.read("notes", 1).select("path").collect())

    def run(number, broken=False):
        (notices / f"{number}.txt").write_text("look\n")
        job = watch_policy(spark.readStream.text(str(notices)), str(vault), store, e, str(tmp_path / "seen"), ["priv"]).trigger(availableNow=True).start()
        if broken:
            with pytest.raises(StreamingQueryException):
                job.awaitTermination()
        else:
            job.awaitTermination()

    assert I.stored_policy(store) is None
    run(0)
    assert paths() == ["a/one.md", "a/two.md", "b/three.md"] and I.stored_policy(store).folders == ("priv",)
    early, commits = store.fence(1), store.commits(1)
    run(1)
    assert store.commits(1) == commits and store.fence(1) == early  # nothing changed
    (vault / "a/.gitignore").write_text("two.md\n")
    reconcile = I.reconcile

    def lost(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "reconcile", lost)
    run(2, broken=True)
    monkeypatch.setattr(I, "reconcile", reconcile)
    # The new policy is stored, so no work from before it can be; the change itself is still to be made.
    assert "before" in store.policy() and len(paths()) == 3
    with pytest.raises(StaleWork):
        (vault / "b/three.md").write_text("edited")
        I.reconcile(spark, str(vault), store, e, PathPolicy(), fence=Fence(early.epoch, early.revision + 1))
    run(3)
    assert paths() == ["a/one.md", "b/three.md"] and "before" not in store.policy()
    os.unlink(vault / "a/.gitignore")
    assert I.adopt_policy(spark, str(vault), store, e, N.vault_policy(spark, str(vault), ["priv"])) == {"noop": 1, "embed": 1, "purge": 0}
    assert I.adopt_policy(spark, str(vault), store, e, PathPolicy(valid=False))["purge"] == 3 and paths() == []
    assert store.generations() == [1] and I.stored_policy(store) == PathPolicy(valid=False)
