"""The change source: listings against a model of moving notes, random edits of a folder, restarts."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from noteloom.operators.embedding import HashingEmbedder
from noteloom.sources.folder_watch import HELD, FolderWatch, file_digest, listing_changes
from noteloom.sources.store import Fence, SnapshotStore
from noteloom.streaming.changes import apply_changes
from noteloom.streaming.maintenance import PathMap, maintain

SCHEMA = "path string, digest string"


def told(spark, before, after, step=1):
    frames = [spark.createDataFrame(list(x.items()), SCHEMA) for x in (before, after)]
    return sorted((r["revision"], r["op"], r["old_path"], r["path"]) for r in listing_changes(*frames, step).collect())


def test_single_changes(spark):
    assert told(spark, {}, {}) == []
    assert told(spark, {"a": "1", "b": None}, {"a": "1", "b": None}) == []
    assert told(spark, {"a": "1"}, {"a": "1", "c": "1"}) == [(3, "create", None, "c")]
    assert told(spark, {"a": "1"}, {"a": "2"}) == [(2, "modify", None, "a")]
    assert told(spark, {"a": "1"}, {}) == [(2, "delete", None, "a")] == told(spark, {"a": "1"}, {"a": None})
    assert told(spark, {"a": "1"}, {"b": "1"}) == [(2, "rename", "a", "b")]
    assert told(spark, {"a": "1"}, {"a": "2", "b": "1"}) == [(2, "rename", "a", "b"), (3, "create", None, "a")]
    # a takes b's place: b's note goes with the rename; two files change places.
    assert told(spark, {"a": "1", "b": "2"}, {"b": "1"}) == [(2, "rename", "a", f"{HELD}b"), (3, "rename", f"{HELD}b", "b")]
    swap = told(spark, {"a": "1", "b": "2"}, {"a": "2", "b": "1"})
    assert swap == [(2, "rename", "a", f"{HELD}b"), (2, "rename", "b", f"{HELD}a"), (3, "rename", f"{HELD}a", "a"), (3, "rename", f"{HELD}b", "b")]


def test_moved_folder_of_equal_files_keeps_names_and_loses_none(spark):
    before = {f"a/{i}.md": "empty" for i in range(300)}
    after = {f"b/{i}.md": "empty" for i in range(300)} | {"b/more.md": "empty"}
    rows = told(spark, before, after)
    renames = {old: path for _, op, old, path in rows if op == "rename"}
    assert len(rows) == 301 and len(renames) == 300 == len(set(renames.values())) and [r for r in rows if r[1] == "create"]
    same = told(spark, before, {f"b/{i}.md": "empty" for i in range(300)})
    assert sum(old[2:] == path[2:] for _, _, old, path in same) > 250


def test_random_moves_end_with_each_note_where_its_text_is(spark):
    rng = random.Random(7)
    for step in range(1, 9):
        paths = [f"p{i}" for i in range(12)]
        before = {p: f"text {i}" for i, p in enumerate(rng.sample(paths, 8))}
        notes = spark.createDataFrame([(p, f"note of {t}") for p, t in before.items()], "path string, note_id string")
        texts = rng.sample(sorted(before.values()), rng.randint(0, 8)) + [f"new {i}" for i in range(4)]
        after = dict(zip(rng.sample(paths, 8), rng.sample(texts, min(8, len(texts)))))
        frames = [spark.createDataFrame(list(x.items()), SCHEMA) for x in (before, after)]
        changes = listing_changes(*frames, step)
        got = {r["path"]: r["note_id"] for r in apply_changes(notes, changes).collect()}
        home = {t: p for p, t in before.items()}
        assert set(got) == set(after)
        for path, text in after.items():
            if text in home:
                assert got[path] == f"note of {text}"
            elif path in before and before[path] not in after.values():
                assert got[path] == f"note of {before[path]}"  # edited in place
            else:
                assert not got[path].startswith("note of")


def test_stream_of_a_folder_under_random_edits_and_restarts(spark, tmp_path):
    rng, vault = random.Random(3), tmp_path / "my vault"
    vault.mkdir()
    watch, paths = FolderWatch(spark, str(vault), str(tmp_path / "watch")), PathMap(spark, str(tmp_path / "paths"))
    model: dict[str, str] = {}  # path to the mark that a note's text has kept since it was made
    number = 0

    def write(path, mark):
        nonlocal number
        number += 1
        (vault / path).parent.mkdir(exist_ok=True)
        (vault / path).write_text(f"{mark}\n" + "x" * number)

    def run():
        paths.follow(watch.stream(), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    marks: dict[str, str] = {}
    for round_ in range(4):
        before, touched = dict(model), set()
        for _ in range(6):
            free = sorted(p for p in model if p not in touched)
            action = rng.choice(["create", "edit", "move", "delete"]) if free else "create"
            path = rng.choice(free) if free else ""
            if action == "create":
                new = f"{rng.choice('ab')}/ü {number}.md"
                write(new, f"mark {number}")
                model[new] = f"mark {number - 1}"
                touched.add(new)
            elif action == "edit":
                write(path, model[path])
                touched.add(path)
            elif action == "move":
                new = f"{rng.choice('cd')}/{number}.md"
                number += 1
                (vault / new).parent.mkdir(exist_ok=True)
                os.rename(vault / path, vault / new)
                model[new] = model.pop(path)
                touched.add(new)
            else:
                (vault / path).unlink()
                del model[path]
        step = watch.poll()
        assert watch.poll() == step  # nothing more to tell
        run()
        got = {r["path"]: r["note_id"] for r in paths.read().collect()}
        assert set(got) == set(model)
        for path, mark in model.items():
            assert marks.setdefault(mark, got[path]) == got[path]  # the note goes with its text
        assert len(set(got.values())) == len(got)
        if round_ == 1:  # the batch's table is there, but the stream died before it noted that
            last = sorted((tmp_path / "checkpoint/commits").glob("[0-9]*"))[-1]
            for name in (last, last.parent / f".{last.name}.crc"):
                name.unlink(missing_ok=True)
    assert watch.step() == 4 and sorted(p.name for p in (tmp_path / "watch").iterdir()) == [f"step-{i:010d}" for i in range(1, 5)]
    assert {r["path"]: r["digest"] for r in watch.listing().collect()} == {p: file_digest(str(vault / p)) for p in model}


def test_touched_and_missing_files_and_always_hash(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("A")
    (vault / "b.txt").write_text("no note")
    watch = FolderWatch(spark, str(vault), str(tmp_path / "watch"))
    assert watch.step() == 0 and watch.listing().count() == 0
    assert watch.poll() == 1 and [(r["op"], r["path"]) for r in watch.changes(1).collect()] == [("create", "a.md")]
    os.utime(vault / "a.md", (1, 1))
    assert watch.poll() == 2 and watch.changes(2).count() == 0
    (vault / "a.md").write_text("B")
    os.utime(vault / "a.md", (1, 1))
    assert watch.poll() == 2  # the same length and time: told only if all is hashed
    careful = FolderWatch(spark, str(vault), str(tmp_path / "watch"), always_hash=True)
    assert careful.poll() == 3 and [r["op"] for r in careful.changes(3).collect()] == ["modify"] and careful.poll() == 3
    (vault / "a.md").unlink()
    assert watch.poll() == 4 and [r["op"] for r in watch.changes(4).collect()] == ["delete"]
    assert file_digest(str(vault / "a.md")) is None


def test_watch_wakes_the_store(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    watch = FolderWatch(spark, str(vault), str(tmp_path / "watch"))
    for number, (name, text) in enumerate((("a.md", "A"), ("b.md", "B"))):
        (vault / name).write_text(text)
        job = watch.polling(str(tmp_path / "beats")).trigger(availableNow=True).start()
        job.awaitTermination()
        watch.poll()
        maintain(watch.stream(), str(vault), store, e, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert store.fence(1) == Fence(0, number)
    assert sorted(r["path"] for r in store.read("notes", 1).where(F.col("generation") == 1).collect()) == ["a.md", "b.md"]
