import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import chunking as K
from noteloom.operators.embedding import HashingEmbedder, pool
from noteloom.plans import indexing as I
from noteloom.sources.store import SnapshotError, SnapshotStore, page
from noteloom.streaming import changes as C


def count(text):
    return len(text) + 2


def codes(text):
    return [ord(c) for c in text]


def covered(text, prepared, limit):
    held = K.units(text)
    assert "".join(p.text for p in prepared.passages) == text
    at = line = 0
    for p in prepared.passages:
        assert p.start == at and K.real(held[p.start : p.end]) == p.text and count(p.text) <= limit
        assert not K.inside_pair(held, p.end) and p.start_line == line
        at, line = p.end, p.end_line
    assert at == len(held) and line == text.count("\n")


def test_structure_and_headings():
    text = "# A\r\n\r\nintro 😀\r\n\r\n## B ##\r\n\r\n- one\n  more\n- two\n\n```\n# not a heading\n```\ntail\n# C\nend"
    found = K.structure(K.units(text))
    assert [K.real(K.units(text)[u.start : u.end]) for u in found] and "".join(K.real(K.units(text)[u.start : u.end]) for u in found) == text
    assert {u.heading for u in found} == {"A", "A / B", "C"}
    fence = next(u for u in found if "not a heading" in K.units(text)[u.start : u.end])
    assert fence.heading == "A / B"
    covered(text, K.prepare_note(text, 32768, count), 1024)


def test_windows_and_limits():
    text = "世界🪴" * 11_000
    prepared = K.prepare_note(text, 256, count)
    covered(text, prepared, 256)
    assert prepared.mode == "aggregated"
    assert K.prepare_note("🪴a", 3, count).passages[0].text == "🪴"
    empty = K.prepare_note("", 256, count)
    assert empty.passages == [] and empty.segments == [(0, 0)]
    with pytest.raises(K.PreparationError):
        K.prepare_note("🪴", 100, lambda t: len(t) * 700 + 2)
    with pytest.raises(K.PreparationError):
        K.prepare_query("x" * 300, 256, count)


def test_random_markdown_is_covered():
    r = random.Random(5)
    parts = ["# h\n", "## g #\n", "- a\n", "  b\n", "\n", "```\n", "~~~~\n", "text 😀 here\n", "long " * 60, "\r\n", "1) x\n", "   \n"]
    for _ in range(150):
        text = "x" + "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        covered(text, K.prepare_note(text, 120, count), 120)


def test_alignment():
    prepared = K.prepare_note("alpha\n\nbeta", 3584, count, codes, late=True)
    assert [(p.start_token, p.end_token) for p in prepared.passages] == [(1, 12)]
    with pytest.raises(K.PreparationError):
        K.prepare_note("word " * 400, 3584, count, lambda t: [len(t)] * len(t), late=True)
    pairs = lambda t: [ord(t[i]) * 70_000 + ord(t[i + 1 : i + 2] or " ") for i in range(0, len(t), 2)]
    text = "# abc\n\nxyz\n\n# de\n\nfghij\n"
    moved = K.prepare_note(text, 3584, count, pairs, late=True)
    assert "".join(p.text for p in moved.passages) == text
    assert [len(b) for b in K.batches([str(i) for i in range(35)], 3584, count)] == [32, 3]


def test_pooling_errors():
    import numpy as np

    with pytest.raises(ValueError):
        pool(np.ones((3, 2)), 2, 2)
    with pytest.raises(ValueError):
        pool(np.zeros((3, 2)), 0, 2)


def rows(spark, notes):
    n = spark.createDataFrame([(k, s, [1.0, float(i)]) for i, (k, s, _) in enumerate(notes)], "note_id string, snapshot_id string, vector array<double>")
    p = spark.createDataFrame([(k, s, i, f"{k}{i}") for k, s, m in notes for i in range(m)], "note_id string, snapshot_id string, passage_index int, body string")
    return n, p


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.generations() == []
    store.publish(2, *rows(spark, [("a", "s1", 33), ("b", "s1", 1)]))
    store.publish(10, *rows(spark, [("a", "s1", 1)]))
    assert store.generations() == [2, 10]
    assert store.read("passages", 2).count() == 34
    assert [r.passage_index for r in store.passages_of(2, "a", "s1").collect()] == list(range(33))
    assert [r.note_id for r in store.vectors(2, [("b", "s1"), ("a", "s1")]).collect()] == ["b", "a"]
    with pytest.raises(SnapshotError):
        store.vectors(2, [("b", "s2")])
    n, p = rows(spark, [("a", "s2", 3)])
    with pytest.raises(SnapshotError):
        store.publish(2, n, p.where("passage_index <> 1"))
    assert store.read("passages", 2).count() == 34
    store.upsert(2, n, p, spark.createDataFrame([("b",)], "note_id string"))
    assert [(r.note_id, r.snapshot_id) for r in store.read("notes", 2).collect()] == [("a", "s2")]
    store.drop(10)
    store.drop(99)
    assert store.generations() == [2]
    assert page(spark.range(100), "id", 1).first().id == 64


def test_index_a_vault(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / "a.md").write_text("---\ntags: [x/y]\npriority: 3\n---\n# Head\n\nAlpha beta.\n\n## Two\n\nGamma #inline.\n")
    (vault / "sub" / "b.md").write_text("Plain note\n")
    (vault / "c.md").write_text("---\nai_index: false\n---\nno\n")
    (vault / "d.md").write_text("---\ntags: status/inbox\n---\nno\n")
    for late in (False, True):
        store = SnapshotStore(spark, str(tmp_path / f"store{late}"))
        result = I.index_vault(spark, str(vault), store, HashingEmbedder(dims=8), late=late)
        notes = {r.path: r for r in store.read("notes", 1).collect()}
        assert set(notes) == {"a.md", "sub/b.md"} and notes["a.md"].tags == ["x/y", "inline"] and notes["a.md"].tag_ancestors == ["x", "x/y", "inline"]
        assert store.read("passages", 1).where(F.size("vector") != 8).count() == 0
        assert {r.path for r in result.rejected.collect()} == {"c.md", "d.md"}
    assert {(r.key, r.kind) for r in I.property_registry(store.read("notes", 1)).collect()} == {("tags", "textArray"), ("priority", "number")}


def test_state_migration():
    s = I.IndexState(3, [1, 6], "old").migrated("new")
    assert (s.active, s.known) == (7, [1, 3, 6, 7]) and s.migrated("new") == s


def test_path_map_changes(spark):
    paths = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "path string, note_id string")
    changes = spark.createDataFrame([("d.md", "rename", "a.md", 1, None), ("b.md", "delete", None, 2, None), ("e.md", "create", None, 3, "9"), ("c.md", "modify", None, 4, None)], "path string, op string, old_path string, revision int, note_id string")
    assert {(r.path, r.note_id) for r in C.apply_changes(paths, changes).collect()} == {("d.md", "1"), ("c.md", "3"), ("e.md", "9")}


def test_path_maps_of_random_sequences(spark):
    """A thousand sequences of creations, edits, renames and deletions against a dictionary."""
    r = random.Random(41)
    first, changes, want = [], [], set()
    for n in range(1000):
        names = [f"{n}/{c}.md" for c in "abcde"]
        held = {p: f"{n}-{i}" for i, p in enumerate(names[: r.randint(0, 3)])}
        first += held.items()
        for revision in range(r.randint(0, 9)):
            op, path, old = r.choice(["create", "modify", "rename", "rename", "delete"]), r.choice(names), r.choice(names)
            changes.append((path, op, old if op == "rename" else None, revision, f"{n}-new{revision}" if op == "create" else None))
            if op == "create":
                held[path] = f"{n}-new{revision}"
            elif op == "delete":
                held.pop(path, None)
            elif op == "rename" and old != path:
                note = held.pop(old, None)
                held.pop(path, None)
                if note:
                    held[path] = note
        want |= set(held.items())
    r.shuffle(changes)
    paths = spark.createDataFrame(first, "path string, note_id string")
    got = C.apply_changes(paths, spark.createDataFrame(changes, "path string, op string, old_path string, revision int, note_id string"))
    assert {(x.path, x.note_id) for x in got.collect()} == want
    assert C.apply_changes(paths, spark.createDataFrame([], "path string, op string, old_path string, revision int, note_id string")).count() == len(first)


def test_a_store_writes_changed_notes_alone(spark, tmp_path, monkeypatch):
    from noteloom.sources import store as module

    store, other = (SnapshotStore(spark, str(tmp_path / "store")) for _ in range(2))
    store.publish(1, *rows(spark, [(f"n{i}", "s0", 2) for i in range(20)]))
    for k in range(3):
        (store, other)[k % 2].upsert(1, *rows(spark, [(f"n{k}", f"s{k + 1}", 3)]), spark.createDataFrame([(f"n{10 + k}",)], "note_id string"))
    held = {x.note_id: x.snapshot_id for x in store.read("notes", 1).collect()}
    assert held == {f"n{i}": f"s{i + 1}" if i < 3 else "s0" for i in range(20) if i not in (10, 11, 12)}
    assert store.read("passages", 1).count() == 3 * 3 + 14 * 2
    newest = store._commits(1)[-1]
    assert spark.read.parquet(store._at("notes", 1, newest)).count() == 1
    store.upsert(1, *rows(spark, [("n10", "back", 1)]))
    assert store.read("notes", 1).count() == 18
    before = sorted(map(str, store.read("notes", 1).collect()))
    store.compact(1)
    assert len(store._commits(1)) == 1 and sorted(map(str, store.read("notes", 1).collect())) == before
    monkeypatch.setattr(module, "MOST_COMMITS", 1)
    store.upsert(1, *rows(spark, [("n11", "back", 1)]))
    assert len(other._commits(1)) == 1 and other.read("notes", 1).count() == 19


def test_reconcile_embeds_what_changed(spark, tmp_path):
    from noteloom.functions.properties import PropertyFilter, compile_filters

    vault = tmp_path / "vault"
    vault.mkdir()
    for i in range(12):
        (vault / f"n{i}.md").write_text(f"---\npriority: {i}\nit's: x\n---\n# Note {i}\n\nBody of note {i}.\n")
    store, e = SnapshotStore(spark, str(tmp_path / "store")), HashingEmbedder(dims=8)
    assert I.reconcile(spark, str(vault), store, e) == {"embed": 12}
    assert I.reconcile(spark, str(vault), store, e) == {"noop": 12, "purge": 0}
    before = {x.path: x for x in store.read("notes", 1).collect()}
    (vault / "n3.md").write_text("---\npriority: 3\n---\n# Note 3\n\nAnother body.\n")
    (vault / "n4.md").write_text("---\npriority: 40\ndue: 2024-02-29\n---\n# Note 4\n\nBody of note 4.\n")
    (vault / "n5.md").unlink()
    assert I.reconcile(spark, str(vault), store, e) == {"noop": 9, "embed": 1, "metadata": 1, "purge": 1}
    after = {x.path: x for x in store.read("notes", 1).collect()}
    assert set(after) == set(before) - {"n5.md"} and after["n4.md"].vector == before["n4.md"].vector and after["n3.md"].vector != before["n3.md"].vector
    assert store.read("passages", 1).where("path = 'n4.md' and snapshot_id = '" + after["n4.md"].snapshot_id + "'").count() == 1
    fields = {(k, kind): name for k, kind, name in I._fields(store.read("notes", 1))}
    some = compile_filters([PropertyFilter("priority", "number", "gte", 9), PropertyFilter("due", "date", "ne", "2024-02-28")], fields)
    for kind in ("notes", "passages"):
        assert {x.path for x in store.read(kind, 1).where(some).collect()} == {"n4.md", "n9.md", "n10.md", "n11.md"}
    assert {x.path for x in store.read("passages", 1).where(compile_filters([PropertyFilter("it's", "text", "eq", "x")], fields)).collect()} == {f"n{i}.md" for i in (0, 1, 2, 6, 7, 8, 9, 10, 11)}


def test_debounce_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("path string, ts timestamp, data string").parquet(str(source)).withWatermark("ts", "0 seconds")
    q = C.debounce_stream(stream, "path", "ts", "data").writeStream.format("memory").queryName("debounced").outputMode("append").start()
    try:
        for some in ([("a", 0, "v1"), ("a", 5, "v2"), ("b", 0, "w1")], [("a", 17, "v3"), ("b", 30, "w2")], [("z", 300, "end")]):
            spark.createDataFrame(some, "path string, s int, data string").select("path", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "data").coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        got = {(r.path, r.data) for r in spark.sql("select * from debounced").collect()}
    finally:
        q.stop()
    assert got == {("a", "v3"), ("b", "w1"), ("b", "w2")}


def test_debounce_batch(spark):
    events = spark.createDataFrame([("a", 0, "1"), ("a", 12, "2"), ("a", 26, "3"), ("a", 40, "4")], "k string, s int, d string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    assert sorted((r.changes, r.d) for r in C.debounce_sessions(events, "k", "ts", 13, "d").collect()) == [(1, "3"), (1, "4"), (2, "2")]


def test_documents_of_any_length_are_chunked_whole(spark):
    """A null text, more than four MiB, more than 4,096 passages, and blanks longer than a passage: no job fails, nothing is lost."""
    from noteloom.operators.chunking import chunk_notes
    from noteloom.operators.coverage import span_coverage

    e = HashingEmbedder()
    texts = [None, "", "word " * (1 << 20) + "end", "a" + " " * 3000 + "b", "\n" * 3000 + "# a\n" + "\n" * 3000, " " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    passages = chunk_notes(docs, "id", "text", e.context_limit, e.count, whole=True)
    found = {r.note_id: r for r in span_coverage(passages, docs, "id", "text", most=None).collect()}
    assert len(found) == len(texts) and all(r.contiguous and r.complete and r.lines for r in found.values())
    assert found["2"].spans > 4096 and found["0"].spans == found["1"].spans == found["5"].spans == 0
    assert passages.where("length(body) > 1022").count() == 0
    with pytest.raises(K.PreparationError):
        K.prepare_note("a" + " " * 3000 + "b", e.context_limit, e.count)


def test_passages_are_given_out_in_bounded_batches():
    import pyarrow as pa

    schema = pa.schema([("n", pa.int32()), ("text", pa.string())])
    out = list(K.given_out(((i, "x" * (K.HELD_CHARACTERS // 4)) for i in range(10)), schema, lambda row: len(row[1])))
    assert [b.num_rows for b in out] == [4, 4, 2] and [n for b in out for n in b.column(0).to_pylist()] == list(range(10))
    assert max(b.num_rows for b in K.given_out(((i, "") for i in range(5000)), schema)) == K.HELD_ROWS
