"""Row rules, and results by growing budgets, against plain versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noteloom.operators.retrieval import escalating
from noteloom.sources.validation import fault_counts, missing_columns, note_rules, passage_rules, whole_notes, with_faults

PASSAGES = "note_id string, snapshot_id string, passage_index int, body string, start int, end int, start_line int, end_line int, start_token int, end_token int, vector array<double>"
GOOD = ("a", "s", 0, "text", 0, 4, 0, 0, 1, 3, [1.0, 0.0])


def test_each_fault_is_named_once_and_good_notes_are_whole(spark):
    def but(**changes):
        names = [c.split()[0] for c in PASSAGES.split(", ")]
        return tuple(changes.get(n, v) for n, v in zip(names, GOOD))

    cases = [
        (but(), []),
        (but(note_id="b", start_token=None, end_token=None), []),
        (but(note_id=None), ["note_id"]),
        (but(note_id="x" * 513), ["note_id"]),
        (but(note_id="x\0y"), ["note_id"]),
        (but(note_id="c", body=None), ["body"]),
        (but(note_id="d", start=5), ["characters"]),
        (but(note_id="e", start_line=2, end_line=1, end_token=1), ["lines", "tokens"]),
        (but(note_id="f", vector=[1.0, 1.0]), ["vector"]),
        (but(note_id="g", passage_index=None, vector=None), ["passage_index", "vector"]),
        (but(note_id="b", passage_index=-1), ["passage_index"]),
    ]
    rows = with_faults(spark.createDataFrame([c for c, _ in cases], PASSAGES), passage_rules(2))
    assert [r["faults"] for r in rows.collect()] == [f for _, f in cases]
    assert {r["fault"]: r["rows"] for r in fault_counts(rows).collect()} == {"note_id": 3, "body": 1, "characters": 1, "lines": 1, "tokens": 1, "vector": 2, "passage_index": 2}
    notes = spark.createDataFrame([("a", "s", "a.md", [1.0, 0.0]), ("b", "s", "b.md", [0.0, 1.0]), ("h", "s", "", [0.0, 1.0])], "note_id string, snapshot_id string, path string, vector array<double>")
    kept, passages = whole_notes(with_faults(notes, note_rules(2)), rows)
    assert [r["note_id"] for r in kept.collect()] == ["a"] and [r["note_id"] for r in passages.collect()] == ["a"]
    assert fault_counts(rows.limit(0)).count() == 0
    assert missing_columns(notes, {"note_id": "string", "path": "int", "title": "string"}) == ["path: string instead of int", "title: missing instead of string"]


@pytest.mark.parametrize("every, taken, exhausted", [(1, 5, False), (3, 20, False), (4, 60, False), (1000, 60, False)])
def test_budgets_grow_until_enough_are_admitted(spark, every, taken, exhausted):
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(100)], "id int, score double")
    seen = []

    def admit(window):
        seen.extend(r["id"] for r in window.collect())
        return window.where(F.pmod("id", F.lit(every)) == 0)

    found = escalating(rows, "id", admit, budgets=(5, 20, 60), wanted=5)
    order = sorted(range(100), key=lambda i: (-(i // 3), i))
    assert seen == order[:taken] and (found.taken, found.exhausted) == (taken, exhausted)
    assert [r["id"] for r in found.hits.collect()] == [i for i in order[:taken] if i % every == 0][:5]


def test_budgets_end_with_the_candidates(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(8)], "id int, score double")
    found = escalating(rows, "id", lambda w: w.where("id > 5"), budgets=(5, 20), wanted=5)
    assert [r["id"] for r in found.hits.collect()] == [6, 7] and found.taken == 8 and found.exhausted
    assert escalating(rows.limit(0), "id", lambda w: w).hits.count() == 0
    with pytest.raises(ValueError):
        escalating(rows, "id", lambda w: w, budgets=(0,))
