import pytest
from pyspark.sql import functions as F

from noteloom.functions import properties as P
from noteloom.functions import text as X
from noteloom.operators.admission import IGNORE_FILE_BYTES, PathPolicy, admission, load_policy, path_reason


def col(spark, values, expr, kind="string"):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", expr(F.col("v"))).orderBy("i").collect()]


def test_tags(spark):
    tags = [["#STATUS/INBOX"], ["#status/inbox/reading"], ["x", "#type/private/medical"], ["#status/inboxes", "#type/privately"]]
    got = col(spark, tags, lambda v: X.blocking_tag(X.normalize_tags(v)), "array<string>")
    assert got == ["status/inbox", "status/inbox/reading", "type/private/medical", None]
    assert col(spark, [["a/b/c", "a"]], X.tag_ancestors, "array<string>") == [["a", "a/b", "a/b/c"]]


def test_frontmatter(spark):
    ok = ["---\na: 1\n---\nbody", "﻿---\r\na: 1\r\n--- \r\nbody", "body --- x", "---\n---\nbody", "---\n" + "k: v\n" * 5000 + "---\nbody"]
    assert col(spark, ok, X.strip_frontmatter) == ["body", "body", "body --- x", "body", "body"]
    with pytest.raises(Exception):
        col(spark, ["---\na: 1\nbody"], X.strip_frontmatter)


def test_paths(spark):
    got = col(spark, ["a\\b/./c.md", "/a.md", "a/../b.md", "a\0b", "a//b.md"], X.normalize_path)
    assert got == ["a/b/c.md", None, None, None, "a/b.md"]
    assert col(spark, ["a/b/c.md", "c.md"], X.ancestor_directories) == [["", "a", "a/b"], [""]]
    assert col(spark, ["a/b.md", "ab/c.md", "a"], lambda v: X.relative_path(F.lit("a"), v)) == ["b.md", None, None]
    assert col(spark, ["/\n x \n\nx\nC:\\y\n../z"], lambda v: X.path_list(v, True)) == [["", "x", None, None]]


def test_kinds_and_registry(spark):
    notes = [(1, '{"priority":3,"A-b":true,"A_b":false,"missing":null,"empty":[]}'), (2, '{"priority":"high"}'), (3, '{"d":"2026-02-30","e":["2024-02-29","x"],"o":{"b":1,"a":[1]},"f":"2024-02-29"}')]
    props = P.explode_properties(spark.createDataFrame(notes, "id int, j string"), "id", "j")
    kinds = {(r.id, r.key): r.kind for r in props.collect()}
    assert kinds[1, "priority"] == "number" and kinds[2, "priority"] == "text" and kinds[1, "missing"] is None and kinds[1, "empty"] is None
    assert kinds[3, "d"] == "text" and kinds[3, "e"] == "textArray" and kinds[3, "o"] == "json" and kinds[3, "f"] == "date"
    assert P.registry(props).where("key = 'priority'").count() == 2
    assert P.registry(props).where("lower(key) = 'a-b' or key = 'A_b'").count() == 2
    keys = {r.id: r for r in P.key_arrays(props, "id").collect()}
    assert keys[1].null_property_keys == ["missing".encode().hex()] and keys[1].empty_list_property_keys == ["empty".encode().hex()]
    with pytest.raises(Exception):
        P.explode_properties(spark.createDataFrame([(1, '{"n":9007199254740993}')], "id int, j string"), "id", "j").collect()


def test_canonical_json():
    assert P.canonical_json({"b": 1.0, "a": [1e21, 0.5, True, None, 1e-7], "é": "x"}) == '{"a":[1e+21,0.5,true,null,1e-7],"b":1,"é":"x"}'
    assert P.canonical_json({"x": 1.5e-6}) == '{"x":0.0000015}'


def test_filters(spark):
    with pytest.raises(ValueError):
        P.compile_filters([P.PropertyFilter("k", "number", "eq", 1)], {})
    with pytest.raises(ValueError):
        P.compile_filters([P.PropertyFilter("k", "text", "gt", "a")], {("k", "text"): "k"})
    assert P.compile_filters([], {}) is None
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 6.0)], "id int, k double")
    got = df.where(P.compile_filters([P.PropertyFilter("k", "number", "ne", 5)], {("k", "number"): "k"})).collect()
    assert [r.id for r in got] == [2, 3]
    assert P.parse_filter_value("2024-01-01T10:20:30Z", "date").hour == 10
    with pytest.raises(ValueError):
        P.parse_filter_value("2024-01-01T10:20Z", "date")


def test_nested_ignore_files(spark):
    controls = {".gitignore": b"ignored/\nCase.md\n\\!literal.md\n\\#hash.md\n# note\n", "ignored/.gitignore": b"!keep.md\n", "docs/.gitignore": b"*.md\n!public.md\n"}
    policy = load_policy(controls, ["private"], ["exact.md"])
    paths = ["ignored/keep.md", "Case.md", "case.md", "!literal.md", "#hash.md", "docs/a.md", "docs/public.md", "private/x.md", "privately/x.md", "exact.md", "x.MD", "../x.md", "deep/Case.md"]
    got = dict(zip(paths, col(spark, paths, lambda v: path_reason(v, policy))))
    assert all(got[p] for p in ("ignored/keep.md", "Case.md", "!literal.md", "#hash.md", "docs/a.md", "private/x.md", "exact.md", "x.MD", "../x.md", "deep/Case.md"))
    assert not any(got[p] for p in ("case.md", "docs/public.md", "privately/x.md"))
    closed = load_policy({"a/.gitignore": b"x" * (IGNORE_FILE_BYTES + 1), "b/.gitignore": None}, [], [])
    assert [bool(r) for r in col(spark, ["a/x.md", "b/x.md", "c/x.md"], lambda v: path_reason(v, closed))] == [True, True, False]


def test_admission_order(spark):
    rows = [("a.txt", False, False, ["status/inbox"]), ("a.md", False, False, []), ("a.md", True, False, ["status/inbox"]), ("a.md", True, None, ["status/inbox"]), ("a.md", True, True, [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, metadata_ready boolean, ai_index boolean, tags array<string>")
    got = admission(df, PathPolicy()).orderBy("i").collect()
    assert [(r.admitted, r.deferred) for r in got] == [(False, False), (False, True), (False, False), (False, False), (True, False)]
    assert got[3].reason == "Blocked tag status/inbox"


DATES = (
    ("2024-02-29", "2024-02-29T00:00:00.000Z"),
    ("2026-02-30", None),
    ("2026-99-01", None),
    ("2026-2-3", None),
    ("2026-02-28T23:59:59+02:00", "2026-02-28T21:59:59.000Z"),
    ("2026-02-28T10:20Z", "2026-02-28T10:20:00.000Z"),
    ("2026-02-28T10:20:30.1239-01:30", "2026-02-28T11:50:30.123Z"),
    ("2026-02-28T10:20:30", None),
    ("2026-02-28T24:00:00Z", None),
    ("2026-02-30T12:00:00Z", None),
    ("x", None),
)


def test_dates_that_exist_are_normalised(spark):
    from noteloom.functions.properties import date_text

    got = spark.createDataFrame([(a,) for a, _ in DATES], "value string").select("value", date_text(F.col("value"))).collect()
    assert [tuple(r) for r in got] == list(DATES)
