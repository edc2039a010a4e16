import math

import pytest
from pyspark.sql import functions as F

from noteloom.functions import vectors as V
from noteloom.operators import graph as G
from noteloom.operators import retrieval as R


def one(df):
    return df.first()[0]


def vec(spark, *vs):
    return spark.createDataFrame([vs], ", ".join(f"v{i} array<double>" for i in range(len(vs))))


def test_cosine_sign_clamp_and_errors(spark):
    cos = V.cosine(F.col("v0"), F.col("v1"))
    assert one(vec(spark, [1.0, 1.0], [0.0, 1.0]).select(cos)) == pytest.approx(math.sqrt(0.5))
    assert one(vec(spark, [1.0, 0.0], [-2.0, 0.0]).select(cos)) == -1.0
    for bad in ([0.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e308, 1e308]):
        with pytest.raises(Exception):
            vec(spark, bad, [0.0, 1.0]).select(cos).collect()
    assert one(vec(spark, [3.0, 4.0]).select(V.cosine_to(F.col("v0"), [3.0, 4.0]))) == pytest.approx(1.0)


def test_aggregate_and_pool(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0])], "k string, v array<double>")
    got = {r.k: r.v for r in V.aggregate_vectors(rows, ["k"], "v", 2).collect()}
    assert got["a"] == pytest.approx([math.sqrt(0.5)] * 2) and got["b"] == pytest.approx([1.0, 0.0])
    with pytest.raises(Exception):
        V.aggregate_vectors(spark.createDataFrame([("a", [1.0, 0.0]), ("a", [-1.0, 0.0])], "k string, v array<double>"), ["k"], "v", 2).collect()
    tokens = spark.createDataFrame([(0, 0, [100.0, 0.0], 0), (0, 1, [3.0, 0.0], 1), (0, 2, [0.0, 4.0], 1), (0, 3, [0.0, 100.0], 0)], "w int, t int, s array<double>, mask int")
    ranges = spark.createDataFrame([(0, 0, 1, 3), (0, 1, 1, 2), (0, 2, 0, 4)], "w int, passage_index int, start_token int, end_token int")
    got = {r.passage_index: r.vector for r in V.pool_ranges(tokens, ranges, "w", "t", "s", 2).collect()}
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([1.0, 0.0]) and got[2] == pytest.approx([0.6, 0.8])


def test_unit_check_and_range(spark):
    assert one(vec(spark, [0.6, 0.8]).select(V.is_unit(F.col("v0"), 2)))
    for bad in ([0.6], [1.0, 1.0], [float("nan"), 1.0]):
        assert not one(vec(spark, bad).select(V.is_unit(F.col("v0"), 2)))
    assert one(spark.range(1).select(V.checked_similarity(F.lit(1.00005)))) == 1.0
    with pytest.raises(Exception):
        spark.range(1).select(V.checked_similarity(F.lit(1.01))).collect()


def results(spark, n):
    return spark.createDataFrame([(f"n{i:02}", i + 1, 1.0 - i / 100) for i in range(n)], "note string, rank int, score double")


def test_graph_bounds(spark):
    listed = results(spark, 30)
    assert G.star_graph(listed, "anchor", "note").count() == 30
    vectors = spark.createDataFrame([(f"n{i:02}", [float(i), 1.0]) for i in range(30)], "note string, v array<double>")
    edges = G.complete_graph(listed, vectors, "note", ["note"], "v")
    assert edges.count() == 435
    assert G.strongest_pairs(edges).count() == 30
    for r in G.ring_layout(listed, "note").collect():
        assert 48 <= r.x <= 312 and 12 <= r.y <= 268
    with pytest.raises(ValueError):
        G.star_graph(results(spark, 31), "anchor", "note")
    with pytest.raises(ValueError):
        G.ring_layout(listed.unionByName(listed).limit(5).unionByName(listed.limit(1)), "note")
    with pytest.raises(LookupError):
        G.complete_graph(listed, vectors.where("note <> 'n03'"), "note", ["note"], "v")
    two = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.7)], "source string, target string, cosine double")
    assert G.edges_above(two, 0.8).count() == 1
    with pytest.raises(ValueError):
        G.edges_above(two, 1.5)


def test_visible_results_refill(spark):
    rows = [(f"note-{i}", 100.0 - i, i % 2 == 1) for i in range(80)] + [("note-1", 50.0, True), ("note-x", float("nan"), True)]
    df = spark.createDataFrame(rows, "note string, score double, ok boolean").where("ok")
    got = R.visible(df, "note", []).orderBy("rank").collect()
    assert [r.score for r in got] == [99.0 - 2 * i for i in range(30)] and [r.rank for r in got] == list(range(1, 31))


def test_grouping_and_ties(spark):
    hits = spark.createDataFrame([("note-b", "low", 0.1), ("note-b", "best", 0.9), ("note-a", "x", 0.9)], "note string, passage string, score double")
    got = R.group_hits(hits, "note", "passage").orderBy(F.desc("score"), "note").collect()
    assert [r.note for r in got] == ["note-a", "note-b"] and got[1].passages == ["best", "low"]
    with pytest.raises(Exception):
        R.group_hits(hits.unionByName(hits), "note", "passage").collect()
    snaps = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", 0.5)], "note string, s string, score double")
    with pytest.raises(Exception):
        R.group_by_note(snaps, "note", "s").collect()


def test_fusion_window(spark):
    k = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "p string, score double")
    v = spark.createDataFrame([("b", 0.5), ("c", 0.5)], "p string, score double")
    assert {r.p: r.score for r in R.fuse(k, v, "p").collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}
