import subprocess
import sys
import textwrap

import duckdb
import pytest

import __spark_entry__
from noteloom import queries as notes

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 30


def test_oracles_name_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(notes.QUERIES) > 60


def test_import_without_the_optional_parts(tmp_path):
    """A copy without the optional subpackage and the pipeline still imports and has the note queries."""
    code = """
        import shutil, sys, pathlib
        root, copy = pathlib.Path(sys.argv[1]), pathlib.Path(sys.argv[2])
        shutil.copytree(root / "noteloom", copy / "noteloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        sys.path.insert(0, str(copy))
        import __spark_entry__ as e
        assert e.__file__.startswith(str(copy)) and "note_connections" in e.queries() and not any(q.startswith("op") for q in e.queries())
        """
    root = __spark_entry__.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", textwrap.dedent(code), root, str(tmp_path)], check=True, cwd=tmp_path)


@pytest.mark.parametrize("name", ["note_connections", "passage_connections_maxsim", "hybrid_grouped_notes", "property_registry", "admission_reason", "debounce_sessions", "heading_ancestry", "buried_conversations", "quarantined_notes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    if name == "hybrid_grouped_notes" and con.execute("select max(vec_id) from embeddings").fetchall()[0][0] < 499:
        pytest.skip("too few vectors")
    want = con.execute(notes.ORACLES[name]).fetchdf()
    got = notes.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    tidy = lambda df: sorted(tuple("" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x) for x in row) for row in df.itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_stream_runs_to_its_end(spark):
    got = notes.QUERIES["stream_debounce"](spark, SF)
    assert got.count() > 0 and got.columns == ["user_id", "first_change", "last_change", "changes", "event_id"]
