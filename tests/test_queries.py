"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from plumbline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canonical(df):
    cell = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert name in queries.SQL
    assert canonical(got) == canonical(duck.sql(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part(tmp_path):
    """With the training-data operators deleted the entry has the core's queries, whether the pipeline is left or
    not and whatever else is on the import path; a module that they lack is an error and not their absence."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))"

    def run(code: str, path: str | None = None):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
        return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)

    def core_alone(path: str | None = None):
        got = run(code, path)
        return got.stdout.split() == [str(len(queries.QUERIES)), "True"] or got.stderr

    assert core_alone() is True
    assert core_alone(str(repo)) is True  # the repository's own pipeline is on the path
    (tmp_path / "plumbline/llm/__pycache__").mkdir(parents=True)
    assert core_alone() is True and core_alone(str(repo)) is True  # a folder that deleted files leave
    (tmp_path / "corpus_pipeline.py").write_text("from plumbline.llm import packing")
    assert core_alone() is True
    (tmp_path / "plumbline/llm/queries.py").write_text("import zstandard_that_is_missing")
    assert "zstandard_that_is_missing" in run("import __spark_entry__").stderr
    (tmp_path / "plumbline/llm/queries.py").write_text("import plumbline.llm.gone")
    assert "plumbline.llm.gone" in run("import __spark_entry__").stderr
    (tmp_path / "plumbline/llm/queries.py").write_text("QUERIES, SQL = {}, {}")
    assert "packing" in run("import __spark_entry__").stderr
