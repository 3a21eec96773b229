"""Every registered query of the core engine against DuckDB on the smallest data."""

import duckdb
import pytest

from innerscan import queries as core

SF = "/root/testdata/sf0.001"
NAMES = list(core.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in core.oracle_sql()])
def test_matches_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(core.queries()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """The entry module imports and lists the core queries where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(core.__file__).parents[1]
    shutil.copytree(root / "innerscan", tmp_path / "innerscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(NAMES)), "False"], out.stderr
