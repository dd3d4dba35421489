"""Each registered query against its SQL on the smallest tables, and that the entry works without the optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from clausewright import queries

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables are not here")


def _plain(x):
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = sql.execute(queries.ORACLE[name])
    assert sorted(c[0] for c in expected.description) == columns
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    right = sorted(repr([_plain(r[k]) for k in order]) for r in expected.fetchall())
    assert sorted(repr([_plain(x) for x in r]) for r in df.select(*columns).collect()) == right


@pytest.mark.parametrize("left", ["nothing", "empty", "cache", "init"])
def test_entry_without_the_optional_parts(tmp_path, left):
    here = Path(__file__).resolve().parent.parent
    for p in here.rglob("*.py"):
        kept = p.relative_to(here)
        if "llm" not in kept.parts and "tests" not in kept.parts and kept.name != "corpus_pipeline.py":
            (tmp_path / kept).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / kept).write_bytes(p.read_bytes())
    rest = tmp_path / "clausewright" / "llm"
    if left != "nothing":
        rest.mkdir()
    if left == "cache":
        (rest / "__pycache__").mkdir()
        (rest / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"")
    if left == "init":
        (rest / "__init__.py").write_text("")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE))], said.stderr
