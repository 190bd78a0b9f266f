"""The registered queries run and agree with their SQL twins."""

import functools
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans import queries

SMALL = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).parent


@pytest.fixture(scope="module")
def case():
    """One workload for all queries, so that each pass of a run is computed once."""
    whole = queries.Case
    queries.Case = functools.cache(whole)
    yield
    queries.Case = whole


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.ORACLE) == set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_twin(spark, case, duck, name):
    df = entry.queries()[name](spark, SMALL)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert norm(tuple(r[c] for c in names) for r in df.collect()) == norm(want.fetchall())


def test_entry_without_the_text_subpackage(tmp_path):
    """A copy without that folder and its tests still gives the other queries, whether or not the pipeline file is left."""
    for name in ("tallyloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyloom" / "llm", ignore_errors=True)
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
        assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE))]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
