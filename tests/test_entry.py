"""The driver's entry: every query against its SQL, and that the library stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from scrollmill.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cursor_rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in cursor_rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows(map(tuple, got.collect())) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_queries_without_sql_run(spark):
    rest = sorted(set(QUERIES) - set(ORACLES))
    assert {"pipeline_stats", "shingle_dedupe", "near_dupe_diff"} <= set(rest)
    for name in ("near_dupe_diff", "shingle_dedupe"):
        assert QUERIES[name](spark, DATA).columns


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_nothing_else_needs_the_subpackage(tmp_path, pipeline_stays):
    """In a copy without both folders."""
    for name in ("scrollmill", "__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * pipeline_stays):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "scrollmill" / "llm", ignore_errors=True)
    code = (
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'exact_dedupe' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names), names\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
        "import bench, scrollmill.cli, scrollmill.streaming.recompute\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
