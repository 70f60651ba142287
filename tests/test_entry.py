"""The driver contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "segment_orders" in e.queries()


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "graphloom"), tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[-1] == "False", said.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_core_queries_match_their_sql(spark):
    import duckdb

    from graphloom import queries as core

    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    for name, query in core.QUERIES.items():
        if name not in core.ORACLE_SQL:
            continue
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        rel = db.sql(core.ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr), name
