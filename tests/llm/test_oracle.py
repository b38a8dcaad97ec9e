"""Queries with a SQL twin, on a small scale factor."""

import os

import pytest
from oracle import connect, rows_of

from evenkeel.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cur = connect(FOLDER).execute(SQL[name])
    cols = [c[0] for c in cur.description]
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols) and got == want and got
