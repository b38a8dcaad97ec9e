"""Every registered query against its SQL twin on a small scale factor."""

import os

import pytest
from oracle import compare, connect

from evenkeel.suite.registry import load_all

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note
