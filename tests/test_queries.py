"""Every registered query of the core runs, and equals its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    assert compare(spark, name, SMALL) == ""


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
