"""The driver's contract."""

import os

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        df = entry.entry(spark)
        assert df.columns[0] == "page_id" and df.count() > 0
