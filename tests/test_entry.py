"""The driver's contract."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["i", "j", "jaccard"]
    assert rows.count() > 0
