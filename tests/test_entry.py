"""The entry points."""

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
