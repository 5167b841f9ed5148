import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
