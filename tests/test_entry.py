import __spark_entry__ as entry


def test_oracles_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
