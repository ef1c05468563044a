import __spark_entry__


def test_every_oracle_has_a_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 100


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ind", "loc", "sl", "all_id", "seq", "depth"] and df.count() > 0
