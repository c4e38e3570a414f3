import __spark_entry__ as entry


def test_every_query_is_registered_with_unique_name():
    qs = entry.queries()
    sql = entry.oracle_sql()
    assert len(qs) >= 100
    assert set(sql) <= set(qs)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 10
    assert {"feature", "t_stat", "p_value"} <= set(df.columns)
