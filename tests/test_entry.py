import __spark_entry__ as E


def test_entry_runs_and_has_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"plan", "segment", "customers", "churn_rate"} <= set(df.columns)


def test_every_query_has_callable_and_oracles_are_a_subset():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40
