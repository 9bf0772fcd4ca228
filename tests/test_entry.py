import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["query_id", "pos", "id", "score"]
    assert [r.pos for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 10


def test_every_oracle_has_a_query():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 80
