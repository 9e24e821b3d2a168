import __spark_entry__ as e


def test_registry():
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and "sample_features" in oracles


def test_oracles_are_sql():
    oracles = e.oracle_sql()
    assert all(isinstance(sql, str) for sql in oracles.values())
