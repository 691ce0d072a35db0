import __spark_entry__ as entry

from logloom import catalog


def test_flagship_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "block", "n_parts", "first_start", "last_end"] and df.count() > 0


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(oracles) <= set(queries)
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
