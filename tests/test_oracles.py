"""Every registered query of the library against its DuckDB SQL, or, without one, for rows and stability."""

import pytest

from tessera.plans import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_check):
    return connect(sf_check)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, sf_check, name):
    f, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert not compare(spark, con, name, f, sql, sf_check)
    else:
        rows = sorted(map(str, f(spark, sf_check).collect()))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # the same tables in other partitions
        try:
            assert rows and rows == sorted(map(str, f(spark, sf_check).collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
