"""Every registered query against its SQL, and the schema of those without."""

import pytest

from quarrystone.plans import catalog

from .conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in catalog.ORACLE_SQL:
        same_rows(df, duck, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
