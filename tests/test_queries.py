import pytest

from tests.compare import assert_same, views
from tidewater.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert_same(df, con, catalog.ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_sample_is_repeatable_and_near_its_share(spark, sf_dir):
    a, b = (sorted(r.o_orderkey for r in catalog.QUERIES["sel_sample"](spark, sf_dir).collect()) for _ in range(2))
    assert a == b and 90 < len(a) < 220


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
