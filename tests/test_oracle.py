"""Every registered query with SQL gives the rows that SQL gives."""

import pytest
from oracle import DATA, available, connect, rows
from pyspark.sql import functions as F

from plumbline.plans import registry

pytestmark = pytest.mark.skipif(not available(), reason="no test tables here")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA).toPandas()
    again = QUERIES[name](spark, DATA).toPandas()
    assert len(rows) > 0 and sorted(map(str, rows.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


@pytest.fixture(scope="module")
def one_label(spark, tmp_path_factory):
    """A folder whose annotators all give the same label, as larger tables have it, and the same for SQL."""
    out = str(tmp_path_factory.mktemp("one_label"))
    spark.read.parquet(f"{DATA}/orders.parquet").withColumn("o_orderstatus", F.lit("F")).write.parquet(f"{out}/orders.parquet")
    own = connect()
    own.execute("create or replace view orders as select * replace ('F' as o_orderstatus) from '%s/orders.parquet'" % DATA)
    return out, own


@pytest.mark.parametrize("name", ["fleiss_kappa", "krippendorff_alpha"])
def test_same_rows_of_one_label(spark, one_label, name):
    got, want = QUERIES[name](spark, one_label[0]).toPandas(), one_label[1].execute(SQL[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
