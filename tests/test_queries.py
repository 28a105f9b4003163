import pytest

import __spark_entry__
from basewright.plans.fixtures import made

DATA = "/root/testdata/sf0.001"


def test_concat_of_whole_tables(spark):
    n = made(spark, DATA, "reads").count()
    got = __spark_entry__.queries()["concat_whole"](spark, DATA)
    assert sorted(x.read_idx for x in got.select("read_idx").collect()) == list(range(2 * n))


def test_concat_of_whole_tables_against_its_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["concat_whole"]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()["concat_whole"](spark, DATA).collect())) == sorted(want)
