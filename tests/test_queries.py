import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright.operators import islands
from tilewright.plans import matching  # noqa: F401
from tilewright.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters_and_sessions_with_nulls(spark, tmp_path):
    """Rows without a date or key, and days before 1970, as SQL counts them; orders of one day are of one cluster in any order."""
    days = [(1, "2000-01-01"), (1, None), (1, "2000-01-20"), (1, "2000-06-01"), (1, None), (2, None), (2, None), (3, "2000-01-01"), (3, None), (None, "2000-01-01"), (None, "2000-01-09"), (4, "1960-03-01"), (4, "1960-03-02")]
    orders = spark.createDataFrame(days, "o_custkey long, day string").select("o_custkey", F.to_timestamp_ntz("day").alias("o_orderdate"))
    times = [(1, "2000-01-01 10:00:00"), (1, "2000-01-01 10:29:59"), (1, "2000-01-01 10:59:59"), (1, None), (1, None), (2, None), (3, "1960-01-01 10:00:00"), (3, None), (None, None), (None, "2000-01-01 10:00:00")]
    events = spark.createDataFrame(times, "user_id long, t string").select("user_id", F.to_timestamp_ntz("t").alias("ts"))
    con = duckdb.connect()
    for name, rows in (("orders", orders), ("events", events)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("cluster_gap", "sessions_30min"):
        found = QUERIES[name](spark, str(tmp_path))
        told = con.sql(f"select {', '.join(found.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(told, key=repr), name
    twins = spark.createDataFrame([(0,), (100,), (100,), (130,), (100,), (161,)], "x long").withColumn("k", F.lit(1))
    assert {tuple(r) for r in islands.clusters_by_gap(twins, ["k"], "x", 30).collect()} == {(1, 0, 1), (1, 107, 4), (1, 161, 1)}
