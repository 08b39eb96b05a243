import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same(spark):
    """Compares a query with its SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")

    def check(query, sql):
        found = query(spark, SF_DIR)
        told = con.sql(sql)
        assert sorted(found.columns) == sorted(told.columns)
        names = sorted(found.columns)
        mine = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
        theirs = sorted(told.select(*[f'"{n}"' for n in names]).fetchall(), key=repr)
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            assert a == pytest.approx(b) if any(isinstance(x, float) for x in a) else a == b

    return check
