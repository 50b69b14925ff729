import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.master": "local[*]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL, as multisets of rows."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        wanted = duck.execute(sql)
        order = [d[0] for d in wanted.description]
        assert sorted(order) == names
        plain = lambda r: repr(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r))
        assert sorted(plain(r) for r in df.select(*names).collect()) == sorted(plain([r[order.index(n)] for n in names]) for r in wanted.fetchall())

    return check
