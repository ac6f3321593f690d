import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame has the rows of a SQL text on the tables of sf0.001, columns by name."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def norm(rows, columns):
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        clean = lambda x: round(x, 6) if isinstance(x, float) else x
        return [columns[k] for k in order], sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)

    def check(df, sql):
        found = con.sql(sql)
        assert norm([tuple(r) for r in df.collect()], df.columns) == norm(found.fetchall(), found.columns)

    return check
