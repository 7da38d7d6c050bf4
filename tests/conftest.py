import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    """Rows as sorted tuples by column name, doubles rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql, sf_dir=SF):
        df = query(spark, sf_dir)
        theirs = duck.sql(sql)
        assert sorted(df.columns) == sorted(theirs.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(theirs.columns, theirs.fetchall())

    return check
