import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the driver's tables at sf0.001."""
    import duckdb

    con = duckdb.connect()
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for t in names.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(x):
    import decimal

    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, decimal.Decimal):
        return str(x.normalize() if x else 0)
    return str(x)


def same_rows(df, con, sql):
    """Spark rows against DuckDB rows, columns by name, rows in any order."""
    mine = [r.asDict() for r in df.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    theirs = [dict(zip(names, r)) for r in rel.fetchall()]
    key = lambda rows: sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows)
    assert key(mine) == key(theirs)
