import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(rows):
    """Rows as sorted tuples, floats to six digits."""
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (int, float)):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


def same(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    got = normal(tuple(r) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})")
    want = normal(cur.fetchall())
    assert got == want, (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3])
