import os

import pytest

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def against_duckdb(found, sql, sf_dir):
    """Both results as sorted rows of text, columns by name."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        con.sql(f"create view {name} as select * from '{path}'")
    a, b = found.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)

    def plain(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return "[" + ",".join(map(plain, v)) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return str(int(v)) if not isinstance(v, (str, bool)) and isinstance(v, (int, float)) and v == int(v) else str(v)

    rows = lambda t: sorted(tuple(map(plain, r)) for r in t[sorted(a.columns)].itertuples(index=False, name=None))
    return rows(a), rows(b)
