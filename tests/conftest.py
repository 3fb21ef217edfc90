import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows of a DuckDB query, in any order."""
    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(df, sql):
        columns = sorted(df.columns)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall()
        got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
        assert sorted(map(repr, got)) == sorted(repr(tuple(norm(v) for v in r)) for r in want)

    return check
