import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    return (1, repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v))


@pytest.fixture(scope="session")
def same():
    def compare(df, con, sql):
        columns = sorted(df.columns)
        got = sorted([_plain(r[c]) for c in columns] for r in df.collect())
        done = con.execute(sql)
        names = [d[0] for d in done.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted([_plain(r[i]) for i in at] for r in done.fetchall())

    return compare
