import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leafmill.session import local_session

    session = local_session(4, "6g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def text_of(v):
    """A value as text, alike from Spark and DuckDB."""
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text_of, v)) + "]"
    return str(v)


def rows_of(df):
    """Rows of a DataFrame as sorted tuples of text, columns by name."""
    cols = sorted(df.columns)
    return sorted(tuple(text_of(r[c]) for c in cols) for r in df.collect())


def sql_rows(duck, sql):
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    return sorted(tuple(text_of(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall())


@pytest.fixture
def table_dir(tmp_path):
    """Writes {name: (rows, schema)} as Parquet tables and gives the folder."""

    def write(spark, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
