"""Every core query against its SQL, and that each has rows."""

import pytest

from leafmill.queries import QUERIES, SQL

from .conftest import DATA, rows_of, sql_rows

#: May be empty on the smallest tables.
MAY_BE_EMPTY = {"mail_subject_search", "search_page", "kw_mixed", "doc_range", "kw_strict"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df)
    if name in SQL:
        assert got == sql_rows(duck, SQL[name])
    assert got or name in MAY_BE_EMPTY


def test_names_match(spark, duck):
    for name, sql in SQL.items():
        cols = [d[0] for d in duck.execute(f"SELECT * FROM ({sql}) LIMIT 0").description]
        assert sorted(cols) == sorted(QUERIES[name](spark, DATA).columns), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_narrowing_is_pushed_to_the_scan(spark):
    plan = QUERIES["kw_and"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(kind" in plan or "In(term" in plan
