"""Every query of the subpackage: against SQL where there is one, else that it runs over the whole tables."""

import pytest

from leafmill.llm.queries import QUERIES, SQL

from ..conftest import DATA, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows_of(QUERIES[name](spark, DATA))
    assert got
    if name in SQL:
        assert got == sql_rows(duck, SQL[name])
    if name.endswith("_found"):
        assert len(got) == len(set(got))


COLUMNS = {
    "p1_found": ["query_id", "seg", "doc_id", "sent_id"], "p2_found": ["docid", "start_pos", "end_pos"],
    "p3_found": ["page_id", "body"], "p5_found": ["tid", "kind", "body"], "p6_found": ["rec_id", "fixed"],
    "p7_found": ["term", "mark"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}

EMPTY = {
    "queries": "query_id bigint, q string", "sents": "seg int, doc_id int, sent_id int, sent string",
    "doctexts": "docid string, doctext string, mtime int, lang string", "pages": "page_id bigint, url string, html string",
    "articles": "tid string, data string", "rawdocs": "rec_id bigint, content binary, encoding string",
    "postings": "kind string, term string, seg int, doc_id int, sent_id int", "segments": "seg int, fname string",
    "docinfo": "seg int, doc_id int", "documents": "doc_id bigint, text string", "benchmark": "item_id bigint, text string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_empty_tables(spark, table_dir, name):
    folder = table_dir(spark, **{t: ([], s) for t, s in EMPTY.items()})
    df = QUERIES[name](spark, folder)
    assert df.columns == COLUMNS[name]
    assert df.collect() == []
