"""Boolean semantics, nulls, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import index as ix
from leafmill.operators import search as se
from leafmill.plans import query as ql

SENTS = [
    (0, 1, 0, "Title of one"), (0, 1, 1, "The harbor is near."), (0, 1, 2, "The catalog is old."),
    (0, 2, 0, "Harbor catalog"), (0, 2, 1, "The harbor, catalog!"), (0, 2, 1, "The harbor, catalog!"),
    (1, 1, 0, "catalog harbor"), (1, 2, 0, None), (1, 3, 0, "図書館の機械"), (1, 3, 1, ""),
    (2, 1, 0, "harbor catalog in a broken run"),
]
DOCS = [(0, 1, 5, "a"), (0, 2, 6, "b"), (0, 2, 6, "b"), (1, 1, 7, "a"), (1, 2, None, None), (1, 3, 0, "c"), (2, 1, 9, "d")]
SEGS = [(0, "aaa", "aaa00000.cdb"), (1, "bbb", "bbb00001.cdb"), (2, "bbb", "bbb00002.cdb.tmp"), (3, None, None)]
KEYS = ["seg", "doc_id"]


@pytest.fixture(scope="module")
def index(spark):
    sents = spark.createDataFrame(SENTS, "seg int, doc_id int, sent_id int, sent string")
    post = ix.postings_of(sents, KEYS)
    labels = spark.createDataFrame(
        [("label", "inbox", 0, 1, 0), ("label", None, 0, 2, 0), (None, "x", 0, 1, 0), ("date", "2023", 1, 1, 0)],
        "kind string, term string, seg int, doc_id int, sent_id int",
    )
    junk = lambda df: df.withColumn("terms", F.lit(1)).withColumn("p0", F.lit(True)).withColumn("contexts", F.lit(2))
    docs = spark.createDataFrame(DOCS, "seg int, doc_id int, mtime int, loc string")
    segs = spark.createDataFrame(SEGS, "seg int, prefix string, fname string")
    return se.Index(junk(post.unionByName(labels)), junk(sents), junk(docs), junk(segs))


def found(index, text, **kw):
    return sorted((r["seg"], r["doc_id"]) for r in se.search(index, ql.parse(text), **kw).collect())


def test_and_over_sentences(index):
    assert found(index, "harbor catalog") == [(0, 1), (0, 2), (1, 1)]


def test_phrase_needs_one_sentence_in_order(index):
    assert found(index, '"harbor catalog"') == [(0, 2)]


def test_or(index):
    assert found(index, "near old", any_of=True) == [(0, 1)]


def test_not_is_taken_after_or(index):
    assert found(index, "harbor catalog -old", any_of=True) == [(0, 2), (1, 1)]


def test_only_negative_is_all_less(index):
    assert found(index, "-harbor") == [(1, 2), (1, 3)]


def test_title(index):
    assert found(index, "title:harbor") == [(0, 2), (1, 1)]


def test_features_need_no_sentence(index):
    assert found(index, "label:inbox") == [(0, 1)]
    assert found(index, "date:2023") == [(1, 1)]


def test_unspaced(index):
    assert found(index, "機械") == [(1, 3)]
    assert found(index, "械館") == []


def test_nothing(index):
    assert found(index, "") == []
    assert found(index, '"') == []
    assert found(index, "???") == []


def test_dedupe_keeps_newest(index):
    assert found(index, "harbor", dedupe=True) == [(0, 2), (1, 1)]


def test_prefix(index):
    only = se.Index(index.postings, index.sents, index.docinfo, index.segments, "aaa")
    assert found(only, "harbor") == [(0, 1), (0, 2)]


def test_contexts_are_first_sentences(index):
    got = {(r["seg"], r["doc_id"]): r["contexts"] for r in se.search(index, ql.parse("harbor catalog")).collect()}
    assert got[0, 1] == [1, 2] and got[0, 2] == [0]


def test_pages_meet_without_overlap(index):
    all_ = se.search(index, ql.parse("harbor"))
    one = se.page(all_, 2).collect()
    last = one[-1]
    two = se.page(all_, 2, ql.save_token(last["fname"], last["doc_id"], 2)).collect()
    assert [(r["fname"], r["doc_id"]) for r in one + two] == [("bbb00001.cdb", 1), ("aaa00000.cdb", 2), ("aaa00000.cdb", 1)]


def test_empty_tables(spark, index):
    none = se.Index(*(df.limit(0) for df in (index.postings, index.sents, index.docinfo, index.segments)))
    for q in ("harbor", "-harbor", "harbor -old"):
        assert found(none, q) == []


def test_snippets(index):
    preds = ql.parse("harbor")
    got = {(r["seg"], r["doc_id"]): r for r in se.with_snippets(index, se.search(index, preds), preds).collect()}
    assert got[0, 1]["title"] == "Title of one"
    assert "<b>harbor</b>" in got[0, 1]["snippet"]


def test_snippet_edges():
    assert se.snippet({}, [], []) == ""
    assert se.snippet({0: "x" * 200}, [], []) == "x" * 100 + "..."
    assert se.highlighted("abcabc", ["abc", "bca"]) == [(0, 6)]


def test_parser():
    p = ql.parse('-"a b" c')
    assert p[0].neg and len(ql.parse(" ".join("abcdefghijklm"))) == ql.MOST_TERMS
    assert ql.parse("references:<x@y>")[0].some == (("msgid", "x@y"), ("reply", "x@y"), ("ref", "x@y"))
    assert ql.parse("date:nonsense")[0].always is False
    assert ql.load_token(ql.save_token("idx00001.cdb", 70000, 3)) == ("idx00001.cdb", 70000, 3)
    assert ql.kana("toshokan") == "としょかん" and ql.kana("xyz") is None


def test_estimate():
    assert se.estimate(100, 50, 5) == 10
    assert se.estimate(10, 0, 0) == 0


def test_document_rules(spark, index):
    all_ = se.search(index, ql.parse("harbor"))
    assert se.decide(all_, []).count() == 3
    assert se.decide(all_, [F.when(F.col("loc") == "a", -1).otherwise(0)]).count() == 1


def test_time_limit(spark):
    import time

    from leafmill.streaming.append import Timeout, within

    slow = F.udf(lambda x: time.sleep(5) or x, "long")
    with pytest.raises(Timeout):
        within(spark, 0.5, lambda: spark.range(100).select(slow("id").alias("x")).collect())
    assert within(spark, 60, lambda: spark.range(3).count()) == 3
