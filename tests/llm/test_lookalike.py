import pytest
from pyspark.sql import functions as F

from leafmill.llm.lookalike import consistent, form, read_alike, scripts_of, tangle

SAME = [
    ("ｶﾞｲﾄﾞ", "ガイド"), ("Ｔｈｅ　cat", "The cat"), ("ﬁn", "fin"), ("e\u0301té", "été"), ("か\u3099", "が"), ("か゛", "が"),
    ("The\u00a0cat", " The  cat "), ("ca\u200bt\u00ad", "cat"), ("закpыл", "закрыл"), ("сор", "cop"), ("Τhe", "The"),
    ("Ёж", "Ëж"), ("Ｓｕｎｎеｔｈ", "Sunneth"), ("größer", "größer"), ("Ǆ", "DŽ"), ("Кatusto文書", "Katusto文書"), ("ニ口", "二ロ"),
]
OTHER = [("cat", "Cat"), ("ete", "été"), ("cat", "cat."), ("て", "で"), ("cat dog", "catdog"), ("1", "l"), ("“a”", '"a"'), ("²", "2")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert form(a) != form(b)


def test_edges():
    assert form(None) is None and form("") == form(" \u200b ") == "" and form("x" * 10**6) == "x" * 10**6
    assert form(form("закpыл Τhe ﬁ")) == form("закpыл Τhe ﬁ")
    assert scripts_of("o") >= {"Latin", "Cyrillic", "Greek"} and scripts_of("ж") == {"Cyrillic"} and "Jpan" in scripts_of("二") & scripts_of("つ")


def test_the_consistent_script_is_chosen():
    assert form("зaкрыл") == "закрыл" and form("Тhey") == "They"


CLEAN = [
    "一つ", "二人は", "力がある", "口に", "二人", "カタカナ", "ローカル", "ヘリ", "学校へ行く", "センター前", "二千", "カニ", "ハエ", "工場と八百屋", "トラック二台",
    "слово сор", "The cat sat", "Λόγος και ρυθμός", "שלום סוס", "سلام هو", "한국어 漢字", "ニュース", "größer", "Ноев ковчег", "一", "夕べ", "索引和车站！",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert consistent(text) == text


@pytest.mark.parametrize("text", CLEAN[:15] + CLEAN[16:17] + CLEAN[20:23])
def test_the_key_of_clean_text_reads_as_it_stands(text):
    import unicodedata

    assert unicodedata.normalize("NFC", form(text)) == text


def test_mixed_tokens_are_respelled():
    assert consistent("Τhe сat ｶﾞｲﾄﾞ cafe\u0301\u200b") == "The cat ガイド café" and consistent("закpыл") == "закрыл"
    assert consistent(None) is None and consistent("") == consistent(" \u200b") == ""
    assert form("ꓐOOꓗ") == form("BOOK") and form("ⲥⲟp") == form("cop")


def test_tangle():
    assert [tangle(x) for x in ("закpыл", "сор", "cop", None, "Tokyo東京")] == ["mixed", "whole", "plain", "plain", "plain"]


def test_pairs(spark):
    q = spark.createDataFrame([(1, "Τhe cat"), (1, "Τhe cat"), (2, "The cat"), (3, None), (4, " "), (5, "\u200b")], "query_id bigint, q string")
    s = spark.createDataFrame([(0, 1, 0, "The cat"), (0, 1, 0, "The cat"), (0, 1, 1, None), (0, 1, 2, ""), (0, 1, 3, "THE CAT")], "seg int, doc_id int, sent_id int, sent string")
    q, s = q.withColumn("form", F.lit("z")).withColumn("sent", F.lit("z")), s.withColumn("q", F.lit("z")).withColumn("form", F.lit(1))
    assert [tuple(r) for r in read_alike(q, s).collect()] == [(1, 0, 1, 0)]
    brute = {
        (a["query_id"], b["seg"], b["doc_id"], b["sent_id"])
        for a in q.collect() for b in s.collect()
        if a["q"] and b["sent"] and form(a["q"]) and form(a["q"]) == form(b["sent"]) and a["q"] != b["sent"]
    }
    assert brute == {(1, 0, 1, 0)}
