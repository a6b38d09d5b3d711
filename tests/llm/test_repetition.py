import itertools

from pyspark.sql import functions as F

from leafmill.llm.repetition import LIMIT, RULES, cascade, repeated, share

UNIQUE = " ".join(f"word{k} thing{k * 7}" for k in range(40))


def test_shares():
    assert share(None) == share("") == share("... !") == 0
    assert share(UNIQUE) == 0
    assert abs(share("alpha beta gamma delta. " * 4) - 0.75) < 1e-9
    assert share("One.\nTwo.\nOne.\n") > 0.3  # a short line that comes again
    assert share("a b c a b d a b e") == 0  # three words are no phrase
    assert abs(share("図書館で会議をしました" + "、" + "図書館で会議をしました") - 0.5) < 1e-9
    assert share("図書館で図書館で") < 0.51 and share("Alpha, BETA gamma-delta! alpha beta gamma delta") == 0.5


def test_against_marking_by_hand():
    text = f"{UNIQUE}\n\nthe same four words {UNIQUE.upper()}"
    assert share(text) > 0.45


def test_order_of_rules_never_matters():
    for text in ("One two three four. Five. One two three four five. Five.\nFive.", UNIQUE * 2, "a\nb\na\nb\nc d e f g c d e f g"):
        assert len({round(share(text, p), 9) for p in itertools.permutations(RULES)}) == 1
        assert len({share(text, p, LIMIT) > LIMIT for p in itertools.permutations(RULES)}) == 1


def test_long_text():
    assert share(" ".join(f"w{k}" for k in range(200_000))) == 0


def test_frame(spark):
    rows = [(1, UNIQUE), (2, "spam words come again " * 9), (2, "spam words come again " * 9), (3, None), (4, ""), (None, "x y z w x y z w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("share", F.lit("z"))
    assert set(cascade(df, "doc_id", "text")) == set(RULES)
    assert sorted((r["doc_id"] or 0) for r in repeated(df, "doc_id", "text", LIMIT).collect()) == [0, 2, 2]
    assert repeated(df, "doc_id", "text").count() == 6 and repeated(df.limit(0), "doc_id", "text", LIMIT).count() == 0
