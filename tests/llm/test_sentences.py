import pytest
from pyspark.sql import functions as F

from leafmill.llm.sentences import Model, learn, sentences, split
from leafmill.session import table

from ..conftest import DATA


def cut(text, model=None, lang="en"):
    return [text[a - 1 : b] for a, b in split(text, model or Model(), lang)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three? four.", ["One.", "Two!", "Three? four."]),
        ("It cost 3.14 now. Ok.", ["It cost 3.14 now.", "Ok."]),
        ("Head\n\nBody\nwraps. End", ["Head", "Body\nwraps.", "End"]),
        ("Head\r\n\r\nBody\r\nwraps.", ["Head", "Body\r\nwraps."]),
        ("* one\n* two. Three", ["* one", "* two. Three"]),
        ("1) one\n2) two", ["1) one", "2) two"]),
        ("am\n26. mai war es.", ["am\n26. mai war es."]),
        ('He said "One. Two." Then left.', ['He said "One. Two."', "Then left."]),
        ('"Go now!" she said. Ok.', ['"Go now!" she said.', "Ok."]),
        ("All be. (It is so. Yes.) End.", ["All be.", "(It is so. Yes.)", "End."]),
        ("Wait... no. Wait... Yes.", ["Wait... no.", "Wait...", "Yes."]),
        ("一つ。二つ！三つ", ["一つ。", "二つ！", "三つ"]),
        ("「行く。来る。」と言った。次", ["「行く。来る。」と言った。", "次"]),
        ("「行く。来る。」次の文。", ["「行く。来る。」", "次の文。"]),
        ("“走了。”小明说。好。", ["“走了。”小明说。", "好。"]),
        ("今日は．明日は３．５", ["今日は．", "明日は３．５"]),
        ("ใกล้แม่น้ำ ตอนเช้า", ["ใกล้แม่น้ำ", "ตอนเช้า"]),
        ("सुबह है। शाम है?", ["सुबह है।", "शाम है?"]),
        ("ظهر السوق. وصل؟ نعم", ["ظهر السوق.", "وصل؟", "نعم"]),
        ("«Да?» — спросил он. Нет.", ["«Да?» — спросил он.", "Нет."]),
        ("¿Qué? ¡Sí! No.", ["¿Qué?", "¡Sí!", "No."]),
        ("", []), (" \n ", []), (None, []), ("...", ["..."]), ("(open. Never closed", ["(open.", "Never closed"]),
    ],
)
def test_rules(text, want):
    assert cut(text) == want if text is not None else split(text, Model()) == []


def test_every_character_once():
    text = "A b c. D «e. f» g! (h. i.) J\n\n* k\n* l\n\n二。“三。”四 5.6 Dr. x"
    seen = set()
    for a, b in split(text, Model(), "en"):
        assert not text[a - 1].isspace() and not text[b - 1].isspace()
        assert seen.isdisjoint(range(a, b + 1))
        seen |= set(range(a, b + 1))
    assert all(text[k - 1].isspace() for k in set(range(1, len(text) + 1)) - seen)


def test_long_text():
    assert len(cut("(" * 50000 + "]" * 50000 + " all. Bee")) == 2
    assert len(cut('"' * 30001 + " a.\n\nB")) == 2
    assert len(cut("One is here. " * 20000)) == 20000


def test_abbreviations_are_learned(spark):
    names = ["Alba", "Bero", "Cali", "Dono", "Emil", "Faro"]
    words = ["house", "river", "garden", "letter"]
    texts = []
    for k in range(120):
        n, w = names[k % 6], words[k % 4]
        texts.append(f"Dr. {n} saw the {w}! The {w} was old, and dr. {n} left. A {w} is a {w}. The others saw Dr. {n}; the {w} fell at 5 a.m. The end was near. {n} and Dr. {names[(k + 1) % 6]} saw {n}, then {n} left it.")
    df = spark.createDataFrame([(str(i), t, "en") for i, t in enumerate(texts)], "docid string, doctext string, lang string")
    model = learn(df)
    assert "dr" in model.abbreviations["en"] and "house" not in model.abbreviations["en"]
    assert cut("Dr. Bero left. The end.", model) == ["Dr. Bero left.", "The end."]


def test_frame(spark):
    rows = [("a", "One. Two", "en"), ("a", "One. Two", "en"), ("b", None, None), (None, "Three", None), ("c", " ", "xx")]
    df = spark.createDataFrame(rows, "docid string, doctext string, lang string").withColumn("start_pos", F.lit(1)).withColumn("word", F.lit("x"))
    got = sorted(map(tuple, sentences(df, "docid", "doctext", "lang", learn(df)).collect()), key=str)
    assert got == [("a", 1, 4), ("a", 6, 8), (None, 1, 5)]


def test_real_texts_lose_nothing(spark):
    docs = table(spark, DATA, "doctexts", "docid", "doctext", "lang")
    got = sentences(docs, "docid", "doctext", "lang", learn(docs))
    marks = F.length(F.regexp_replace("doctext", r"\s", ""))
    inside = got.join(docs.distinct(), "docid").select(
        "docid", marks.alias("all"), F.length(F.regexp_replace(F.expr("substring(doctext, start_pos, end_pos - start_pos + 1)"), r"\s", "")).alias("n")
    )
    assert inside.groupBy("docid", "all").agg(F.sum("n").alias("n")).where("n <> all and abs(n - all) > 3").count() == 0


def test_unlabelled_texts_teach(spark):
    """Without labels, under a label of another script, and beside a Chinese word, abbreviations are learned."""
    full = "The clerk met Prof. Varn in the town and the house of Prof. Lund. We saw the other clerk on the way. "
    plain = "The boxes of the town are in the house and the clerk is on the way. We saw them."
    for rows in (
        [(full * 30, None)],
        [(full * 30, " ")],
        [(full * 30, "ja"), (plain, "en")],
        [(full * 30, None), (plain * 5, "en"), ("Der Weg in die Stadt ist lang und das Haus ist klein.", "de")],
        [((full + "The mark 词典 stood there. ") * 30, "en")],
    ):
        model = learn(spark.createDataFrame(rows, "doctext string, lang string"))
        assert any("prof" in words for words in model.abbreviations.values()), rows[0][1]
        assert cut("We met Prof. Varn in the town. The way is long.", model, rows[0][1]) == ["We met Prof. Varn in the town.", "The way is long."]


def test_whole_paragraph_and_long_words_count(spark):
    m = Model()
    m.profile["en"], m.profile["de"] = {"the", "of"}, {"der", "und"}
    assert m.language("the of " * 100 + "der und " * 300, None) == "de"
    text = "The clerk saw sections. 3 and the house saw sections. 4 on the way. " * 40
    got = learn(spark.createDataFrame([(text + "We met the clerk and 5 of them in sections there.", "en")], "doctext string, lang string"))
    assert "sections" in got.numbered["en"] | got.mixed["en"]


def test_abbreviations_that_end_sentences_sometimes(spark):
    """A title before names, at the start of sentences too, isn't ended by being a street elsewhere; initials go on."""
    texts = []
    for k in range(60):
        a, b = ("Varn", "Lund", "Holm", "Berg", "Falk", "Dahl")[k % 6], ("clerk", "house", "garden", "letter")[k % 4]
        texts.append(f"The {b} was sold by St. {a} on the way! A {b} stood at 7 Main St. The {b} was old, and a {b} fell, as it was old to the {b}. {a} saw it. It was sold to st. {a}.")
    model = learn(spark.createDataFrame([(t, "en") for t in texts], "doctext string, lang string"))
    assert cut("St. Varn sold the house. He lived at 7 Main St. The house fell.", model) == ["St. Varn sold the house.", "He lived at 7 Main St.", "The house fell."]
    assert cut("It fell! K. A. Varn saw it.", model) == ["It fell!", "K. A. Varn saw it."]


def test_a_plain_word_ends_a_sentence_before_lower_case(spark):
    text = "We saw the garden of the clerk. iMark was old. The garden is near. A garden was here, approx. ten of them. It was approx. nine. We saw approx. two. The garden. eBee was new."
    model = learn(spark.createDataFrame([(text * 20, "en")], "doctext string, lang string"))
    assert cut("This is a garden. eBee was new.", model) == ["This is a garden.", "eBee was new."]
    assert cut("It was approx. ten.", model) == ["It was approx. ten."]


def test_a_model_too_large_to_broadcast_gives_the_same(spark):
    docs = table(spark, DATA, "doctexts", "docid", "doctext", "lang")
    whole, parted = learn(docs), learn(docs, limit=10)
    assert parted.pieces is not None and not parted.abbreviations
    rows = lambda m: sorted(map(str, sentences(docs, "docid", "doctext", "lang", m).collect()))
    assert rows(whole) == rows(parted)


def test_languages_of_one_script_are_told_apart(spark):
    ru, uk = "это было в городе и на реке не так как у нас ", "це було у місті та на річці не так як у нас "
    rows = [(ru * 30 + "Мы жили на ул. Новой.", "ru"), (uk * 30 + "Ми жили на вул. Новій.", "uk"), ("Как это было у нас", None), ("Як це було та у місті", "ru")]
    model = learn(spark.createDataFrame(rows, "doctext string, lang string"))
    assert model.language("это было в городе", None) == "ru" and model.language("це було у місті та", None) == "uk"
    assert model.language("це було у місті та на річці", "ru") == "uk" and model.language("Слово", None) in ("ru", "uk")
