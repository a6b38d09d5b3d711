import random

from pyspark.sql import functions as F

from leafmill.llm.leakage import bloom, contains, leaked, least_shared, least_words, on_a_diagonal, passes
from leafmill.llm.words import shingles, word_ids
from leafmill.llm.words import words


def vocabulary(n=3000):
    return [f"w{k}" for k in range(n)]


def brute(item, doc):
    """Least edits of any passage of at least half the item against any place of the document."""
    n, m = len(item), least_words(len(item))
    for s in range(n - m + 1):
        row = [0] * (len(doc) + 1)
        for k in range(s, n):
            new = [row[0] + 1]
            for j, d in enumerate(doc):
                new.append(min(row[j] + (d != item[k]), row[j + 1] + 1, new[j] + 1))
            row = new
            size = k - s + 1
            if size >= m and min(row) <= size / 10:
                return True
    return False


def test_contains_like_brute_force():
    rnd, vocab, agree, n = random.Random(4), vocabulary(), 0, 0
    for _ in range(250):
        item = rnd.choices(vocab, k=rnd.randint(12, 40))
        part = rnd.choice([0.3, 0.45, 0.55, 0.8, 1.0])
        size = max(1, round(part * len(item)))
        start = rnd.randint(0, len(item) - size)
        piece = item[start : start + size]
        for _ in range(rnd.choice([0, 1, 2, len(piece) // 10, len(piece) // 5])):
            k = rnd.randrange(len(piece))
            piece[k : k + 1] = rnd.choice([[rnd.choice(vocab)], [], [piece[k], rnd.choice(vocab)]])
            if not piece:
                piece = ["x"]
        doc = rnd.choices(vocab, k=rnd.randint(0, 30)) + piece + rnd.choices(vocab, k=rnd.randint(0, 30))
        n += 1
        agree += contains(item, doc) == brute(item, doc)
    assert agree >= 0.99 * n


def test_order_matters_and_quotes_are_no_case():
    item = vocabulary(40)
    shuffled = item[:]
    random.Random(1).shuffle(shuffled)
    assert not contains(item, shuffled) and not contains(item, item[:12]) and contains(item, item[10:31])
    assert contains(["a"], ["b", "a"]) and not contains([], ["a"]) and not contains(["a"], [])


def test_bound_is_necessary():
    for n in range(10, 120):
        m = least_words(n)
        for p in range(m, n + 1):
            assert least_shared(n, n - 4) <= max(1, p - 4 - 5 * (p // 10))


def test_the_bound_of_position_loses_nothing():
    rnd, vocab = random.Random(6), vocabulary()
    for _ in range(300):
        item = rnd.choices(vocab, k=rnd.randint(12, 60))
        piece = item[: rnd.randint(least_words(len(item)), len(item))]
        for _ in range(len(piece) // 10):
            k = rnd.randrange(len(piece))
            piece[k : k + 1] = rnd.choice([[rnd.choice(vocab)], [], [piece[k], rnd.choice(vocab)]])
        doc = rnd.choices(vocab, k=9) + piece + rnd.choices(vocab, k=9)
        k = min(5, least_words(len(item)))
        hs, ds = shingles(word_ids(item), k).tolist(), shingles(word_ids(doc), k).tolist()
        where = {}
        for i, h in enumerate(hs):
            where.setdefault(h, []).append(i)
        need = least_shared(len(item), len(where), k)
        if contains(item, doc):
            assert on_a_diagonal(where, need, len(item), ds, range(len(ds)))
    spread = [x for i in range(0, 40, 5) for x in item[i : i + 5] + rnd.choices(vocab, k=30)]
    ds = shingles(word_ids(spread), 5).tolist()
    assert not on_a_diagonal(where, max(need, 3), len(item), ds, range(len(ds)))


def test_filter(spark):
    import numpy as np

    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    f = bloom(spark.createDataFrame([(int(x),) for x in h[:2500]], "h bigint"))
    assert passes(h[:2500], f).all() and passes(h[2500:], f).mean() < 0.05
    tiny = bloom(spark.createDataFrame([(int(x),) for x in h[:2500]], "h bigint"), 1024)
    assert len(tiny) == 16 and passes(h[:2500], tiny).all()


def test_words():
    assert words("> The <b>Cat</b>,\n* Ｓａｔ &amp; 図書") == ["the", "cat", "sat", "図", "書"]
    assert words("2024-01-02 03:04:05 INFO One\n12. two") == ["one", "two"] and words(None) == words("...") == []


def test_frame(spark):
    rnd = random.Random(2)
    item = " ".join(rnd.choices(vocabulary(), k=30))
    rows = [
        (1, "Head. " + item + " tail"), (1, "Head. " + item + " tail"), (2, item.upper().replace(" ", ",\n> ")), (3, " ".join(item.split()[:9])),
        (4, None), (5, ""), (6, "図書館で会議をした。" * 3), (7, " ".join(rnd.choices(vocabulary(), k=4000)) + " " + item),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit(1))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "図書館で会議をした。"), (6, "!")], "item_id bigint, text string")
    items = items.withColumn("n", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, leaked(docs, items).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (6, 5), (7, 1), (7, 2)]
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0


def test_hot_passage_keeps_all_rows(spark):
    rnd = random.Random(8)
    item = " ".join(rnd.choices(vocabulary(), k=25))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(item)).otherwise(F.lit("other words are here now")).alias("text"))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert leaked(docs, items).count() == 1000
