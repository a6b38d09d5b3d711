from collections import defaultdict

from pyspark.sql import functions as F

from leafmill.llm import frequency as fr


def test_against_counting(spark):
    rows = [("word", f"t{(i * i) % 97}" if i % 3 else "hot", i % 4, i % 50, i % 7) for i in range(3000)]
    rows += rows[:500] + [("word", None, 0, 1, 0), ("word", "", 0, 1, 0), (None, "nokind", 0, 1, 0)]
    df = spark.createDataFrame(rows, "kind string, term string, seg int, doc_id int, sent_id int")
    occ, recs = defaultdict(set), defaultdict(set)
    for r in rows:
        if r[1]:
            occ[r[1]].add(r)
            recs[r[1]].add(r[2:4])
    got = {r["term"]: (r["occurrences"], r["records"]) for r in fr.term_frequency(df, "term", ["seg", "doc_id"]).collect()}
    assert got == {t: (len(occ[t]), len(recs[t])) for t in occ}


def test_dictionary_is_dense_and_ordered(spark):
    terms = spark.range(0, 20000, 1, 5).select(F.format_string("w%05d", "id").alias("term"))
    got = fr.dictionary(terms).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(20000)) and [r["term"] for r in got] == sorted(r["term"] for r in got)


def test_arrays_pass_on_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fr, "HELD", 2)
    monkeypatch.setattr(fr, "RANGE", 4)
    rows = [pa.RecordBatch.from_pydict({"id": i, "n": n}) for i, n in (([0, 5, 9], [1, 2, 3]), ([0, 13], [4, 5]))]
    laid = pa.Table.from_batches(fr._lay(iter(rows))).sort_by("range").combine_chunks()
    assert laid.num_rows == 5  # the first range twice, as the arrays were passed on in between
    out = pa.Table.from_batches(fr._sum(iter(laid.to_batches(max_chunksize=2)))).to_pylist()
    assert {r["id"]: (r["occ"], r["recs"]) for r in out} == {0: (5, 2), 5: (2, 1), 9: (3, 1), 13: (5, 1)}


def test_marks(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "term string, occurrences bigint, records bigint")
    assert {r["term"]: r["mark"] for r in fr.mark(df, 10).collect()} == {"a": "rare", "b": None, "c": "common"}
