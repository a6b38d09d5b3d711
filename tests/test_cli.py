"""The command line end to end on a few files."""

from pyspark.sql import functions as F

from leafmill import cli
from leafmill.plans import query as ql
from leafmill.sources import store


def said(capsys, *argv, spark):
    cli.main(list(argv), spark)
    return capsys.readouterr().out


def test_make_search_merge(spark, tmp_path, capsys):
    files, index, out = tmp_path / "files", f"file://{tmp_path}/idx", f"file://{tmp_path}/merged"
    files.mkdir()
    for k in range(5):
        (files / f"f{k}.txt").write_text(f"The harbor number {k}. It is old.\nCatalog line")
    at = f"file://{files}"
    assert said(capsys, "make", index, at, "-D", "2", spark=spark).strip() == "3"
    assert said(capsys, "make", index, at, "-m", "N", spark=spark).strip() == "0"
    got = said(capsys, "search", index, "harbor", "-n", "2", "-a", spark=spark)
    assert got.count("<b>harbor</b>") == 2 and "5 documents" in got
    token = next(x for x in got.splitlines() if x.startswith("#")).split()[1]
    more = said(capsys, "search", index, "harbor", "-n", "9", "-c", token, spark=spark)
    assert more.count("<b>harbor</b>") == 3
    assert said(capsys, "search", index, "nowhere", spark=spark).startswith("Not found.")
    assert "Not found" not in said(capsys, "search", index, "nowhere", "old", "-D", "-T", "60", spark=spark)
    assert said(capsys, "merge", index, out, spark=spark).strip() == "1"
    assert said(capsys, "search", out, "harbor", spark=spark).count("<b>") == 5
    assert "sent 0 1 0" in said(capsys, "dump", index, spark=spark)
    assert said(capsys, "grams", index, spark=spark).splitlines()[0].split("\t")[1]
    assert len(said(capsys, "info", index, spark=spark).splitlines()) == 3 and said(capsys, "sents", index, spark=spark)


def test_versions(spark, tmp_path, capsys):
    rows = [("00000000", "00000000", "0000000000000000.gz", 1, 1, "a"), ("00000001", "00000000", "0000000100000000.gz", 1, 2, "b")]
    spark.createDataFrame(rows, "tid string, aid string, name string, size int, mtime int, data string").write.parquet(f"{tmp_path}/t")
    table = f"{tmp_path}/t"
    assert said(capsys, "snapshots", table, spark=spark).splitlines() == ["00000000\t00000001", "00000001\t00000000"]
    assert len(said(capsys, "snapshots", table, "00000000", spark=spark).splitlines()) == 2
    assert said(capsys, "articles", table, spark=spark).strip() == "00000000"
    assert said(capsys, "latest", table, spark=spark).split("\t")[1] == "00000001"


def test_readings():
    any_of, preds = ql.parse_readings("sakura")
    assert any_of and preds[1].every[0][0] == "yomi"
    assert ql.parse_readings("sakura hana")[0] is False and len(ql.parse_readings("sakura hana")[1]) == 2
    assert ql.parse_readings("xq sakura")[1][0].every == (("word", "xq"),)
    assert ql.parse_readings("") == (False, [])


def test_recover(spark):
    e = spark.createDataFrame([(k, bytearray(b"x" * 700)) for k in range(20)], "recno bigint, data binary")
    right = store.rescan(e, 4096)
    broken = right.where("recno <> 3").withColumn("code", F.when(F.col("recno") == 5, "0").otherwise(F.col("code")))
    assert sorted(r["recno"] for r in store.validate(broken, right).collect()) == [3, 5]
    fixed = store.recover(broken, e, 4096)
    assert store.validate(fixed, right).count() == 0 and fixed.where("was is null").count() == 1


def docs_of(spark, *locs):
    rows = [(x, f"The harbor of {x}. It is old.", 5, None, None) for x in locs]
    return spark.createDataFrame(rows, "loc string, text string, mtime int, labels array<string>, title string")


def hits(spark, path):
    from leafmill.operators import search as se

    rows = se.search(cli.open_index(spark, path), ql.parse("harbor")).collect()
    return sorted(r["loc"] for r in rows), sorted((r["seg"], r["doc_id"]) for r in rows)


def test_a_broken_run_leaves_nothing(spark, tmp_path, monkeypatch):
    from leafmill.operators import shelf

    path = f"file://{tmp_path}/idx"
    assert cli.make(spark, docs_of(spark, "l1"), path) == 1
    with monkeypatch.context() as m:
        m.setattr(shelf.Shelf, "_finish", lambda *a: 1 / 0)
        try:
            cli.make(spark, docs_of(spark, "l2", "l2b"), path)
        except ZeroDivisionError:
            pass
    assert cli.make(spark, docs_of(spark, "l3"), path) == 1
    assert hits(spark, path) == (["l1", "l3"], [(0, 1), (1, 1)])
    book = shelf.Shelf(spark, path)
    assert len(book.cleanup()) == 1 and hits(spark, path)[0] == ["l1", "l3"]
    # Starting over replaces the old segments.
    assert cli.make(spark, docs_of(spark, "n1"), path, "R") == 1
    assert hits(spark, path) == (["n1"], [(0, 1)])
    # Of two runs from the same state one publishes.
    base, other = book.version(), shelf.Shelf(spark, path)
    book._publish(base, book.runs())
    try:
        other._publish(base, [])
        raise AssertionError
    except shelf.Conflict:
        pass
    assert cli.make(spark, docs_of(spark).limit(0), path) == 0


def test_merge_in_place(spark, tmp_path):
    from leafmill.operators.shelf import Shelf

    path = f"file://{tmp_path}/idx"
    for locs in (("a", "b"), ("b", "c"), ("d",)):
        cli.make(spark, docs_of(spark, *locs), path, "F", per_segment=1)
    cli.make(spark, docs_of(spark, "z"), path, "F", prefix="new")
    assert cli.merge(spark, path, docs=2, cleanup=True) == 3
    assert hits(spark, path)[0] == ["a", "b", "c", "d", "z"]
    book = Shelf(spark, path)
    assert len(book.runs()) == 1 and {r["prefix"] for r in book.index().segments.collect()} == {"idx", "new"}
    assert sum(r["ndocs"] for r in book.index().segments.collect()) == 5
    assert [(r["seg"], r["doc_id"]) for r in book.index().docinfo.orderBy("seg", "doc_id").collect()][0] == (0, 1)


def test_sentences_and_documents_are_not_shuffled(spark, tmp_path):
    """Also where static estimates say that nothing can be broadcast."""
    import re

    from leafmill.operators import search as se

    path = f"file://{tmp_path}/idx"
    cli.make(spark, docs_of(spark, *"abcdefgh"), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = se.search(cli.open_index(spark, path), ql.parse("harbor old"))
        assert df.count() == 8
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    shuffled = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert shuffled and not any("sent#" in x for x in shuffled)


def test_readings_from_text(spark, tmp_path, capsys):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("新しい図書館の本。\nショップ")
    (tmp_path / "d.tsv").write_text("図書館\tとしょかん\n本\tほん\n本\tもと\n")
    index = f"file://{tmp_path}/i"
    said(capsys, "make", index, f"file://{tmp_path}/f", "-Y", f"file://{tmp_path}/d.tsv", spark=spark)
    for text, there in (("toshokan", True), ("kanno", True), ("nohon", True), ("nomoto", True), ("sho", True), ("hoto", False)):
        assert ("Not found" not in said(capsys, "search", index, text, "-Y", spark=spark)) == there, text
    assert ql.reading_pairs(None, {}) == [] and ql.reading_pairs("明後日は", {"明": ["みょう"], "後": ["ご"], "日": ["にち", "じつ"], "明後日": ["あさって"]}) == sorted(
        ["みょ", "ょう", "うご", "ごに", "ごじ", "にち", "じつ", "ちは", "つは", "あさ", "さっ", "って", "ては"]
    )


def test_stores(spark, tmp_path, capsys):
    say = lambda *a: said(capsys, *a, spark=spark).splitlines()
    (tmp_path / "kv.txt").write_text("+1,1:a->1\n+1,2:b->22\n+1,1:a->3\nnothing\n")
    kv = f"{tmp_path}/kv"
    say("kv", "make", kv, f"file://{tmp_path}/kv.txt")
    assert say("kv", "get", kv, "b", "x") == ["b\t22"] and len(say("kv", "dump", kv)) == 3
    say("kv", "merge", f"{tmp_path}/kv2", kv, kv)
    assert say("kv", "get", f"{tmp_path}/kv2", "b") == ["b\t22 22"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("one")
    tar = f"{tmp_path}/tar"
    say("tar", "add", tar, f"file://{tmp_path}/in")
    say("tar", "add", tar, f"file://{tmp_path}/in")
    assert [x.split("\t")[:2] for x in say("tar", "ls", tar)] == [["0", "x.txt"], ["1", "x.txt"]]
    assert say("tar", "get", tar, "00000001") == ["x.txt\tone"]
    say("tar", "recover", tar)
    assert say("tar", "validate", tar) == []
    cms = f"{tmp_path}/cms"
    say("cms", "create", cms, "The harbor")
    say("cms", "create", cms, "A catalog", "tag")
    say("cms", "modify", cms, "00000000", "The old harbor")
    assert say("cms", "get", cms, "00000000") == ["The old harbor"]
    assert say("cms", "find", cms, "harbor") == ["00000000\t00000002"] and say("cms", "find", cms, "label:tag") == ["00000001\t00000001"]
    say("cms", "recover", cms)
    assert say("cms", "validate", cms) == []


def test_chain_recovery(spark):
    from leafmill.operators import versions as vs

    rows = spark.createDataFrame([("00000000", "00000000", "0000000000000000.gz", 1, 1, "a"), ("00000001", "00000000", "0000000100000000.gz", 1, 2, "b")], cli._ARTICLES)
    broken = vs.chain(rows).where("tid = '00000000'").withColumn("next", F.lit("ffffffff"))
    got = {r["tid"]: (r["next"], r["was"]) for r in vs.recover(rows, broken).collect()}
    assert got == {"00000000": ("00000001", "ffffffff"), "00000001": ("00000000", None)}


def test_limits_are_parameters(spark):
    from leafmill.operators import index as ix
    from leafmill.sources import readers

    df = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(100_010)))], "id int, text string")
    assert ix.number_sents(df, ["id"], ix.line_sents(F.col("text"))).count() == 100_010
    assert ix.number_sents(df, ["id"], ix.line_sents(F.col("text")), most=ix.MOST_SENTS).count() == ix.MOST_SENTS
    long = "Subject: s\n\n" + "x" * 1_200_000
    assert len(readers.mail(long)["parts"][0][2]) == 1_200_000 and len(readers.mail(long, readers.MAIL_BYTES)["parts"][0][2]) == 1_000_000 - 12


def test_strict_headers():
    p = ql.parse('subject:a+b', strict=True)[0]
    assert p.exact and p.start == "^(?:subject):" and p.pattern == ql.strict_pattern("a+b")
