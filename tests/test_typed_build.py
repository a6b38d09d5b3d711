"""New indexes read each document by its type."""

from leafmill import cli
from leafmill.operators import index as ix
from leafmill.queries import QUERIES

MULTI = (
    "From: ann@a.example\nSubject: =?utf-8?b?w4lsYW4=?=\nContent-Type: multipart/mixed; boundary=x\n\n"
    "--x\nContent-Type: text/plain\n\nPlain leaf. It ends.\n--x\nContent-Type: text/html\n\n<p class=c>Web &amp; leaf</p>\n--x--\n"
)
ROWS = [
    (1, "<script>var q;</script><p class=c>A page &amp; more</p>", "H"), (2, "Subject: One\n\nBody here. Twice.", "E"),
    (3, MULTI, "E"), (4, "a. b\nc", "C"), (5, "One. Two.", "T"), (6, None, "E"), (7, "x", None),
]
WANT = [
    ["A page & more"], ["One", "Subject: One", "Body here.", "Twice."], ["Élan", "From: ann@a.example", "Subject: Élan"],
    ["Plain leaf.", "It ends."], ["Web & leaf"], ["a. b", "c"], ["One.", "Two."], [], ["x"],
]


def test_typed_build(spark, table_dir):
    rows = [(k, t, None, None, kind, f"/d/{k}", 5) for k, t, kind in ROWS]
    d = table_dir(spark, documents=(rows, "doc_id bigint, text string, lang string, source string, doctype string, loc string, mtime int"))
    got = {}
    for r in QUERIES["build_sents_typed"](spark, d).orderBy("doc_id", "sent_id").collect():
        got.setdefault(r["doc_id"], []).append(r["sent"])
    assert got == {k: s for k, s in enumerate(WANT, 1) if s}
    words = {r["kind"]: r["terms"] for r in QUERIES["build_postings_typed"](spark, d).collect()}
    assert words["word"] == len({w for s in WANT for x in s for w in ix_words(spark, x)})
    docs = spark.createDataFrame([(r[5], r[1], r[4], 5) for r in rows], "loc string, text string, doctype string, mtime int")
    info = ix.build(docs, ["loc"], doctype="doctype")["docinfo"].orderBy("doc_id").collect()
    assert [r["loc"] for r in info] == ["/d/1", "/d/2", "/d/3", "/d/3", "/d/3", "/d/4", "/d/5", "/d/6", "/d/7"]


def ix_words(spark, sent):
    df = spark.createDataFrame([(1, 0, sent)], "doc_id int, sent_id int, sent string")
    return [r["term"] for r in ix.postings_of(df, ["doc_id"]).where("kind = 'word'").collect()]


def test_make_mails(spark, tmp_path, capsys):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.eml").write_text(MULTI)
    cli.main(["make", f"file://{tmp_path}/i", f"file://{tmp_path}/m", "-t", "E"], spark)
    capsys.readouterr()
    for word in ("leaf", "ann"):
        cli.main(["search", f"file://{tmp_path}/i", word], spark)
        assert "Not found" not in capsys.readouterr().out
