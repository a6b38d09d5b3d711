"""Readers, upkeep, versions, stores, deliveries and streams on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as ft
from leafmill.operators import incremental as inc
from leafmill.operators import index as ix
from leafmill.operators import segments as sg
from leafmill.operators import versions as vs
from leafmill.operators.numbering import number, with_previous
from leafmill.sources import corpus, readers, store


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<html><body></body></html>", [""]),
        ("<html><body>a</body></html>", ["a"]),
        ("<html><style>foo</style>a</body></html>", ["a"]),
        ("<html>&amp;a</html>", ["&a"]),
        ("<body><p>abc<p>def</html>", ["", "abc", "def"]),
        ("<body>abc\ndef</body>", ["abc\ndef"]),
        ("<pre>abc\ndef</pre>", ["", "abc\n", "def", ""]),
        ('<p>abc\n<img src="foo" alt="baa">', ["", "abc\n[baa]"]),
        ("a<!-- x -> b", ["a b"]),
        ("&EACUTE;&nosuch;&#65;&#x42", ["é&nosuch;AB"]),
        ("<p a='>'>x", ["", "x"]),
        ("x <a <b>y</b>", ["x y"]),
        ("<![CDATA[<p>]]>", ["<p>"]),
        ("", [""]),
    ],
)
def test_html_blocks(page, blocks):
    assert readers.html_blocks(page) == blocks


MULTI = """From: a@b
Subject: =?utf-8?b?44GC?=
Date: Mon, 02 Jan 2023 03:04:05 +0100
Message-ID: <1@x>
In-Reply-To: <0@x>
References: <9@x> <0@x>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain

one
--B
Content-Type: text/html

<p>two</p>
--B--
"""


def test_mail():
    m = readers.mail(MULTI)
    assert m["title"] == "あ" and m["date"] == 1672625045
    assert m["headers"][0] == "From: a@b" and m["msgid"] == ["1@x"] and m["ref"] == ["9@x", "0@x"]
    assert [(p, k, t.strip()) for p, k, t in m["parts"]] == [(1, "text/plain", "one"), (2, "text/html", "<p>two</p>")]
    assert readers.mail(None) is None
    assert readers.mail("Date: never\n\nx")["date"] == 0 and readers.mail("")["headers"] == []


def test_mail_frames(spark):
    df = spark.createDataFrame([(1, MULTI, 5), (2, None, None), (3, "", 7)], "id int, text string, mtime int")
    assert readers.mail_features(df, "id", "text").count() == 4
    assert {r["id"]: r["mtime"] for r in readers.mail_info(df, "id", "text", "mtime").collect()} == {1: 1672625045, 2: 0, 3: 7}
    assert readers.mail_parts(df, "id", "text").where("id = 1").count() == 2


def test_typed_sents(spark):
    rows = [(1, "a. b\nc", "T"), (2, "a. b\nc", "C"), (3, "<p>x</p>y", "H"), (4, "Subject: s\n\nbody. more", "E"), (5, None, None), (6, "q", None)]
    df = spark.createDataFrame(rows, "id int, text string, t string")
    got = {}
    for r in readers.sents_of(df, ["id"], "text", "t").collect():
        got.setdefault(r["id"], {})[r["sent_id"]] = r["sent"]
    assert got == {1: {0: "a.", 1: "b", 2: "c"}, 2: {0: "a. b", 1: "c"}, 3: {0: "x", 1: "y"}, 4: {0: "s", 1: "Subject: s", 2: "body.", 3: "more"}, 6: {0: "q"}}


def test_registry():
    assert corpus.reader("tar") is corpus.archive and readers.doctype("T") is ix.plain_sents
    with pytest.raises(ValueError):
        corpus.reader("nothing")
    with pytest.raises(ValueError):
        readers.doctype("nothing")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    row = corpus.files(spark, f"file://{tmp_path}", "x-nothing", titled=True).select("*", readers.decoded("content", "encoding").alias("t")).first()
    assert (row["title"], row["t"], row["size"]) == ("a.txt", "é", 1)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Ａ　b", "図書館 x_1 図", "abc"), (None, None, None)], "a string, b string, c string")
    got = df.select(
        ft.stored(F.col("a")), ft.words(F.col("b")), ft.grams(F.col("b")), ft.key_hash(F.col("c")), ft.hex_id(F.lit(255)),
        ft.date_terms(F.lit(1672625045)), ft.date_terms(F.lit(0)),
    ).collect()
    assert tuple(got[0]) == ("A b", ["x_1"], ["図書", "書館", "図"], 193409669, "000000ff", ["2023", "2023/01", "2023/01/02"], [])
    assert got[1][0] is None and got[1][3] is None


def test_numbering_ties_and_empty(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") % 10).alias("k"), "id")
    got = number(df, "k", "id").orderBy("k", "id").collect()
    assert [r["number"] for r in got] == list(range(1000))
    assert number(df.limit(0), "id").count() == 0
    prev = with_previous(df, ["k"], ["id"], "id", "before").where("before is null").count()
    assert prev == 10


def test_build_and_write(spark, tmp_path):
    rows = [("b", "One two. Three", 5, ["x", "x", None, ""]), ("a", None, 0, None), ("c", "", None, [])]
    docs = spark.createDataFrame(rows, "loc string, text string, mtime int, labels array<string>").withColumn("seg", F.lit(9))
    tables = ix.build(docs, ["loc"], labels="labels", per_segment=2)
    assert sorted((r["seg"], r["doc_id"], r["loc"]) for r in tables["docinfo"].collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]
    assert tables["postings"].where("kind = 'label'").count() == 1
    assert tables["postings"].where("kind = 'word'").count() == 3
    ix.write(tables, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx/sents")).count() == 2


def test_title_first_and_cap(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", " T "), (2, "a\nb", None)], "id int, text string, title string")
    got = ix.number_sents(df, ["id"], ix.line_sents(F.col("text")), F.col("title"), most=2).orderBy("id", "sent_id").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 0, "T"), (1, 1, "a"), (2, 0, "a"), (2, 1, "b")]


def test_merge_groups():
    assert sg.merge_groups([(0, 1500, 1), (1, 600, 1), (2, 10, 1)]) == [[0, 1], [2]]
    assert sg.merge_groups([]) == []


def test_update_modes(spark):
    docinfo = spark.createDataFrame([(0, 1, 5, "a"), (1, 1, 9, "a"), (0, 2, 5, None)], "seg int, doc_id int, mtime int, loc string")
    segs = spark.createDataFrame([(0, "x.cdb"), (1, "y.cdb"), (2, None)], "seg int, fname string")
    found = spark.createDataFrame([("a", 8), ("a", 9), ("b", None)], "loc string, mtime int")
    take = lambda m: sorted((r["loc"], r["mtime"] or 0) for r in sg.candidates(found, docinfo, segs, m).collect())
    assert take("F") == [("a", 8), ("a", 9), ("b", 0)] and take("N") == [("b", 0)] and take("U") == [("a", 9), ("b", 0)]
    with pytest.raises(ValueError):
        take("X")


def snaps(spark, rows):
    return spark.createDataFrame(rows, "tid string, aid string, name string, size int, mtime int, data string")


def test_versions(spark):
    one = snaps(spark, [])
    new = lambda rows: spark.createDataFrame(rows, "pos int, aid string, label string, mtime int, data string")
    one = one.unionByName(vs.create(one, new([(0, None, "abc", 1, "text1")])))
    for k in (2, 3):
        one = one.unionByName(vs.modify(one, new([(0, "00000000", None, k, f"mod{k}"), (1, "ffffffff", None, k, "lost")])))
    one = one.unionByName(one)
    assert {r["tid"]: r["next"] for r in vs.chain(one).collect()} == {"00000000": "00000002", "00000001": "00000000", "00000002": "00000001"}
    assert [r["tid"] for r in vs.history(one, "00000000").orderBy("place").collect()] == ["00000002", "00000001", "00000000"]
    assert vs.latest(one).first()["data"] == "mod3" and vs.unmodified(one).count() == 0
    assert vs.validate(one, vs.chain(one)).count() == 0
    assert one.select(vs.labels(F.col("name")).alias("l")).where("l = 'abc'").count() == 2
    assert vs.find_articles(one.select("tid"), one).first()["tid"] == "00000002"


def test_kv(spark):
    kv = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "a", "é->3"), (4, None, "x")], "seq int, key string, value string")
    assert sorted(map(tuple, store.get(kv, kv.select("key")).collect())) == [("a", "1"), ("b", "2")]
    assert store.range_from(kv, "b").count() == 3 and store.range_from(kv, "zz").count() == 0
    text = store.dump_text(kv.where("key is not null"))
    assert text.orderBy("seq").first()["line"] == "+1,1:a->1"
    assert sorted(map(tuple, store.load_text(text).collect())) == [(1, "a", "1"), (2, "b", "2"), (3, "a", "é->3")]
    assert store.load_text(spark.createDataFrame([(1, "+9,1:a->1"), (2, "x"), (3, None)], "seq int, line string")).count() == 0


def test_trie(spark):
    t = spark.createDataFrame([(["a"], "1"), (["a", "b"], "2"), (["x", "y"], "3")], "path array<string>, value string")
    assert store.trie_lookup(t, t.select("path")).count() == 2
    assert store.trie_orphans(t).count() == 1 and store.trie_below(t, ["a"]).count() == 2 and store.trie_below(t, []).count() == 3


def test_layout_equals_a_plain_fold(spark):
    import random

    rnd = random.Random(5)
    sizes = [rnd.choice([0, 1, 511, 512, 513, 3000, 90000]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "recno bigint, size bigint").repartition(9)
    idx = at = 0
    want = []
    for k, s in enumerate(sizes):
        if at >= 20480:
            idx, at = idx + 1, 0
        want.append((k, idx, at))
        at += 512 * (1 + -(-s // 512))
    assert sorted(map(tuple, store.layout(df, 20480).collect())) == want
    assert store.layout(df.limit(0)).count() == 0


def test_fixed(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "c")], "recno int, record string")
    assert store.fixed(df, 3).where("recno = 0").first()["record"] == "ab "
    assert store.record_at(df, -1).first()["record"] == "c"
    with pytest.raises(Exception, match="longer"):
        store.fixed(df, 1).collect()


def ts(s):
    return dt.datetime(2023, 1, 1) + dt.timedelta(seconds=s)


RAW = "rec_id bigint, loc string, content binary, mtime int, seen_at timestamp, crc int"


def test_pending(spark):
    import zlib

    crc = lambda b: zlib.crc32(b)
    raw = spark.createDataFrame(
        [
            (1, "a", b"x", 1, ts(1), 0), (2, "a", b"y", 0, ts(2), 0), (2, "a", b"y", 0, ts(2), 0), (3, "a", None, 5, ts(3), 0),
            (4, "b", b"x", 1, ts(1), 0), (9, "b", b"z", 1, ts(1), 0), (5, "c", b"", 1, None, 0), (6, None, b"q", 1, ts(1), 0),
            (7, "d", b"old", 1, ts(1), 0), (8, "e", b"t", 1, ts(1), 0),
        ],
        RAW,
    )
    docinfo = spark.createDataFrame(
        [(0, 1, "a", crc(b"y")), (1, 1, "b", crc(b"x")), (0, 2, "d", crc(b"new")), (1, 2, "d", crc(b"old")), (2, 1, "e", crc(b"t")), (0, 3, None, 1)],
        "seg int, doc_id int, loc string, crc bigint",
    )
    segs = spark.createDataFrame([(0, "a.cdb"), (1, "b.cdb"), (2, "c.cdb.tmp"), (3, None)], "seg int, fname string")
    assert sorted(map(tuple, inc.pending(raw, docinfo, segs).collect())) == [("b", 9), ("c", 5), ("e", 8)]
    assert inc.pending(raw.limit(0), docinfo, segs).count() == 0
    assert inc.pending(raw, docinfo.limit(0), segs.limit(0)).count() == 5


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    log = inc.RunLog(spark, str(tmp_path / "log"))
    first = spark.createDataFrame([(1, "a", b"1", 0, ts(10), 0), (2, "b", b"2", 0, ts(20), 0)], RAW)
    batch = log.next_batch(first)
    assert batch.count() == 2
    # A transaction opened at 15 is still open when the run ends, so the next reads from 15.
    log.commit(1, batch, ts(15))
    late = spark.createDataFrame([(3, "c", b"3", 0, ts(16), 0), (4, "a", b"new", 0, ts(30), 0)], RAW)
    both = first.unionByName(late)
    assert sorted(r["rec_id"] for r in log.next_batch(both).collect()) == [3, 4]
    # A run that breaks off after its ledger, before its mark, counts for nothing.
    log.next_batch(both).select(F.lit(2).cast("bigint").alias("run_id"), "loc", "crc").write.mode("append").parquet(f"{log.path}/ledger")
    assert sorted(r["rec_id"] for r in log.next_batch(both).collect()) == [3, 4]
    log.commit(3, log.next_batch(both), ts(31))
    assert log.next_batch(both).count() == 0


def test_runs_survive_failures(spark, tmp_path):
    log = inc.RunLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(1, "a", b"old", 0, None, 0), (2, "a", b"new", 0, ts(5), 0), (3, "b", b"x", 0, ts(6), 0)], RAW)
    rows.write.parquet(str(tmp_path / "raw"))
    read = lambda: spark.read.schema(RAW).parquet(str(tmp_path / "raw"))
    batch = log.next_batch(read())
    # What arrives between the batch and its commit isn't marked as processed.
    spark.createDataFrame([(4, "c", b"late", 0, ts(7), 0)], RAW).write.mode("append").parquet(str(tmp_path / "raw"))
    log.commit(1, batch, ts(7))
    assert sorted(r["rec_id"] for r in batch.collect()) == [2, 3]
    # An older delivery without seen_at is reread, but doesn't displace the newer one that was processed.
    assert [r["rec_id"] for r in log.next_batch(read()).collect()] == [4]
    # A broken run and its retry under the same number count once.
    log.next_batch(read())
    again = inc.RunLog(spark, log.path)
    retry = again.next_batch(read())
    again.commit(2, retry, ts(8))
    assert again.next_batch(read()).count() == 0 and again.ledger().where("loc = 'c'").count() == 1
    other, both = log.next_batch(read()), log.next_batch(read())
    with pytest.raises(inc.Conflict):
        log.commit(2, other, ts(9))
    log.commit(3, other, ts(8))
    with pytest.raises(inc.Conflict):
        log.commit(4, both, ts(8))  # took the same deliveries as run 3
    with pytest.raises(ValueError):
        log.commit(5, read(), ts(9))
    # Back to an earlier version is a change; the compacted ledger says the same.
    spark.createDataFrame([(5, "a", b"old", 0, ts(9), 0)], RAW).write.mode("append").parquet(str(tmp_path / "raw"))
    log.compact(6)
    assert [m["run_id"] for m in log.marks()] == [6] and log.runs().count() == 1
    assert [r["rec_id"] for r in log.next_batch(read()).collect()] == [5]
    assert log.next_batch(read().limit(0)).count() == 0


def test_stream_appends_segments(spark, tmp_path):
    from leafmill.streaming.append import append_stream, read_index

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "loc string, text string, mtime int"
    for k in range(2):
        spark.createDataFrame([(f"d{k}", "The harbor. Again", 5), (f"e{k}", None, 0)], schema).coalesce(1).write.mode("append").parquet(src)
        append_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    tables = read_index(spark, out)
    assert tables["segments"].count() == 2 and tables["docinfo"].count() == 4
    assert tables["postings"].where("term = 'harbor'").count() == 2


def test_small_measures(spark):
    from leafmill.session import small

    df = spark.range(100)
    assert "Hint broadcast" in small(df)._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" not in small(df, limit=10)._jdf.queryExecution().logical().toString()


def test_the_package_is_shipped_once(spark):
    from leafmill.session import ship

    ship(spark)
    files = spark.sparkContext.listFiles
    ship(spark)
    assert sum("leafmill.zip" in f for f in files) == 1 and spark.sparkContext.listFiles == files


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    from leafmill.session import shared_dir

    def session(master, conf=None):
        return Some(conf=Some(get=lambda *_: conf), sparkContext=Some(master=master, getCheckpointDir=lambda: None))

    assert shared_dir(session("local[4]")).startswith("file://") and shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "spark://a:1", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
