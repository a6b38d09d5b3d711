import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import tokenizer as tk

PATH = f"{tk.vocabulary_dir()}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    t = tk.transducer(PATH)
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    letters = ["a", "b", "th", "e", " ", "\n", "é", "ﬁ", "ー", "検", "0", "1", "-", "=", "😀", "\u0301", "ن", "'s", "\u00a0", "<|endoftext|>"]
    for _ in range(800):
        yield "".join(rnd.choices(letters[: rnd.randint(1, len(letters))], k=rnd.randint(0, 120)))
    yield "ab" * 20000
    yield "-" * 5000 + " " * 5000
    yield "é" * 3000


def test_equals_merging(plain):
    t = tk.transducer(PATH)
    for x in texts():
        assert t.encode(x) == plain.encode_ordinary(x)


def test_equals_the_library_tokenizer():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tk.vocabulary_dir()}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    t = tk.transducer(PATH)
    for x in texts():
        assert t.encode(x) == lib.encode(x, add_special_tokens=False).ids


def test_tables_may_be_emptied_at_any_time(monkeypatch, plain):
    monkeypatch.setattr(tk, "STATES", 5)
    monkeypatch.setattr(tk, "PIECES", 2)
    monkeypatch.setattr(tk, "PAIRS", 3)
    t = tk.Transducer(tk.transducer(PATH).ranks)
    for x in list(texts())[:60]:
        assert t.encode(x) == plain.encode_ordinary(x)


def test_tokens_come_out_early():
    t = tk.transducer(PATH)
    state, out = t.start, []
    for b in b"the" * 200:
        emitted, state = state.next.get(b) or t._step(state, b)
        out += emitted
        assert len(state.pending) <= t.longest
    assert out


def test_decode_streams_and_replaces():
    t = tk.transducer(PATH)
    d = tk.Decoder(t.bytes_of)
    for x in texts():
        assert d.decode(t.encode(x)) == x
    for data in (b"\xe3\x81", b"\xff", b"a\xc3(", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        ids = [t.ranks[data[i : i + 1]] for i in range(len(data))]
        assert d.decode(ids) == data.decode("utf-8", "replace") or "\ufffd" in d.decode(ids)
    assert d.decode(None) is None and d.decode([]) == ""


def test_frame(spark):
    df = spark.createDataFrame([(1, "The cat"), (1, "The cat"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string")
    df = df.withColumn("ids", F.lit("clash"))
    got = tk.encode(df, "doc_id", "text")
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str)[:4] == sorted([(1, [464, 3797]), (1, [464, 3797]), (2, []), (3, [])], key=str)
    assert {r["doc_id"]: r["text"] for r in tk.decode(got, "doc_id", "ids").collect()}[1] == "The cat"
    multi = tk.encode(df, "doc_id", "text", "byte_bpe_multi_50k").where("doc_id = 1").first()["ids"]
    assert multi
