"""Documents to sentences, sentences to postings, and statistics of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import CJK, date_terms, grams, stored, words
from leafmill.operators.numbering import number, with_previous
from leafmill.plans.query import reading_pairs
from leafmill.session import BROADCAST_BYTES

#: Sentences of a document that the original tool keeps, documents of a segment.
MOST_SENTS, SEGMENT_DOCS = 100_000, 1000


def plain_sents(text: Column) -> Column:
    """Sentences of plain text: a mark before a blank ends one, and so does a line."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+|\n", "$1\x01"), "\x01")


def line_sents(text: Column) -> Column:
    """One sentence a line, as for source code."""
    return F.split(text, "\n")


def number_sents(docs: DataFrame, keys: list[str], sents: Column, title: Column | None = None, most: int | None = None) -> DataFrame:
    """(keys, sent_id, sent): dense numbers from 0; the title comes first if there is one.

    Sentences are stored in one width with blanks collapsed; empty ones take no
    number. Null texts have no sentences. With ``most`` the rest of a longer
    document is left out, as the original tool does at ``MOST_SENTS``.
    """
    kept = F.filter(F.transform(sents, stored), lambda s: s != "")
    if title is not None:
        head = stored(title)
        kept = F.when(F.coalesce(head, F.lit("")) != "", F.concat(F.array(head), F.coalesce(kept, F.array()))).otherwise(kept)
    kept = kept if most is None else F.slice(kept, 1, most)
    return docs.select(*keys, F.posexplode(kept).alias("sent_id", "sent"))


def postings_of(sents: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, term, keys, sent_id): distinct words and grams of each sentence."""
    pair = lambda kind, terms: F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    both = F.concat(pair("word", words(F.col("sent"))), pair("gram", grams(F.col("sent"))))
    return sents.select(*keys, "sent_id", F.explode(both).alias("t")).select("t.kind", "t.term", *keys, "sent_id")


def reading_postings(sents: DataFrame, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """(kind, term, keys, sent_id): pairs of morae that sentences may be read with, by a dictionary (word, reading).

    Every word of the dictionary that stands in a sentence lends its readings,
    kana read as they stand. Pairs run inside a reading and from the end of
    one to the start of those that may follow. Null rows of the dictionary
    don't count. The dictionary travels with the tasks; it is that of a
    language, and its measured size is bounded by ``BROADCAST_BYTES``.
    """
    words = dictionary.select("word", "reading").where("word <> '' and reading <> ''").distinct()
    size = words.select(F.sum(F.octet_length("word") + F.octet_length("reading") + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"the dictionary takes {size} bytes, more than {BROADCAST_BYTES}")
    known: dict[str, list[str]] = {}
    for w, r in words.collect():
        known.setdefault(w, []).append(r)
    pairs = F.udf(lambda text: reading_pairs(text, known), "array<string>")
    texts = sents.where(F.col("sent").rlike(f"[{CJK}]"))
    return texts.select(F.lit("yomi").alias("kind"), F.explode(pairs("sent")).alias("term"), *keys, "sent_id")


def feature_postings(docs: DataFrame, keys: list[str], labels: Column | None = None, mtime: Column | None = None) -> DataFrame:
    """(kind, term, keys, sent_id): labels and dates of documents, at sentence 0."""
    pair = lambda kind, terms: F.transform(
        F.filter(terms, lambda t: t.isNotNull() & (t != "")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))
    )
    parts = []
    if labels is not None:
        parts.append(pair("label", F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))))
    if mtime is not None:
        parts.append(pair("date", date_terms(mtime)))
    return docs.select(*keys, F.explode(F.concat(*parts)).alias("t")).select(
        "t.kind", "t.term", *keys, F.lit(0).alias("sent_id")
    )


def parts(docs: DataFrame, order: list[str], text: str = "text", loc: str = "loc", mtime: str = "mtime", labels: str | None = None, title: str | None = None,
          lines: Column | None = None, per_segment: int = SEGMENT_DOCS, doctype: str | None = None, most: int | None = None, readings: DataFrame | None = None,
          first: int = 0) -> dict[str, DataFrame]:
    """Tables docinfo, sents and features of a new index over ``docs``, and ``yomi``, postings of readings, if given a dictionary.

    Documents are numbered in ``order``; every ``per_segment`` of them make a
    segment, from number ``first`` on, in which doc_ids start at 1. ``lines``
    is true for documents that are read line by line; with ``doctype``, a
    column, each is read by its type instead, and text leaves of multipart
    mails are documents of their own with the mail's loc, right after it.
    ``most`` bounds the sentences of a document; there is no bound by default.
    A bound on a segment's terms isn't needed, since nothing is held in memory
    until a segment is full.
    """
    kept = list(dict.fromkeys([*order, text, loc, mtime, *(c for c in (labels, title, doctype) if c)]))
    if doctype:
        from leafmill.sources.readers import sents_of, with_leaves

        docs = with_leaves(docs.select(*kept), text, doctype)
        order, kept = [*order, "part"], [*kept, "part"]
    flag = F.coalesce(lines, F.lit(False)) if lines is not None else F.lit(False)
    rows = number(docs.select(*kept, flag.alias("_lines")), *order, name="_n")
    rows = rows.select(
        "*",
        (F.floor(F.col("_n") / per_segment) + first).cast("int").alias("seg"),
        (F.col("_n") % per_segment + 1).cast("int").alias("doc_id"),
    )
    keys = ["seg", "doc_id"]
    if doctype:
        sents = sents_of(rows, keys, text, doctype, title, most)
    else:
        cut_text = F.when(F.col("_lines"), line_sents(F.col(text))).otherwise(plain_sents(F.col(text)))
        sents = number_sents(rows, keys, cut_text, F.col(title) if title else None, most)
    out = {
        "docinfo": rows.select(*keys, F.col(mtime).alias("mtime"), F.col(loc).alias("loc")),
        "sents": sents,
        "features": feature_postings(rows, keys, F.col(labels) if labels else None, F.col(mtime)),
    }
    if doctype:
        from leafmill.sources.readers import mail_ids

        ids = rows.where((F.upper(doctype) == "E") & (F.col("part") == 0)).select(*keys, F.explode(mail_ids(F.col(text))).alias("t"))
        out["features"] = out["features"].unionByName(ids.select("t.kind", "t.term", *keys, F.lit(0).alias("sent_id")))
    if readings is not None:
        out["readings"] = readings
    return out


def _all_postings(sents: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    keys = ["seg", "doc_id"]
    postings = postings_of(sents, keys).unionByName(made["features"])
    return postings.unionByName(reading_postings(sents, keys, made["readings"])) if "readings" in made else postings


def build(docs: DataFrame, order: list[str], **options) -> dict[str, DataFrame]:
    """Tables docinfo, sents, postings and segments of a new index over ``docs``; the options are those of ``parts``."""
    made = parts(docs, order, **options)
    postings = _all_postings(made["sents"], made)
    return {"docinfo": made["docinfo"], "sents": made["sents"], "postings": postings, "segments": index_info(made["docinfo"], postings)}


def save(spark: SparkSession, made: dict[str, DataFrame], path: str) -> None:
    """Write the tables of ``parts`` under ``path``; postings are made from the written sentences, so no text is cut twice."""
    write_sorted({"docinfo": made["docinfo"], "sents": made["sents"]}, path)
    sents = spark.read.schema("seg int, doc_id int, sent_id int, sent string").parquet(f"{path}/sents")
    write_sorted({"postings": _all_postings(sents, made)}, path)


def write_sorted(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet under ``path``, sorted by what scans ask for, so that they skip row groups.

    Postings are parted by range of all their columns, so a hot term spreads
    over tasks. Documents and sentences keep the parts they come in, which
    hold ranges of documents; there is no folder per segment.
    """
    for name, df in tables.items():
        if name == "postings":
            df = df.repartitionByRange("kind", "term", "seg", "doc_id", "sent_id")
            df = df.sortWithinPartitions("kind", "term", F.desc("seg"), F.desc("doc_id"), F.desc("sent_id"))
        elif name == "segments":
            df = df.coalesce(1)
        else:
            df = df.sortWithinPartitions(*[c for c in ("seg", "doc_id", "sent_id") if c in df.columns])
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


write = write_sorted


def index_info(docinfo: DataFrame, postings: DataFrame) -> DataFrame:
    """(seg, ndocs, nterms): distinct documents, and distinct terms with features, of each segment."""
    docs = docinfo.groupBy("seg").agg(F.count_distinct("doc_id").alias("ndocs"))
    # Distinct terms first, so that a term of very many rows is combined where it stands.
    terms = postings.select("seg", "kind", "term").distinct().groupBy("seg").agg(F.count("*").alias("nterms"))
    return docs.join(terms, "seg", "left").fillna(0, ["nterms"])


def gram_counts(postings: DataFrame) -> DataFrame:
    """(term, n): length of each text term's posting lists over all segments."""
    rows = postings.select("kind", "term", "seg", "doc_id", "sent_id").where(F.col("kind").isin("word", "gram")).distinct()
    return rows.groupBy("term").agg(F.count("*").alias("n"))


def sent_stats(sents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_sents, n_chars): sentences and characters without blanks of each document."""
    rows = sents.select(*keys, "sent_id", "sent").distinct()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_sents"), F.sum(F.length(F.regexp_replace("sent", r"\s", ""))).alias("n_chars")
    )


def posting_list(postings: DataFrame, kind: str, term: str) -> DataFrame:
    """(seg, doc_id, sents): a term's list by document, both descending; ``sents`` joins the numbers."""
    rows = postings.where((F.col("kind") == kind) & (F.col("term") == term)).select("seg", "doc_id", "sent_id").distinct()
    sents = F.array_join(F.transform(F.sort_array(F.collect_list("sent_id"), False), lambda x: x.cast("string")), ",")
    return rows.groupBy("seg", "doc_id").agg(sents.alias("sents"))


def out_of_order(postings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of stored posting lists that aren't smaller than the one before; needs ``pos``, the stored place."""
    rows = postings.select("kind", "term", "seg", "doc_id", "sent_id", "pos")
    rows = rows.withColumn("_at", F.struct("seg", "doc_id", "sent_id"))
    before = with_previous(rows, keys or ["kind", "term"], ["pos", "doc_id", "sent_id"], "_at", "_before")
    return before.where(F.col("_before") <= F.col("_at")).drop("_at", "_before")


def dump(docinfo: DataFrame, sents: DataFrame, postings: DataFrame) -> DataFrame:
    """(key, value) of everything an index holds, as text."""
    doc = docinfo.distinct().select(F.format_string("doc %d %d", "seg", "doc_id").alias("key"), F.concat_ws(" ", "mtime", "loc").alias("value"))
    sent = sents.distinct().select(F.format_string("sent %d %d %d", "seg", "doc_id", "sent_id").alias("key"), F.col("sent").alias("value"))
    post = postings.distinct().groupBy("kind", "term", "seg").agg(F.count("*").alias("n"))
    post = post.select(F.concat_ws(" ", "kind", "term", "seg").alias("key"), F.col("n").cast("string").alias("value"))
    return doc.unionByName(sent).unionByName(post)


def estimated_terms(counts: Column) -> Column:
    """Terms to expect in a union: each list adds what exceeds a quarter of the terms so far."""
    step = lambda r, n: r + F.greatest(n - F.floor(r * 0.25), F.lit(0).cast("bigint"))
    return F.aggregate(counts, F.lit(0).cast("bigint"), step)
