"""Command line over an index folder of Parquet tables: ``python -m leafmill COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import index as ix
from leafmill.operators import search as se
from leafmill.operators import segments as sg
from leafmill.operators import versions as vs
from leafmill.operators.shelf import Shelf
from leafmill.plans import query as ql
from leafmill.operators.numbering import number
from leafmill.session import local_session
from leafmill.sources import corpus, readers, store
from leafmill.sources.publish import exists

def open_index(spark: SparkSession, path: str, prefix: str = "") -> se.Index:
    """The index under a folder, all of its segments."""
    return Shelf(spark, path).index(prefix)


def make(spark: SparkSession, docs: DataFrame, path: str, mode: str = "U", prefix: str = "idx", doctype: str = "T", per_segment: int = ix.SEGMENT_DOCS, **build) -> int:
    """Index documents (loc, text, mtime, labels, title) that ``mode`` takes; gives how many segments were added."""
    return Shelf(spark, path).make(docs, mode, prefix, doctype, per_segment, **build)


def merge(spark: SparkSession, path: str, out: str | None = None, docs: int = sg.MERGE_DOCS, terms: int = sg.MERGE_TERMS, cleanup: bool = False) -> int:
    """Merge the segments of an index in place or into a new folder; gives the number of segments then."""
    return Shelf(spark, path).merge(Shelf(spark, out) if out else None, docs, terms, cleanup)


def _add(df: DataFrame, at: str) -> None:
    """Append rows to a table of its own writer."""
    df.write.mode("append").parquet(at)


def _kv_load(spark: SparkSession, at: str, *texts: str) -> None:
    lines = spark.read.text(list(texts)).withColumnRenamed("value", "line")
    store.load_text(number(lines, "line", name="seq")).write.parquet(at)


def _kv_merge(spark: SparkSession, at: str, *tables: str) -> None:
    each = [spark.read.parquet(t).select(F.lit(i).alias("source"), "seq", "key", "value") for i, t in enumerate(tables)]
    number(store.merge_values(reduce(DataFrame.unionByName, each)), "key", name="seq").write.parquet(at)


#: Commands on key-value tables (seq, key, value).
_KV = {
    "make": _kv_load,
    "get": lambda spark, at, *keys: store.get(spark.read.parquet(at), spark.createDataFrame([(k,) for k in keys], "key string")),
    "dump": lambda spark, at: store.dump_text(spark.read.parquet(at)).orderBy("seq").select("line"),
    "merge": _kv_merge,
}


def _entries(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("recno bigint, name string, mtime int, data binary").parquet(at)


def _tar_add(spark: SparkSession, at: str, files: str) -> None:
    new = corpus.files(spark, files, titled=True).select(F.col("title").alias("name"), "mtime", F.col("content").alias("data"))
    old = _entries(spark, at) if exists(spark, at) else spark.createDataFrame([], "recno bigint, name string, mtime int, data binary")
    _add(store.append(old, new, "name").select("recno", "name", "mtime", "data"), at)


def _catalog(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}.catalog")


#: Commands on archives (recno, name, mtime, data), with a catalog beside.
_TAR = {
    "add": _tar_add,
    "ls": lambda spark, at: _entries(spark, at).select("recno", "name", "mtime", F.octet_length("data").alias("size")).orderBy("recno"),
    "get": lambda spark, at, *locs: store.archive_get(_entries(spark, at), spark.createDataFrame([(x,) for x in locs], "loc string"))
    .select("name", F.decode("data", "utf-8").alias("text")),
    "recover": lambda spark, at: store.rescan(_entries(spark, at)).write.mode("overwrite").parquet(f"{at}.catalog"),
    "validate": lambda spark, at: store.validate(_catalog(spark, at), store.rescan(_entries(spark, at))),
}

_ARTICLES = "tid string, aid string, name string, size int, mtime int, data string"


def _articles(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(_ARTICLES).parquet(at) if exists(spark, at) else spark.createDataFrame([], _ARTICLES)


def _snapshot(spark: SparkSession, at: str, of, *row) -> None:
    new = spark.createDataFrame([(0, *row, int(time.time()))], "pos int, aid string, label string, data string, mtime int")
    _add(of(_articles(spark, at), new), at)


def _cms_find(spark: SparkSession, at: str, *terms: str) -> DataFrame:
    rows = _articles(spark, at)
    tables = ix.build(vs.snapshot_documents(rows), ["loc"], labels="labels")
    segments = tables["segments"].withColumn("fname", F.format_string("idx%05d.cdb", "seg"))
    return vs.find(se.Index(tables["postings"], tables["sents"], tables["docinfo"], segments), ql.parse(" ".join(terms)), rows)


#: Commands on tables of versioned articles.
_CMS = {
    "create": lambda spark, at, data, label=None: _snapshot(spark, at, vs.create, None, label, data),
    "modify": lambda spark, at, aid, data, label=None: _snapshot(spark, at, vs.modify, aid, label, data),
    "get": lambda spark, at, aid: vs.latest(_articles(spark, at)).where(F.col("aid") == aid).select("data"),
    "find": _cms_find,
    "recover": lambda spark, at: vs.chain(_articles(spark, at)).write.mode("overwrite").parquet(f"{at}.chain"),
    "validate": lambda spark, at: vs.validate(_articles(spark, at), spark.read.parquet(f"{at}.chain")),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("make", help="index the files of a folder")
    a.add_argument("index")
    a.add_argument("files")
    a.add_argument("-m", "--mode", choices="FUNR", default="U")
    a.add_argument("-p", "--prefix", default="idx")
    a.add_argument("-t", "--doctype", choices="TCHE", default="T")
    a.add_argument("-e", "--encoding")
    a.add_argument("-D", "--docs", type=int, default=ix.SEGMENT_DOCS)
    a.add_argument("-Y", "--readings", help="dictionary of tab-separated words and readings, whose readings are indexed too")
    a.add_argument("-S", "--sentences", type=int, help="most sentences of a document")
    a = sub.add_parser("search", help="search an index")
    a.add_argument("index")
    a.add_argument("terms", nargs="+")
    a.add_argument("-D", "--any", action="store_true", help="one term is enough")
    a.add_argument("-s", "--strict", action="store_true")
    a.add_argument("-Y", "--readings", action="store_true")
    a.add_argument("-p", "--prefix", default="")
    a.add_argument("-n", type=int, default=10)
    a.add_argument("-T", "--timeout", type=float)
    a.add_argument("-a", "--stats", action="store_true")
    a.add_argument("-c", "--token", help="go on after a saved place")
    a = sub.add_parser("merge", help="merge segments into a new folder")
    a.add_argument("index")
    a.add_argument("out", nargs="?")
    a.add_argument("-C", "--cleanup", action="store_true", help="remove runs that no longer count")
    a.add_argument("-D", "--docs", type=int, default=sg.MERGE_DOCS)
    a.add_argument("-T", "--terms", type=int, default=sg.MERGE_TERMS)
    for name in ("dump", "grams", "sents", "info"):
        sub.add_parser(name).add_argument("index")
    for name in ("snapshots", "articles", "latest"):
        a = sub.add_parser(name, help="of a table of versioned articles")
        a.add_argument("table")
        if name == "snapshots":
            a.add_argument("aid", nargs="?")
    for store_, commands in (("kv", _KV), ("tar", _TAR), ("cms", _CMS)):
        a = sub.add_parser(store_)
        a.add_argument("what", choices=commands)
        a.add_argument("table")
        a.add_argument("rest", nargs="*")
    args = p.parse_args(argv)
    spark = spark or local_session()

    def show(df: DataFrame, sep: str = "\t") -> int:
        # Rows stream to the caller part by part.
        for r in df.toLocalIterator():
            print(sep.join("" if x is None else str(x) for x in r))
        return 0

    if args.command == "make":
        raw = corpus.files(spark, args.files, args.encoding, titled=True)
        docs = raw.select("loc", readers.decoded("content", "encoding").alias("text"), "mtime", "labels", "title")
        words = args.readings and spark.read.csv(args.readings, sep="\t", schema="word string, reading string")
        print(make(spark, docs, args.index, args.mode, args.prefix, args.doctype, args.docs, readings=words, most=args.sentences))
    elif args.command == "search":
        index, text = open_index(spark, args.index, args.prefix), " ".join(args.terms)
        any_of, preds = ql.parse_readings(text, strict=args.strict) if args.readings else (args.any, ql.parse(text, strict=args.strict))
        began = time.time()

        def run():
            found = se.page(se.search(index, preds, any_of=any_of), args.n, args.token)
            return se.order(se.with_snippets(index, found, preds)).collect()

        if args.timeout:
            from leafmill.streaming.append import within

            rows = within(spark, args.timeout, run)
        else:
            rows = run()
        for r in rows:
            print(f"{r['loc']}\t{r['mtime']}\t{r['title'] or ''}\n  {r['snippet']}")
        if rows:
            print("#", ql.save_token(rows[-1]["fname"], rows[-1]["doc_id"], len(rows)))
        else:
            print("Not found.")
        if args.stats:
            print(f"# {time.time() - began:.2f} s, {sg.total_docs(index.segments).first()[0]} documents")
    elif args.command == "merge":
        print(merge(spark, args.index, args.out, args.docs, args.terms, args.cleanup))
    elif args.command in ("kv", "tar", "cms"):
        command = {"kv": _KV, "tar": _TAR, "cms": _CMS}[args.command][args.what]
        got = command(spark, args.table, *args.rest)
        return 0 if got is None else show(got)
    elif args.command in ("dump", "grams", "sents", "info"):
        i = open_index(spark, args.index)
        return show({
            "dump": lambda: ix.dump(i.docinfo, i.sents, i.postings),
            "grams": lambda: ix.gram_counts(i.postings).orderBy(F.desc("n"), "term"),
            "sents": lambda: ix.sent_stats(i.sents, ["seg", "doc_id"]),
            "info": lambda: ix.index_info(i.docinfo, i.postings).orderBy("seg"),
        }[args.command]())
    else:
        rows = spark.read.parquet(args.table)
        return show({
            "snapshots": lambda: vs.history(rows, args.aid) if args.aid else vs.chain(rows).orderBy("tid"),
            "articles": lambda: vs.articles(rows).orderBy("aid"),
            "latest": lambda: vs.latest(rows).drop("data").orderBy("aid"),
        }[args.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
