"""Corpora: tables of (loc, content, mtime, size, title, labels, encoding), whatever they are kept in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.store import archive_corpus

COLUMNS = ("loc", "content", "mtime", "size", "title", "labels", "encoding")


def corpus(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` as a corpus; what isn't given is taken by name or null. Per-location hooks are such columns.

    A 0 or missing mtime stays 0, which is unknown.
    """
    kinds = dict(zip(COLUMNS, ("string", "binary", "int", "bigint", "string", "array<string>", "string")))
    out = []
    for name, kind in kinds.items():
        c = columns.get(name, F.col(name) if name in rows.columns else F.lit(None))
        out.append((F.coalesce(c.cast(kind), F.lit(0)) if name == "mtime" else c.cast(kind)).alias(name))
    return rows.select(*out)


def files(spark: SparkSession, path: str, encoding: str | None = None, titled: bool = False, pattern: str | None = None) -> DataFrame:
    """Files under a folder; with ``titled`` the title is the file's name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    return corpus(
        rows, loc=F.col("path"), mtime=F.unix_timestamp("modificationTime"), size=F.col("length"),
        encoding=F.lit(encoding), title=F.regexp_extract("path", r"[^/]+$", 0) if titled else F.lit(None),
    )


def key_values(kv: DataFrame, encoding: str | None = None) -> DataFrame:
    """A key-value table (key, value): the key is the location, the first value counts, the mtime is unknown."""
    rows = kv.groupBy("key").agg(F.min_by("value", "seq").alias("value")) if "seq" in kv.columns else kv
    return corpus(rows, loc=F.col("key"), content=F.col("value").cast("binary"), size=F.octet_length("value"), encoding=F.lit(encoding))


def database(rows: DataFrame, key: str = "docid", text: str = "doctext", mtime: str = "mtime") -> DataFrame:
    """A table of documents in a database, by default columns docid, doctext and mtime; texts are UTF-8."""
    return corpus(
        rows, loc=F.col(key), content=F.encode(F.col(text), "utf-8"), mtime=F.col(mtime), size=F.octet_length(text), encoding=F.lit("utf-8")
    )


def jdbc(spark: SparkSession, url: str, dbtable: str = "documents", key: str = "docid", text: str = "doctext", mtime: str = "mtime", **options: str) -> DataFrame:
    """Documents of a JDBC source; partition options pass through."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    return database(rows, key, text, mtime)


def archive(entries: DataFrame) -> DataFrame:
    """Entries of an archive; locations are record numbers in hex."""
    return corpus(archive_corpus(entries))


def packed_archive(entries: DataFrame) -> DataFrame:
    """Entries of an archive whose data is gzip."""
    return corpus(archive_corpus(entries, packed=True))


#: Corpora by the name that tools know them by.
REGISTRY: dict[str, Callable] = {
    "fs": files, "filesystem": files, "tar": archive, "tgz": packed_archive, "kv": key_values, "sql": database, "jdbc": jdbc,
}


def reader(name: str) -> Callable:
    """The reader of a registered corpus."""
    try:
        return REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown corpus {name!r}; known are {', '.join(sorted(REGISTRY))}") from None
