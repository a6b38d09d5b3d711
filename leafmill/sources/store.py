"""Key-value files, tries, fixed records and append-only archives as tables."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from leafmill.functions.text import from_hex
from leafmill.operators.numbering import number
from leafmill.session import cut

#: Bytes at which an archive file is followed by the next, and bytes of its blocks.
ROTATE, BLOCK = 10 << 20, 512


# --- constant key-value tables: (seq, key, value); keys may repeat


def get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value): first value of each asked key that is there."""
    first = kv.join(keys.select("key").distinct(), "key", "left_semi")
    return first.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def range_from(kv: DataFrame, start: str) -> DataFrame:
    """Entries in order from the first one of an existing key; none if it isn't there."""
    at = kv.where(F.col("key") == start).agg(F.min("seq").alias("at"))
    return kv.join(F.broadcast(at), F.col("seq") >= F.col("at")).drop("at")


def merge_values(kvs: DataFrame) -> DataFrame:
    """(key, value): values of equal keys of several tables in order, joined by blanks.

    ``kvs`` has ``source`` and ``seq`` for the order. A key's values make one
    string, so they meet in one task by definition; the sort is of that group.
    """
    ordered = F.array_sort(F.collect_list(F.struct("source", "seq", "value")))
    joined = F.array_join(F.transform(ordered, lambda x: x["value"]), " ")
    return kvs.where("key is not null and value is not null").groupBy("key").agg(joined.alias("value"))


def dump_text(kv: DataFrame) -> DataFrame:
    """(seq, line): entries as ``+klen,vlen:key->value`` with lengths in bytes."""
    line = F.concat(
        F.lit("+"), F.octet_length("key").cast("string"), F.lit(","), F.octet_length("value").cast("string"),
        F.lit(":"), F.col("key"), F.lit("->"), F.col("value"),
    )
    return kv.select("seq", line.alias("line"))


def load_text(lines: DataFrame) -> DataFrame:
    """(seq, key, value) of dumped lines (seq, line); lines that are no entry are left out.

    Lengths count bytes, so keys and values may hold any sign; a length that
    doesn't fit its line makes it no entry.
    """
    k = F.regexp_extract("line", r"^\+(\d+),(\d+):", 1).cast("int")
    v = F.regexp_extract("line", r"^\+(\d+),(\d+):", 2).cast("int")
    body = F.encode(F.regexp_replace("line", r"^\+\d+,\d+:", ""), "utf-8")
    rows = lines.where(F.col("line").rlike(r"^\+\d+,\d+:")).select("seq", k.alias("k"), v.alias("v"), body.alias("b"))
    rows = rows.where((F.octet_length("b") == F.col("k") + F.col("v") + 2))
    cut = lambda a, n: F.decode(F.substring(F.col("b"), a, n), "utf-8")
    return rows.select("seq", cut(F.lit(1), F.col("k")).alias("key"), cut(F.col("k") + 3, F.col("v")).alias("value"))


# --- tries: (path, value)


def trie_lookup(trie: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, values): for each asked path the value at every level; paths with a missing level are left out."""
    asked = paths.select("path").distinct()
    levels = asked.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"))
    levels = levels.withColumn("at", F.slice("path", 1, F.col("k")))
    known = trie.select(F.col("path").alias("at"), "value").dropDuplicates(["at"])
    got = levels.join(known, "at").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("k", "value"))).alias("l"), F.count("*").alias("n")
    )
    return got.where(F.col("n") == F.size("path")).select("path", F.transform("l", lambda x: x["value"]).alias("values"))


def trie_below(trie: DataFrame, path: list[str]) -> DataFrame:
    """(path, value) of all entries under a path, the path's own included."""
    n = len(path)
    want = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    return trie.where((F.size("path") >= n) & (F.slice("path", 1, max(n, 1)) == want if n else F.lit(True)))


def trie_orphans(trie: DataFrame) -> DataFrame:
    """Entries whose parent is missing: a depth may grow by one at a time."""
    deep = trie.where(F.size("path") > 1).withColumn("up", F.slice("path", 1, F.size("path") - 1))
    return deep.join(trie.select(F.col("path").alias("up")), "up", "left_anti").drop("up")


# --- fixed records: (recno, record)


def fixed(rows: DataFrame, width: int) -> DataFrame:
    """(recno, record) padded with blanks; records over the width are an error."""
    long = F.octet_length("record") > width
    checked = F.when(long, F.raise_error(F.lit(f"a record is longer than {width} bytes"))).otherwise(F.rpad("record", width, " "))
    return rows.select("recno", checked.alias("record"))


def record_at(rows: DataFrame, index: int) -> DataFrame:
    """The record at an index; a negative one counts from the end."""
    if index >= 0:
        return rows.where(F.col("recno") == index)
    n = rows.agg(F.max("recno")).first()[0]
    return rows.where(F.col("recno") == (n if n is not None else -1) + 1 + index)


# --- archives: (recno, name, mtime, data)


def entry_bytes(size: Column) -> Column:
    """Bytes that an entry takes: a header block and its data in whole blocks."""
    return (F.lit(1) + F.ceil(size / BLOCK)).cast("bigint") * BLOCK


def _transfer(batches, rotate: int):
    """What a part of the entries does to the offset it starts at, for every offset: runs of equal outcomes."""
    starts = np.arange(0, rotate, BLOCK, dtype=np.int64)
    at, inc, of, part = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts)), None
    seen = 0
    for b in batches:
        part = int(b["part"].iloc[0]) if len(b) and part is None else part
        for size in b["bytes"].to_numpy():
            full = at >= rotate
            inc = inc + full
            at = np.where(full, 0, at) + size
            seen += 1
            if seen % 64 == 0 and len(at) > 1:
                # Offsets that meet never part again.
                pairs, back = np.unique(np.stack([at, inc]), axis=1, return_inverse=True)
                at, inc, of = pairs[0], pairs[1], np.ravel(back)[of]
    if part is not None:
        ends, incs = at[of], inc[of]
        new = np.flatnonzero(np.r_[True, (np.diff(ends) != 0) | (np.diff(incs) != 0)])
        yield pd.DataFrame({"part": part, "start": starts[new], "inc": incs[new], "end": ends[new]})


def layout(entries: DataFrame, rotate: int = ROTATE) -> DataFrame:
    """(recno, tar_idx, tar_offset): where each entry of (recno, size) goes; a file that reached ``rotate`` is followed.

    Where an entry goes depends on all before it. Parts of the entries first
    tell, side by side, what they do to any offset they may start at, which is
    a few runs each; the driver chains these, and the parts lay their entries.
    A null size counts as 0. ``rotate`` is taken in whole blocks.
    """
    rotate = max(BLOCK, rotate - rotate % BLOCK)
    sized = entries.select("recno", entry_bytes(F.coalesce("size", F.lit(0))).alias("bytes"))
    parts = sized.repartitionByRange("recno").sortWithinPartitions("recno")
    parts = cut(parts.withColumn("part", F.spark_partition_id()))
    runs = parts.mapInPandas(lambda b: _transfer(b, rotate), "part int, start bigint, inc bigint, end bigint").collect()
    by_part: dict[int, list] = {}
    for r in runs:
        by_part.setdefault(r["part"], []).append((r["start"], r["inc"], r["end"]))
    idx = at = 0
    begins = []
    for part in sorted(by_part):
        if at >= rotate:
            idx, at = idx + 1, 0
        begins.append((part, idx, at))
        _, inc, end = max(r for r in by_part[part] if r[0] <= at)
        idx, at = idx + inc, end

    def lay(batches):
        i = o = None
        for b in batches:
            out = []
            for recno, size, i0, o0 in zip(b["recno"], b["bytes"], b["i0"], b["o0"]):
                if i is None:
                    i, o = int(i0), int(o0)
                if o >= rotate:
                    i, o = i + 1, 0
                out.append((recno, i, o))
                o += int(size)
            yield pd.DataFrame(out, columns=["recno", "tar_idx", "tar_offset"])

    table = entries.sparkSession.createDataFrame(begins, "part int, i0 bigint, o0 bigint")
    # The broadcast join keeps parts and their order.
    return parts.join(F.broadcast(table), "part").mapInPandas(lay, "recno bigint, tar_idx int, tar_offset bigint")


def catalog_code(idx: Column, offset: Column) -> Column:
    """Catalog entry: seven hex digits of the file and eight of the offset."""
    return F.concat(F.lpad(F.lower(F.hex(idx.cast("bigint"))), 7, "0"), F.lpad(F.lower(F.hex(offset)), 8, "0"))


def append(entries: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """``new`` (name, mtime, data) with record numbers after those of ``entries``."""
    last = entries.agg(F.max("recno")).first()[0]
    start = 0 if last is None else last + 1
    return number(new, *order, name="recno").withColumn("recno", F.col("recno") + start)


def set_info(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with name and mtime of ``changes`` (recno, name, mtime) where those are given; data stays."""
    c = changes.select("recno", F.col("name").alias("_name"), F.col("mtime").alias("_mtime")).dropDuplicates(["recno"])
    joined = entries.join(c, "recno", "left")
    return joined.select(
        *[F.coalesce(F.col(f"_{k}"), F.col(k)).alias(k) if k in ("name", "mtime") else F.col(k) for k in entries.columns]
    )


def validate(catalog: DataFrame, rescan: DataFrame) -> DataFrame:
    """(recno, code, scanned): entries on which a catalog and a scan of the files disagree, missing ones included."""
    a = catalog.select("recno", "code").distinct()
    b = rescan.select("recno", F.col("code").alias("scanned")).distinct()
    return a.join(b, "recno", "full_outer").where(~F.col("code").eqNullSafe(F.col("scanned")))


def rescan(entries: DataFrame, rotate: int = ROTATE) -> DataFrame:
    """(recno, code): the catalog that follows from the entries themselves."""
    placed = layout(entries.select("recno", F.octet_length("data").alias("size")), rotate)
    return placed.select("recno", catalog_code(F.col("tar_idx"), F.col("tar_offset")).alias("code"))


def recover(catalog: DataFrame, entries: DataFrame, rotate: int = ROTATE) -> DataFrame:
    """(recno, code) of a right catalog, and ``was``: the code it had, null where one was missing."""
    have = catalog.select("recno", F.col("code").alias("was")).dropDuplicates(["recno"])
    return rescan(entries, rotate).join(have, "recno", "left")


@F.pandas_udf(BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    """Unpacked bytes; data that isn't gzip stays as it is, null stays null."""

    def one(x):
        try:
            return gzip.decompress(x)
        except (OSError, EOFError):
            return bytes(x)

    return data.map(one, na_action="ignore")


@F.pandas_udf(BinaryType())
def gzipped(data: pd.Series) -> pd.Series:
    """Packed bytes, the same for the same data; null stays null."""
    return data.map(lambda x: gzip.compress(bytes(x), mtime=0), na_action="ignore")


def archive_corpus(entries: DataFrame, packed: bool = False) -> DataFrame:
    """(loc, content, mtime, size) of an archive: loc is the record number in eight hex digits."""
    content = gunzip("data") if packed else F.col("data")
    loc = F.lpad(F.lower(F.hex("recno")), 8, "0")
    return entries.select(loc.alias("loc"), content.alias("content"), "mtime", F.octet_length("data").alias("size"))


def archive_get(entries: DataFrame, locs: DataFrame) -> DataFrame:
    """Entries of asked locations; a location that is no hex number finds none."""
    asked = locs.select(from_hex(F.col("loc")).alias("recno")).where("recno is not null").distinct()
    return entries.join(asked, "recno", "left_semi")
