"""Versioned articles: every edit is a snapshot, articles are chains of them.

A table of snapshots (tid, aid, name, data) holds all; an article's aid is the
tid of its first snapshot. The latest snapshot and the chain are read from the
table, so no pointers need to be kept in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import from_hex, hex_id
from leafmill.operators.numbering import number, with_previous
from leafmill.operators.search import Index, search


def snapshots(rows: DataFrame) -> DataFrame:
    """Distinct (tid, aid, name, size, mtime, data) with both ids."""
    rows = rows.select("tid", "aid", "name", "size", "mtime", "data").distinct()
    return rows.where("tid is not null and aid is not null")


def labels(name):
    """Label of an archive name: what follows both ids, without suffix; null if empty."""
    return F.nullif(F.regexp_replace(F.substring(name, 17, 1 << 30), r"\.gz$", ""), F.lit(""))


def latest(rows: DataFrame) -> DataFrame:
    """(aid, tid, revs, mtime, label, data) of each article's newest snapshot; one aggregate, however many snapshots."""
    top = F.max(F.struct("tid", "mtime", "name", "data")).alias("t")
    out = snapshots(rows).groupBy("aid").agg(top, F.count_distinct("tid").alias("revs"))
    return out.select("aid", "t.tid", "revs", "t.mtime", labels(F.col("t.name")).alias("label"), "t.data")


def history(rows: DataFrame, aid: str) -> DataFrame:
    """(aid, tid, place) of one article, newest first from place 1."""
    mine = snapshots(rows).where(F.col("aid") == aid).select("aid", "tid").distinct()
    return number(mine, F.desc("tid"), name="place").withColumn("place", (F.col("place") + 1).cast("int"))


def chain(rows: DataFrame) -> DataFrame:
    """(tid, next): the circular chain: an article's first record points to its newest, every other to the one before.

    Works on ids only, without a window, as one article may hold any share of
    the snapshots.
    """
    ids = snapshots(rows).select("aid", "tid").distinct()
    newest = ids.groupBy("aid").agg(F.max("tid").alias("top"))
    joined = with_previous(ids, ["aid"], ["tid"], "tid", "prev").join(newest, "aid")
    return joined.select("tid", F.when(F.col("tid") == F.col("aid"), F.col("top")).otherwise(F.col("prev")).alias("next"))


def unmodified(rows: DataFrame) -> DataFrame:
    """(aid): articles of a single snapshot."""
    ids = snapshots(rows).select("aid", "tid").distinct()
    return ids.groupBy("aid").agg(F.count("*").alias("n")).where("n = 1").select("aid")


def articles(rows: DataFrame) -> DataFrame:
    """(aid): all articles, modified or not."""
    return snapshots(rows).select("aid").distinct()


def create(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of new articles (pos, label, mtime, data): ids follow the greatest tid, in order of ``pos``."""
    return _append(rows, new.withColumn("aid", F.lit(None).cast("string")))


def modify(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of edits (pos, aid, label, mtime, data); edits of unknown articles are left out."""
    return _append(rows, new.join(articles(rows), "aid", "left_semi"))


def _append(rows: DataFrame, new: DataFrame) -> DataFrame:
    top = rows.agg(F.max(from_hex(F.col("tid")))).first()[0]
    new = number(new, "pos", name="_n")
    n = F.col("_n") + F.lit(0 if top is None else top + 1)
    tid = hex_id(n)
    aid = F.coalesce("aid", tid)
    name = F.concat(tid, aid, F.coalesce("label", F.lit("")), F.lit(".gz"))
    return new.select(
        tid.alias("tid"), aid.alias("aid"), name.alias("name"),
        F.octet_length("data").alias("size"), "mtime", "data",
    )


def validate(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(tid, next, stored): where a stored chain (tid, next) and the one that follows from the names disagree."""
    names = rows.select(F.substring("name", 1, 8).alias("tid"), F.substring("name", 9, 8).alias("aid"), "name", "size", "mtime", "data")
    want = chain(names)
    have = stored.select("tid", F.col("next").alias("stored")).distinct()
    return want.join(have, "tid", "full_outer").where(~F.col("next").eqNullSafe(F.col("stored")))


def recover(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(tid, next, was): the right chain, with what a stored chain (tid, next) had; null where it had nothing."""
    have = stored.select("tid", F.col("next").alias("was")).dropDuplicates(["tid"])
    return chain(rows).join(have, "tid", "left")


def find(index: Index, preds: list, rows: DataFrame, any_of: bool = False) -> DataFrame:
    """(aid, tid): articles with snapshots that an index of snapshots (loc = tid) finds, each by its newest hit."""
    return find_articles(search(index, preds, any_of=any_of).select(F.col("loc").alias("tid")), rows)


def snapshot_documents(rows: DataFrame) -> DataFrame:
    """(loc, text, mtime, labels, title) of snapshots, as an index takes them; repeated rows come once."""
    label = labels(F.col("name"))
    return snapshots(rows).select(
        F.col("tid").alias("loc"), F.col("data").alias("text"), "mtime", F.array_compact(F.array(label)).alias("labels"), F.lit(None).cast("string").alias("title")
    ).dropDuplicates(["loc"])


def find_articles(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(aid, tid): of found snapshots (tid) each article's newest hit, by the true aid."""
    ids = snapshots(rows).select("tid", "aid").distinct()
    hit = found.select("tid").distinct().join(ids, "tid")
    return hit.groupBy("aid").agg(F.max("tid").alias("tid"))
