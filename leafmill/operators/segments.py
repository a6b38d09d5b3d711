"""Upkeep of segmented indexes: what to index, what to merge, and the merge itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.incremental import published
from leafmill.operators.numbering import number
from leafmill.session import small

#: Documents and terms beyond which a group of segments is closed.
MERGE_DOCS, MERGE_TERMS = 2000, 50_000


def newest_docs(docinfo: DataFrame, segments: DataFrame) -> DataFrame:
    """(seg, doc_id, mtime, loc): of each location the row in the greatest published segment, then the greatest doc_id.

    A null location is dropped. Aggregates instead of sorting, so a location
    that holds very many rows is combined before the shuffle.
    """
    rows = docinfo.select("seg", "doc_id", "mtime", "loc").where("loc is not null")
    rows = rows.join(small(published(segments)), "seg", "left_semi")
    top = rows.groupBy("loc").agg(F.max(F.struct("seg", "doc_id", "mtime")).alias("t"))
    return top.select("t.seg", "t.doc_id", "t.mtime", "loc")


def candidates(found: DataFrame, docinfo: DataFrame, segments: DataFrame, mode: str, cutoff: Column | None = None) -> DataFrame:
    """Rows of ``found`` (loc, mtime) that an index run takes.

    ``F`` and ``R`` take all; ``N`` those whose location isn't indexed; ``U``
    those, and the indexed ones changed since the index: a known mtime that is
    not before the index's. A null or 0 mtime is unknown and counts as old.
    """
    if mode in ("F", "R"):
        return found
    held = newest_docs(docinfo, segments).select("loc", F.col("mtime").alias("_held"))
    if mode == "N":
        return found.join(held.select("loc"), "loc", "left_anti")
    if mode != "U":
        raise ValueError(f"unknown mode {mode!r}")
    since = cutoff if cutoff is not None else F.col("_held")
    joined = found.join(held, "loc", "left")
    return joined.where(F.col("_held").isNull() | (F.coalesce(F.col("mtime"), F.lit(0)) >= since)).drop("_held")


def remap(docinfo: DataFrame, segments: DataFrame) -> DataFrame:
    """(seg, doc_id, mtime, loc, new_id): survivors of a merge with ids that keep age order.

    Ids run from 1 over segments and documents.
    """
    kept = number(newest_docs(docinfo, segments), "seg", "doc_id", "loc", name="new_id")
    return kept.withColumn("new_id", (F.col("new_id") + 1).cast("int"))


def merge(postings: DataFrame, sents: DataFrame, mapping: DataFrame, into: int) -> dict[str, DataFrame]:
    """Tables of the merged segment; sentences and postings of replaced documents go.

    Repeated rows go after the join, so those of replaced documents aren't moved.
    """
    ids = small(mapping.select("seg", "doc_id", "new_id"))
    move = lambda df, *rest: (
        df.join(ids, ["seg", "doc_id"]).select(F.lit(into).alias("seg"), F.col("new_id").alias("doc_id"), *rest).distinct()
    )
    return {
        "docinfo": mapping.select(F.lit(into).alias("seg"), F.col("new_id").alias("doc_id"), "mtime", "loc"),
        "sents": move(sents.select("seg", "doc_id", "sent_id", "sent"), "sent_id", "sent"),
        "postings": move(postings.select("kind", "term", "seg", "doc_id", "sent_id"), "kind", "term", "sent_id"),
    }


def merge_all(postings: DataFrame, sents: DataFrame, docinfo: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """Tables of all merged segments at once; ``plan`` (seg, into) says which segments make which new one.

    Of each location in a group the newest segment's row, then the greatest
    doc_id, survives; new ids run from 1 in each group in age order. A null
    location is dropped. The tables must not repeat rows, as those that this
    engine writes don't; nothing is then made distinct, and sentences and
    postings are moved once, or not at all where the survivors measure small.
    """
    rows = docinfo.select("seg", "doc_id", "mtime", "loc").where("loc is not null").join(small(plan.select("seg", "into")), "seg")
    top = rows.groupBy("into", "loc").agg(F.max(F.struct("seg", "doc_id", "mtime")).alias("t")).select("into", "t.seg", "t.doc_id", "t.mtime", "loc")
    kept = number(top, "into", "seg", "doc_id", "loc", name="n")
    first = kept.groupBy("into").agg(F.min("n").alias("first"))
    kept = kept.join(small(first), "into").withColumn("new_id", (F.col("n") - F.col("first") + 1).cast("int"))
    ids = small(kept.select("seg", "doc_id", "into", "new_id"))
    move = lambda df, *rest: df.join(ids, ["seg", "doc_id"]).select(F.col("into").alias("seg"), F.col("new_id").alias("doc_id"), *rest)
    return {
        "docinfo": kept.select(F.col("into").alias("seg"), F.col("new_id").alias("doc_id"), "mtime", "loc"),
        "sents": move(sents, "sent_id", "sent"),
        "postings": move(postings, "kind", "term", "sent_id").select("kind", "term", "seg", "doc_id", "sent_id"),
    }


def merge_groups(rows: list[tuple[int, int, int]], docs: int = MERGE_DOCS, terms: int = MERGE_TERMS) -> list[list[int]]:
    """Groups of segment numbers to merge, from (seg, ndocs, nterms) oldest first.

    A group is closed when its documents or its estimated terms pass their
    bound, which is tested before the next segment is added.
    """
    out: list[list[int]] = []
    n = t = 0
    for seg, ndocs, nterms in rows:
        if not out or n > docs or t > terms:
            out.append([])
            n = t = 0
        out[-1].append(seg)
        n += ndocs
        t += max(nterms - int(0.25 * t), 0)
    return out


def merge_policy(segments: DataFrame, docs: int = MERGE_DOCS, terms: int = MERGE_TERMS) -> DataFrame:
    """(seg, grp): which published segments to merge; the fold runs per prefix in Spark's aggregate.

    There are few segments of a prefix, one row each, so a prefix is one fold.
    """
    rows = segments.where(F.col("fname").endswith(".cdb")).select("prefix", "seg", "ndocs", "nterms").distinct()
    listed = rows.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("seg", "ndocs", "nterms"))).alias("l"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("t"),
        F.array().cast("array<struct<seg:int,grp:bigint>>").alias("out"),
    )

    def step(acc, x):
        full = (acc["n"] > docs) | (acc["t"] > terms)
        g = F.when(full, acc["g"] + 1).otherwise(acc["g"])
        t0 = F.when(full, F.lit(0).cast("bigint")).otherwise(acc["t"])
        n0 = F.when(full, F.lit(0).cast("bigint")).otherwise(acc["n"])
        return F.struct(
            g.alias("g"),
            (n0 + F.coalesce(x["ndocs"], F.lit(0)).cast("bigint")).alias("n"),
            (t0 + F.greatest(F.coalesce(x["nterms"], F.lit(0)).cast("bigint") - F.floor(t0 * 0.25), F.lit(0).cast("bigint"))).alias("t"),
            F.concat(acc["out"], F.array(F.struct(x["seg"].cast("int").alias("seg"), g.alias("grp")))).alias("out"),
        )

    folded = listed.select("prefix", F.explode(F.aggregate("l", start, step)["out"]).alias("o"))
    return folded.select("prefix", "o.seg", "o.grp")


def tiers(docs: DataFrame, now: int, days: int = 3) -> DataFrame:
    """``docs`` with ``tier``: ``bbb`` for those changed in the last days, ``aaa`` for older and unknown ones."""
    fresh = F.coalesce(F.col("mtime"), F.lit(0)) > now - days * 86400
    return docs.withColumn("tier", F.when(fresh, F.lit("bbb")).otherwise(F.lit("aaa")))


def total_docs(segments: DataFrame) -> DataFrame:
    """(total): documents of all published segments."""
    rows = segments.where(F.col("fname").endswith(".cdb")).select("seg", "ndocs").distinct()
    return rows.agg(F.coalesce(F.sum(F.col("ndocs").cast("bigint")), F.lit(0).cast("bigint")).alias("total"))


def last_loc(docinfo: DataFrame, segments: DataFrame) -> DataFrame:
    """(prefix, fname, mtime, lastloc): newest published segment of each prefix and the location of its greatest doc_id."""
    live = segments.where(F.col("fname").endswith(".cdb")).groupBy("prefix").agg(
        F.max(F.struct("fname", "seg", "mtime")).alias("t")
    )
    live = live.select("prefix", "t.fname", "t.seg", "t.mtime")
    last = docinfo.groupBy("seg").agg(F.max(F.struct("doc_id", "loc")).alias("d"))
    return live.join(last, "seg", "left").select("prefix", "fname", "mtime", F.col("d.loc").alias("lastloc"))


def loc_lookup(docinfo: DataFrame, segments: DataFrame, locs: DataFrame) -> DataFrame:
    """(loc, seg, doc_id) of asked locations: newest segment; null for those not indexed."""
    asked = locs.select("loc").where("loc is not null").distinct()
    return asked.join(newest_docs(docinfo, segments).select("loc", "seg", "doc_id"), "loc", "left")


def by_mtime(docs: DataFrame, newest_first: bool = False) -> DataFrame:
    """Known rows by mtime, ties by location; rows without mtime are left out."""
    known = docs.where("mtime is not null")
    return known.orderBy(F.desc("mtime") if newest_first else F.asc("mtime"), "loc")
