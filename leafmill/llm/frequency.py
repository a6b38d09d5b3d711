"""How often every distinct term occurs, and in how many records.

A global integer dictionary numbers the distinct terms in term order, and the
rows are encoded with it, so that only numbers are moved from then on. Each
block of encoded rows accumulates two arrays over identifier ranges, one for
occurrences and one for the records a term is present in. The arrays are
summed range by range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.incremental import published
from leafmill.session import cut, small, table

#: Identifiers in one array, and arrays a task holds before it passes them on.
RANGE, HELD = 4096, 512


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, id): dense identifiers 0.. in term order of a distinct ``term`` column.

    Only one row count per partition reaches the driver. The numbered parts
    are checkpointed, so a lost executor can't renumber them.
    """
    part = (
        terms.select("term")
        .repartitionByRange("term")
        .sortWithinPartitions("term")
        .select("term", F.monotonically_increasing_id().alias("m"))
        .select("term", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    )
    part = cut(part)
    sizes = sorted((r["part"], r["n"]) for r in part.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = terms.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    return part.join(F.broadcast(offsets), "part").select("term", (F.col("start") + F.col("k")).alias("id"))


def encoded(rows: DataFrame, term: str, terms: DataFrame) -> DataFrame:
    """``rows`` with ``id`` in place of the term. A dictionary that measures small is broadcast; else both sides
    are joined by term, where adaptive execution splits a term that holds very many rows."""
    return rows.withColumnRenamed(term, "term").join(small(terms), "term").drop("term")


def presence(rows: DataFrame, record: list[str]) -> DataFrame:
    """(id, n): for each term and record it is present in, its occurrences there, repeated rows counted once.

    Rows meet by term and record together, so neither a term nor a record that
    holds a third of all rows meets in one task; it is one shuffle of numbers.
    """
    here = rows.repartition("id", *record).dropDuplicates()
    return here.groupBy("id", *record).agg(F.count("*").alias("n")).select("id", "n")


def _arrays(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Arrays of a block, by range: places that aren't zero, with their counts."""
    at, occ, recs = [], [], []
    for a in held.values():
        used = np.flatnonzero(a[1])
        at.append(used.astype(np.int32))
        occ.append(a[0][used])
        recs.append(a[1][used])
    ranges = pa.array(list(held), pa.int64())
    out = pa.RecordBatch.from_arrays([ranges, _lists(at, pa.int32()), _lists(occ, pa.int64()), _lists(recs, pa.int64())], names=["range", "at", "occ", "recs"])
    held.clear()
    return out


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _lay(batches):
    """Arrays of occurrences and record presence of a block of (id, n) rows."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        rng, at = ids // RANGE, ids % RANGE
        for k in np.unique(rng).tolist():
            mine = rng == k
            a = held.get(k)
            if a is None:
                if len(held) >= HELD:
                    yield _arrays(held)
                a = held[k] = np.zeros((2, RANGE), np.int64)
            np.add.at(a[0], at[mine], n[mine])
            np.add.at(a[1], at[mine], 1)
    if held:
        yield _arrays(held)


def _sum(batches):
    """Arrays that come sorted by range, summed; one is held at a time."""
    key, total = None, None

    def out():
        used = np.flatnonzero(total[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(key * RANGE + used), pa.array(total[0][used]), pa.array(total[1][used])], names=["id", "occ", "recs"]
        )

    for b in batches:
        ends = b.column(1).offsets.to_numpy()
        at, occ, recs = (b.column(i).values.to_numpy() for i in (1, 2, 3))
        for i, k in enumerate(b.column(0).to_pylist()):
            if k != key:
                if key is not None:
                    yield out()
                key, total = k, np.zeros((2, RANGE), np.int64)
            mine = slice(ends[i], ends[i + 1])
            total[0][at[mine]] += occ[mine]
            total[1][at[mine]] += recs[mine]
    if key is not None:
        yield out()


def id_frequency(rows: DataFrame, record: list[str]) -> DataFrame:
    """(id, occurrences, records) of encoded rows, by arrays over identifier ranges."""
    laid = presence(rows, record).mapInArrow(_lay, "range bigint, at array<int>, occ array<bigint>, recs array<bigint>")
    summed = laid.repartition("range").sortWithinPartitions("range").mapInArrow(_sum, "id bigint, occ bigint, recs bigint")
    return summed.select("id", F.col("occ").alias("occurrences"), F.col("recs").alias("records"))


def term_frequency(rows: DataFrame, term: str, record: list[str], keep=None) -> DataFrame:
    """(term, occurrences, records) for every term of ``rows``; ``keep`` may take rows out before they get their term back.

    ``rows`` is taken as a set: repeated rows count once. Null and empty terms
    are no terms. Columns of ``rows`` other than ``term`` and ``record`` tell
    occurrences apart. Empty input gives no rows. Results follow from the data
    alone; the number of blocks and ranges changes only the work.
    """
    rows = rows.where(F.col(term).isNotNull() & (F.col(term) != ""))
    terms = dictionary(rows.select(F.col(term).alias("term")).distinct())
    counts = id_frequency(encoded(rows, term, terms), record)
    if keep is not None:
        counts = keep(counts)
    return counts.join(terms, "id").select("term", *[c for c in counts.columns if c != "id"])


def mark(frequency: DataFrame, total: int, rare: int = 1, common: tuple[int, int] = (1, 5)) -> DataFrame:
    """Adds ``mark``: ``rare`` up to ``rare`` records, ``common`` in more than that share of ``total``, else null.

    The share is a fraction of whole numbers, so the comparison is exact.
    """
    return frequency.withColumn(
        "mark",
        F.when(F.col("records") <= rare, F.lit("rare")).when(
            F.col("records") * common[1] > common[0] * total, F.lit("common")
        ),
    )


def _packed(high, low):
    """Two 32-bit numbers in one, null in the low one apart from all numbers that occur (as -1)."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(
        F.coalesce(low, F.lit(-1)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    )


def _published_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc, place) of the text postings in published segments, packed so that little is moved."""
    postings = table(spark, sf_dir, "postings", "kind", "term", "seg", "doc_id", "sent_id")
    keep = published(table(spark, sf_dir, "segments"))
    rows = postings.where(F.col("kind").isin("word", "gram")).join(small(keep), "seg", "left_semi")
    kind = F.when(F.col("kind") == "word", 0).otherwise(1)
    return rows.select("term", _packed(F.col("seg"), F.col("doc_id")).alias("doc"), _packed(kind, F.col("sent_id")).alias("place"))


def p7_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every term of the published postings."""
    return term_frequency(_published_postings(spark, sf_dir), "term", ["doc"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: terms too rare or too common to help a search.

    A term of exactly one document is rare even where one document is more
    than a fifth of all.
    """
    docs = table(spark, sf_dir, "docinfo", "seg", "doc_id").join(
        published(table(spark, sf_dir, "segments")), "seg", "left_semi"
    )
    total = docs.distinct().count()
    marked = lambda counts: mark(counts, total).where("mark is not null")
    return term_frequency(_published_postings(spark, sf_dir), "term", ["doc"], marked).select("term", "mark")
