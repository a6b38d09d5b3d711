"""Dense numbers over all rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut, small


def number(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, which must tell all rows apart to be repeatable.

    Rows are parted by range and numbered inside their part; only one row
    count per part reaches the driver. The numbered parts are checkpointed, so
    that parts that are computed again can't shift.
    """
    kept = df.columns
    part = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .select(*kept, F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    )
    part = cut(part)
    at, starts = 0, []
    for p, n in sorted((r["_part"], r["n"]) for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return part.join(small(offsets), "_part").select(*kept, (F.col("_start") + F.col("_k")).alias(name))


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before, in ``order``, among rows of equal ``keys``; else null.

    A lag without windows: rows are numbered over all keys and joined with
    their number plus one, so a key may hold any share of the rows.
    """
    n = number(df, *keys, *order, name="_n")
    before = n.select(
        (F.col("_n") + 1).alias("_n"), *[F.col(k).alias(f"_b_{k}") for k in keys], F.col(value).alias(name)
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    joined = n.join(before, "_n", "left")
    return joined.select(*df.columns, F.when(same, F.col(name)).alias(name))
