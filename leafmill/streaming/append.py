"""Streams: an index that grows by a segment per micro-batch, and searches with a time limit."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafmill.operators import index as ix


class SegmentSink:
    """Appends each micro-batch as one segment, numbered by batch, under ``path``.

    A batch that is delivered again after a failure overwrites its own
    segment, so nothing is indexed twice. Empty batches leave no segment.
    """

    def __init__(self, path: str, prefix: str = "idx", order: str = "loc"):
        self.path, self.prefix, self.order = path.rstrip("/"), prefix, order

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        tables = ix.build(batch, [self.order], per_segment=1 << 62)
        info = tables["segments"].select("ndocs", "nterms")
        fname = f"{self.prefix}{batch_id:05d}.cdb"
        mtime = tables["docinfo"].agg(F.max("mtime").alias("mtime"))
        segment = info.withColumn("k", F.lit(1)).join(mtime.withColumn("k", F.lit(1)), "k").drop("k")
        segment = segment.select(
            F.lit(self.prefix).alias("prefix"), F.lit(fname).alias("fname"), "ndocs", "nterms", "mtime"
        )
        # The segments row goes last: a segment without it isn't read.
        for name in ("docinfo", "sents", "postings"):
            keys = [c for c in ("kind", "term", "doc_id", "sent_id") if c in tables[name].columns]
            tables[name].drop("seg").sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.path}/{name}/seg={batch_id}")
        segment.write.mode("overwrite").parquet(f"{self.path}/segments/seg={batch_id}")


def append_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Start indexing a stream of (loc, text, mtime) documents into ``path``; all available ones, then it ends."""
    sink = SegmentSink(path, **options)
    return (
        docs.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a stream's index."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "sents", "docinfo", "segments")}


def changed_stream(docs: DataFrame, seconds: str = "1 day") -> DataFrame:
    """Deliveries of a stream (loc, crc, seen_at) without those repeated within the watermark."""
    return docs.withWatermark("seen_at", seconds).dropDuplicatesWithinWatermark(["loc", "crc"])


class Timeout(Exception):
    """The search took longer than it was given."""


def within(spark: SparkSession, seconds: float, action: Callable):
    """Result of ``action()``, whose jobs are cancelled after ``seconds``."""
    sc = spark.sparkContext
    tag = f"leafmill-{threading.get_ident()}-{id(action)}"
    fired = threading.Event()

    def cancel():
        fired.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if fired.is_set():
            raise Timeout(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
