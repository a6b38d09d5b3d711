"""Deliveries that the next run has to process.

A run rereads everything from the oldest transaction that was still open when
the last run ended, so late commits are never skipped. What the reread brings
twice is taken out by an anti join of (key, version) pairs against the ledger
of processed pairs. Key is the location, version the CRC-32 of the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import table
from leafmill.sources.publish import Conflict, attempt, publish, published_names, read


def published(segments: DataFrame) -> DataFrame:
    """Numbers of the segments whose file was renamed into place.

    Broken-off segments (``.cdb.tmp``) and a null name are left out.
    """
    return segments.where(F.col("fname").endswith(".cdb")).select("seg").distinct()


def processed_ledger(docinfo: DataFrame, segments: DataFrame) -> DataFrame:
    """(loc, crc) that the index holds: of each loc the row of the greatest published seg.

    Repeated rows count once; within a segment the greatest doc_id wins. A
    null loc is dropped. Aggregates with ``max_by``, so a loc that holds very
    many rows is combined before the shuffle. Empty input gives no rows.
    """
    rows = docinfo.select("seg", "doc_id", "loc", "crc").where(F.col("loc").isNotNull())
    return (
        rows.join(published(segments), "seg", "left_semi")
        .groupBy("loc")
        .agg(F.max(F.struct("seg", "doc_id", "crc")).alias("top"))
        .select("loc", F.col("top.crc").alias("crc"))
    )


def current_deliveries(rawdocs: DataFrame, since: Column | None = None) -> DataFrame:
    """(loc, rec_id, crc) of each loc's current delivery.

    That is the row with content not null and the latest seen_at, then the
    greatest rec_id; a null seen_at counts as earliest. ``since`` limits the
    reread, e.g. to ``F.col("seen_at") >= low_water``. The content is reduced
    to its CRC-32 before the shuffle, so whole documents are never moved.
    """
    return _current(rawdocs, since).select("loc", "v.rec_id", "v.crc")


def _current(rawdocs: DataFrame, since: Column | None) -> DataFrame:
    """(loc, v) of each loc's current delivery, as (seen_at, rec_id, crc)."""
    rows = rawdocs.select("loc", "rec_id", "content", "seen_at")
    rows = rows.where(F.col("content").isNotNull() & F.col("loc").isNotNull())
    if since is not None:
        rows = rows.where(since)
    version = F.struct("seen_at", "rec_id", F.crc32("content").alias("crc"))
    return rows.select("loc", version.alias("v")).groupBy("loc").agg(F.max("v").alias("v"))


def pending(rawdocs: DataFrame, docinfo: DataFrame, segments: DataFrame, since: Column | None = None) -> DataFrame:
    """(loc, rec_id) that the next index run must process, each once.

    A null crc in the ledger counts as another version. Ties and repeated
    rows give one row per loc; columns beyond those used are ignored.
    """
    now = current_deliveries(rawdocs, since)
    held = processed_ledger(docinfo, segments)
    return now.join(held, ["loc", "crc"], "left_anti").select("loc", "rec_id")


class RunLog:
    """Committed runs and the ledger of what they processed, under ``path``.

    ``attempts`` has a folder per attempt with its batch: the (loc, crc) pairs
    and the deliveries (seen_at, rec_id) they came with, frozen before anything
    processes them. ``marks`` has one small file per committed run, which names
    the attempt and the low-water mark (the oldest transaction open when the
    run read). The mark is written whole and last, so a run that breaks off
    anywhere counts for nothing, also when it is tried again under the same
    number; the batches that marks name are the ledger.
    """

    BATCH = "loc string, rec_id bigint, crc bigint, seen_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._frozen: dict[int, tuple[DataFrame, str, int]] = {}

    def marks(self) -> list[dict]:
        """Committed runs by number: run_id, attempt, low (microseconds or None), since a run that replaced all before it."""
        folder = f"{self.path}/marks"
        found = [read(self.spark, folder, n) | {"place": int(n)} for n in published_names(self.spark, folder)]
        whole = max((i for i, m in enumerate(found) if m.get("whole")), default=0)
        return found[whole:]

    def runs(self) -> DataFrame:
        """(run_id, low_water) of the committed runs."""
        rows = self.spark.createDataFrame([(m["run_id"], m["low"]) for m in self.marks()], "run_id bigint, low bigint")
        return rows.select("run_id", F.timestamp_micros("low").alias("low_water"))

    def ledger(self) -> DataFrame:
        """(run_id, loc, rec_id, crc, seen_at) that committed runs processed."""
        marks = self.marks()
        if not marks:
            return self.spark.createDataFrame([], f"run_id bigint, {self.BATCH}")
        rows = self.spark.read.schema(self.BATCH).parquet(*[f"{self.path}/attempts/{m['attempt']}" for m in marks])
        of = self.spark.createDataFrame([(m["run_id"], m["attempt"]) for m in marks], "run_id bigint, attempt string")
        rows = rows.withColumn("attempt", F.regexp_extract(F.input_file_name(), r"/attempts/([0-9a-f]+)/", 1))
        return rows.join(F.broadcast(of), "attempt").select("run_id", "loc", "rec_id", "crc", "seen_at")

    def held(self) -> DataFrame:
        """(loc, v) of each location: its newest ledger entry, as (seen_at, rec_id, crc)."""
        entry = F.struct("run_id", F.struct("seen_at", "rec_id", "crc").alias("v"))
        return self.ledger().groupBy("loc").agg(F.max(entry).alias("e")).select("loc", "e.v")

    def low_water(self):
        """Where the next run starts to read; None before the first run."""
        marks = self.marks()
        if not marks or marks[-1]["low"] is None:
            return None
        return self.spark.range(1).select(F.timestamp_micros(F.lit(marks[-1]["low"]))).first()[0]

    def next_batch(self, rawdocs: DataFrame) -> DataFrame:
        """Changed (loc, rec_id, crc) since the last committed run, each once, frozen under an attempt of its own.

        Rereads from the low-water mark on. What is current is decided between
        the deliveries reread and the newest one in the ledger, so an older
        delivery that is read again, or one without seen_at, never displaces a
        newer one that was processed. A loc that changes back to an earlier
        version is processed again. A null loc or content is left out; a null
        seen_at counts as earliest and is always reread.
        """
        base = self._last()
        low = self.low_water()
        since = None if low is None else F.col("seen_at").isNull() | (F.col("seen_at") >= F.lit(low))
        fresh = _current(rawdocs, since)
        both = fresh.join(self.held().withColumnRenamed("v", "w"), "loc", "left")
        newer = F.col("w").isNull() | ((F.col("v") > F.col("w")) & ~F.col("v.crc").eqNullSafe(F.col("w.crc")))
        name = attempt()
        both.where(newer).select("loc", "v.rec_id", "v.crc", "v.seen_at").write.parquet(f"{self.path}/attempts/{name}")
        batch = self.spark.read.schema(self.BATCH).parquet(f"{self.path}/attempts/{name}").select("loc", "rec_id", "crc")
        self._frozen[id(batch)] = batch, name, base
        return batch

    def _last(self) -> int:
        """Place of the newest mark; 0 before the first."""
        return max((m["place"] for m in self.marks()), default=0)

    def _mark(self, base: int, run_id: int, name: str, low: int | None, **more) -> None:
        last = self.marks()[-1:]
        if last and (last[0]["place"] != base or run_id <= last[0]["run_id"]):
            raise Conflict(f"run {last[0]['run_id']} was committed in between")
        # Marks are named by their place, so of two runs that read the same state only one can commit.
        publish(self.spark, f"{self.path}/marks", f"{base + 1:019d}", {"run_id": run_id, "attempt": name, "low": low, **more})

    def commit(self, run_id: int, batch: DataFrame, low_water) -> None:
        """Record a batch of ``next_batch`` as processed, in one atomic step.

        Run numbers go up. If another run committed since the batch was taken,
        this one is a Conflict, as it may hold the same deliveries. A frame
        that ``next_batch`` didn't give is refused, as it may be read again
        with other rows.
        """
        known = self._frozen.get(id(batch))
        if known is None or known[0] is not batch:
            raise ValueError("only a batch that next_batch of this log gave can be committed")
        low = None if low_water is None else self.spark.range(1).select(F.unix_micros(F.lit(low_water))).first()[0]
        self._mark(known[2], run_id, known[1], low)
        del self._frozen[id(batch)]

    def compact(self, run_id: int) -> None:
        """Replace the ledger by its newest entries, as run ``run_id``, so that it doesn't grow with the number of runs."""
        marks = self.marks()
        if not marks:
            return
        name = attempt()
        self.held().select("loc", "v.rec_id", "v.crc", "v.seen_at").write.parquet(f"{self.path}/attempts/{name}")
        self._mark(marks[-1]["place"], run_id, name, marks[-1]["low"], whole=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4 over the whole tables."""
    return pending(
        table(spark, sf_dir, "rawdocs"), table(spark, sf_dir, "docinfo"), table(spark, sf_dir, "segments")
    )
