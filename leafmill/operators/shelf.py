"""Indexes on disk: runs that become visible whole, merges in one job, clean-up.

An index folder holds ``runs``, a folder of tables per run, and ``versions``,
one small manifest per state of the index, which lists the runs that count. A
run writes its tables under a name of its own and publishes the next manifest
last. What a run that broke off left behind is named by no manifest, so it is
never read. Of two writers that start from the same state one gets a Conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import index as ix
from leafmill.operators import segments as sg
from leafmill.operators.numbering import number
from leafmill.operators.search import Index
from leafmill.session import small
from leafmill.sources.publish import Conflict, attempt, publish, published_names, read, remove

SCHEMAS = {
    "postings": "kind string, term string, seg int, doc_id int, sent_id int",
    "sents": "seg int, doc_id int, sent_id int, sent string",
    "docinfo": "seg int, doc_id int, mtime int, loc string",
    "segments": "seg int, prefix string, fname string, ndocs bigint, nterms bigint, mtime int",
}


class Shelf:
    """The index under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first."""
        names = published_names(self.spark, f"{self.path}/versions")
        return int(names[-1]) if names else 0

    def runs(self, version: int | None = None) -> list[str]:
        """Names of the runs that count."""
        version = self.version() if version is None else version
        return read(self.spark, f"{self.path}/versions", f"{version:019d}")["runs"] if version else []

    def tables(self, runs: list[str] | None = None) -> dict[str, DataFrame]:
        runs = self.runs() if runs is None else runs
        out = {}
        for name, schema in SCHEMAS.items():
            paths = [f"{self.path}/runs/{r}/{name}" for r in runs]
            out[name] = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return out

    def index(self, prefix: str = "") -> Index:
        """All published segments, or those of a prefix."""
        t = self.tables()
        return Index(t["postings"], t["sents"], t["docinfo"], t["segments"], prefix)

    def _publish(self, base: int, runs: list[str]) -> None:
        publish(self.spark, f"{self.path}/versions", f"{base + 1:019d}", {"runs": runs})

    def _finish(self, base: int, name: str, before: list[str], segments: DataFrame) -> None:
        """Write a run's segments table and make the run visible; the run goes if another one was first."""
        columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS["segments"].split(", ")]
        segments.select(*columns).coalesce(1).write.parquet(f"{self.path}/runs/{name}/segments")
        try:
            self._publish(base, [*before, name])
        except Conflict:
            remove(self.spark, f"{self.path}/runs/{name}")
            raise

    def make(self, docs: DataFrame, mode: str = "U", prefix: str = "idx", doctype: str = "T", per_segment: int = ix.SEGMENT_DOCS, **build) -> int:
        """Index documents (loc, text, mtime, labels, title) that ``mode`` takes; gives how many segments were added.

        New segments are numbered after the greatest published one. Mode ``R``
        starts over: the old runs no longer count. Nothing is published if no
        document is taken.
        """
        base = self.version()
        before = self.runs(base)
        old = self.tables(before)
        docs = sg.candidates(docs, old["docinfo"], old["segments"], mode)
        last = None if mode == "R" else old["segments"].agg(F.max("seg")).first()[0]
        first = 0 if last is None else last + 1
        docs = docs.withColumn("_type", F.lit({"html": "H", "email": "E"}.get(doctype, doctype)))
        name = attempt()
        folder = f"{self.path}/runs/{name}"
        ix.save(self.spark, ix.parts(docs, ["loc"], labels="labels", title="title", per_segment=per_segment, doctype="_type", first=first, **build), folder)
        made = self.tables_of(folder)
        info = ix.index_info(made["docinfo"], made["postings"])
        newest = made["docinfo"].groupBy("seg").agg(F.max("mtime").alias("mtime"))
        segs = info.join(newest, "seg").select("*", F.lit(prefix).alias("prefix"), F.format_string(f"{prefix}%05d.cdb", "seg").alias("fname"))
        n = made["docinfo"].select("seg").distinct().count()
        if not n and mode != "R":
            remove(self.spark, folder)
            return 0
        self._finish(base, name, [] if mode == "R" else before, segs)
        return n

    def tables_of(self, folder: str) -> dict[str, DataFrame]:
        return {n: self.spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in ("postings", "sents", "docinfo")}

    def merge(self, out: Shelf | None = None, docs: int = sg.MERGE_DOCS, terms: int = sg.MERGE_TERMS, cleanup: bool = False) -> int:
        """Merge the groups of segments that the policy gives, all in one job; gives the number of segments then.

        The result replaces this index, or goes to ``out``. With ``cleanup``
        the files of runs that no longer count are removed; searches that
        began before may need them.
        """
        base = self.version()
        old = self.tables(self.runs(base))
        policy = sg.merge_policy(old["segments"], docs, terms)
        groups = number(policy.select("prefix", "grp").distinct(), "prefix", "grp", name="into")
        plan = policy.join(small(groups), ["prefix", "grp"]).select("seg", "prefix", F.col("into").cast("int").alias("into"))
        merged = sg.merge_all(old["postings"], old["sents"], old["docinfo"], plan)
        target = out or self
        to = target.version()
        name = attempt()
        folder = f"{target.path}/runs/{name}"
        ix.write_sorted(merged, folder)
        made = target.tables_of(folder)
        times = old["segments"].select("seg", "mtime").join(small(plan), "seg").groupBy("into", "prefix").agg(F.max("mtime").alias("mtime"))
        info = ix.index_info(made["docinfo"], made["postings"]).join(small(times.withColumnRenamed("into", "seg")), "seg")
        segs = info.select("*", F.concat("prefix", F.format_string("%05d.cdb", "seg")).alias("fname"))
        target._finish(to, name, [] if out is None else target.runs(to), segs)
        n = self.spark.read.parquet(f"{folder}/segments").count()
        if cleanup:
            target.cleanup()
        return n

    def cleanup(self) -> list[str]:
        """Remove runs that no manifest of the newest version lists: merged, replaced and broken-off ones."""
        keep = set(self.runs())
        gone = [r for r in published_names(self.spark, f"{self.path}/runs") if r not in keep]
        for r in gone:
            remove(self.spark, f"{self.path}/runs/{r}")
        return gone
