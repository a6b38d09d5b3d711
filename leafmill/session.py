"""Session and small helpers that every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Serialized bytes up to which a measured side may be broadcast.
BROADCAST_BYTES = 16 << 20


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, as they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    home = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="leafmill-")) / "leafmill.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    sc.addPyFile(str(at))
    sc._leafmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It comes from ``spark.checkpoint.dir``, or from the context if that was
    given one. Only a local master, as in tests, may go without: there a
    temporary folder stands in. On a cluster that would lose data, so it is an
    error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/leafmill-{os.getpid()}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is under ``limit``.

    The size is that of the named columns as text plus 16 bytes a value. A
    larger ``df`` comes back without hint, so that the join shuffles.
    """
    columns = columns or tuple(df.columns)
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in columns), F.lit(0))
    size = df.select(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
