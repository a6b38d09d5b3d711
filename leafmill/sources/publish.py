"""Small files that come into being whole: marks of runs and manifests of indexes.

A file is written beside its place and renamed into it, and a name is used
once. What a mark names is read, what none names is not, so a run that breaks
off leaves nothing behind that counts. Two writers that aim at the same name
collide: the second one gets an error instead of a mixed state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another run published under the same name first."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def attempt() -> str:
    """A name that no other attempt has."""
    return uuid.uuid4().hex


def publish(spark: SparkSession, folder: str, name: str, value: dict) -> None:
    """Put ``value`` as ``folder/name``, whole or not at all; Conflict if the name is taken."""
    fs, at = _at(spark, f"{folder}/{name}")
    _, held = _at(spark, f"{folder}/.{name}.{attempt()}")
    fs.mkdirs(at.getParent())
    out = fs.create(held, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(held, at):
        fs.delete(held, False)
        raise Conflict(f"{folder}/{name} was published by another run")


def published_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder in order, without those being written; none if there is no folder."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def read(spark: SparkSession, folder: str, name: str) -> dict:
    """The value of a published file."""
    fs, at = _at(spark, f"{folder}/{name}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing if it isn't there."""
    fs, at = _at(spark, path)
    fs.delete(at, True)
