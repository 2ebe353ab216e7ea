"""Commits of a table made of many folders: readers see what the newest commit names, and nothing else.

Writers put their files into new folders first.  A commit is one small file with the next number; it is created
exclusively, so of two writers one has to start again, and a writer that dies leaves only folders that no
commit names.  A file that was cut off while it was written does not count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import SparkSession


class Conflict(PySparkRuntimeError):
    """Another writer made the commit that this one was about to make."""

    def __init__(self, root: str, version: int):
        Exception.__init__(self, f"version {version} of {root} is there already")


@dataclass(frozen=True)
class Commit:
    """``folders`` by part name, ``marks``: how far the inputs are read, ``schema`` of the table as JSON."""

    version: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)
    schema: str = ""


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(root: str) -> str:
    """An unused folder for the files of one write."""
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _open(spark, f"{root.rstrip('/')}/_commits")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, root: str, version: int) -> Commit | None:
    fs, at = _open(spark, f"{root.rstrip('/')}/_commits/{version:010d}.json")
    stream = fs.open(at)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()
    try:
        return Commit(**json.loads(text))
    except (ValueError, TypeError):
        return None


def newest(spark: SparkSession, root: str) -> Commit | None:
    """The newest whole commit."""
    for version in reversed(_versions(spark, root)):
        if found := _read(spark, root, version):
            return found
    return None


def commit(spark: SparkSession, root: str, after: Commit | None, folders: dict[str, str], marks: dict[str, str] | None = None, schema: str = "") -> Commit:
    """Name the folders of the table from now on; ``after`` is the commit that the writer has read.

    Raises :class:`Conflict` if another commit came in between.
    """
    seen = _versions(spark, root)
    base = after.version if after else 0
    for version in seen:
        if version > base and _read(spark, root, version):
            raise Conflict(root, version)
    new = Commit(max([base, *seen]) + 1, dict(folders), dict(marks or {}), schema)
    fs, at = _open(spark, f"{root.rstrip('/')}/_commits/{new.version:010d}.json")
    try:
        out = fs.create(at, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error) or "already exists" in str(error):
            raise Conflict(root, new.version) from error
        raise
    try:
        out.write(bytearray(json.dumps(new.__dict__).encode("utf-8")))
    finally:
        out.close()
    return new


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the data folders and commits that the ``keep`` newest commits do not need, and say how many folders went.

    Not while a writer is at work: its folders are in no commit yet.
    """
    versions = _versions(spark, root)
    kept = [c for c in (_read(spark, root, v) for v in versions) if c][-keep:]
    start = f"{root.rstrip('/')}/data/"
    needed = {folder.removeprefix(start).split("/", 1)[0] for c in kept for folder in c.folders.values()}
    fs, data = _open(spark, f"{root.rstrip('/')}/data")
    gone = 0
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in needed:
            gone += fs.delete(status.getPath(), True)
    for version in versions:
        if kept and version < kept[0].version:
            _, at = _open(spark, f"{root.rstrip('/')}/_commits/{version:010d}.json")
            fs.delete(at, False)
    return gone
