"""Zip archives of newline-delimited JSON, and plain text files, as rows of lines that keep their identity.

``source_dataset``, ``member`` and ``line_no`` name a line: they depend on its own file alone, not on which other
files are read with it or how Spark splits them.
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from embertrace.operators.skew import TableSize
from embertrace.session import ship_package

_BATCH = 10_000
_SCHEMA = "source_dataset string, member string, line_no bigint, line string"
_MEMBER = "path string, member string, at bigint, method int, flags int, crc bigint, packed bigint, size bigint"
#: A task reads members of about this many packed bytes, or one larger member; or splits of text files of about as many bytes.
TASK_BYTES = 32 << 20
MOST_TASKS = 20_000


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system that can read parts of a file, and the path there; ValueError if there is none for the scheme."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path)


class _Ranged(io.RawIOBase):
    """A file of a store as Python's zip reader wants it: places before its start are OS errors."""

    def __init__(self, path: str):
        system, name = _file_system(path)
        self.file = system.open_input_file(name)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as error:
            raise OSError(str(error)) from error

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> io.BufferedReader:
    return io.BufferedReader(_Ranged(path), 1 << 18)


def _directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The JSON members of archives by their central directories, which lie at the ends of the files."""
    for batch in batches:
        for path in batch["path"]:
            with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                rows = [
                    (path, m.filename, m.header_offset, m.compress_type, m.flag_bits, m.CRC, m.compress_size, m.file_size)
                    for m in archive.infolist()
                    if m.filename.endswith(".json")
                ]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in _MEMBER.split(", ")])


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of members, each read from its own place in its archive."""
    for batch in batches:
        for m in batch.itertuples(index=False):
            if m.flags & 1:
                raise RuntimeError(f"{m.member} in {m.path} is encrypted")
            info = zipfile.ZipInfo(m.member)
            info.compress_type, info.flag_bits, info.CRC, info.compress_size, info.file_size = (int(x) for x in (m.method, m.flags, m.crc, m.packed, m.size))
            with _opened(m.path) as raw:
                raw.seek(m.at)
                # a local header is 30 bytes, then a name and extra fields whose lengths stand at its end
                raw.seek(m.at + 30 + sum(struct.unpack("<26x2H", raw.read(30))))
                with zipfile.ZipExtFile(raw, "r", info) as content:
                    yield from _lines(_stem(m.path), m.member, io.TextIOWrapper(content, encoding="utf-8", errors="replace"))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            stem = _stem(path)
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    if member.endswith(".json"):
                        with archive.open(member) as raw:
                            yield from _lines(stem, member, io.TextIOWrapper(raw, encoding="utf-8", errors="replace"))


def _lines(stem: str, member: str, text: Iterable[str]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[str, str, int, str]] = []
    for number, line in enumerate(text):
        if line := line.strip():
            rows.append((stem, member, number, line))
        if len(rows) >= _BATCH:
            yield pd.DataFrame(rows, columns=["source_dataset", "member", "line_no", "line"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["source_dataset", "member", "line_no", "line"])


def zip_members(spark: SparkSession, *paths: str) -> DataFrame:
    """The JSON members of zip archives (files, folders or globs): where each lies and how large it is."""
    ship_package(spark)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(list(paths))
    # without its content column a file is only listed
    found = archives.select("path")
    return found.repartition(max(1, min(found.count(), spark.sparkContext.defaultParallelism)), "path").mapInPandas(_directory, _MEMBER)


def zip_lines(spark: SparkSession, *paths: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Lines of all ``*.json`` members of zip archives (files, folders or globs); ``line_no`` counts them from 0.

    The central directories are read first.  Then members are the unit of work: each is read from its own place in
    the archive, so an archive of many members is read by many tasks and none of them holds it.  In a store that
    offers no reading from the middle of a file, an archive is one value in one task.
    """
    ship_package(spark)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(list(paths))
    some = archives.select("path").first()
    try:
        if some:
            _file_system(some["path"])
    except (ValueError, OSError):
        return archives.select("path", "content").mapInPandas(_unzip, _SCHEMA)
    members = zip_members(spark, *paths)
    total = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("packed"), F.lit(0)).alias("bytes")).first()
    by_size = -(-total["bytes"] // task_bytes)
    tasks = max(1, min(total["n"], MOST_TASKS, max(by_size, 8 * spark.sparkContext.defaultParallelism, total["n"] // 2)))
    return members.repartition(tasks, "path", "at").mapInPandas(_members, _SCHEMA)


def _bytes_before(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bytes of the lines before this one in its split, as rows come in the order of the file."""
    last, carried = None, 0
    for file, block, size in parts:
        keys = np.column_stack([file.to_numpy(), block.to_numpy()])
        sizes = size.to_numpy()
        before = np.cumsum(sizes) - sizes
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        offset = -before[starts]
        if len(keys) and last is not None and tuple(keys[0]) == last:
            offset[0] += carried
        place = before + np.repeat(offset, np.diff(np.append(starts, len(keys))))
        if len(keys):
            last, carried = tuple(keys[-1]), int(place[-1] + sizes[-1])
        yield pd.Series(place)


def _few_tasks(lines: DataFrame, splits: int) -> DataFrame:
    """The lines of a scan with several small splits to a task, as a task takes longer to start than to read some kilobytes.

    The splits are the same, and so is the order of the lines in each.
    """
    spark = lines.sparkSession
    most = splits * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(-(-most // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < splits else lines


def _placed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, name, at, line``: :func:`offset_lines` with the names of the files, found once per split."""
    ship_package(spark)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    size = F.octet_length("value") + 1
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select("value", file.alias("path"), block.alias("block"), size.cast("bigint").alias("size"))
    files, parts = lines.inputFiles(), lines.rdd.getNumPartitions()
    # a part is one split of the full size, or ends of files and small files
    splits = parts + len(files)
    width = 32 + max((len(p) + len(posixpath.basename(p)) for p in files), default=0)
    lines = _few_tasks(lines, parts)
    per_split = lines.groupBy("path", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_split.select("path", "block", _name(F.col("path")).alias("name"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    # bounded, not measured, which would take one more scan
    if TableSize(splits, splits * width).may_broadcast():
        starts = F.broadcast(starts)
    # the running sum must see every line, so no filter may move below it
    running = F.pandas_udf(_bytes_before, LongType()).asNondeterministic()
    inside = running(F.xxhash64("path"), "block", "size")
    placed = lines.withColumn("inside", inside).join(starts, ["path", "block"], "left")
    changed = F.raise_error(F.lit("files were split in another way in the second scan"))
    at = F.when(F.col("start").isNull(), changed.cast("bigint")).otherwise(F.col("start") + F.col("inside"))
    return placed.select("path", "name", at.alias("at"), F.col("value").alias("line"))


def offset_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, at, line``: the lines of text files, large ones split between tasks, with the byte each starts at.

    A first scan sums the bytes of each split; what a file's earlier splits hold, and the running sum inside a split,
    give the place of a line whatever the splits are.
    """
    return _placed_lines(spark, *paths).select("path", "at", "line")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of unpacked JSON files; large files are split between tasks.  ``line_no`` is the byte a line starts at."""
    # trimming other characters than blanks walks through the whole text
    line = F.when(F.endswith("line", F.lit("\r")), F.rtrim("line", F.lit("\r"))).otherwise(F.col("line"))
    return (
        _placed_lines(spark, *paths)
        .select(F.col("name").alias("source_dataset"), F.col("path").alias("member"), F.col("at").alias("line_no"), line.alias("line"))
        .filter(F.trim("line") != "")
    )


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of log files (files or globs)."""
    return spark.read.text(list(paths)).select(F.col("value").alias("line"))
