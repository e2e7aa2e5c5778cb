"""The files of a tree as rows that tasks list and read: no name passes through the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType, TimestampType

from loomwright.sources.stores import store

#: Rows and bytes of content of a batch that a task hands on.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def reached(root: str) -> bool:
    """Whether tasks can walk this folder by name; other roots (files, globs, stores that Hadoop alone opens) they cannot."""
    try:
        fs, base = store(root)
        return fs.get_file_info(base).type == pafs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ValueError, OSError):
        return False


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, size, microseconds of the last change) of what a folder holds; a local folder of any length is read piece by piece."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for one in found:
                if one.is_dir() or one.is_file():
                    told = one.stat()
                    yield one.name, one.is_dir(), told.st_size, told.st_mtime_ns // 1000
        return
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000


def _cut(rows: Iterator[tuple], kinds: dict[str, pa.DataType], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded rows and, where a column has sizes, bytes."""
    held, taken = [], 0
    for row in rows:
        held.append(row)
        taken += row[size] if size is not None else 0
        if len(held) >= BATCH_ROWS or taken > BATCH_BYTES:
            yield _batch(held, kinds)
            held, taken = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def _listing(folders: DataFrame, root: str, want_folders: bool) -> DataFrame:
    """The folders, or the files with size and time, right inside of each of `folders` (folder), by their path below the root."""
    kinds = {"folder": pa.string()} if want_folders else {"source_id": pa.string(), "size": pa.int64(), "modified": pa.timestamp("us", "UTC")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    for name, is_folder, size, changed in _entries(fs, f"{base}/{folder}"):
                        if is_folder == want_folders:
                            yield (f"{folder}{name}/",) if want_folders else (f"{folder}{name}", size, changed)

        yield from _cut(found(), kinds)

    return folders.mapInArrow(run, "folder string" if want_folders else "source_id string, size long, modified timestamp")


def walk(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(source_id, size, modified) of the files of a folder; source_id is the path below it.

    Folders are found level by level, each listed by the tasks of one job, and stay as rows; files are listed when the result is read.
    """
    tasks = spark.sparkContext.defaultParallelism
    level = folders = spark.createDataFrame([("",)], "folder string")
    while recursive:
        level = _listing(level.repartition(tasks, "folder"), root, True).persist()
        if level.isEmpty():
            break
        folders = folders.unionByName(level)
    return _listing(folders.repartition(tasks, "folder"), root, False)


def contents(listed: DataFrame, root: str) -> DataFrame:
    """Rows of a walk, whose columns begin with source_id and size, with `content`, the bytes of each file.

    Rows are dealt to all cores by name; a batch is bounded in bytes, and one larger file stands alone.
    """
    own = listed.select("source_id", "size", *(c for c in listed.columns if c not in ("source_id", "size")))
    fields = {f.name: pa.timestamp("us", "UTC") if isinstance(f.dataType, TimestampType) else to_arrow_type(f.dataType) for f in own.schema.fields} | {"content": pa.binary()}
    dealt = own.repartition(4 * listed.sparkSession.sparkContext.defaultParallelism, "source_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns)):
                    with fs.open_input_file(f"{base}/{row[0]}") as source:
                        yield *row, source.read()

        yield from _cut(each(), fields, 1)

    return dealt.mapInArrow(run, StructType([*own.schema.fields, StructField("content", BinaryType())]))
