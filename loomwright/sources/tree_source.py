"""A tree of source files as a Spark data source, `source_tree`, in batch and as a stream.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("root", uri).option("exclude", "build/*,**/node_modules/**").load()
    spark.readStream.format("source_tree").option("root", uri).load()

The driver lists names, sizes and times; tasks read the files, in shares of bounded bytes.  Filters on language, extension and modification time are
applied to the listing, so files that cannot match are never opened; Spark hands them over where its setting for Python sources allows it,
and the options `languages` and `since` do the same everywhere.  A file that cannot be read is a row with
an error and no content, and does not fail the scan.  A stream's offset is the time and path of the last file: files that come later with older times are not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

from loomwright.functions.text import path_pattern
from loomwright.sources.files import TREE_EXTENSIONS
from loomwright.sources.stores import store

#: Columns of the source.
COLUMNS = "source_id string, language string, extension string, size long, modified timestamp, content string, error string"
#: Bytes and files of a task's share, and bytes of a batch that it hands on.
SHARE_BYTES, SHARE_FILES, BATCH_BYTES = 32 << 20, 1000, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Share(InputPartition):
    """Files of one task: (source id, size, microseconds of the last change)."""

    files: list[tuple[str, int, int]]


def decoded(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it is not that."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class _Tree:
    """Listing and reading, which batch and stream share."""

    def __init__(self, options: dict[str, str]):
        told = {k.lower(): v for k, v in options.items()}
        if not told.get("root"):
            raise ValueError("the option root names the tree's folder")
        self.root = told["root"]
        self.exclude = [path_pattern(g.strip()) for g in told.get("exclude", "").split(",") if g.strip()]
        wanted = {x.strip().lower() for x in told.get("languages", "").split(",") if x.strip()}
        self.extensions = {e for e, lang in TREE_EXTENSIONS.items() if not wanted or lang in wanted}
        self.after = _micros(datetime.fromisoformat(told["since"])) if told.get("since") else None

    def listed(self) -> list[tuple[str, int, int]]:
        """(source id, size, microseconds of the last change) of the files that are wanted, by id; empty files are not."""
        fs, base = store(self.root)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.root)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
            name = info.path[len(base) :].lstrip("/")
            changed = (info.mtime_ns or 0) // 1000
            if info.type == pafs.FileType.File and info.size and _extension(name) in self.extensions and (self.after is None or changed > self.after) and not any(re.search(p, info.path) for p in self.exclude):
                out.append((name, info.size, changed))
        return sorted(out)

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        fs, base = store(self.root)
        rows, held = [], 0
        for name, size, changed in share.files:
            content = error = None
            try:
                with fs.open_input_file(f"{base}/{name}") as source:
                    content = decoded(source.read())
            except OSError as e:  # one file's failure is its own
                error = f"{type(e).__name__}: {e}"
            rows.append((name, TREE_EXTENSIONS[_extension(name)], _extension(name), size, changed, content, error))
            held += size
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _extension(name: str) -> str:
    found = re.search(r"\.[^./]+$", name)
    return found[0] if found else ""


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1e6)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in COLUMNS.split(", ")])


def shares(files: list[tuple[str, int, int]]) -> list[Share]:
    """Files dealt to tasks of bounded bytes and numbers; a larger file is a share of its own."""
    out: list[Share] = []
    held = SHARE_BYTES
    for one in files:
        if held + one[1] > SHARE_BYTES or len(out[-1].files) >= SHARE_FILES:
            out.append(Share([]))
            held = 0
        out[-1].files.append(one)
        held += one[1]
    return out


class TreeReader(DataSourceReader):
    def __init__(self, tree: _Tree):
        self.tree = tree

    def partitions(self) -> list[InputPartition]:
        return shares(self.tree.listed()) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class PushingReader(TreeReader):
    """A reader that takes over filters on language, extension and modification time."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tree = self.tree
        for one in filters:
            name, value = (one.attribute[0] if len(one.attribute) == 1 else None), getattr(one, "value", None)
            values = value if isinstance(one, In) else (value,)
            if name == "language" and isinstance(one, (EqualTo, In)):
                tree.extensions = {e for e in tree.extensions if TREE_EXTENSIONS[e] in values}
            elif name == "extension" and isinstance(one, (EqualTo, In)):
                tree.extensions &= set(values)
            elif name == "modified" and isinstance(one, (GreaterThan, GreaterThanOrEqual)) and isinstance(value, datetime):
                least = _micros(value) - isinstance(one, GreaterThanOrEqual)
                tree.after = least if tree.after is None else max(tree.after, least)
            else:
                yield one  # Spark's to apply


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, tree: _Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        changed, name = max(((c, n) for n, _, c in self.tree.listed()), default=(-1, ""))
        return {"changed": changed, "path": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((at["changed"], at["path"]) for at in (start, end))
        return shares([f for f in self.tree.listed() if low < (f[2], f[0]) <= high]) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else TreeReader)(_Tree(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeStreamReader(_Tree(dict(self.options)))


def _options(root: str, exclude: list[str] | None, languages: list[str] | None, since: str | None) -> dict[str, str]:
    told = {"root": root, "exclude": ",".join(exclude or []), "languages": ",".join(languages or []), "since": since or ""}
    return {k: v for k, v in told.items() if v}


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, since: str | None = None) -> DataFrame:
    """The files of a tree, with an error by row for those that cannot be read."""
    spark.dataSource.register(TreeSource)
    pushing = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("source_tree").options(pushdown=pushing, **_options(root, exclude, languages, since)).load()


def stream_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """The files of a tree as they come and change, each change a row."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").options(**_options(root, exclude, languages, None)).load()
