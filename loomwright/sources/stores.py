"""Files by name in any store that executors share: local folders, and what pyarrow reaches by URI."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path inside it."""
    return pafs.FileSystem.from_uri(uri.rstrip("/") or "/")


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """Write each row's text or bytes to its path under `folder`, from the executors; returns how many files.

    A task that runs again writes the same files; of rows with one path any is the one that stays, and null contents are empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        made: set[str] = set()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{name}"
                above = target.rsplit("/", 1)[0]
                if above not in made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                with fs.open_output_stream(target) as out:
                    out.write(b"" if body is None else body.encode() if isinstance(body, str) else bytes(body))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return rows.select(path, content).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
