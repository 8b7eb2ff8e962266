"""Files as bytes: written by tasks, and read by a data source that opens each only for its first bytes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.functions.session import importable

#: Files of one folder that a task reads.
FILES_A_TASK = 10_000


def file_system(path: str):
    """The file system of an absolute path or an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _listed(system, root: str, deep: bool) -> list:
    """Entries of a folder; names that begin with a dot or an underscore are not data."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, recursive=deep))
    return [e for e in found if not any(p.startswith((".", "_")) for p in e.path[len(root) :].strip("/").split("/"))]


class FolderPart(InputPartition):
    """A folder to be listed by its task, or files that have been listed, as (path, length)."""

    def __init__(self, folder: str | None, files: list[tuple[str, int]]):
        self.folder, self.files = folder, files


class HeadReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[FolderPart]:
        """Only the uppermost level is listed here; a folder in it is listed and read by a task of its own."""
        found = sorted(_listed(*file_system(self.path), False), key=lambda e: e.path)
        files = [(e.path, e.size) for e in found if e.is_file]
        parts = [FolderPart(e.path, []) for e in found if not e.is_file]
        parts += [FolderPart(None, files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)]
        return parts or [FolderPart(None, [])]

    def read(self, part: FolderPart) -> Iterator[tuple[str, int, bytes]]:
        system, _ = file_system(self.path)
        files = part.files if part.folder is None else [(e.path, e.size) for e in _listed(system, part.folder, True) if e.is_file]
        for path, length in files:
            with system.open_input_file(path) as f:
                yield path, length, f.read(self.most)


class FileHeads(DataSource):
    """path, length and the first bytes (option `bytes`, 12 if unset) of every file under the folder in option `path`."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("bytes", 12)))


def read_heads(spark: SparkSession, path: str, most: int = 12) -> DataFrame:
    """path, length, head of every file under a folder that all executors reach; nothing beyond the head is read."""
    importable(spark)
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", most).load(path)


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row (path, content) as a file under the folder and return their number. A file gets its name when it is whole, so
    a lost task leaves no part of one; a repeated task writes the same files again. A null content is an empty file."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        made = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content").to_pylist()):
                place = f"{root}/{path}"
                parent, name = place.rsplit("/", 1)
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content or b"")
                system.move(part, place)
            yield pa.record_batch([pa.array([len(paths)], pa.int64())], names=["n"])

    return df.select("path", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
