"""Slices of volume files as a data source: spark.read.format("volume_slices").load(folder).

A partition is some files, so many that the files make TASKS partitions, but not more than TASK_FILES of them or TASK_BYTES; with the option
`parts`, a file of SPLIT_BYTES or more is every parts-th slice of it, so that large files are read by several tasks. What is asked for are options, as lists in JSON: `k` (slices) and `studies`; a file of another study is not
opened, and of the others only the headers and these slices are read (volumes.Volume). They are options and not conditions
that Spark hands down, because two scans of one frame with different conditions share what is handed down. Others: parts
(1), files (files of a partition at most), split_bytes. Files are reached through pyarrow, by path or URI.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.shipping import ship
from ledgerline.sources.volumes import SCHEMA, slices

#: Partitions that few files are dealt to, and what one holds at most: a task costs about as much as opening ten small files.
TASKS, TASK_FILES, TASK_BYTES = 64, 500, 128 << 20
#: Smaller files are not read by several tasks, whatever `parts`.
SPLIT_BYTES = 16 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Share(InputPartition):
    """Files; value: which of their parts, None for all of them."""

    def __init__(self, files: Sequence[str], part: int | None):
        super().__init__(part)
        self.files = list(files)

    def holds(self, i: int, parts: int) -> bool:
        return self.value is None or i % parts == self.value


def found_files(store: fs.FileSystem, path: str, wanted: Callable[[str], bool]) -> list[fs.FileInfo]:
    """The wanted files below path, by path."""
    return sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and wanted(f.path)), key=lambda f: f.path)


def shares(found: Sequence[fs.FileInfo], parts: int, most: int = TASK_FILES, split_bytes: int = SPLIT_BYTES) -> list[Share]:
    """The partitions of files: large ones in parts, the others several at a time."""
    large = lambda f: parts > 1 and f.size >= split_bytes
    out = [Share([f.path], part) for f in found if large(f) for part in range(parts)]
    small = [f for f in found if not large(f)]
    each, held, size = max(1, min(most, -(-len(small) // TASKS))), [], 0
    for f in small:
        if held and (len(held) >= each or size + f.size > TASK_BYTES):
            out.append(Share(held, None))
            held, size = [], 0
        held.append(f.path)
        size += f.size
    return out + [Share(held, None)] * bool(held)


class SliceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.parts, self.each, self.split_bytes = int(options.get("parts", 1)), int(options.get("files", TASK_FILES)), int(options.get("split_bytes", SPLIT_BYTES))
        self.slices, self.studies = (json.loads(options[name]) if name in options else None for name in ("k", "studies"))

    def partitions(self) -> Sequence[InputPartition]:
        store, path = _store(self.path)
        only = None if self.studies is None else set(self.studies)
        named = found_files(store, path, lambda f: f.endswith((".nii", ".nii.gz")) and (only is None or self.study(f) in only))
        return shares(named, self.parts, self.each, self.split_bytes)

    @staticmethod
    def study(file: str) -> str:
        return file.rpartition("/")[2].removesuffix(".gz").removesuffix(".nii").partition("__")[0]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for file in partition.files:
            with store.open_input_file(file) as stream:
                for row in slices(stream, file.rpartition("/")[2], lambda k, n: partition.holds(k, self.parts) and (self.slices is None or k in self.slices)):
                    yield tuple(row.values())


class VolumeSlices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_slices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SliceReader:
        return SliceReader(self.options)


def volume_slices(spark: SparkSession, folder: str, k: Sequence[int] | None = None, studies: Sequence[str] | None = None, parts: int = 1) -> DataFrame:
    """Registers the source and reads the folder: the slices k of the studies, or all."""
    ship(spark)
    spark.dataSource.register(VolumeSlices)
    asked = {name: json.dumps(list(value)) for name, value in (("k", k), ("studies", studies)) if value is not None}
    return spark.read.format("volume_slices").options(parts=parts, **asked).load(folder)
