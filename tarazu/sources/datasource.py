"""Statement files as a data source of Spark: spark.read.format("statements"), and the same as a stream.

Options: path; pattern, a glob of file names; formats, one's own formats by name ("module:attribute", separated by
commas), each a pair as in sources.statements. Gives (statement_id, number, cells, reason), as read_files() does, and
a reason for empty files, which Spark's own listing leaves out;
sources.load.from_grid() takes it from there. Files are opened by the executors, so the store has to be one that
pyarrow reaches; read_files() reads whatever Spark reads.
"""

from __future__ import annotations

import csv
import fnmatch
import importlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import workbook
from .statements import MOST_BYTES, Refused, cut

SCHEMA = "statement_id string, number int, cells array<string>, reason string"
PATTERN = "*.{csv,tsv,txt,xlsx,xls,pdf}"
#: A partition is as many files as have about so many bytes.
PARTITION_BYTES = 1 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def _patterns(glob: str) -> list[str]:
    """A glob's braces, written out."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [x for part in m[1].split(",") for x in _patterns(glob[: m.start()] + part + glob[m.end() :])] if m else [glob]


class _Reading:
    """What both readers share: the listing and the cutting of files."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.globs = options["path"], _patterns(options.get("pattern", PATTERN))
        self.names = [x for x in options.get("formats", "").split(",") if x]
        self.most_bytes = int(options.get("most_bytes", MOST_BYTES))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path.removeprefix("file:")))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) of the files, oldest first. Only names and sizes pass here."""
        from pyarrow import fs

        store, root = self._store()
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and any(fnmatch.fnmatchcase(f.base_name, g) for g in self.globs)]
        return sorted((f.mtime_ns, f.path, f.size) for f in found)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[InputPartition]:
        out, held = [[]], 0
        for _, path, size in files:
            if held and held + size > self.partition_bytes:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += max(size, 1)
        return [Files(x) for x in out if x]

    def rows(self, partition: Files) -> Iterator[tuple]:
        parts = [name.partition(":") for name in self.names]
        formats = tuple(getattr(importlib.import_module(module), attribute) for module, _, attribute in parts)
        store, _ = self._store()
        for path, size in partition.files:
            if size == 0 or size > self.most_bytes:
                yield path, 1, None, "the file is empty" if size == 0 else f"larger than {self.most_bytes} bytes"
                continue
            try:
                with store.open_input_stream(path, compression=None) as f:
                    records = cut(f.read(), path, formats)
            except (Refused, csv.Error, workbook.Unreadable) as e:
                yield path, 1, None, str(e)
                continue
            for k, cells in enumerate(records, 1):
                yield path, k, cells, None


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(self.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class StreamReader(_Reading, DataSourceStreamReader):
    """An offset is the time and path of the last file taken; files are taken once, in the order of their times."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = ((x["time"], x["path"]) for x in (start, end))
        return self.dealt([f for f in self.listed() if after < f[:2] <= until]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:  # files stay where they are
        return None


class Statements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(Statements)
