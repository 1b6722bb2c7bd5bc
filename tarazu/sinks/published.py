"""One file from a distributed table: tasks stage parts beside it, and the commit joins them in order and puts the file in place.

Rows become lines of text on the JVM side, of CSV or of a workbook's sheets. A part that a failed or repeated task left
is in no commit, and goes with the staging folder. Nothing is collected: the commit copies bytes, piece by piece. The
file has to be in a store that pyarrow reaches.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import NumericType

from ..sources import workbook

PIECE = 1 << 20


@dataclass
class Staged(WriterCommitMessage):
    """The parts of a task: (sheet, partition, file)."""

    parts: list[tuple[int, int, str]]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


class Publisher(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], options.get("kind", "csv")
        self.names = options.get("sheets", "").split("\n")
        self.staging = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, rows: Iterator) -> Staged:
        """rows(sheet, line): a part for each sheet that the task has rows of."""
        store, folder = _store(self.staging)
        store.create_dir(folder, recursive=True)
        partition, parts, files = TaskContext.get().partitionId(), [], {}
        for row in rows:
            if row[0] not in files:
                name = f"{folder}/{uuid.uuid4().hex}"
                files[row[0]] = store.open_output_stream(name, compression=None)
                parts.append((row[0], partition, name))
            files[row[0]].write(row[1].encode())
        for f in files.values():
            f.close()
        return Staged(parts)

    def _parts(self, messages: list[Staged], sheet: int) -> Iterator[bytes]:
        store, _ = _store(self.staging)
        for _, _, name in sorted(p for m in messages if m for p in m.parts if p[0] == sheet):
            with store.open_input_stream(name, compression=None) as f:
                while piece := f.read(PIECE):
                    yield piece

    def commit(self, messages: list[Staged]) -> None:
        store, path = _store(self.path)
        _, folder = _store(self.staging)
        store.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with store.open_output_stream(whole, compression=None) as out:
            if self.kind == "csv":
                out.write(b"\xef\xbb\xbf")
                for piece in self._parts(messages, 0):
                    out.write(piece)
            else:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                    for name, text in workbook.frame(self.names).items():
                        book.writestr(name, text)
                    for k in range(len(self.names)):
                        with book.open(f"{workbook.SHEET}{k + 1}.xml", "w", force_zip64=True) as sheet:
                            shutil.copyfileobj(_Pieces([workbook.SHEET_HEAD.encode()], self._parts(messages, k), [workbook.SHEET_FOOT.encode()]), sheet, PIECE)
        store.move(whole, path)
        store.delete_dir(folder)

    def abort(self, messages: list[Staged]) -> None:
        store, folder = _store(self.staging)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


class _Pieces:
    """Iterators of bytes as something to read from; a read gives a piece, whatever its size."""

    def __init__(self, *parts) -> None:
        self.pieces = (piece for part in parts for piece in part if piece)

    def read(self, _size: int) -> bytes:
        return next(self.pieces, b"")


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema, overwrite: bool) -> Publisher:
        return Publisher(dict(self.options))


def csv_line(columns: list[Column]) -> Column:
    """A line as csv.writer gives it: cells with a comma, quote or line break are quoted, null is empty."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat(F.concat_ws(",", *(cell(c.cast("string")) for c in columns)), F.lit("\r\n"))


def sheet_line(df: DataFrame, columns: list[str]) -> Column:
    """A sheet's row: numbers are numbers, null is an empty cell, all else is text."""

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, NumericType):
            return F.coalesce(F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>")), F.lit("<c/>"))
        text = F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        for sign, name_ in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name_))
        return F.coalesce(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")), F.lit("<c/>"))

    return F.concat(F.lit("<row>"), *(cell(c) for c in columns), F.lit("</row>"))


def _titled(df: DataFrame, line: Column, title: str, order: list[str], sheet: int) -> DataFrame:
    """(sheet, place, line), a title before all rows. place is the order's columns."""
    keys = [F.struct(F.col(f"`{c}`").isNotNull().alias("known"), F.col(f"`{c}`").cast("string").alias("text") if not isinstance(df.schema[c].dataType, NumericType) else F.lpad((F.col(f"`{c}`").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0").alias("text")) for c in order]
    rows = df.select(F.lit(sheet).alias("sheet"), F.array(F.struct(F.lit(True).alias("known"), F.lit("1").alias("text")), *keys).alias("place"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(title,)], "line string").select(F.lit(sheet).alias("sheet"), F.array(F.struct(F.lit(True).alias("known"), F.lit("0").alias("text"))).alias("place"), "line")
    return rows.unionByName(head)


def _publish(lines: DataFrame, path: str, **options: str) -> None:
    lines.sparkSession.dataSource.register(Published)
    lines.orderBy("sheet", "place").select("sheet", "line").write.format("published").options(path=path, **options).mode("append").save()


def publish_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a byte-order mark and a header, rows by the order's columns, nulls first."""
    _publish(_titled(df, csv_line([F.col(f"`{c}`") for c in df.columns]), ",".join(df.columns) + "\r\n", order, 0), path, kind="csv")


def publish_workbook(sheets: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """One workbook; each sheet is a table and the columns that its rows are ordered by, under a row of titles."""
    parts = []
    for k, (df, order) in enumerate(sheets.values()):
        title = "<row>" + "".join(f'<c t="inlineStr"><is><t>{workbook.escape(c.replace("_", " "))}</t></is></c>' for c in df.columns) + "</row>"
        parts.append(_titled(df, sheet_line(df, df.columns), title, order, k))
    _publish(reduce(DataFrame.unionByName, parts), path, kind="xlsx", sheets="\n".join(sheets))
