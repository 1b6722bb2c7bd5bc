"""Delimited files of any size: lines are scanned in splits, and records cut where no quoted cell is open, whatever split they lie in.

Whether a line lies inside a quoted cell follows from all lines before it. A split doesn't know these, so it reads its
lines under both beginnings and for each delimiter; the splits of a file are then chained from first to last, which
tells each its own. No file, and no more than a split, is ever one value; lines end at LF.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import written
from .statements import KEY, SNIFFED

DELIMITERS = ",;\t|"
HEAD_LINES = 64
LINES = f"{KEY} string, split long, at long, value string, valid boolean, before int, after int"


def open_after(line: str, is_open: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open at a line's end, if one was or wasn't at its start. A quote opens a cell at its first place only, and a doubled one is text."""
    at = 0
    while True:
        if is_open:
            end = line.find('"', at)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == '"':
                at = end + 2
                continue
            at, is_open = end + 1, False
        elif line[at : at + 1] == '"':
            at, is_open = at + 1, True
            continue
        end = line.find(delimiter, at)
        if end < 0:
            return False
        at = end + 1


def read_lines(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """(statement_id, split, at, value, valid, before, after): the bits of before and after tell, for each delimiter and each beginning of the split, whether a quoted cell is open."""
    files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text([path] if isinstance(path, str) else list(dict.fromkeys(path)))
    raw = files.select(F.col("_metadata.file_path").alias(KEY), F.col("_metadata.file_block_start").alias("split"), F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"))
    opened = 0b10101010  # bits 2k and 2k + 1 are of delimiter k, for a split that begins outside and inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, 0, 0
        for b in batches:
            before, after, at = [], [], []
            for file, split, line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, split) != now:
                    now, state, n = (file, split), opened, 0
                before.append(state)
                if '"' in line:
                    first = line.removeprefix("﻿") if split == 0 and n == 0 else line
                    state = sum(open_after(first, bool(state >> k & 1), DELIMITERS[k // 2]) << k for k in range(8))
                after.append(state)
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64()), b.column(2), b.column(3), pa.array(before, pa.int32()), pa.array(after, pa.int32())], [KEY, "split", "at", "value", "valid", "before", "after"])

    # rows of a split come in its order, as nothing is shuffled between the scan and here
    return raw.mapInArrow(run, LINES)


def delimiters(lines: DataFrame) -> DataFrame:
    """(statement_id, d): the place in DELIMITERS of what each file's first lines are cut by."""
    first = lines.filter(f"split = 0 and at < {HEAD_LINES}").groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name, head in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    d = csv.Sniffer().sniff(head.removeprefix("﻿")[:SNIFFED], delimiters=DELIMITERS).delimiter
                except csv.Error:
                    d = "\t" if name.lower().endswith(".tsv") else ","
                found.append(DELIMITERS.index(d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], [KEY, "d"])

    return first.mapInArrow(run, f"{KEY} string, d int")


def records(lines: DataFrame) -> DataFrame:
    """lines -> (statement_id, number, d, text): records from 1, with the line breaks of their quoted cells."""
    by_file = written(delimiters(lines), "delimiters")
    # each split as what it makes of either beginning, chained along the file; a file has a split for each of its blocks
    splits = lines.groupBy(KEY, "split").agg(F.max_by("after", "at").alias("after")).join(by_file, KEY)
    chain = F.array_sort(F.collect_list(F.struct("split", F.expr("cast(shiftright(after, 2 * d) & 3 as int)").alias("ends"))))

    def step(acc, s):
        ends = s["ends"].bitwiseAND(F.when(acc["open"] == 1, 2).otherwise(1))
        return F.struct((ends != 0).cast("int").alias("open"), F.array_append(acc["out"], F.struct(s["split"].alias("split"), acc["open"].alias("begins"))).alias("out"))

    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<split:bigint,begins:int>>").alias("out"))
    begins = splits.groupBy(KEY, "d").agg(chain.alias("chain")).select(KEY, "d", F.inline(F.aggregate("chain", start, step, lambda acc: acc["out"])))
    rows = lines.join(begins, [KEY, "split"]).withColumn("inside", F.expr("(shiftright(before, 2 * d + begins) & 1) = 1"))
    # a record begins at each line that isn't inside; the records of earlier splits are counted first
    counts = rows.groupBy(KEY, "split").agg(F.count_if(~F.col("inside")).alias("k"))
    earlier = counts.withColumn("earlier", F.coalesce(F.sum("k").over(Window.partitionBy(KEY).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(KEY, "split", "earlier")
    along = Window.partitionBy(KEY, "split").orderBy("at")
    placed = rows.join(earlier, [KEY, "split"]).withColumns({"number": F.col("earlier") + F.sum((~F.col("inside")).cast("int")).over(along), "goes_on": F.expr("(shiftright(after, 2 * d + begins) & 1) = 1")})
    alone = placed.filter("not inside and not goes_on").select(KEY, "number", "d", F.col("value").alias("text"))
    parts = placed.filter("inside or goes_on").groupBy(KEY, "number", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return alone.unionByName(parts)


def scan(spark: SparkSession, path: str | list[str], pattern: str = "*.{csv,tsv,txt}") -> DataFrame:
    """(statement_id, number, cells, reason): the records of all delimited files, as csv.reader cuts them; files that aren't UTF-8 have one row with the reason."""
    lines = written(read_lines(spark, path, pattern), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            names, numbers, cells = [], [], []
            for name, number, d, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text.removeprefix("﻿") if number == 1 else text
                for row in csv.reader(io.StringIO(text, newline=""), delimiter=DELIMITERS[d]) if text else [[]]:
                    names.append(name)
                    numbers.append(number)
                    cells.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], [KEY, "number", "cells"])

    bad = written(lines.filter("not valid").select(KEY).distinct(), "bad")
    good = records(lines.join(bad, KEY, "left_anti")).select(KEY, "number", "d", "text").mapInArrow(run, f"{KEY} string, number long, cells array<string>")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("reason", F.lit("not UTF-8 text")), allowMissingColumns=True)
