"""Bank statements in delimited files and workbooks: ragged grids in, typed statements and transactions out, with the files refused and why.

Bytes are cut into rows in Python, a file a row; all that follows is Column expressions and windows by
statement. Files are read apart, so a window holds one file's rows.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import dates, money
from ..functions.bind import bind
from ..session import shuffled
from . import workbook

#: Column headings by field, bank names, and patterns of labels.
ALIASES = {
    "value_date": ("value date", "value dt"),
    "date": ("date", "txn date", "transaction date", "tran date", "posting date"),
    "narration": ("narration", "description", "particulars", "transaction remarks", "remarks", "details", "transaction details", "transaction description"),
    "debit": ("withdrawal amt", "withdrawal amount", "withdrawal", "withdrawal (dr)", "debit", "debit amount", "dr", "paid out"),
    "credit": ("deposit amt", "deposit amount", "deposit", "deposit (cr)", "credit", "credit amount", "cr", "paid in"),
    "balance": ("closing balance", "balance", "running balance", "balance (inr)", "available balance"),
    "amount": ("amount", "transaction amount", "amount (inr)"),
}
BANKS = ("hdfc", "icici", "sbi", "state bank of india", "axis", "kotak", "yes bank", "idfc", "indusind", "pnb", "canara", "bank of baroda", "au small finance", "federal bank")
OPENING = r"(?i)^\s*(opening\s+bal(?:ance)?\.?|bal(?:ance)?\.?\s+b[/\s.]*f|b[/\s.]*f|brought\s+forward)\b"
CLOSING = r"(?i)^\s*(closing\s+bal(?:ance)?\.?|bal(?:ance)?\.?\s+c[/\s.]*f|c[/\s.]*f|carried\s+forward)\b"
SUMMARY = r"(?i)^\s*((statement|account|transaction)\s+summary\b|summary\s*[:\-])"
TOTALS = r"(?i)^\s*(transaction|grand|statement)?\s*totals?(\s+(of\s+)?transactions?)?\s*$"
#: How a cell begins that one of the patterns above can match.
MARKED = r"(?i)^\s*(?:open|clos|bal|b[/\s.]*f|brought|c[/\s.]*f|carried|statement|account|transaction|summary|grand|total)"
TIME_SUFFIX = r"\s*(?:[&/]|and)\s*time\s*$"
CURRENCY_SUFFIX = r"\s*(?:[(\[]\s*(?:in\s+)?(?:inr|rs\.?|₹|usd|\$)\s*[)\]]|\sin\s(?:inr|rs\.?|₹))\s*$"
MASKED = r"((?:[Xx]{2,}|\*{2,})\s?\d{3,6})\b"
LABELLED = r"(?i)\baccount\s*(?:no\.?|number|#)?\s*[:\-]\s*(\d{6,20})\b"
OLE2 = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
HEADER_ROWS, LOOK_AHEAD, SNIFFED = 40, 6, 4096
#: Files are one value each here, which can't be larger than 2 GiB.
MOST_BYTES = 1 << 30
KEY = "statement_id"


class Refused(ValueError):
    """Why a file's bytes give no grid."""


#: A format of one's own: whether it takes a file, by its bytes and path, and how it cuts these into rows.
Format = tuple[Callable[[bytes, str], bool], Callable[[bytes, str], list[list[str]]]]


def cut(content: bytes, path: str, formats: tuple[Format, ...] = ()) -> list[list[str]]:
    """Records of a file: by the first format that takes it, else by what its first bytes say it is."""
    for accepts, read in formats:
        if accepts(content, path):
            return read(content, path)
    if content.startswith(OLE2):
        raise Refused("an old binary workbook: save it as .xlsx or .csv")
    if content.startswith(b"%PDF"):
        raise Refused("needs_password" if b"/Encrypt" in content else "a PDF: words with their places are read by sources.words")
    return first_table(content) if content.startswith(b"PK\x03\x04") else delimited(content, path)


def names_money(cells: list[str]) -> bool:
    """What names_columns() says of a row, for rows that aren't in Spark yet."""
    plain = [re.sub(CURRENCY_SUFFIX, "", re.sub(TIME_SUFFIX, "", re.sub(r"[.:]+$", "", " ".join(c.lower().split())))).strip() for c in cells]
    field = {name: f for f, names in ALIASES.items() for name in names}
    found = {field.get(c) or field.get(c[:-1] if c.endswith("s") else "") for c in plain}
    return "date" in found and bool({"balance", "amount"} & found or {"debit", "credit"} <= found)


def first_table(content: bytes) -> list[list[str]]:
    """The rows of a workbook's first sheet that has a header, or of its first sheet."""
    first = None
    for rows in workbook.sheets(content):
        if any(map(names_money, rows[:HEADER_ROWS])):
            return rows
        first = rows if first is None else first
    return first


def delimited(content: bytes, path: str) -> list[list[str]]:
    """Records of a delimited file; quoted line breaks stay in their cell, which may be of any size."""
    try:
        text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
    except UnicodeDecodeError:
        raise Refused("not UTF-8 text") from None
    csv.field_size_limit(1 << 30)
    try:
        delimiter = csv.Sniffer().sniff(text[:SNIFFED], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = "\t" if path.lower().endswith(".tsv") else ","
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


def read_files(spark: SparkSession, path: str | list[str], pattern: str = "*.{csv,tsv,txt,xlsx,xls,pdf}", formats: tuple[Format, ...] = (), most_bytes: int = MOST_BYTES, most_files: int | None = None) -> DataFrame:
    """cut_files() of every file under the paths. A file that several paths reach is read once.

    Larger files, and those of a folder after its first most_files by name, are refused unread: what is too large is
    told by the listing, and the limit reaches the scan. Spark lists no empty files. Delimited files of any size:
    sources.delimited.
    """
    files = found_files(spark, path, pattern)
    listing = files.select("path", "length")
    reason = F.when(F.col("length") > most_bytes, f"larger than {most_bytes} bytes")
    taken = files.filter(F.col("length") <= most_bytes)
    if most_files is not None:
        folder = Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).orderBy("path")
        listing = listing.withColumn("k", F.row_number().over(folder))
        reason = F.coalesce(reason, F.when(F.col("k") > most_files, f"over {most_files} files in a folder"))
        taken = taken.join(listing.filter(F.col("k") <= most_files).select("path"), "path", "left_semi")
    refused = listing.select(F.col("path").alias(KEY), reason.alias("reason")).filter("reason is not null")
    return cut_files(taken, formats).unionByName(refused.withColumns({"number": F.lit(1), "cells": F.lit(None).cast("array<string>")}).select(KEY, "number", "cells", "reason"))


def cut_files(files: DataFrame, formats: tuple[Format, ...] = ()) -> DataFrame:
    """files(path, content) -> (statement_id, number, cells, reason): every record of each, numbered from 1; a file that gives none has one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows, reason = cut(content, name, formats), None
                except (Refused, csv.Error, workbook.Unreadable) as e:
                    rows, reason = [None], str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(rows, pa.list_(pa.string())), pa.array([reason] * len(rows), pa.string())], [KEY, "number", "cells", "reason"])

    return files.select("path", "content").mapInArrow(run, f"{KEY} string, number int, cells array<string>, reason string")


def found_files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    one = [files.load(p) for p in ([path] if isinstance(path, str) else dict.fromkeys(path))]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more.join(out.select("path"), "path", "left_anti"))
    return out


def read_grid(spark: SparkSession, path: str | list[str], pattern: str = "*.{csv,tsv,txt,xlsx}") -> DataFrame:
    """(statement_id, number, cells) of the files that give rows."""
    return read_files(spark, path, pattern).filter("reason is null").drop("reason")


def digests(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(statement_id, digest, bytes): the SHA-256 of each file as it is."""
    return found_files(spark, path, pattern).select(F.col("path").alias(KEY), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def heading(text: Column) -> Column:
    """A heading in lower case, without trailing punctuation, a time qualifier and a currency."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"[.:]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, TIME_SUFFIX, ""), CURRENCY_SUFFIX, ""))


def column_map(cells: Column) -> Column:
    """map<field, index>, from left to right: a heading, or its singular, takes the first field that is free."""
    fields = F.create_map(*(F.lit(x) for field, names in ALIASES.items() for name in names for x in (name, field)))
    none = F.lit(None).cast("string")
    heads = F.transform(cells, lambda c, i: F.struct(i.alias("i"), heading(c).alias("h")))
    one = lambda h: F.when((F.length(h) > 3) & h.endswith("s") & ~h.endswith("ss"), F.try_element_at(fields, F.substring(h, F.lit(1), F.length(h) - 1))).otherwise(none)
    wanted = F.transform(heads, lambda x: F.struct(x["i"].alias("i"), F.array_compact(F.array(F.try_element_at(fields, x["h"]), one(x["h"]))).alias("f")))

    def claim(found: Column, x: Column) -> Column:
        free = F.filter(x["f"], lambda f: ~F.map_contains_key(found, f))
        return F.when(F.size(free) == 0, found).otherwise(F.map_concat(found, F.map_from_arrays(F.slice(free, 1, 1), F.array(x["i"]))))

    return F.aggregate(wanted, F.create_map().cast("map<string,int>"), claim)


def names_columns(columns: Column) -> Column:
    """Whether a row's column_map names a date and money, as a header does."""
    has = lambda f: F.map_contains_key(columns, F.lit(f))
    return has("date") & (has("balance") | has("amount") | (has("debit") & has("credit")))


def may_name(cells: Column) -> Column:
    """False where names_columns() is false: each heading of a date holds this word. Few rows pass, so few are mapped."""
    return F.exists(cells, lambda c: c.rlike("(?i)date"))


def is_header(cells: Column) -> Column:
    return F.when(F.coalesce(may_name(cells), F.lit(False)), names_columns(column_map(cells))).otherwise(False)


def headers(grid: DataFrame) -> DataFrame:
    """(statement_id, header, columns): the first of a file's first rows that names a date and money."""
    rows = grid.filter((F.col("number") <= HEADER_ROWS) & may_name(F.col("cells"))).select(KEY, "number", column_map(F.col("cells")).alias("columns"))
    rows = rows.filter(names_columns(F.col("columns")))
    return rows.groupBy(KEY).agg(F.min("number").alias("header"), F.min_by("columns", "number").alias("columns"))


def bank_of(text: Column) -> Column:
    """The earliest bank name in a text, of two at one place the longer; null if there is none."""
    places = F.array(*(F.struct(F.instr(text, b).alias("at"), F.lit(-len(b)).alias("n"), F.lit(b).alias("name")) for b in BANKS))
    name = F.array_min(F.filter(places, lambda p: p["at"] > 0))["name"]
    return F.when(F.length(name) <= 5, F.upper(name)).otherwise(F.initcap(name))


def identities(grid: DataFrame, header: DataFrame) -> DataFrame:
    """(statement_id, bank, account_hint) from the rows above the header. A full account number is masked but for four digits."""
    above = grid.join(header.select(KEY, "header"), KEY).filter("number < header")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", F.array_join("cells", " ").alias("x")))), lambda r: r["x"])
    out = header.select(KEY).join(above.groupBy(KEY).agg(lines.alias("lines")), KEY, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    first = lambda pattern: F.get(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), F.lit(0))
    full = first(LABELLED)
    stem = F.regexp_replace(F.lower(F.substring_index(KEY, "/", -1)), r"\.[^.]*$", "")
    hint = F.coalesce(F.replace(first(MASKED), F.lit(" "), F.lit("")), F.concat(F.repeat(F.lit("X"), F.length(full) - 4), F.right(full, F.lit(4))), F.lit(""))
    return out.select(KEY, F.coalesce(bank_of(F.lower(F.array_join("lines", " "))), bank_of(stem), F.lit("unknown")).alias("bank"), hint.alias("account_hint"))


def cells_of(grid: DataFrame, header: DataFrame) -> DataFrame:
    """The rows under each header with their fields as text."""
    rows = grid.join(header, KEY).filter("number > header")
    cell = lambda f: F.coalesce(F.trim(F.get("cells", F.try_element_at("columns", F.lit(f)))), F.lit(""))
    return rows.select(KEY, "number", "cells", "columns", *(cell(f).alias(f"{f}_text") for f in ALIASES))


def classified(grid: DataFrame, header: DataFrame) -> DataFrame:
    """The rows under each header with their fields as text, amounts, and kind: skip, totals, opening, closing, entry, wrapped or bad."""
    rows = cells_of(grid, header).withColumns({"readings": F.transform("cells", money.reading), "days": dates.readings(F.col("date_text"))})
    of = lambda f: F.get("readings", F.try_element_at("columns", F.lit(f)))
    rows = rows.withColumns({f: of(f)["amount"] for f in ("debit", "credit", "balance", "amount")} | {"found": F.array_compact(F.transform("readings", lambda r: r["amount"]))})
    marks = lambda c: F.when(~c.rlike(MARKED), "").when(c.rlike(OPENING), "opening").when(c.rlike(CLOSING), "closing").when(c.rlike(TOTALS), "totals").when(c.rlike(SUMMARY), "summary").otherwise("")
    rows = rows.withColumn("marks", F.transform("cells", marks))
    pair = F.map_contains_key("columns", "debit") | F.map_contains_key("columns", "credit")
    d, c, a = F.col("debit"), F.col("credit"), F.col("amount")
    # nought beside a figure is absence
    rows = rows.withColumns({
        "out": F.when(pair, F.when((d == 0) & (F.coalesce(c, F.lit(0)) != 0), None).otherwise(d)).otherwise(F.when(a < 0, -a)),
        "into": F.when(pair, F.when((c == 0) & (F.coalesce(d, F.lit(0)) != 0), None).otherwise(c)).otherwise(F.when(a >= 0, a)),
        "label": F.get(F.filter("marks", lambda x: x.isin("opening", "closing")), F.lit(0)),
        "joined": F.array_join(F.filter("cells", lambda x: F.trim(x) != ""), " "),
        "has_opening": F.array_contains("marks", "opening"),
        "has_closing": F.array_contains("marks", "closing"),
    })
    spread = F.when(F.size("found") > 0, F.when(F.col("joined").rlike(OPENING), "opening").when(F.col("joined").rlike(CLOSING), "closing"))
    garbled = F.greatest(*(F.coalesce(of(f)["bad"], F.lit(False)) for f in ("debit", "credit", "balance", "amount")))
    rows = rows.withColumn("label", F.coalesce("label", spread))
    kind = (
        F.when(F.forall("cells", lambda x: (F.trim(x) == "") | money.is_placeholder(x)), "skip")
        .when(F.array_contains("marks", "totals"), "totals")
        .when(F.col("label").isNotNull(), F.col("label"))
        .when(garbled | (F.col("out").isNotNull() & F.col("into").isNotNull()), "bad")
        .when(F.col("out").isNotNull() | F.col("into").isNotNull(), "entry")
        .when(F.col("balance").isNull() & F.col("days.d").isNull() & F.col("days.m").isNull(), "wrapped")
        .otherwise("bad")
    )
    summary = (F.array_contains("marks", "summary") | (F.col("has_opening") & F.col("has_closing"))) & (kind != "skip")
    rows = rows.withColumns({"kind": kind, "summary": summary, "value": F.coalesce("balance", F.get("found", F.lit(0)))})
    before = Window.partitionBy(KEY).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("entries", F.coalesce(F.count(F.when(F.col("kind") == "entry", 1)).over(before), F.lit(0)))
    ends = (F.col("entries") > 0) & (F.col("summary") | (F.col("kind") == "closing"))
    rows = rows.withColumns({"d": F.col("days.d"), "m": F.col("days.m")}).drop("readings", "marks", "days")
    return rows.withColumn("end", F.min(F.when(ends, F.col("number"))).over(Window.partitionBy(KEY)))


def summary_block(rows: DataFrame) -> DataFrame:
    """(statement_id, s_opening, s_closing): figures under the labels of the summary that ends a ledger."""
    every = Window.partitionBy(KEY)
    rows = rows.withColumn("is_block", F.max(F.when(F.col("number") == F.col("end"), F.col("summary"))).over(every)).filter("is_block and number >= end")
    rows = rows.withColumn("labels", F.min(F.when((F.col("has_opening") | F.col("has_closing")) & (F.col("number") < F.col("end") + LOOK_AHEAD), F.col("number"))).over(every))
    at = lambda pattern: F.max(F.when(F.col("number") == F.col("labels"), F.array_position(F.transform("cells", lambda x: x.rlike(pattern)), True))).over(every)
    rows = rows.withColumns({"o": at(OPENING), "c": at(CLOSING)}).filter((F.col("number") > F.col("labels")) & (F.col("number") <= F.col("labels") + LOOK_AHEAD))
    figure = lambda k: F.when(F.col(k) > 0, money.parse_optional_amount(F.get("cells", F.col(k).cast("int") - 1)))
    rows = rows.withColumns({"ov": figure("o"), "cv": figure("c")})
    pick = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.col("number")))
    return rows.groupBy(KEY).agg(pick("ov").alias("s_opening"), pick("cv").alias("s_closing"))


def parsed(grid: DataFrame, header: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, transactions, rejects). A file with a row that can't be read is refused whole: a ledger with a gap proves nothing.

    Rows are read several times over, so the headers, the classified rows and the settled dates are written first.
    """
    header = shuffled(headers(grid), "headers") if header is None else header
    rows = shuffled(classified(grid, header), "rows")
    order = shuffled(dates.settle_order(rows.select(KEY, F.col("number").alias("pos"), "date_text", "d", "m")), "orders")
    ledger = rows.filter(F.col("end").isNull() | (F.col("number") < F.col("end"))).join(order, KEY)
    in_order = lambda r: F.when(F.col("date_order") == "month_first", r["m"]).otherwise(r["d"])
    ledger = ledger.withColumns({"date": in_order({c: F.col(c) for c in "dm"}), "value_date": bind(dates.readings(F.col("value_date_text")), in_order), "seq": F.col("entries") + (F.col("kind") == "entry").cast("long")})
    ledger = shuffled(ledger.select(KEY, "number", "kind", "seq", "date", "value_date", "narration_text", "out", "into", "balance"), "ledger")

    spent = F.col("out").isNotNull()
    entries = ledger.filter("kind in ('entry', 'wrapped') and seq > 0").groupBy(KEY, "seq").agg(
        F.min("number").alias("row"),
        *(F.min_by(c, "number").alias(c) for c in ("date", "value_date")),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "narration_text"))), lambda r: r["narration_text"]), " ")).alias("narration"),
        F.min_by(F.when(spent, "debit").otherwise("credit"), "number").alias("direction"),
        F.min_by(F.abs(F.coalesce("out", "into")), "number").alias("amount"),
        F.min_by("balance", "number").alias("balance"),
    )
    entries = shuffled(entries, "entries")
    move = money.signed(F.col("direction"), F.col("amount"))
    ends = entries.groupBy(KEY).agg(F.min("date").alias("_any"), F.min_by(F.col("balance") - move, "seq").alias("d_opening"), F.max_by("balance", "seq").alias("d_closing"), F.min_by("date", "seq").alias("period_start"), F.max_by("date", "seq").alias("period_end"))
    marks = rows.filter(F.col("end").isNull() | (F.col("number") <= F.col("end"))).filter(F.coalesce(F.col("number") < F.col("end"), F.lit(True)) | ~F.col("summary"))
    mark = lambda kind, v: F.when((F.col("kind") == kind) & F.col(v).isNotNull(), F.col("number"))
    marks = marks.groupBy(KEY).agg(
        F.min_by("value", mark("opening", "value")).alias("m_opening"),
        F.max_by("value", mark("closing", "value")).alias("m_closing"),
        *(F.max_by(side, F.when(F.col("kind") == "totals", F.col("number"))).alias(f"stated_{side}s") for side in ("debit", "credit")),
    )
    facts = header.join(identities(grid, header), KEY).join(order, KEY, "left").join(marks, KEY, "left").join(summary_block(rows), KEY, "left").join(ends, KEY, "left")
    opening, closing = F.coalesce("m_opening", "s_opening"), F.coalesce("s_closing", "m_closing")
    faults = ledger.groupBy(KEY).agg(
        F.min(F.when((F.col("kind") == "bad") | ((F.col("kind") == "wrapped") & (F.col("seq") == 0)), F.col("number"))).alias("bad_row"),
        F.min(F.when((F.col("kind") == "entry") & F.col("date").isNull(), F.col("number"))).alias("bad_date"),
    )
    facts = facts.join(faults, KEY, "left").withColumns({"opening": F.coalesce(opening, F.col("d_opening")), "closing": F.coalesce(closing, F.col("d_closing"))})
    row = lambda c, text: F.concat(F.lit("row "), F.col(c).cast("string"), F.lit(text))
    reason = (
        F.when(F.coalesce("inconsistent", F.lit(False)), "no single date order fits the file")
        .when(F.col("bad_row").isNotNull(), row("bad_row", " can't be read"))
        .when(F.col("bad_date").isNotNull(), row("bad_date", " has no date"))
        .when(F.col("period_start").isNull(), "no transaction rows under the header")
        .when(F.col("opening").isNull(), "no opening balance stated, and none to derive it from")
        .when(F.col("closing").isNull(), "no closing balance stated, and none to derive it from")
    )
    facts = shuffled(facts.withColumns({"reason": reason, "opening_source": F.when(opening.isNull(), "derived").otherwise("explicit"), "closing_source": F.when(closing.isNull(), "derived").otherwise("explicit")}), "facts")
    good = facts.filter("reason is null")
    statements = good.select(KEY, "bank", "account_hint", "opening", "closing", "opening_source", "closing_source", "stated_debits", "stated_credits", "date_order", F.col("observed").alias("date_order_observed"), "period_start", "period_end")
    headless = grid.select(KEY).distinct().join(header, KEY, "left_anti").select(KEY, F.lit("no header row").alias("reason"))
    rejects = facts.filter("reason is not null").select(KEY, "reason").unionByName(headless)
    return statements, entries.join(good.select(KEY), KEY, "left_semi"), rejects
