"""Sinks: the ledger for spreadsheets, JSON, and the text of a certificate."""

from __future__ import annotations

import base64
import csv
import io
from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from ..functions.money import rupees
from ..sources import workbook
from .published import publish_csv, publish_workbook


def rows(transactions: DataFrame, certificates: DataFrame) -> DataFrame:
    """One row for each transaction in date order where written: debit or credit in rupees, and whether its statement is proved."""
    side = lambda d: rupees(F.when(F.col("direction") == d, F.col("amount")))
    stamped = transactions.join(certificates.select("statement_id", "reconciled"), "statement_id", "left")
    return stamped.select("date", F.col("statement_id").alias("source"), "row", "seq", side("debit").alias("debit"), side("credit").alias("credit"), rupees(F.col("balance")).alias("balance"), F.when(F.col("reconciled"), "yes").otherwise("NO").alias("reconciled"))


#: The export's columns, in order.
COLUMNS = ("date", "value_date", "narration", "merchant", "category", "counterparty_type", "debit", "credit", "balance", "institution", "account", "source_file", "page", "row", "reconciled")


def ledger_rows(ledger: DataFrame, statements: DataFrame, certificates: DataFrame) -> DataFrame:
    """COLUMNS of a labelled ledger. statements(statement_id, institution, account_hint); a page is what paged sources give, else null."""
    side = lambda d: rupees(F.when(F.col("direction") == d, F.col("amount")))
    rows = ledger.join(statements.select("statement_id", "institution", "account_hint"), "statement_id", "left").join(certificates.select("statement_id", "reconciled"), "statement_id", "left")
    values = {
        "merchant": F.col("name"),
        "counterparty_type": F.col("kind"),
        "debit": side("debit"),
        "credit": side("credit"),
        "balance": rupees(F.col("balance")),
        "account": F.col("account_hint"),
        "source_file": F.substring_index("statement_id", "/", -1),
        "page": F.col("page") if "page" in ledger.columns else F.lit(None).cast("int"),
        "reconciled": F.when(F.col("reconciled"), "yes").otherwise("NO"),
    }
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in COLUMNS))


def xlsx_bytes(df: DataFrame, most_rows: int = 100_000) -> bytes:
    """One small workbook; larger tables go to write_csv()."""
    found = df.limit(most_rows + 1).collect()
    if len(found) > most_rows:
        raise ValueError(f"over {most_rows} rows: use write_csv()")
    return workbook.book([list(df.columns), *([v if v is None or isinstance(v, int | float | Decimal) else str(v) for v in r] for r in found)])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; null is empty."""
    df.orderBy("date", "source", "row", "seq").write.csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def csv_bytes(df: DataFrame, most_rows: int = 100_000) -> bytes:
    """One small file with a byte-order mark, for spreadsheets; larger tables go to write_csv()."""
    found = df.limit(most_rows + 1).collect()
    if len(found) > most_rows:
        raise ValueError(f"over {most_rows} rows: use write_csv()")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows([["" if v is None else v for v in r] for r in found])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def blob(data: bytes) -> str:
    return base64.b64encode(data).decode()


def certificate_text(certificate: dict) -> str:
    """A certificate row as text."""
    lines = [f"{certificate['statement_id']}: {'reconciled' if certificate['reconciled'] else 'NOT RECONCILED'}"]
    for title in ("checks", "caveats", "failures"):
        lines += [f"  {title[:-1]}: {x}" for x in certificate[title]]
    return "\n".join(lines)


def certificate_lines(certificates: DataFrame) -> DataFrame:
    """(statement_id, line, text): what certificate_text() says of each, a row a line."""
    of = lambda c: F.transform(c, lambda x: F.concat(F.lit(f"  {c[:-1]}: "), x))
    head = F.concat(F.col("statement_id"), F.when(F.col("reconciled"), ": reconciled").otherwise(": NOT RECONCILED"))
    return certificates.select("statement_id", F.posexplode(F.concat(F.array(head), *(of(c) for c in ("checks", "caveats", "failures")))).alias("line", "text"))


def write(df: DataFrame, path: str, order: list[str] | None = None, certificates: DataFrame | None = None) -> None:
    """One file, by suffix: .csv, .txt and none are CSV, .xlsx is a workbook with the certificates' lines beside the ledger; .json is a folder of JSON lines."""
    suffix = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    order = [c for c in (order or ("date", "source", "source_file", "row", "seq")) if c in df.columns]
    if suffix in ("", "csv", "txt"):
        publish_csv(df, path, order)
    elif suffix == "xlsx":
        proof = {} if certificates is None else {"Certificate": (certificate_lines(certificates), ["statement_id", "line"])}
        publish_workbook({"Ledger": (df, order)} | proof, path)
    elif suffix == "json":
        write_json(df, path)
    else:
        raise ValueError(f"no sink for .{suffix}")
