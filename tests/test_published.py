"""Single files from distributed tables."""

import csv
import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from tarazu.sinks import export, published
from tarazu.sources import workbook

ROWS = [("2024-01-02", 3, 'say "x", y', 1.5, None), ("2024-01-01", 10, "a\nb", None, "₹ <&>"), ("2024-01-01", 9, None, 2.0, "z"), (None, 1, "first", 0.0, "")]
SCHEMA = "date string, row long, text string, amount double, note string"


def test_a_csv_file_is_what_the_writer_of_python_gives(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    export.write(df, str(tmp_path / "ledger.csv"))
    data = (tmp_path / "ledger.csv").read_bytes()
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", "))
    for k in (3, 2, 1, 0):
        writer.writerow(["" if v is None else v for v in ROWS[k]])
    assert data == b"\xef\xbb\xbf" + out.getvalue().encode()
    assert [p.name for p in tmp_path.iterdir()] == ["ledger.csv"]


def test_many_parts_stay_in_order(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("row"), (-F.col("id")).alias("down")).repartition(7)
    published.publish_csv(df, str(tmp_path / "x.csv"), ["down"])
    rows = list(csv.reader(io.StringIO((tmp_path / "x.csv").read_text("utf-8-sig"))))
    assert rows[0] == ["row", "down"] and [int(r[0]) for r in rows[1:]] == list(range(19_999, -1, -1))
    published.publish_csv(df.filter("false"), str(tmp_path / "none.csv"), ["down"])
    assert (tmp_path / "none.csv").read_text("utf-8-sig").splitlines() == ["row,down"]


def test_a_workbook_holds_the_ledger_and_its_certificate(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    proof = spark.createDataFrame([("s", True, ["chain"], [], []), ("t", False, [], ["c"], ["off by 1"])], "statement_id string, reconciled boolean, checks array<string>, caveats array<string>, failures array<string>")
    path = tmp_path / "ledger.xlsx"
    export.write(df, str(path), certificates=proof)
    assert workbook.grid(path.read_bytes()) == [["date", "row", "text", "amount", "note"], ["", "1", "first", "0.0", ""], ["2024-01-01", "9", "", "2.0", "z"], ["2024-01-01", "10", "a\nb", "", "₹ <&>"], ["2024-01-02", "3", 'say "x", y', "1.5", ""]]
    with zipfile.ZipFile(path) as book:
        assert ['name="Ledger"' in x and 'name="Certificate"' in x for x in [book.read("xl/workbook.xml").decode()]] == [True]
        lines = ["".join(t.itertext()) for t in ElementTree.fromstring(book.read("xl/worksheets/sheet2.xml")).iter() if t.tag.endswith("}row")]
    assert len(lines) == 1 + 5
    expected = [line for s in proof.collect() for line in export.certificate_text(s.asDict()).splitlines()]
    assert [line[line.index(x) :] for line, x in zip(lines[1:], expected, strict=True)] == expected


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="no"):
        published.publish_csv(bad, str(tmp_path / "x.csv"), [])
    assert list(tmp_path.iterdir()) == []
