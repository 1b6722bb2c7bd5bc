"""Delimited files scanned in splits, against csv.reader."""

import csv
import io
import random

import pytest
from tarazu.sources import datasource, delimited, load, statements


def by_reader(text, delimiter=","):
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


def written_rows(own, n, delimiter):
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=delimiter, lineterminator=own.choice(["\n", "\r\n"]))
    for _ in range(n):
        writer.writerow(["".join(own.choice(['a', "b", delimiter, '"', "\n", "é", " "]) for _ in range(own.choice([0, 3, 30]))) for _ in range(4)])
    return out.getvalue()


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_records_are_those_of_the_reader_wherever_splits_fall(spark, tmp_path, small_splits):
    own, texts = random.Random(8), {}
    for k, d in enumerate([",", ";", "\t", "|", ","]):
        head = d.join(["Date", "Narration", "Debit", "Balance"]) + "\n" + "".join(d.join([f"0{i}-Jan-2024", "x", "1.00", "2.00"]) + "\n" for i in range(1, 9)) * 3
        texts[f"f{k}.csv"] = ("﻿" if k == 4 else "") + head + written_rows(own, 150, d)
    texts["quotes.csv"] = 'Date,Narration,Amount,Balance\n' + '01-Jan-2024,5" disc,1.00,2.00\n' * 40 + '02-Jan-2024,"said ""hi""\nand, left",1.00,2.00\n' * 40 + '03-Jan-2024,"a"b"c,1.00,2.00\n\n,,,\n' * 10 + 'last,"open\ncell'
    texts["empty.csv"], texts["one.csv"] = "", "a,b"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.csv").write_bytes(b"Date,\xff\xe9\n")
    lines = delimited.read_lines(spark, str(tmp_path), "*.csv")
    assert lines.select("statement_id", "split").distinct().count() > 30
    found, reasons = {}, {}
    for r in delimited.scan(spark, str(tmp_path)).collect():
        name = r["statement_id"].rpartition("/")[2]
        if r["reason"]:
            reasons[name] = r["reason"]
        else:
            found.setdefault(name, []).append((r["number"], r["cells"]))
    assert reasons == {"latin.csv": "not UTF-8 text"}
    for name, text in texts.items():
        d = ",;\t|"[int(name[1])] if name[0] == "f" and name != "f4.csv" else ","
        assert [c for _, c in sorted(found.get(name, []), key=lambda x: x[0])] == by_reader(text.removeprefix("﻿"), d), name


def test_statements_are_loaded_from_splits(spark, tmp_path, small_splits):
    text = "HDFC Bank\nDate,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n" + "".join(f'{1 + k % 28:02d}-Jan-2024,"UPI/x\n{k}",1.00,,{1000 - k}.00\n' for k in range(100))
    (tmp_path / "bank.csv").write_text(text)
    whole = load.load(spark, str(tmp_path), "*.csv")
    split = load.load_delimited(spark, str(tmp_path), "*.csv")
    for a, b in ((whole.banks, split.banks), (whole.transactions, split.transactions)):
        strip = lambda df: sorted(str([v if c != "statement_id" else v.rpartition("/")[2] for c, v in r.asDict().items()]) for r in df.collect())
        assert strip(a) == strip(b) and a.count() > 0


def test_an_open_cell_is_followed_through_a_line():
    assert not delimited.open_after('a,"b"', False, ",") and delimited.open_after('a,"b', False, ",") and delimited.open_after('a"b', False, ",") is False
    assert delimited.open_after("b", True, ",") and not delimited.open_after('b",c', True, ",") and delimited.open_after('b"",c', True, ",") and delimited.open_after('b","c', True, ",")
    assert delimited.open_after('b";"c', True, ";") and not delimited.open_after('b";"c', True, ",")


def test_limits_refuse_files_unread(spark, tmp_path, capsys):
    bank = "HDFC Bank\nDate,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n03-Jan-2024,x,100.00,,900.00\n"
    for k in range(4):
        (tmp_path / f"b{k}.csv").write_text(bank)
    (tmp_path / "large.csv").write_text(bank + "," * 5000)
    found = load.load(spark, str(tmp_path), "*.csv", most_bytes=1000, most_files=3)
    assert {r["statement_id"].rpartition("/")[2]: r["reason"] for r in found.rejects.collect()} == {"b3.csv": "over 3 files in a folder", "large.csv": "larger than 1000 bytes"}
    assert found.banks.count() == 3
    statements.read_files(spark, str(tmp_path), "*.csv", most_bytes=1000).explain("formatted")
    assert "LessThanOrEqual(length,1000)" in capsys.readouterr().out


BARS = (lambda content, path: path.endswith(".bar"), lambda content, path: [x.split("/") for x in content.decode().splitlines()])


def test_statements_are_a_data_source(spark, tmp_path):
    """Batch and stream give the rows of read_files(); a format of one's own is found by its name."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("Date,Amount\n1,2\n")
    (tmp_path / "in" / "deep" / "b.tsv").write_text("Date\tAmount\n")
    (tmp_path / "in" / "c.bar").write_text("x/y\nz")
    (tmp_path / "in" / "old.xls").write_bytes(statements.OLE2)
    datasource.register(spark)
    plain = lambda rows: sorted((r["statement_id"].rpartition("/")[2], r["number"], r["cells"], r["reason"]) for r in rows)
    own = "statement_formats:BARS"
    (tmp_path / "statement_formats.py").write_text("BARS = (lambda content, path: path.endswith('.bar'), lambda content, path: [x.split('/') for x in content.decode().splitlines()])\n")
    spark.sparkContext.addPyFile(str(tmp_path / "statement_formats.py"))
    options = {"pattern": "*.{csv,tsv,bar,xls}", "formats": own}
    batch = spark.read.format("statements").options(**options, partition_bytes="10").load(str(tmp_path / "in"))
    expected = plain(statements.read_files(spark, str(tmp_path / "in"), options["pattern"], (BARS,)).collect())
    assert plain(batch.collect()) == expected and len(expected) == 6 and batch.rdd.getNumPartitions() > 1
    stream = lambda: spark.readStream.format("statements").options(**options).load(str(tmp_path / "in"))
    run = lambda: stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(100)
    assert run()
    assert plain(spark.read.parquet(str(tmp_path / "out")).collect()) == expected
    (tmp_path / "in" / "later.csv").write_text("Date,Amount\n")
    assert run()
    assert len(plain(spark.read.parquet(str(tmp_path / "out")).collect())) == len(expected) + 1
