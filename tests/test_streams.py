"""Streams: ingestion, budgets, daily totals, sessions."""

import os
import random
from datetime import datetime

from tarazu.streaming import budget, ingest

BANK = "HDFC Bank\nDate,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n03-Jan-2024,{},100.00,,900.00\n04-Jan-2024,SALARY,,50.00,950.00\n"


def drained(spark, df, name, trigger="availableNow"):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(**{trigger: True}).start()
    assert query.awaitTermination(100)
    return spark.table(name).collect()


def test_files_are_ingested_once(spark, tmp_path):
    inbox, target, marks = (str(tmp_path / x) for x in ("inbox", "target", "marks"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.csv").write_text(BANK.format("ATM"))
    (tmp_path / "inbox" / "x.csv").write_text("nothing,here")
    ingest.ingest(spark, inbox, target, marks).awaitTermination(180)
    assert ingest.read(spark, target, "transactions").count() == 2 and ingest.read(spark, target, "rejects").count() == 1
    (tmp_path / "inbox" / "b.csv").write_text(BANK.format("RENT"))
    ingest.ingest(spark, inbox, target, marks).awaitTermination(180)
    assert sorted(r["narration"] for r in ingest.read(spark, target, "transactions").collect()) == ["ATM", "RENT", "SALARY", "SALARY"]
    assert ingest.read(spark, target, "banks").count() == 2


def stream_of(spark, tmp_path, rows, schema, triggers):
    """A stream whose triggers hold the given rows each, and a last one of another client that passes all of them."""
    end = max(r[1] for r in rows) + 10**6
    for k, some in enumerate([*triggers, [(99, end, 10**6, *rows[0][3:])]]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        part = next((tmp_path / f"t{k}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_budgets_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Rows out of order, within and across triggers, some of which hold no row of a client, or come long after."""
    own, schema = random.Random(1), "client long, at long, seq long"
    rows = [(own.randrange(3), own.randrange(1500), i) for i in range(260)]
    by_time = sorted(rows, key=lambda r: r[1] + own.randrange(55))
    cuts = [0, 1, 40, 41, 120, 200, 260]
    stream = stream_of(spark, tmp_path, rows, schema, [by_time[a:b] for a, b in zip(cuts, cuts[1:])])
    found = drained(spark, budget.admitted_stream(stream, 60, 4, "1 minute"), "budgets")
    expected = sorted(map(tuple, budget.admitted(spark.createDataFrame(rows, schema), 60, 4).collect()))
    assert sorted(tuple(r) for r in found if r["client"] != 99) == expected and {r[3] for r in expected} == {True, False}


def test_verdicts_are_remembered_for_a_while(spark, tmp_path):
    own, schema = random.Random(3), "client long, at long, seq long, reachable boolean, good boolean"
    rows = [(own.randrange(3), own.randrange(4000), i, own.random() < 0.4, own.random() < 0.7) for i in range(150)]
    memory, expected = {}, []
    for c, at, seq, reachable, good in sorted(rows):
        since, was = memory.get(c, (None, False))
        if since is not None and at - since < 50:
            expected.append((c, at, seq, "remembered", was))
        elif reachable:
            memory[c] = at, good
            expected.append((c, at, seq, "asked", good))
        else:
            expected.append((c, at, seq, "grace", True) if was and at - since < 300 else (c, at, seq, "unreachable", False))
    batch = budget.remembered(spark.createDataFrame(rows, schema), 50, 300)
    assert sorted(map(tuple, batch.collect())) == sorted(expected) and {r[3] for r in expected} == {"remembered", "asked", "grace", "unreachable"}
    by_time = sorted(rows, key=lambda r: r[1] + own.randrange(50))
    stream = stream_of(spark, tmp_path, rows, schema, [by_time[:70], by_time[70:75], by_time[75:]])
    found = drained(spark, budget.remembered_stream(stream, 50, 300), "verdicts")
    assert sorted(tuple(r) for r in found if r["client"] != 99) == sorted(expected)


def test_daily_totals_and_sessions_close_with_the_watermark(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = spark.createDataFrame([("a", at(1, 3), "debit", "x", 500), ("a", at(1, 9), "debit", "x", 500), ("a", at(2), "debit", "y", 70), ("a", at(30), "debit", "z", 1)], "statement_id string, ts timestamp, direction string, name string, amount long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    days = {str(r["date"]): (r["amount"], r["n"]) for r in drained(spark, budget.daily_totals(read()), "days")}
    assert days == {"2024-01-01": (1000, 2), "2024-01-02": (70, 1)}
    sessions = drained(spark, budget.duplicate_sessions(read()), "sessions")
    assert [(r["name"], r["amount"], str(r["first_date"]), r["n"]) for r in sessions] == [("x", 500, "2024-01-01", 2)]
