"""Request budgets, at most so many admitted requests of a client in any window (refusals aren't counted); remembered verdicts; sums and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bind import bind
from .folds import in_event_time


def admitted(requests: DataFrame, seconds: int = 60, allowance: int = 12) -> DataFrame:
    """requests(client, at seconds, seq) -> with admitted, in batch. A fold for each client judges by the window's hits; a client's rows are one array."""
    ordered = requests.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("r"))
    start = F.struct(F.filter(F.transform(F.slice("r", 1, 1), lambda x: x["at"]), lambda x: F.lit(False)).alias("hits"), F.filter(F.transform(F.slice("r", 1, 1), lambda x: F.struct(x["at"].alias("at"), x["seq"].alias("seq"), F.lit(True).alias("admitted"))), lambda x: F.lit(False)).alias("out"))

    def step(acc, x):
        def judge(hits):
            ok = F.size(hits) < allowance
            return F.struct(F.when(ok, F.array_append(hits, x["at"])).otherwise(hits).alias("hits"), F.array_append(acc["out"], F.struct(x["at"].alias("at"), x["seq"].alias("seq"), ok.alias("admitted"))).alias("out"))

        return F.get(F.transform(F.array(F.filter(acc["hits"], lambda h: h > x["at"] - seconds)), judge), F.lit(0))

    out = ordered.select("client", F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("x"))
    return out.select("client", "x.at", "x.seq", "x.admitted")


def admitted_stream(requests: DataFrame, seconds: int = 60, allowance: int = 12, late: str = "1 minute") -> DataFrame:
    """The same over a stream, whatever triggers its rows lie in and however long these are apart; a request is judged once the watermark has passed it."""

    def step(memory: tuple, row: tuple) -> tuple[tuple, tuple]:
        hits = [h for h in memory[0] if h > row[0] - seconds]
        ok = len(hits) < allowance
        return ([*hits, row[0]] if ok else hits,), (ok,)

    return in_event_time(requests, [], ([],), step, "hits array<long>", "admitted boolean", seconds, late)


def remembered(lookups: DataFrame, fresh: int = 300, grace: int = 86_400) -> DataFrame:
    """lookups(client, at, seq, reachable, good) -> (client, at, seq, source, good): verdicts on a key, remembered for a while.

    A verdict is used again for fresh seconds. After that the source is asked; where it can't be reached, a good
    verdict is still used for grace seconds, and else there is none (source 'unreachable', good false).
    """
    ordered = lookups.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "reachable", "good"))).alias("r"))
    out = "array<struct<at:bigint,seq:bigint,source:string,good:boolean>>"
    start = F.struct(F.lit(None).cast("long").alias("since"), F.lit(False).alias("was"), F.array().cast(out).alias("out"))

    def step(acc, x):
        age = x["at"] - acc["since"]
        source = F.when(age < fresh, "remembered").when(x["reachable"], "asked").when(acc["was"] & (age < grace), "grace").otherwise("unreachable")

        def judge(source):
            asked = source == "asked"
            verdict = F.when(asked, x["good"]).when(source == "unreachable", False).otherwise(acc["was"])
            row = F.struct(x["at"].alias("at"), x["seq"].alias("seq"), source.alias("source"), verdict.alias("good"))
            return F.struct(F.when(asked, x["at"]).otherwise(acc["since"]).alias("since"), F.when(asked, x["good"]).otherwise(acc["was"]).alias("was"), F.array_append(acc["out"], row).alias("out"))

        return bind(source, judge)

    return ordered.select("client", F.inline(F.aggregate("r", start, step, lambda a: a["out"])))


def remembered_stream(lookups: DataFrame, fresh: int = 300, grace: int = 86_400, late: str = "1 minute") -> DataFrame:
    """The same over a stream."""

    def step(memory: tuple, row: tuple) -> tuple[tuple, tuple]:
        since, was = memory
        at, reachable, good = row
        if since is not None and at - since < fresh:
            return memory, ("remembered", was)
        if reachable:
            return (at, good), ("asked", good)
        return memory, ("grace", True) if was and at - since < grace else ("unreachable", False)

    return in_event_time(lookups, ["reachable", "good"], (None, False), step, "since long, was boolean", "source string, good boolean", grace, late)


def daily_totals(ledger: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily sums of a stream of ledger rows (ts timestamp), closed when the watermark passes."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "statement_id").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).select("statement_id", F.col("window.start").cast("date").alias("date"), "amount", "n")


def duplicate_sessions(ledger: DataFrame, late: str = "7 days") -> DataFrame:
    """Clusters of equal charges of a stream, as sessions that a gap of over three days closes."""
    days = ledger.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", late)
    debits = days.filter(F.col("direction") == "debit")
    out = debits.groupBy(F.session_window("day", "3 days 1 second"), "statement_id", "name", "amount").agg(F.count("*").alias("n"))
    return out.filter("n >= 2").select("statement_id", "name", "amount", F.col("session_window.start").cast("date").alias("first_date"), "n")
