"""Matches across statements: transfers between own accounts, card repayments, and what was truly spent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PAIR = pa.schema([("o_id", pa.string()), ("o_seq", pa.int64()), ("i_id", pa.string()), ("i_seq", pa.int64()), ("amount", pa.int64()), ("lag_days", pa.int32())])
TRANSFER_WINDOW, REPAYMENT_WINDOW = (0, 3), (-2, 7)


class Free:
    """Places 0 to n - 1 that are taken one by one; next(i) is the first free one from i on."""

    def __init__(self, n: int) -> None:
        self.ahead = list(range(n + 1))

    def next(self, i: int) -> int:
        while self.ahead[i] != i:
            self.ahead[i] = i = self.ahead[self.ahead[i]]
        return i

    def take(self, i: int) -> None:
        self.ahead[i] = i + 1


def matched(outs: list[tuple], ins: list[tuple], window: tuple[int, int], across_only: bool) -> list[tuple[int, int]]:
    """Places of pairs; rows are (statement_id, seq, day), each side in its order. Ins lie by day, so an out looks at the days of its window only."""
    days: dict[int, list[int]] = {}
    for k, (_, _, day) in enumerate(ins):
        days.setdefault(day, []).append(k)
    free = {day: Free(len(places)) for day, places in days.items()}
    found = []
    for j, (name, _, day) in enumerate(outs):
        for lag in range(max(map(abs, window)) + 1):
            near = []
            for at in {day + lag, day - lag}:
                if at in days and window[0] <= at - day <= window[1]:
                    i = free[at].next(0)
                    while across_only and i < len(days[at]) and ins[days[at][i]][0] == name:
                        i = free[at].next(i + 1)
                    if i < len(days[at]):
                        near.append((days[at][i], at, i))
            if near:
                k, at, i = min(near)
                free[at].take(i)
                found.append((j, k))
                break
    return found


def pair_off(outs: DataFrame, ins: DataFrame, window: tuple[int, int], across_only: bool) -> DataFrame:
    """(o_id, o_seq, i_id, i_seq, amount, lag_days), one to one.

    outs and ins: statement_id, seq, date, amount, place. Outs in order of place take the free in of
    equal amount whose date is nearest (of ties the first by place), its lag within the window. Rows of
    one amount that lie further apart than the window never meet, so each run of near dates is matched
    on its own, in one task. Runs are cut on an amount's distinct dates, and those of one side only drop out.
    """
    both = outs.withColumn("_side", F.lit(0)).unionByName(ins.withColumn("_side", F.lit(1)))
    reach = max(map(abs, window))
    dates = both.groupBy("amount", "date").agg(F.min("_side").alias("_least"), F.max("_side").alias("_most"))
    order = Window.partitionBy("amount").orderBy("date")
    dates = dates.withColumn("_new", F.coalesce((F.datediff("date", F.lag("date").over(order)) > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("amount", "_run")
    dates = dates.withColumn("_both", (F.min("_least").over(run) == 0) & (F.max("_most").over(run) == 1)).filter("_both").select("amount", "date", "_run")
    rows = both.join(dates, ["amount", "date"]).select("amount", "_run", "_side", "statement_id", "seq", F.unix_date("date").alias("day"), "place")
    rows = rows.repartition("amount", "_run").sortWithinPartitions("amount", "_run", "_side", "place", "statement_id", "seq").drop("place")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        out: list[tuple] = []

        def close() -> None:
            for j, k in matched(*sides, window, across_only):
                o, i = sides[0][j], sides[1][k]
                out.append((o[0], o[1], i[0], i[1], now[0], i[2] - o[2]))

        for b in batches:
            for amount, number, side, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (amount, number) != now:
                    close()
                    now, sides = (amount, number), ([], [])
                sides[side].append(tuple(row))
            if len(out) >= 8192:
                yield table(out)
                out = []
        close()
        yield table(out)

    ids = outs.schema["statement_id"].dataType.simpleString()
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, PAIR.types, strict=True)], schema=PAIR)
    return rows.mapInArrow(pairs, f"o_id {ids}, o_seq long, i_id {ids}, i_seq long, amount long, lag_days int")


def transfers(ledger: DataFrame, window: tuple[int, int] = TRANSFER_WINDOW) -> DataFrame:
    """Bank debits paired with equal bank credits of another account within the window's days."""
    banks = ledger.filter("not on_card")
    place = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, "abcd", strict=True))).alias("place")
    outs = banks.filter(F.col("direction") == "debit").select("statement_id", "seq", "date", "amount", place(F.col("date"), F.col("row"), F.col("pos"), F.col("seq")))
    ins = banks.filter(F.col("direction") == "credit").select("statement_id", "seq", "date", "amount", place(F.lit(None).cast("date"), F.lit(0).cast("long"), F.col("pos"), F.col("seq")))
    return pair_off(outs, ins, window, across_only=True)


def repayments(ledger: DataFrame, window: tuple[int, int] = REPAYMENT_WINDOW) -> DataFrame:
    """(o_id, o_seq, i_id, i_seq, amount, lag_days): bank debits of kind card bill paired with card credits."""
    outs, ins = _repaid(ledger), _received(ledger)
    return pair_off(outs, ins, window, across_only=False)


def _repaid(ledger: DataFrame) -> DataFrame:
    rows = ledger.filter((~F.col("on_card")) & (F.col("direction") == "debit") & (F.col("kind") == "card bill"))
    return rows.select("statement_id", "seq", "date", "amount", F.struct(F.col("pos").alias("a"), F.col("date").alias("b"), F.col("row").alias("c"), F.col("seq").alias("d")).alias("place"))


def _received(ledger: DataFrame) -> DataFrame:
    rows = ledger.filter(F.col("on_card") & (F.col("direction") == "credit"))
    return rows.select("statement_id", "seq", "date", "amount", F.struct(F.col("pos").alias("a"), F.lit(None).cast("date").alias("b"), F.lit(0).cast("long").alias("c"), F.col("seq").alias("d")).alias("place"))


def repayment_links(ledger: DataFrame) -> DataFrame:
    """Every repayment with the card credit that took it, if any."""
    pairs = repayments(ledger).select(F.col("o_id").alias("statement_id"), F.col("o_seq").alias("seq"), F.col("i_id").alias("card_id"), F.col("i_seq").alias("card_seq"), "lag_days")
    return _repaid(ledger).drop("place").join(pairs, ["statement_id", "seq"], "left")


def orphan_payments(ledger: DataFrame) -> DataFrame:
    """Card credits that no repayment reached."""
    pairs = repayments(ledger).select(F.col("i_id").alias("statement_id"), F.col("i_seq").alias("seq"))
    return _received(ledger).drop("place").join(pairs, ["statement_id", "seq"], "left_anti")


def unlinked(ledger: DataFrame) -> DataFrame:
    """(statement_id, seq, date, amount, repayment): repayments that no card took, and card credits that no repayment reached; pairs are made once for both."""
    pairs = repayments(ledger)
    taken = pairs.select(F.explode(F.array(F.struct(F.col("o_id").alias("statement_id"), F.col("o_seq").alias("seq")), F.struct(F.col("i_id").alias("statement_id"), F.col("i_seq").alias("seq")))).alias("x")).select("x.*")
    rows = _repaid(ledger).drop("place").withColumn("repayment", F.lit(True)).unionByName(_received(ledger).drop("place").withColumn("repayment", F.lit(False)))
    return rows.join(taken, ["statement_id", "seq"], "left_anti")


def spend_summary(ledger: DataFrame) -> DataFrame:
    """One row: flows of bank accounts, what only moved between own accounts, and what was truly spent."""
    flow = ledger.agg(*(F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0)).alias(name) for name, cond in (("outflow", (~F.col("on_card")) & (F.col("direction") == "debit")), ("inflow", (~F.col("on_card")) & (F.col("direction") == "credit")), ("card_charges", F.col("on_card") & (F.col("direction") == "debit")))))
    links = repayment_links(ledger).agg(F.coalesce(F.sum(F.when(F.col("card_id").isNotNull(), F.col("amount"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(F.col("card_id").isNull(), F.col("amount"))), F.lit(0)).alias("unmatched"))
    moved = transfers(ledger).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("moved"))
    out = flow.crossJoin(links).crossJoin(moved)  # one row each
    return out.withColumns({"true_outflow": F.expr("outflow - matched - moved + card_charges"), "true_inflow": F.expr("inflow - moved"), "complete": F.col("unmatched") == 0})


def merged(ledger: DataFrame) -> DataFrame:
    """All bank rows with their account, in ledger order."""
    return ledger.filter("not on_card").select(F.col("statement_id").alias("account"), "date", "row", "seq", "direction", "amount", "name").orderBy("date", "account", "row", "seq")
