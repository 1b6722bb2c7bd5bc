"""Proof of a ledger: running balances, totals, stated totals, card summaries, verdicts and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import signed

ROUNDING = 100
KEY = ["statement_id"]


def run(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """The transactions with expected: the balance that each row should have.

    After a row with a balance the running balance is that one, so the expectation is the last printed
    balance plus what moved since: one window, no loop.
    """
    order = Window.partitionBy(*KEY).orderBy("seq")
    rows = transactions.withColumn("_cum", F.sum(signed(F.col("direction"), F.col("amount"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    anchor = F.last(F.when(F.col("balance").isNotNull(), F.struct("balance", "_cum")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_anchor", anchor).join(statements.select(*KEY, "opening"), KEY)
    return rows.withColumn("expected", F.coalesce(F.col("_anchor.balance") - F.col("_anchor._cum"), F.col("opening")) + F.col("_cum"))


def chain_faults(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, seq, row, expected, actual, delta) where a printed balance differs from the running one."""
    rows = run(transactions, statements).filter(F.col("balance") != F.col("expected"))
    return rows.select(*KEY, "seq", "row", "expected", F.col("balance").alias("actual"), (F.col("balance") - F.col("expected")).alias("delta"))


def sums(transactions: DataFrame) -> DataFrame:
    """(statement_id, credits, debits, n)."""
    of = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0))
    return transactions.groupBy(*KEY).agg(of("credit").alias("credits"), of("debit").alias("debits"), F.count("*").alias("n"))


def totals(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """A row for each statement: credits, debits, computed and stated closing, delta."""
    rows = statements.join(sums(transactions), KEY, "left")
    computed = F.col("opening") + F.coalesce("credits", F.lit(0)) - F.coalesce("debits", F.lit(0))
    return rows.select(*KEY, "opening", "closing", F.coalesce("credits", F.lit(0)).alias("credits"), F.coalesce("debits", F.lit(0)).alias("debits"), computed.alias("computed"), (F.col("closing") - computed).alias("delta"))


def stated_totals(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, kind, expected, actual): stated column totals that the rows don't give; expected is the rows' sum."""
    rows = statements.join(sums(transactions), KEY, "left")
    pairs = F.array(*(F.struct(F.lit(f"stated-{side}").alias("kind"), F.coalesce(side, F.lit(0)).alias("expected"), F.col(f"stated_{side}").alias("actual")) for side in ("debits", "credits")))
    return rows.select(*KEY, F.explode(pairs).alias("x")).select(*KEY, "x.*").filter("actual is not null and actual <> expected")


def card_summary(summary: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row for each check of a card's summary box: (statement_id, kind, expected, actual, fault, rounding).

    summary: previous, payments, purchases, fees, due. A difference under a rupee in the box is rounding;
    row sums are exact, their expectation is what the box states.
    """
    rows = summary.join(sums(transactions), KEY, "left")
    box = F.col("previous") - F.col("payments") + F.col("purchases") + F.coalesce("fees", F.lit(0))
    checks = F.array(
        F.struct(F.lit("summary").alias("kind"), box.alias("expected"), F.col("due").alias("actual")),
        F.struct(F.lit("rows-debit").alias("kind"), (F.col("purchases") + F.coalesce("fees", F.lit(0))).alias("expected"), F.coalesce("debits", F.lit(0)).alias("actual")),
        F.struct(F.lit("rows-credit").alias("kind"), F.col("payments").alias("expected"), F.coalesce("credits", F.lit(0)).alias("actual")),
    )
    out = rows.select(*KEY, F.explode(checks).alias("x")).select(*KEY, "x.*").filter("expected is not null and actual is not null")
    delta = F.abs(F.col("actual") - F.col("expected"))
    rounding = (F.col("kind") == "summary") & (delta > 0) & (delta < ROUNDING)
    return out.withColumns({"fault": (delta > 0) & ~rounding, "rounding": rounding})


def verdicts(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """A row for each bank statement: n_chain, first_bad_row, chain_checked, totals_ok, stated_ok, tautological, ok.

    One window and one aggregation over the transactions, both by statement, so these are dealt once.
    """
    wrong = F.col("balance") != F.col("expected")
    of = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0))
    facts = run(transactions, statements).groupBy(*KEY).agg(F.count_if(wrong).alias("n_chain"), F.min(F.when(wrong, F.col("row"))).alias("first_bad_row"), (F.count("balance") > 0).alias("chain_checked"), of("credit").alias("credits"), of("debit").alias("debits"))
    n = lambda c: F.coalesce(c, F.lit(0))
    stated = lambda side: F.coalesce(F.col(f"stated_{side}") == n(side), F.lit(True))
    out = statements.join(facts, KEY, "left").select(
        *KEY,
        n("n_chain").alias("n_chain"),
        "first_bad_row",
        F.coalesce("chain_checked", F.lit(False)).alias("chain_checked"),
        (F.col("closing") == F.col("opening") + n("credits") - n("debits")).alias("totals_ok"),
        (stated("debits") & stated("credits")).alias("stated_ok"),
        ((F.col("opening_source") == "derived") & (F.col("closing_source") == "derived")).alias("tautological"),
    )
    return out.withColumn("ok", (F.col("n_chain") == 0) & F.col("totals_ok") & F.col("stated_ok"))


def card_verdicts(summaries: DataFrame, transactions: DataFrame) -> DataFrame:
    """A row for each card statement: checks that ran, ok, verified (rows were checked), reconciled (ok, and something was checked), roundings.

    summaries: as card_summary() takes them.
    """
    checks = card_summary(summaries, transactions).groupBy(*KEY).agg(F.array_sort(F.collect_set("kind")).alias("checks"), F.count_if("fault").alias("faults"), F.count_if("rounding").alias("roundings"), F.array_sort(F.collect_set(F.when(F.col("fault"), F.col("kind")))).alias("failures"))
    none = F.array().cast("array<string>")
    out = summaries.select(*KEY).join(checks, KEY, "left").select(*KEY, *(F.coalesce(c, none).alias(c) for c in ("checks", "failures")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("faults", "roundings")))
    return out.select(*KEY, "checks", "failures", "roundings", (F.col("faults") == 0).alias("ok"), F.arrays_overlap("checks", F.array(F.lit("rows-debit"), F.lit("rows-credit"))).alias("verified"), ((F.col("faults") == 0) & (F.size("checks") > 0)).alias("reconciled"))


def card_certificates(verdict: DataFrame) -> DataFrame:
    """The same lists for cards. A statement that states nothing to check against is never stamped reconciled."""
    caveats = _list((F.size("checks") == 0, "no stated totals to check the rows against"), ((F.size("checks") > 0) & ~F.col("verified"), "the summary box only was checked, not the rows"))
    return verdict.select(*KEY, "reconciled", "checks", caveats.alias("caveats"), "failures")


def _list(*items: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in items)))


def certificates(verdict: DataFrame) -> DataFrame:
    """(statement_id, reconciled, checks, caveats, failures): the lists that an export is stamped with."""
    return verdict.select(
        *KEY,
        F.col("ok").alias("reconciled"),
        _list((F.col("chain_checked"), "chain"), (F.lit(True), "totals")).alias("checks"),
        _list((F.col("tautological"), "both endpoints are derived from the rows"), (~F.col("chain_checked"), "no running balance to check")).alias("caveats"),
        _list((F.col("n_chain") > 0, F.concat(F.lit("chain breaks at row "), F.col("first_bad_row").cast("string"))), (~F.col("totals_ok"), "totals differ"), (~F.col("stated_ok"), "stated totals differ")).alias("failures"),
    )
