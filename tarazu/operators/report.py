"""What a report shows: states of the statements, and loops still open."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import linking, patterns


def trust_strip(verdicts: DataFrame) -> DataFrame:
    """(state, n): failed, weak (proved only against itself) or ok."""
    state = F.when(~F.col("ok"), "failed").when(F.col("tautological") & ~F.col("chain_checked"), "weak").otherwise("ok")
    return verdicts.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def open_loops(ledger: DataFrame, exact: DataFrame) -> DataFrame:
    """(kind, statement_id, amount, date): charges still doubled, repayments no card shows, card payments of unknown origin."""
    doubled = patterns.duplicates(ledger).filter("exposure > 0").select(F.lit("duplicate").alias("kind"), "statement_id", F.col("exposure").alias("amount"), F.col("first_date").alias("date"))
    open_ends = linking.unlinked(exact).select(F.when(F.col("repayment"), "unmatched repayment").otherwise("orphan payment").alias("kind"), "statement_id", "amount", "date")
    return doubled.unionByName(open_ends)
