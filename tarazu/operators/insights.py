"""Roll-ups of a labelled ledger: merchants, categories, shares, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.merchants import confident


def merchant_rollup(ledger: DataFrame) -> DataFrame:
    """A row for each merchant; its category is that of its first row. Ordered by turnover, then name, where it is shown."""
    of = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0))
    first = F.min_by("category", F.struct("date", "statement_id", "row", "seq"))
    out = ledger.groupBy("name").agg(of("debit").alias("debits"), of("credit").alias("credits"), F.count("*").alias("n"), F.count_if(F.col("direction") == "debit").alias("n_debits"), first.alias("category"))
    return out.withColumns({"turnover": F.col("debits") + F.col("credits"), "net": F.col("credits") - F.col("debits")})


def merchant_sources(ledger: DataFrame) -> DataFrame:
    """(name, source, n): how a merchant's rows were told."""
    return ledger.groupBy("name", "source").agg(F.count("*").alias("n"))


def category_rollup(ledger: DataFrame) -> DataFrame:
    """Categories of the merchants' roll-up, so a row counts under its merchant's first category."""
    return merchant_rollup(ledger).groupBy("category").agg(F.sum("debits").alias("debits"), F.sum("credits").alias("credits"), F.sum("n").alias("n"), F.sum("n_debits").alias("n_debits"), F.count("*").alias("merchants"))


def category_share(ledger: DataFrame) -> DataFrame:
    """Debits by category with whole per cents, rounded down; categories without debits are left out."""
    rows = category_rollup(ledger).filter("debits > 0")
    total = F.sum("debits").over(Window.partitionBy())
    return rows.withColumn("_total", total).select("category", "debits", F.col("n_debits").alias("n"), F.expr("debits * 100 div _total").alias("percent"))


def coverage(ledger: DataFrame) -> DataFrame:
    """(kind, n, confident, classified)."""
    return ledger.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(confident(F.col("source"))).alias("confident"), F.count_if(F.col("kind") != "unknown").alias("classified"))
