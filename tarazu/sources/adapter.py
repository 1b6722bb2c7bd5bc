"""A ledger over the driver's tables: accounts are users, rows are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.money import signed

OPENING = 100_000


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows. amount is bucketed, exact is to the paisa."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    direction = F.when(F.col("event_type").isin("signup", "error"), "credit").otherwise("debit")
    kind = F.when(k % 8 == 0, "card bill").when(k % 8 == 1, "person").when(k % 8 == 2, "unknown").otherwise("merchant")
    source = F.when(k % 5 == 0, "lexicon").when(k % 5 == 1, "vpa").when(k % 5 == 2, "prefix").when(k % 5 == 3, "segmented").otherwise("raw")
    return e.select(
        F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("statement_id"), F.col("user_id").alias("pos"), F.col("event_id").alias("seq"), F.col("event_id").alias("row"),
        F.col("ts").cast("date").alias("date"), direction.alias("direction"), F.concat(F.lit("m"), (k % 8).cast("string")).alias("name"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"),
        ((F.floor(F.col("value") / 50) + 1) * 5000).cast("long").alias("amount"), F.round(F.col("value") * 100).cast("long").alias("exact"), (F.col("user_id") % 4 == 0).alias("on_card"), kind.alias("kind"), source.alias("source"),
    )


def exact(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount", F.col("exact"))


def transactions(rows: DataFrame) -> DataFrame:
    """Exact amounts with running balances: a hundred paise off where the row number divides by 97, none where by 5."""
    order = Window.partitionBy("statement_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = exact(rows)
    balance = OPENING + F.sum(signed(F.col("direction"), F.col("amount"))).over(order) + F.when(F.col("seq") % 97 == 0, 100).otherwise(0)
    return rows.withColumn("balance", F.when(F.col("seq") % 5 != 0, balance))


def statements(rows: DataFrame) -> DataFrame:
    """A statement for each account; some closing balances and stated totals are off."""
    moved = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("exact"))), F.lit(0))
    out = rows.groupBy("statement_id", "pos", "on_card").agg(moved("debit").alias("d"), moved("credit").alias("c"))
    off = lambda n, by: F.when(F.col("pos") % n == 0, by).otherwise(0)
    source = lambda n: F.when(F.col("pos") % n == 0, "derived").otherwise("explicit")
    return out.select(
        "statement_id", "pos", F.when(F.col("on_card"), "card").otherwise("bank").alias("kind"), F.lit(OPENING).cast("long").alias("opening"), (OPENING + F.col("c") - F.col("d") + off(7, 50)).alias("closing"), source(2).alias("opening_source"), source(3).alias("closing_source"),
        F.when(F.col("pos") % 3 == 0, F.col("d") + off(11, 1)).alias("stated_debits"), F.when(F.col("pos") % 3 == 0, F.col("c") + off(13, 1)).alias("stated_credits"),
        F.lit(50_000).cast("long").alias("previous"), (F.col("c") + off(17, 5)).alias("payments"), F.when(F.col("pos") % 19 != 0, F.col("d")).alias("purchases"), F.when(F.col("pos") % 8 == 0, 0).cast("long").alias("fees"), (50_000 - F.col("c") + F.col("d") + off(12, 60) + off(16, 500)).alias("due"),
    )
