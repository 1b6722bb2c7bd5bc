"""Patterns inside one statement: refunds, duplicate charges, recurring charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

REFUND_DAYS, DUPLICATE_DAYS, MIN_CHARGES = 90, 3, 3
#: Cadences by days.
CADENCES = ((7, "weekly"), (14, "fortnightly"), (30, "monthly"), (91, "quarterly"), (365, "yearly"))


def greedy(outs: Column, ins: Column, eligible, choose) -> Column:
    """Pairs each of outs, in order, with one of the free ins: array<struct<o, i>>. A fold on the JVM side."""
    start = F.struct(ins.alias("free"), F.filter(F.transform(F.slice(outs, 1, 1), lambda o: F.struct(o.alias("o"), F.get(ins, F.lit(0)).alias("i"))), lambda x: F.lit(False)).alias("pairs"))

    def step(acc: Column, o: Column) -> Column:
        pick = choose(F.filter(acc["free"], lambda i: eligible(o, i)), o)

        def take(p: Column) -> Column:
            kept = F.filter(acc["free"], lambda i: ~i["k"].eqNullSafe(p["k"]))
            return F.struct(F.when(p.isNull(), acc["free"]).otherwise(kept).alias("free"), F.when(p.isNull(), acc["pairs"]).otherwise(F.array_append(acc["pairs"], F.struct(o.alias("o"), p.alias("i")))).alias("pairs"))

        return F.get(F.transform(F.array(pick), take), F.lit(0))

    return F.aggregate(outs, start, step, lambda acc: acc["pairs"])


def refunds(ledger: DataFrame, days: int = REFUND_DAYS) -> DataFrame:
    """(statement_id, name, amount, debit_seq, credit_seq, debit_date, credit_date, lag_days).

    Credits in statement order take the first free debit of the same name and amount that lies up to
    ``days`` before. Only keys with both sides are gathered.
    """
    keys = ["statement_id", "name", "amount"]
    item = F.struct("date", F.col("seq").alias("k"))
    groups = ledger.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("direction") == "debit", item))).alias("debits"),
        F.sort_array(F.collect_list(F.when(F.col("direction") == "credit", F.struct(F.col("seq").alias("k"), "date")))).alias("credits"),
    )
    near = lambda c, d: F.datediff(c["date"], d["date"]).between(0, days)
    pairs = greedy(F.col("credits"), F.col("debits"), near, lambda free, c: F.get(free, F.lit(0)))
    rows = groups.filter("size(debits) > 0 and size(credits) > 0").select(*keys, F.explode(pairs).alias("p"))
    return rows.select(*keys, F.col("p.i.k").alias("debit_seq"), F.col("p.o.k").alias("credit_seq"), F.col("p.i.date").alias("debit_date"), F.col("p.o.date").alias("credit_date"), F.datediff("p.o.date", "p.i.date").alias("lag_days"))


def duplicates(ledger: DataFrame, days: int = DUPLICATE_DAYS) -> DataFrame:
    """Clusters of equal charges, each up to ``days`` after the one before, less those that were refunded."""
    keys = ["statement_id", "name", "amount"]
    order = Window.partitionBy(*keys).orderBy("date", "seq")
    debits = ledger.filter(F.col("direction") == "debit")
    debits = debits.withColumn("_new", F.coalesce((F.datediff("date", F.lag("date").over(order)) > days).cast("int"), F.lit(1)))
    debits = debits.withColumn("_cluster", F.sum("_new").over(order))
    back = refunds(ledger).select("statement_id", F.col("debit_seq").alias("seq"), F.lit(1).alias("_back"))
    out = debits.join(back, ["statement_id", "seq"], "left").groupBy(*keys, "_cluster").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("_back").alias("refunded"))
    return out.filter("n >= 2").select(*keys, "n", "first_date", "last_date", "refunded", (F.col("amount") * F.greatest(F.col("n") - 1 - F.col("refunded"), F.lit(0))).alias("exposure"))


def recurring(ledger: DataFrame, minimum: int = MIN_CHARGES) -> DataFrame:
    """Charges of one merchant at a steady pace and price."""
    keys = ["statement_id", "name"]
    as_of = ledger.groupBy("statement_id").agg(F.max("date").alias("as_of"))
    debits = ledger.filter(F.col("direction") == "debit")
    prices = debits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.bround(F.median("amount")).cast("long").alias("typical"), F.min_by("category", F.struct("row", "seq")).alias("category"))
    dates = debits.select(*keys, "date").distinct()
    gaps = dates.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))))
    pace = gaps.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.bround(F.median("gap")).cast("int").alias("spacing"), F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.max("date").alias("last_date"))
    slack = F.greatest(F.lit(4.0), F.col("spacing") * 0.25)
    steady = (F.col("n_dates") >= minimum) & (F.col("spacing") > 0) & (F.abs(F.col("shortest") - F.col("spacing")) <= slack) & (F.abs(F.col("longest") - F.col("spacing")) <= slack)
    alike = F.when(F.col("least") == 0, F.col("most") == 0).otherwise(F.col("most") <= F.col("least") * 1.25)
    out = pace.filter(steady).join(prices, keys).filter(alike).join(as_of, "statement_id")
    cadence = F
    for day, label in CADENCES:
        cadence = cadence.when(F.abs(F.col("spacing") - day) <= max(3, 0.2 * day), label)
    cadence = cadence.otherwise(F.concat(F.lit("every "), F.col("spacing").cast("string"), F.lit("d")))
    return out.select(*keys, "category", "n", "typical", "spacing", cadence.alias("cadence"), "last_date", (F.datediff("as_of", "last_date") <= 1.5 * F.col("spacing")).alias("active"), F.bround(F.col("typical") * 365 / F.col("spacing")).cast("long").alias("annualised"))
