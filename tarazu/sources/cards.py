"""Card statements in the grids of delimited files: which files are cards, their rows, and the summary box that proves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, money
from ..session import shuffled
from .statements import KEY, cells_of, heading, headers, identities

#: Labels that only cards have, labels of the summary box by field, and issuers.
MARKERS = r"(?i)min(imum)?\s+(amount\s+)?due|total\s+(amount\s+)?dues?\b|payment\s+due\s+date|credit\s+card"
BOX = (
    ("minimum_due", r"min(imum)?\s+(amount\s+)?dues?"),
    ("total_due", r"total\s+(amount\s+)?dues?|total\s+payable|net\s+amount\s+due"),
    ("previous_balance", r"(previous|opening|last)\s+(statement\s+)?(bal(ance)?|dues?)|past\s+dues?"),
    ("payments", r"payments?\s*[/&]\s*credits?|payments?\b|credits?\s*[/&]\s*payments?"),
    ("purchases", r"purchases?\s*[/&]\s*debits?|purchases?\b|new\s+debits?|total\s+spends?"),
    ("fees", r"finance\s+charges?|interest\s+charges?|other\s+charges?|fees?\s*[&/]?\s*charges?"),
)
DUE_DATE = r"payment\s+due\s+date|due\s+date"
ISSUERS = ("hdfc", "icici", "sbi", "axis", "kotak", "amex", "american express", "citi", "standard chartered", "rbl", "indusind", "au bank", "yes bank", "onecard", "slice", "idfc")
#: What every label of BOX and DUE_DATE holds, and the columns that hold figures.
HOLDS = "due|payable|bal|payment|credit|purchase|debit|spend|charge|fee"
FIGURES = ("debit", "credit", "amount")
BELOW = 2


def card_files(grid: DataFrame, header: DataFrame) -> DataFrame:
    """(statement_id) of the files that are card statements: no balance column, and a label that only cards have."""
    marked = grid.groupBy(KEY).agg(F.bool_or(F.exists("cells", lambda c: c.rlike(MARKERS))).alias("marked")).filter("marked")
    return header.filter(~F.map_contains_key("columns", F.lit("balance"))).join(marked, KEY).select(KEY)


def issuer_of(text: Column) -> Column:
    """The first issuer, in order of the list, that a text names."""
    out = F
    for name in ISSUERS:
        out = out.when(text.contains(name), name.upper() if len(name) <= 5 else name.title())
    return out.otherwise(None)


def summary(grid: DataFrame) -> DataFrame:
    """(statement_id, the fields of BOX, due_date): of the labels of a field the first, in reading order, that has a figure beside it or below."""
    rows = Window.partitionBy(KEY).orderBy("number")
    grid = grid.select(KEY, "number", "cells", *(F.lead("cells", k).over(rows).alias(f"below{k}") for k in range(1, BELOW + 1)))
    labels = grid.select(KEY, "number", "cells", *(f"below{k}" for k in range(1, BELOW + 1)), F.posexplode("cells").alias("at", "cell")).filter(F.lower("cell").rlike(HOLDS)).withColumn("label", heading(F.col("cell")))

    def near(read) -> Column:
        """What read() makes of the cells beside, then of those below."""
        beside = F.transform(F.slice("cells", F.col("at") + 2, F.size("cells")), read)
        below = F.array(*(read(F.coalesce(F.get(f"below{k}", F.col("at")), F.lit(""))) for k in range(1, BELOW + 1)))
        return F.get(F.filter(F.concat(beside, below), lambda v: v.isNotNull()), F.lit(0))

    place, fields = F.struct("number", "at"), []
    found = labels.filter(F.col("label").rlike("^(?:" + "|".join(p for _, p in (*BOX, ("", DUE_DATE))) + ")"))
    found = found.withColumns({"figure": near(money.parse_optional_amount), "day": near(lambda c: dates.parse_date(c))})
    for name, pattern in BOX:
        fields.append(F.min_by("figure", F.when(F.col("label").rlike(f"^(?:{pattern})") & F.col("figure").isNotNull(), place)).alias(name))
    due = F.min_by("day", F.when(F.col("label").rlike(f"^(?:{DUE_DATE})") & F.col("day").isNotNull(), place)).alias("due_date")
    return found.groupBy(KEY).agg(*fields, due)


def box_patterns() -> dict[str, str]:
    """The labels of the summary box by field, for words.labelled_values()."""
    return {name: rf"^\s*(?:{pattern})" for name, pattern in (*BOX, ("due_date", DUE_DATE))}


def overridden(summaries: DataFrame, labelled: DataFrame) -> DataFrame:
    """summaries with what stands under the labels on the page, by labelled(statement_id, field, value): places on a page are surer than cells, where they give a figure or a day."""
    amount, day = money.parse_optional_amount(F.col("value")), dates.parse_date(F.col("value"))
    of = lambda name: F.max(F.when(F.col("field") == name, day if name == "due_date" else F.col("value_amount")))
    names = [*(name for name, _ in BOX), "due_date"]
    placed = labelled.withColumn("value_amount", amount).groupBy(KEY).agg(*(of(name).alias(f"_{name}") for name in names))
    both = summaries.join(placed, KEY, "full")
    return both.select(KEY, *(F.coalesce(f"_{name}", name).alias(name) for name in names))


def parsed(grid: DataFrame, header: DataFrame | None = None, labelled: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, transactions, rejects) of the card files of a grid; labelled: see overridden(). Only dated rows with an amount are transactions; other rows of the table are its summary and its foot."""
    header = headers(grid) if header is None else header
    files = card_files(grid, header)
    rows = cells_of(grid, header.join(files, KEY, "left_semi"))
    sided = F.map_contains_key("columns", F.lit("debit")) | F.map_contains_key("columns", F.lit("credit"))
    rows = rows.withColumns({f"{f}_read": money.reading(F.col(f"{f}_text")) for f in FIGURES} | {"days": dates.readings(F.col("date_text"))})
    rows = rows.withColumns({f: F.col(f"{f}_read.amount") for f in FIGURES})
    text = F.lower(F.trim("amount_text"))
    # on a card, Cr, a minus and a leading plus all take off what is owed
    off = text.endswith("cr") | (F.col("amount") < 0) | text.startswith("+")
    direction = F.when(sided, F.when(F.col("debit").isNotNull(), "debit").otherwise("credit")).otherwise(F.when(off, "credit").otherwise("debit"))
    figure = F.when(sided, F.coalesce("debit", "credit")).otherwise(F.col("amount"))
    garbled = F.greatest(*(F.col(f"{f}_read.bad") for f in FIGURES))
    dated = rows.filter("days.d is not null or days.m is not null").select(KEY, "number", "date_text", "narration_text", F.col("days.d").alias("d"), F.col("days.m").alias("m"), direction.alias("direction"), figure.alias("figure"), garbled.alias("bad"))
    # faults, orders and entries are read from these rows
    dated = shuffled(dated, "dated")
    order = dates.settle_order(dated.select(KEY, F.col("number").alias("pos"), "date_text", "d", "m"))
    dated = dated.join(order, KEY)
    day = F.when(F.col("date_order") == "month_first", F.col("m")).otherwise(F.col("d"))
    faults = dated.groupBy(KEY).agg(F.min(F.when(F.col("bad"), F.col("number"))).alias("bad_row"), F.count(F.when(~F.col("bad"), F.col("figure"))).alias("n"))
    facts = files.join(faults, KEY, "left")
    reason = F.when(F.col("bad_row").isNotNull(), F.concat(F.lit("row "), F.col("bad_row").cast("string"), F.lit(" can't be read"))).when(F.coalesce("n", F.lit(0)) == 0, "no transaction rows under the header")
    facts = facts.withColumn("reason", reason)
    good = facts.filter("reason is null").select(KEY)
    entries = dated.filter("figure is not null").join(good, KEY, "left_semi")
    entries = entries.withColumn("seq", F.row_number().over(Window.partitionBy(KEY).orderBy("number")).cast("long"))
    entries = entries.select(KEY, "seq", F.col("number").alias("row"), day.alias("date"), F.lit(None).cast("date").alias("value_date"), F.col("narration_text").alias("narration"), "direction", F.abs("figure").alias("amount"), F.lit(None).cast("long").alias("balance"))
    periods = entries.groupBy(KEY).agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"))
    above = grid.join(header.select(KEY, "header"), KEY).filter("number < header").groupBy(KEY).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.array_join("cells", " ").alias("x")))), lambda r: r["x"]), " ")).alias("top"))
    stem = F.regexp_replace(F.lower(F.substring_index(KEY, "/", -1)), r"\.[^.]*$", "")
    identity = identities(grid, header).select(KEY, "account_hint")
    statements = good.join(periods, KEY).join(identity, KEY, "left").join(above, KEY, "left").join(summary(grid) if labelled is None else overridden(summary(grid), labelled), KEY, "left")
    statements = statements.select(KEY, F.coalesce(issuer_of(F.coalesce("top", F.lit(""))), issuer_of(stem), F.lit("unknown")).alias("issuer"), F.coalesce("account_hint", F.lit("")).alias("account_hint"), *(name for name, _ in BOX), "due_date", "period_start", "period_end")
    return statements, entries, facts.filter("reason is not null").select(KEY, "reason")
