"""Dates of statements: two numeric readings, the unambiguous forms, and the order that a file's dates settle."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .bind import bind

#: The accepted forms in order. Two-digit and four-digit years are tried apart.
NUMERIC = {"day_first": ("d/M/yy", "d/M/yyyy", "d-M-yy", "d-M-yyyy"), "month_first": ("M/d/yy", "M/d/yyyy", "M-d-yy", "M-d-yyyy")}
NAMED = ("d MMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "d MMMM yyyy", "yyyy-M-d", "d MMM, yyyy", "d MMMM, yyyy")
TRAILING_TIME = r"(?i)[\s|,;]+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?\s*$"
#: What the numeric forms read, which no named one does, and the length of the shortest named form.
NUMERIC_SHAPE, LEAST_NAMED = r"^\d{1,2}[/-]\d{1,2}[/-](\d{2}|\d{4})$", 8
NUMERIC_DATE = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})\s*$"


def _cleaned(text: Column) -> Column:
    s = F.trim(text)
    s = F.when(F.instr(s, ":") > 0, F.regexp_replace(s, TRAILING_TIME, "")).otherwise(s)
    return F.rtrim(s, F.lit("|,; "))


def _shape(form: str) -> str:
    """The pattern of the texts that a form can read, so that each text is parsed by one form only."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + re.sub("y+|M+|d", lambda m: parts[m[0]], form) + "$"


def _read(s: Column, forms: tuple[str, ...]) -> Column:
    """A cleaned text by the form whose shape it has. Two-digit years pivot at 69, as POSIX has it."""
    letters = F.regexp_extract(s, "[A-Za-z]+", 0)
    named = F.replace(s, letters, F.initcap(F.lower(letters)))
    out = F
    for form in forms:
        out = out.when(s.rlike(_shape(form)), F.try_to_timestamp(named if "MMM" in form else s, F.lit(form)).cast("date"))
    short = s.rlike(r"[/-]\d{2}$")
    return bind(out.otherwise(None), lambda found: F.when((F.year(found) > 2068) & short, F.add_months(found, -1200)).otherwise(found))


def _named(s: Column) -> Column:
    return F.when(F.length(s) >= LEAST_NAMED, _read(s, NAMED))


def parse_date(text: Column, order: str = "day_first") -> Column:
    """A date, or null."""
    return bind(_cleaned(text), lambda s: F.when(s.rlike(NUMERIC_SHAPE), _read(s, NUMERIC[order])).otherwise(_named(s)))


def readings(text: Column) -> Column:
    """struct<d, m>: parse_date() of a text in both orders at once."""
    both = lambda d, m: F.struct(d.alias("d"), m.alias("m"))
    return bind(_cleaned(text), lambda s: F.when(s.rlike(NUMERIC_SHAPE), both(*(_read(s, NUMERIC[o]) for o in ("day_first", "month_first")))).otherwise(bind(_named(s), lambda n: both(n, n))))


def looks_like_date(text: Column) -> Column:
    return bind(readings(text), lambda r: r["d"].isNotNull() | r["m"].isNotNull())


def order_evidence(text: Column) -> list[Column]:
    """Aggregates over one file's date cells: what decides its order."""
    # a failing cast costs far more than a match
    first, second = (F.when(text.rlike(NUMERIC_DATE), F.regexp_extract(text, NUMERIC_DATE, k).cast("int")) for k in (1, 2))
    return [F.coalesce(F.bool_or(first > 12), F.lit(False)).alias("day_over"), F.coalesce(F.bool_or(second > 12), F.lit(False)).alias("month_over"), F.coalesce(F.bool_or(first.isNotNull()), F.lit(False)).alias("any_numeric")]


def settle_order(cells, file: str = "statement_id", position: str = "pos", text: str = "date_text"):
    """(file, date_order, observed, inconsistent): a component over 12 decides, then the only ascending reading, else day first unobserved. cells may have the readings d and m of the text already."""
    from pyspark.sql import Window

    order = Window.partitionBy(file).orderBy(position)
    cells = cells if "d" in cells.columns else cells.withColumn("_days", readings(F.col(text))).withColumns({c: F.col("_days")[c] for c in "dm"})
    read = cells.select(file, position, text, "d", "m")
    before = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    read = read.withColumns({"d_back": F.col("d") < before("d"), "m_back": F.col("m") < before("m")})
    facts = read.groupBy(file).agg(*order_evidence(F.col(text)), *(((F.count(c) > 0) & ~F.coalesce(F.bool_or(f"{c}_back"), F.lit(False))).alias(f"{c}_runs") for c in ("d", "m")))
    decided = F.when(~F.col("any_numeric"), "day_first").when(F.col("day_over"), "day_first").when(F.col("month_over"), "month_first").when(F.col("m_runs") & ~F.col("d_runs"), "month_first").otherwise("day_first")
    observed = ~F.col("any_numeric") | F.col("day_over") | F.col("month_over") | (F.col("d_runs") != F.col("m_runs"))
    return facts.select(file, decided.alias("date_order"), observed.alias("observed"), (F.col("day_over") & F.col("month_over")).alias("inconsistent"))
