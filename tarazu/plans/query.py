"""Questions as a small immutable query, its validation, and its plan over a ledger."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..operators import patterns

#: The fields that each intent reads; a query with any other set is malformed.
READS = {
    "total": ("merchant", "category", "period", "direction", "on_card"),
    "count": ("merchant", "category", "period", "direction"),
    "top": ("category", "period", "direction"),
    "refunds": ("merchant", "period"),
    "recurring": (),
    "duplicates": (),
}
TOP = 5


@dataclass(frozen=True)
class Period:
    start: date
    end: date
    label: str = ""


@dataclass(frozen=True)
class Query:
    intent: str
    merchant: str | None = None
    category: str | None = None
    period: Period | None = None
    direction: str | None = None
    on_card: bool | None = None

    def __post_init__(self) -> None:
        if self.intent not in READS:
            raise ValueError(f"no such intent: {self.intent!r}")
        extra = [f for f in ("merchant", "category", "period", "direction", "on_card") if getattr(self, f) is not None and f not in READS[self.intent]]
        if extra:
            raise ValueError(f"{self.intent} doesn't read {', '.join(extra)}")


@dataclass(frozen=True)
class Answer:
    """evidence: the ledger rows behind the figure."""

    query: Query | None
    amount: int | None
    n: int
    evidence: DataFrame | None
    understood: bool = True
    refused: tuple[str, ...] = ()


def select(ledger: DataFrame, query: Query) -> DataFrame:
    """Rows that meet all of the query's filters; unset fields filter nothing."""
    for column, value in (("name", query.merchant), ("category", query.category), ("direction", query.direction), ("on_card", query.on_card)):
        if value is not None:
            ledger = ledger.filter(F.col(column) == F.lit(value))
    if query.period:
        ledger = ledger.filter(F.col("date").between(F.lit(query.period.start), F.lit(query.period.end)))
    return ledger


def total(ledger: DataFrame, query: Query) -> DataFrame:
    """(amount, n); amount is null where nothing matched."""
    return select(ledger, query).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def count(ledger: DataFrame, query: Query) -> DataFrame:
    """(amount, n); amount is 0 where nothing matched."""
    return select(ledger, query).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count("*").alias("n"))


def top(ledger: DataFrame, query: Query, most: int = TOP) -> DataFrame:
    """(name, amount, n) of the largest merchants; ties in order of first appearance."""
    first = F.min(F.struct("date", "statement_id", "row", "seq"))
    groups = select(ledger, query).groupBy("name").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), first.alias("_first"))
    return groups.orderBy(F.desc("amount"), "_first").limit(most).drop("_first")


def refunds(ledger: DataFrame, query: Query) -> DataFrame:
    found = patterns.refunds(ledger)
    if query.merchant is not None:
        found = found.filter(F.col("name") == query.merchant)
    if query.period:
        found = found.filter(F.col("credit_date").between(F.lit(query.period.start), F.lit(query.period.end)))
    return found


def evidence(ledger: DataFrame, query: Query) -> DataFrame:
    """The rows behind an answer, by a semi join on (statement_id, seq)."""
    if query.intent in ("total", "count"):
        return select(ledger, query)
    if query.intent == "top":
        return select(ledger, query).join(top(ledger, query).select("name"), "name", "left_semi")
    if query.intent == "refunds":
        found = refunds(ledger, query)
        keys = found.select("statement_id", F.explode(F.array("debit_seq", "credit_seq")).alias("seq"))
        return ledger.join(keys, ["statement_id", "seq"], "left_semi")
    debits = ledger.filter(F.col("direction") == "debit")
    if query.intent == "recurring":
        return debits.join(patterns.recurring(ledger).filter("active").select("statement_id", "name"), ["statement_id", "name"], "left_semi")
    found = patterns.duplicates(ledger).select("statement_id", "name", "amount", "first_date", "last_date")
    same = [debits[c] == found[c] for c in ("statement_id", "name", "amount")]
    return debits.join(found, [*same, debits["date"].between(found["first_date"], found["last_date"])], "left_semi")


def figure(ledger: DataFrame, query: Query) -> DataFrame:
    """(amount, n) of any intent, as one row."""
    if query.intent == "total":
        return total(ledger, query)
    if query.intent == "count":
        return count(ledger, query)
    if query.intent == "top":
        return top(ledger, query).agg(F.max("amount").alias("amount"), F.count("*").alias("n"))
    rows, column = {
        "refunds": lambda: (refunds(ledger, query), "amount"),
        "recurring": lambda: (patterns.recurring(ledger).filter("active"), "annualised"),
        "duplicates": lambda: (patterns.duplicates(ledger), "exposure"),
    }[query.intent]()
    return rows.agg(F.coalesce(F.sum(column), F.lit(0)).alias("amount"), F.count("*").alias("n"))


def run(ledger: DataFrame, query: Query) -> Answer:
    row = figure(ledger, query).first()
    return Answer(query, row["amount"], row["n"], evidence(ledger, query))
