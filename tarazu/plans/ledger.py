"""The labelled ledger: parsed transactions with the names, categories and kinds that questions are asked of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import merchants, segments
from ..functions.narration import parse_narration
from ..session import written

KEY = "statement_id"


def labelled(transactions: DataFrame, words: list[str] | None = None) -> DataFrame:
    """transactions(statement_id, seq, narration, ...) with name, category, kind, source, channel and counterparty.

    Each statement's narrations teach it words, and those of several teach all; each distinct counterparty of a
    statement is cut and labelled once. words: known ones, commonest first, in place of the lexicon's.
    """
    spoken = written(segments.firsts(transactions), "spoken")
    seed = segments.vocabulary(spoken, words)
    own = written(segments.learnt(spoken, seed), "learnt")
    parts = transactions.select(KEY, "narration").distinct().withColumn("parts", parse_narration(F.col("narration")))
    narrations = written(parts.withColumn("text", F.col("parts.counterparty")), "narrations")
    cut = segments.segmented(narrations, own, seed)
    labels = narrations.join(cut, [KEY, "text"]).select(KEY, "narration", merchants.identify(F.col("narration"), F.col("words"), F.col("parts")).alias("label"))
    # a null narration meets its own label
    same = [transactions[KEY] == labels[KEY], transactions["narration"].eqNullSafe(labels["narration"])]
    rows = transactions.join(labels, same).select(transactions["*"], "label")
    return rows.select(*transactions.columns, *(F.col("label")[c].alias(c) for c in ("name", "category", "kind", "source", "channel", "counterparty")))


def ledger(transactions: DataFrame, on_card: DataFrame) -> DataFrame:
    """The labelled rows of all statements. on_card(statement_id, on_card, pos); rows are ordered where they are shown."""
    return labelled(transactions).join(on_card.select(KEY, "on_card", "pos"), KEY)


def names(rows: DataFrame) -> DataFrame:
    """(name, category) of a ledger, each pair once."""
    return rows.select("name", "category").distinct()
