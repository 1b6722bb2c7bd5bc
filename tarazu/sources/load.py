"""Statement files of any kind: cut, told apart as bank or card, parsed; what can't be read is counted, not raised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shuffled
from . import cards, delimited, statements
from .statements import KEY, Format


@dataclass(frozen=True)
class Loaded:
    """banks and cards: a row a statement; transactions: the rows of both, on_card tells which; rejects: (statement_id, reason)."""

    banks: DataFrame
    cards: DataFrame
    transactions: DataFrame
    rejects: DataFrame


def from_grid(grid: DataFrame, rejects: DataFrame | None = None, labelled: DataFrame | None = None) -> Loaded:
    """grid(statement_id, number, cells); labelled: words.labelled_values(words, cards.box_patterns()) of paged cards."""
    header = shuffled(statements.headers(grid), "headers")
    on_card = shuffled(cards.card_files(grid, header), "cards")
    banks, entries, refused = statements.parsed(grid.join(on_card, KEY, "left_anti"), header.join(on_card, KEY, "left_anti"))
    card, card_entries, card_refused = cards.parsed(grid.join(on_card, KEY, "left_semi"), header.join(on_card, KEY, "left_semi"), labelled)
    columns = [KEY, "seq", "row", "date", "value_date", "narration", "direction", "amount", "balance"]
    rows = entries.select(*columns, F.lit(False).alias("on_card")).unionByName(card_entries.select(*columns, F.lit(True).alias("on_card")))
    out = refused.unionByName(card_refused)
    return Loaded(banks, card, rows, out if rejects is None else out.unionByName(rejects))


def load(spark: SparkSession, path: str | list[str], pattern: str = "*.{csv,tsv,txt,xlsx,xls,pdf}", formats: tuple[Format, ...] = (), **limits: int) -> Loaded:
    """All statement files under the paths; formats: further formats, tried first; limits: those of read_files()."""
    files = shuffled(statements.read_files(spark, path, pattern, formats, **limits), "grid")
    return from_grid(files.filter("reason is null").drop("reason"), files.filter("reason is not null").select(KEY, "reason"))


def load_delimited(spark: SparkSession, path: str | list[str], pattern: str = "*.{csv,tsv,txt}") -> Loaded:
    """Delimited files under the paths, scanned in splits: a file may be of any size."""
    rows = shuffled(delimited.scan(spark, path, pattern), "grid")
    return from_grid(rows.filter("reason is null").select(KEY, "number", "cells"), rows.filter("reason is not null").select(KEY, "reason"))
