"""Scorecards of question readers: what each made of questions whose right queries are known, as tables.

gold(text, kind, QUERY) has the right query of each question, with a null intent where refusing is right. attempts(reader,
text, QUERY, latency_ms, cost) has what a reader made of it, with a null intent where it refused; a saved run is such a
table, so a card is made from it without asking again. Right figures are computed by running the right query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .question import QUERY, with_figures

#: Fixed value: the share of questions, in hundredths, that are held back.
TEST_SHARE = 40


def split_of(text: Column) -> Column:
    """'test' or 'dev', by a hash of the question itself, so that nobody chooses what they are graded on."""
    digits = F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 8)
    return F.when(F.conv(digits, 16, 10).cast("long") % 100 < TEST_SHARE, "test").otherwise("dev")


def judged(attempts: DataFrame, gold: DataFrame, ledger: DataFrame) -> DataFrame:
    """attempts with kind, split, expected (the right query), query_ok, answer_ok and refused. Questions without a right answer on file are left out.

    Queries are equal if all their fields are; two figures are, if both are missing too.
    """
    fields = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in QUERY))
    right = with_figures(gold.select("text", "kind", *QUERY).distinct(), ledger).select("text", "kind", fields("").alias("expected"), F.col("amount").alias("right_amount"))
    made = with_figures(attempts, ledger).join(right, "text")
    return made.withColumns({
        "split": split_of(F.col("text")),
        "query_ok": F.to_json(fields("")) == F.to_json("expected"),
        "answer_ok": F.col("amount").eqNullSafe(F.col("right_amount")),
        "refused": F.col("intent").isNull(),
    })


def scorecards(judged_: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """(reader, kind, split, n, queries_ok, answers_ok, refused, p50_latency_ms, cost) over kinds and splits, null standing for all.

    reached(reader, complete): readers whose run stopped early get no card, as questions never asked would count as wrong.
    A cost is null where an attempt has none; the median latency is exact.
    """
    if reached is not None:
        judged_ = judged_.join(reached.filter("complete").select("reader"), "reader", "left_semi")
    counted = lambda c: F.count_if(F.col(c))
    priced = F.when(F.count("cost") == F.count("*"), F.sum("cost"))
    cards = judged_.cube("reader", "kind", "split").agg(F.count("*").alias("n"), counted("query_ok").alias("queries_ok"), counted("answer_ok").alias("answers_ok"), counted("refused").alias("refused"), F.median("latency_ms").alias("p50_latency_ms"), priced.alias("cost"), F.grouping("reader").alias("_all"))
    return cards.filter("_all = 0").drop("_all")


def missed(judged_: DataFrame) -> DataFrame:
    """(reader, kind, split, text, expected, made) of the questions that were read otherwise, queries as JSON."""
    return judged_.filter("not query_ok").select("reader", "kind", "split", "text", F.to_json("expected").alias("expected"), F.to_json(F.struct(*QUERY)).alias("made"))
