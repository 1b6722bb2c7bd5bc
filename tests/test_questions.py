"""Tables of questions and of model answers, and scorecards, against one question at a time and by hand."""

import json
import random
from datetime import date

import pytest
from tarazu.operators import patterns
from tarazu.plans import evaluation, question
from tarazu.plans.query import Query, figure

LEDGER = "statement_id string, seq long, row long, date date, name string, category string, direction string, amount long, on_card boolean"


@pytest.fixture(scope="module")
def ledger(spark):
    own = random.Random(4)
    names = [("Swiggy", "food"), ("Swiggy Instamart", "groceries"), ("Acme Corp", "salary"), ("Bits & Bobs", "home goods"), ("(no narration)", "uncategorised"), ("Zen", "food")]
    rows = []
    for k in range(300):
        name, category = own.choice(names)
        rows.append((own.choice("ab"), k, k, date(2024, own.randrange(1, 7), own.randrange(1, 29)), name, category, own.choice(["debit", "debit", "credit"]), own.randrange(1, 9) * 1000, own.random() < 0.3))
    return spark.createDataFrame(rows, LEDGER).cache()


TEXTS = [
    "How much did I spend on food in March?", "how much did I spend at swiggy instamart", "how many times did I pay Zen", "what was my biggest expense in home goods?", "biggest expenses in February",
    "did swiggy refund me", "did I get any refunds in March?", "what subscriptions am I paying", "was I charged twice?", "how much income did I get in 2023", "how much did I spend on my cards from January to March",
    "how much did I spend at Tesco, and at Flipkart", "tell me a joke", "", None, "how much did bits & bobs cost", "how much did I spend in food and home goods last month",
]


def test_a_table_gives_what_each_query_gives(spark, ledger):
    texts = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*TEXTS, *TEXTS[:3]])], "k int, text string, intention string").repartition(3)
    rows = {r["k"]: r for r in question.answered(texts, ledger).collect()}
    assert len(rows) == len(TEXTS) + 3 and rows[0]["merchant"] is None and rows[1]["merchant"] == "Swiggy Instamart" and rows[15]["merchant"] == "Bits & Bobs" and rows[16]["category"] == "home goods"
    assert list(rows[11]["refused"]) == ["tesco", "flipkart"] and rows[11]["amount"] is None
    assert [rows[k]["understood"] for k in (12, 13, 14)] == [False] * 3
    checked = 0
    for r in rows.values():
        if r["intent"] and not r["refused"]:
            period = question.Period(r["start"], r["end"]) if r["start"] else None
            one = figure(ledger, Query(r["intent"], r["merchant"], r["category"], period, r["direction"], r["on_card"])).first()
            assert (r["amount"], r["n"]) == (one["amount"], one["n"]), r
            checked += 1
    assert checked == len(TEXTS) + 3 - 4 and patterns.refunds(ledger).count() > 0
    assert [rows[len(TEXTS) + k].asDict() | {"k": k} for k in range(3)] == [rows[k].asDict() for k in range(3)]


def test_nothing_is_taken_of_an_empty_ledger(spark, ledger):
    texts = spark.createDataFrame([("how much did I spend in March",)], "text string")
    assert question.answered(texts, ledger.filter("false")).first()["understood"] is False
    assert question.answered(texts.filter("false"), ledger).count() == 0


def test_every_fault_of_a_model_answer_is_a_row(spark, ledger):
    answers = [
        {"intent": "total", "category": "food", "on_card": False, "more": [1]}, {"intent": "total", "merchant": "Tesco", "category": "pets", "direction": "up", "period": {"start": "2024-02-01", "end": "2024-01-01"}},
        {"intent": "top", "merchant": "Zen", "period": {"start": "2024-01-01", "end": "2024-02-10", "label": "winter"}}, {"intent": 5}, {"intent": None, "reason": " unsure "}, {}, {"intent": "refunds", "period": "March"}, {"intent": "COUNT", "merchant": 7, "category": " "}, {"intent": "sum", "period": {"start": "2024-13-01", "end": 5}},
    ]
    texts = [json.dumps(a) for a in answers] + ["nothing", "[1, 2]", '{"intent": "total"', None, 'So: ```json\n{"intent": "recurring"}\n``` done']
    good, rejects = question.model_queries(spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string"), ledger)
    found = {r["answer_id"]: r for r in good.collect()}
    assert set(found) == {0, 2, 7, 13} and found[0]["direction"] == "debit" and found[0]["on_card"] is None and found[7]["intent"] == "count" and found[7]["merchant"] is None
    assert (found[2]["merchant"], str(found[2]["end"]), found[2]["label"]) == (None, "2024-02-10", "winter") and found[13]["direction"] is None
    faults = {}
    for r in rejects.collect():
        faults.setdefault(r["answer_id"], set()).add(r["field"])
    assert faults == {1: {"merchant", "category", "direction", "period"}, 3: {"intent"}, 4: {"intent"}, 5: {"intent"}, 6: {"period"}, 8: {"intent", "period"}, 9: {"answer"}, 10: {"answer"}, 11: {"answer"}, 12: {"answer"}}
    assert {r["reason"] for r in rejects.filter("answer_id = 4").collect()} == {"unsure"}


def test_scorecards_by_kind_and_split(spark, ledger):
    texts = [t for t in TEXTS if t]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    read = question.answered(table, ledger)
    right = read.select("text", question.F.lit("all").alias("kind"), *(question.F.when(question.F.size("refused") == 0, question.F.col(c)).alias(c) for c in question.QUERY))
    good = right.drop("kind").withColumns({"reader": question.F.lit("good"), "latency_ms": question.F.length("text").cast("double"), "cost": question.F.lit(1.0)})
    silent = good.select("text", *(question.F.lit(None).cast(good.schema[c].dataType).alias(c) for c in question.QUERY), question.F.lit("silent").alias("reader"), "latency_ms", question.F.lit(None).cast("double").alias("cost"))
    late = good.withColumn("reader", question.F.lit("late"))
    judged = evaluation.judged(good.unionByName(silent).unionByName(late), right, ledger).cache()
    cards = {(r["reader"], r["kind"], r["split"]): r for r in evaluation.scorecards(judged, spark.createDataFrame([("good", True), ("silent", True), ("late", False)], "reader string, complete boolean")).collect()}
    n, refusals = len(texts), 2
    card = cards["good", None, None]
    assert (card["n"], card["queries_ok"], card["answers_ok"], card["refused"], card["cost"]) == (n, n, n, refusals, float(n))
    assert card["p50_latency_ms"] == sorted(map(len, texts))[n // 2] if n % 2 else True
    assert (cards["silent", None, None]["queries_ok"], cards["silent", None, None]["refused"], cards["silent", None, None]["cost"]) == (refusals, n, None) and not any(k[0] == "late" for k in cards)
    import hashlib

    test = sum(int(hashlib.sha256(t.strip().lower().encode()).hexdigest()[:8], 16) % 100 < 40 for t in texts)
    assert cards["good", "all", "test"]["n"] == test and cards["good", "all", "dev"]["n"] == n - test
    assert evaluation.missed(judged).filter("reader = 'silent'").count() == n - refusals and evaluation.missed(judged).filter("reader = 'good'").isEmpty()


def test_names_are_cut_at_the_lengths_that_they_have(spark):
    """Texts are cut at the lengths of the names' first letters only, of which there are GRAM at most."""
    ledger = spark.createDataFrame([("m3",), ("Zomato",)], "name string")
    texts = spark.createDataFrame([("paid M3 twice",), ("at zomato",), ("none",), ("",)], "text string")
    found = question.merchants_in(texts, ledger)
    assert {tuple(r) for r in found.collect()} == {("paid M3 twice", "m3"), ("at zomato", "Zomato")}
    assert "sequence(1, 4" not in found._jdf.queryExecution().optimizedPlan().toString()
