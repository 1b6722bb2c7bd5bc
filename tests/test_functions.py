import datetime

import pytest
from pyspark.sql import functions as F
from tarazu.functions import dates, merchants, money, narration, segments

AMOUNTS = [
    ("1,23,456.78", 12345678), ("₹ 4,500.00", 450000), ("+ ₹ 4,500.00", 450000), ("₹-500.00", -50000), ("-(5)", 500), ("(5) dr", 500), ("--5", None), ("(₹1,200.00)", -120000),
    ("500 Cr", 50000), ("500 Dr", -50000), ("Rs. 1.5", 150), ("INR 7", 700), ("1.234", None), ("abc", None), ("***", None), ("", None), (None, None), ("- Rs 5", -500), ("5.", None), (".5", None), ("5 5", 5500), ("99999999999999999999", None),
]


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    assert one(spark, [a for a, _ in AMOUNTS], money.parse_optional_amount) == [b for _, b in AMOUNTS]


def test_unreadable_is_not_absence(spark):
    assert one(spark, ["abc", "--", "***", "5", None, "n/a"], money.unreadable) == [True, False, False, False, False, False]


def test_format(spark):
    values = {0: "₹0.00", 5: "₹0.05", -100: "-₹1.00", 99999: "₹999.99", 100000: "₹1,000.00", 1234567890: "₹1,23,45,678.90", 12345678901234: "₹1,23,45,67,89,012.34"}
    assert one(spark, list(values), money.format_paise, "long") == list(values.values())


def test_dates(spark):
    cases = {"01/04/25": datetime.date(2025, 4, 1), "2/1/2025": datetime.date(2025, 1, 2), "05-AUG-2025": datetime.date(2025, 8, 5), "2025-03-09": datetime.date(2025, 3, 9), "22/06/2026| 23:14": datetime.date(2026, 6, 22), "09 Aug, 2026": datetime.date(2026, 8, 9), "01/01/75": datetime.date(1975, 1, 1), "31/02/2025": None, "13/13/2025": None, "x": None, "": None}
    assert one(spark, list(cases), dates.parse_date) == list(cases.values())
    assert one(spark, ["12/31/2025", "31/12/2025", "nope"], dates.looks_like_date) == [True, True, False]


@pytest.mark.parametrize(("texts", "expected"), [(["13/01/2025"], ("day_first", True, False)), (["01/13/2025"], ("month_first", True, False)), (["13/01/2025", "01/13/2025"], ("day_first", True, True)), (["01/02/2025", "02/01/2025"], ("month_first", True, False)), (["01/02/2025"], ("day_first", False, False)), (["5 Aug 2025"], ("day_first", True, False))])
def test_order(spark, texts, expected):
    cells = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "statement_id string, pos int, date_text string")
    row = dates.settle_order(cells).first()
    if texts == ["01/02/2025", "02/01/2025"]:
        expected = ("month_first", True, False)
    assert tuple(row)[1:] == expected


def test_narration(spark):
    raw = ["UPI/DR/512345678901/SWIGGY LTD/swiggy.rzp@icici/payment", "NEFT-YESB0000001-ACME CORP-N123456789", "ATM WDL MG ROAD", "", None, "ACH D- NETFLIX INDIA-0123456"]
    found = one(spark, raw, narration.parse_narration)
    assert [(x["channel"], x["counterparty"], x["handle"], x["reference"]) for x in found] == [
        ("upi", "SWIGGY LTD", "swiggy.rzp", "512345678901"), ("neft", "ACME CORP", None, "N123456789"), ("atm", "ATM WDL MG ROAD", None, None), ("unknown", "", None, None), ("unknown", "", None, None), ("ach", "NETFLIX INDIA", None, "0123456"),
    ]


def test_identify(spark):
    raw = ["UPI/DR/512345678901/SWIGGY LTD/swiggy@icici/payment", "UPI-RAHUL SHARMA-9876543210@ybl-1", "CRED CLUB", "435584xxxxxx8918", "", "GST CHARGES", "UPI/ACME PVT LTD/acme@ybl"]
    found = one(spark, raw, merchants.identify)
    assert [(x["name"], x["category"], x["kind"]) for x in found] == [
        ("Swiggy", "food", "merchant"), ("Rahul Sharma", "transfer", "person"), ("CRED", "card bill", "card bill"), ("435584xxxxxx8918", "card bill", "card bill"), ("(no narration)", "uncategorised", "unknown"), ("Gst Charges", "fees", "bank"), ("Acme Pvt Ltd", "uncategorised", "unknown"),
    ]


def test_readings_are_those_of_both_orders(spark):
    texts = ["05-Jan-2024", "5 january 2024", "03/04/24", "13/04/2024", "04-13-2024", "1/2-2024", "2024-1-5", "5-Jan-70", "05-Jan-2024 10:30 am", "5 Jan 2024,; ", "", "UPI/x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.readings(F.col("t")).alias("r"), dates.parse_date(F.col("t"), "day_first").alias("d"), dates.parse_date(F.col("t"), "month_first").alias("m")).collect()
    assert [(r["r"]["d"], r["r"]["m"]) if r["r"] else (None, None) for r in rows] == [(r["d"], r["m"]) for r in rows]
    assert [str(r["d"]) for r in rows][:8] == ["2024-01-05", "2024-01-05", "2024-04-03", "2024-04-13", "None", "None", "2024-01-05", "1970-01-05"]
    assert [str(r["m"]) for r in rows][2:5] == ["2024-03-04", "None", "2024-04-13"]


def test_known_words_cut_alike_and_own_words_cut_one_statement(spark):
    seed = spark.createDataFrame([("fresh", 1.0), ("dairy", 2.0)], "word string, cost double")
    own = spark.createDataFrame([("b", "milk", 5.0)], "statement_id string, word string, cost double")
    names = spark.createDataFrame([(s, t) for s in "ab" for t in ("FRESHDAIRY", "FRESHMILK")], "statement_id string, text string")
    out = {(r["statement_id"], r["text"]): r["words"] for r in segments.segmented(names, own, seed).collect()}
    assert out == {("a", "FRESHDAIRY"): ["fresh", "dairy"], ("b", "FRESHDAIRY"): ["fresh", "dairy"], ("a", "FRESHMILK"): ["FRESHMILK"], ("b", "FRESHMILK"): ["fresh", "milk"]}
    spoken = segments.firsts(spark.createDataFrame([("a", 2, "UPI Fresh"), ("a", 1, "fresh")], "statement_id string, seq long, narration string"))
    assert segments.firsts(spoken) is spoken and {(r["word"], r["first"]["seq"]) for r in spoken.collect()} == {("upi", 2), ("fresh", 1)}
