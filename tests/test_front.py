"""The segmenter, questions, JSON queries, workbooks, loading of mixed files, cards."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from tarazu.functions import segments
from tarazu.plans import ledger as labels, question
from tarazu.plans.query import Period, Query
from tarazu.sinks import export
from tarazu.sources import load, statements, workbook

DAY = date(2024, 3, 20)


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        ("a", 1, date(2024, 1, 5), "Swiggy", "food", "debit", 10_000, False),
        ("a", 2, date(2024, 3, 7), "Swiggy Instamart", "groceries", "debit", 5_000, False),
        ("a", 3, DAY, "Acme", "salary", "credit", 900_000, False),
        ("b", 1, date(2024, 2, 9), "(no narration)", "uncategorised", "debit", 100, True),
    ]
    df = spark.createDataFrame(rows, "statement_id string, seq long, date date, name string, category string, direction string, amount long, on_card boolean").withColumn("row", F.col("seq"))
    return df.cache()


#: The words that the tests know from the start, commonest first.
KNOWN = "the and pay india bank card cash bill shop store mart gold air airlines airways business class fare cab cabs auto designs instamart fresh dairy milk salary credit acme technologies".split() + segments.brand_words()


def cut(spark, *texts):
    seed = segments.known(spark, KNOWN)
    names = spark.createDataFrame([("s", t) for t in texts], "statement_id string, text string")
    none = spark.createDataFrame([], "statement_id string, word string, cost double")
    return {r["text"]: r["words"] for r in segments.segmented(names, none, seed).collect()}


def test_welded_names_are_cut_or_left_whole(spark):
    out = cut(spark, "SWIGGYINSTAMART", "MYNTRADESIGNS", "NETFLIXINDIA", "SwiggyInstamart", "ZOMATO", "QWXZPLKJHGFD", "SALARY CREDIT ACME", "technologies", "", "12345678")
    assert out["SWIGGYINSTAMART"] == ["swiggy", "instamart"] and out["MYNTRADESIGNS"] == ["myntra", "designs"] and out["NETFLIXINDIA"] == ["netflix", "india"]
    assert out["SwiggyInstamart"] == ["Swiggy", "Instamart"] and out["ZOMATO"] == ["ZOMATO"] and out["QWXZPLKJHGFD"] == ["QWXZPLKJHGFD"]
    assert out["SALARY CREDIT ACME"] == ["SALARY", "CREDIT", "ACME"] and out["technologies"] == ["technologies"] and out[""] == [] and out["12345678"] == ["12345678"]


def brute_cover(run, costs):
    best = {0: (0.0, [])}
    for end in range(1, len(run) + 1):
        for start in range(end):
            if start in best and run[start:end] in costs and (end not in best or best[start][0] + costs[run[start:end]] < best[end][0]):
                best[end] = best[start][0] + costs[run[start:end]], [*best[start][1], run[start:end]]
    return best.get(len(run), (0, [run]))[1]


def test_covers_are_the_cheapest(spark):
    costs = {r["word"]: r["cost"] for r in segments.known(spark, KNOWN).collect()}
    runs = ["freshdairymilkstore", "cashcardbank", "theandpaybill", "airlinesairways", "goldshopmart", "businessclassfare", "cabscabsauto"]
    out = cut(spark, *runs)
    assert {x: out[x] for x in runs} == {x: brute_cover(x, costs) for x in runs}


def test_words_are_learnt_in_order_and_long_ones_are_not(spark):
    rows = spark.createDataFrame([("s", 2, "blue moon traders"), ("s", 1, "moon SWIGGYINSTAMART bank"), ("t", 1, "other words")], "statement_id string, seq long, narration string")
    seed = segments.known(spark, KNOWN)
    out = {(r["statement_id"], r["word"]): r["cost"] for r in segments.learnt(rows, seed).collect()}
    assert set(out) == {("s", "moon"), ("s", "blue"), ("s", "traders"), ("t", "other"), ("t", "words")}
    assert out["s", "moon"] < out["s", "blue"] < out["s", "traders"]
    ratio = segments.weld_ratio(rows, segments.learnt(rows, seed), seed).filter("statement_id = 's'").first()
    assert (ratio["tokens"], ratio["welded"]) == (6, 1)


def test_words_of_several_statements_are_known_to_all(spark):
    rows = [("s", 1, "blue moon traders"), ("t", 1, "moon blue"), ("t", 2, "moon moon"), ("u", 1, "MOON alone"), ("u", 2, None), ("u", 3, "SWIGGYINSTAMARTS moontrip")]
    seed = segments.vocabulary(spark.createDataFrame(rows, "statement_id string, seq long, narration string"))
    costs = {r["word"]: r["cost"] for r in seed.collect()}
    assert {"blue", "moon", "swiggy"} <= set(costs) and not {"traders", "alone", "moontrip", "swiggyinstamarts"} & set(costs) and costs["moon"] < costs["blue"]


def test_periods(spark):
    def of(text, as_of=DAY):
        row = spark.createDataFrame([(text,)], "text string").select(question.period(F.col("text"), F.lit(as_of).cast("date")).alias("p")).select("p.start", "p.end", question.label(F.col("p.start"), F.col("p.end")).alias("label")).first()
        return Period(*row) if row["start"] else None

    assert of("spend in march") == Period(date(2024, 3, 1), date(2024, 3, 31), "March 2024")
    assert of("how much may i have spent") is None and of("in may").start == date(2024, 5, 1) and of("may 2023").end == date(2023, 5, 31)
    assert of("january to march") == Period(date(2024, 1, 1), date(2024, 3, 31), "January to March 2024")
    assert of("last month").label == "February 2024" and of("last month", date(2024, 1, 9)).label == "December 2023"
    assert of("this month").label == "March 2024" and of("in 2022") == Period(date(2022, 1, 1), date(2022, 12, 31), "2022") and of("ever") is None and of("in march", None) is None
    assert of("march to January").label == "January 2024" and of("from March to January").end == date(2024, 1, 31) and of("by AUG 2021").label == "August 2021" and of("marching in") is None


def test_questions(ledger):
    q = lambda t: question.parse(t, ledger)
    assert q("How much did I spend on food in January?") == Query("total", category="food", period=Period(date(2024, 1, 1), date(2024, 1, 31), "January 2024"), direction="debit")
    assert q("how often did I order from swiggy instamart") == Query("count", merchant="Swiggy Instamart", direction="debit")
    assert q("what did I pay on my card").on_card is True and q("how much income did I get").direction == "credit"
    assert q("was I charged twice?") == Query("duplicates") and q("my subscriptions") == Query("recurring") and q("did swiggy refund me").merchant == "Swiggy Instamart"
    assert q("what is the weather") is None
    assert question.ask("how much did I spend at Tesco", ledger).refused == ("tesco",)
    answer = question.ask("how much did I spend on food", ledger)
    assert (answer.amount, answer.n, answer.evidence.count()) == (10_000, 1, 1)
    assert not question.ask("tell me a joke", ledger).understood


def test_json_queries(ledger):
    of = lambda x: question.from_json(x if isinstance(x, str) else json.dumps(x), ledger)
    fenced = '```json\n{"intent": "total", "category": "food", "on_card": false}\n```'
    assert of(fenced) == (Query("total", category="food", direction="debit"), None)
    assert of({"intent": "recurring", "direction": "in"}) == (Query("recurring"), None)
    assert of({"intent": "count", "period": {"start": "2024-01-01", "end": "2024-01-31"}})[0].period.label == "2024-01-01 to 2024-01-31"
    for bad in ("no object", {"intent": None, "reason": "unsure"}, {"intent": "sum"}, {"intent": "total", "merchant": "Tesco"}, {"intent": "total", "direction": "up"}, {"intent": "total", "period": "x"}, {"intent": "total", "period": {"start": "2024-02-01", "end": "2024-01-01"}}):
        query, reason = of(bad)
        assert query is None and reason


BANK = 'HDFC Bank\nAccount No: 123456789012\nDate,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n03-Jan-2024,"UPI/SWIGGYINSTAMART/x@icici",100.00,,900.00\n04-Jan-2024,SALARY CREDIT ACME,,50.00,950.00\n'
CARD = "ICICI credit card\nTotal Dues,,1,150.00\n".replace("1,150", '"1,150') .replace("150.00\n", '150.00"\n') + 'Previous Balance,1000.00\nPayments / Credits,100.00\nPurchases / Debits,250.00\nDate,Details,Amount (INR)\n05-Jan-2024,POS ZOMATO,250.00\n06-Jan-2024,PAYMENT,+100.00\n,foot,\n'


def test_mixed_files_are_told_apart_and_bad_ones_counted(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "bank.csv").write_text(BANK)
    (tmp_path / "deep" / "card.csv").write_text(CARD)
    rows = [line.split(",") for line in BANK.replace('"', "").splitlines()]
    (tmp_path / "book.xlsx").write_bytes(workbook.book([[float(x) if x.replace(".", "").isdigit() and "." in x else x for x in r] for r in rows]))
    (tmp_path / "old.xls").write_bytes(statements.OLE2 + b"x")
    (tmp_path / "latin.csv").write_bytes(b"Date,\xff\xe9")
    (tmp_path / "big.csv").write_text("Date," + "x" * 200_000)
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04nothing")
    (tmp_path / "own.txt").write_text("OWN")
    own = (lambda content, path: content == b"OWN", lambda content, path: [["Date", "Narration", "Amount", "Balance"], ["01-Jan-2024", "x", "5.00", "15.00"]])
    found = load.load(spark, [str(tmp_path), str(tmp_path / "deep")], formats=(own,))
    name = lambda r: r["statement_id"].rpartition("/")[2]
    banks, cards, rejects = ({name(r): r for r in df.collect()} for df in (found.banks, found.cards, found.rejects))
    assert set(banks) == {"bank.csv", "book.xlsx", "own.txt"} and set(cards) == {"card.csv"}
    assert set(rejects) == {"old.xls", "latin.csv", "big.csv", "locked.pdf", "broken.xlsx"} and rejects["locked.pdf"]["reason"] == "needs_password" and rejects["big.csv"]["reason"] == "no header row"
    assert (banks["book.xlsx"]["opening"], banks["book.xlsx"]["closing"]) == (banks["bank.csv"]["opening"], banks["bank.csv"]["closing"]) == (100_000, 95_000)
    card = cards["card.csv"]
    assert (card["total_due"], card["previous_balance"], card["payments"], card["purchases"], card["issuer"]) == (115_000, 100_000, 10_000, 25_000, "ICICI")
    rows = {(name(r), r["seq"]): r for r in found.transactions.collect()}
    assert [(rows["card.csv", k]["direction"], rows["card.csv", k]["amount"]) for k in (1, 2)] == [("debit", 25_000), ("credit", 10_000)]
    labelled = {(name(r), r["seq"]): r for r in labels.labelled(found.transactions).collect()}
    assert labelled["bank.csv", 1]["name"] == "Swiggy Instamart" and labelled["card.csv", 1]["name"] == "Pos Zomato"
    digest = {name(r): r["digest"] for r in statements.digests(spark, str(tmp_path)).collect()}
    import hashlib

    assert digest["bank.csv"] == hashlib.sha256(BANK.encode()).hexdigest()


def test_workbooks_round_trip_and_dates():
    rows = [["Date", "n"], [], ["x & <y>", 12.5], [None, "z"]]
    assert workbook.grid(workbook.book(rows)) == [["Date", "n"], [], ["x & <y>", "12.5"], ["", "z"]]
    with pytest.raises(workbook.Unreadable):
        workbook.grid(b"PK\x03\x04")


def test_the_first_sheet_with_a_header_is_read(tmp_path):
    """Sheets lie in the workbook's order; truth values and times of day are empty, dates lose their times."""
    row = lambda *cells: "<row>" + "".join(cells) + "</row>"
    text = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    cover = row(text("Cover"), '<c t="b"><v>1</v></c>')
    ledger = row(*map(text, ("Txn Date:", "Details", "Amount (INR)", "Balance"))) + row('<c s="1"><v>45292.75</v></c>', '<c s="1"><v>0.5</v></c>', '<c s="2"><v>12.5000000001</v></c>', '<c t="d"><v>2024-01-02T10:00:00</v></c>')
    styles = f'<styleSheet xmlns="{workbook.MAIN}"><numFmts><numFmt numFmtId="170" formatCode="[Red]0.00&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    frame = workbook.frame(["Ledger", "Cover"])
    frame["xl/_rels/workbook.xml.rels"] = frame["xl/_rels/workbook.xml.rels"].replace("sheet1.xml", "sheetX.xml").replace("sheet2.xml", "sheet1.xml").replace("sheetX.xml", "sheet2.xml")
    out = workbook.io.BytesIO()
    with workbook.zipfile.ZipFile(out, "w") as book:
        for name, part in (frame | {"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": workbook.SHEET_HEAD + cover + workbook.SHEET_FOOT, "xl/worksheets/sheet2.xml": workbook.SHEET_HEAD + ledger + workbook.SHEET_FOOT}).items():
            book.writestr(name, part)
    found = list(workbook.sheets(out.getvalue()))
    assert found == [[["Txn Date:", "Details", "Amount (INR)", "Balance"], ["2024-01-01", "", "12.50", "2024-01-02"]], [["Cover", ""]]]
    assert statements.cut(out.getvalue(), "x.xlsx") == found[0] and statements.names_money(found[0][0]) and not statements.names_money(["Date", "Debit"])


def test_export_has_all_columns(spark, ledger):
    rows = ledger.withColumns({"value_date": F.lit(None).cast("date"), "narration": F.lit("n"), "kind": F.lit("merchant"), "balance": F.lit(None).cast("long")})
    books = spark.createDataFrame([("a", "HDFC", "XX12"), ("b", "ICICI", "")], "statement_id string, institution string, account_hint string")
    proved = spark.createDataFrame([("a", True), ("b", False)], "statement_id string, reconciled boolean")
    out = export.ledger_rows(rows, books, proved)
    assert tuple(out.columns) == export.COLUMNS
    first = out.filter("merchant = 'Swiggy'").first()
    assert (str(first["debit"]), first["credit"], first["institution"], first["reconciled"]) == ("100.00", None, "HDFC", "yes")
    assert workbook.grid(export.xlsx_bytes(out))[0] == list(export.COLUMNS)
