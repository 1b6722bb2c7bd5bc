"""Words with their places on pages, as rows."""

from tarazu.sources import load, words

WORDS = "statement_id string, page int, top double, x0 double, x1 double, text string, fontname string"
COLUMNS = (("Date", 10), ("Narration", 60), ("Withdrawal Amt.", 200), ("Deposit Amt.", 300), ("Closing Balance", 400))


def line(top, *cells, page=1, font=None):
    """Words of 6 points a letter and a gap of 2, from the given starts."""
    out = []
    for x, text in cells:
        for w in text.split():
            out.append(("s", page, float(top), float(x), x + 4.0 * len(w), w, font))
            x += 4.0 * len(w) + 2
    return out


def frame(spark, *rows):
    return spark.createDataFrame([w for r in rows for w in r], WORDS).repartition(3)


def header(top, page=1):
    return line(top, *((x, t) for t, x in COLUMNS), page=page)


def test_words_of_a_line_are_level_with_its_first(spark):
    rows = [("s", 1, t, x, x + 5, n, f) for t, x, n, f in ((100.0, 10.0, "a", None), (102.9, 20.0, "b", None), (103.5, 30.0, "c", None), (104.0, 1.0, "C", "ITFRupee"))]
    out = words.lines(spark.createDataFrame(rows, WORDS)).collect()
    assert {r["text"]: r["line"] for r in out} == {"a": 0, "b": 0, "c": 1, "₹": 1}


def test_labels_and_columns(spark):
    df = frame(spark, header(50))
    out = words.labels(words.lines(df)).first()
    assert [x["text"] for x in out["labels"]] == [t for t, _ in COLUMNS]
    columns = words.page_columns(words.labels(words.lines(df))).first()
    assert columns["fields"] == {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4}
    edges = columns["edges"]
    assert edges[0]["left"] == float("-inf") and edges[4]["right"] == float("inf") and all(a["right"] == b["left"] for a, b in zip(edges, edges[1:]))
    assert edges[1]["left"] == (26 + 60) / 2


def test_rows_wrap_break_and_span_pages(spark):
    df = frame(
        spark,
        line(20, (10, "HDFC Bank")),
        header(50),
        line(61, (60, "Name of the holder")),
        line(72, (10, "03-Jan-2024"), (60, "UPI SWIGGY"), (400, "900.00")),
        line(83, (60, "more text"), (205, "100.00")),
        line(94, (10, "04-Jan-2024"), (60, "SALARY"), (305, "50.00"), (400, "950.00")),
        line(105, (60, "of January")),
        line(130, (10, "Closing balance includes funds earmarked")),
        line(141, (60, "for hold")),
        header(50, page=2),
        line(61, (10, "05-Jan-2024"), (60, "ATM"), (205, "50.00"), (400, "900.00"), page=2),
        line(72, (10, "Closing Balance"), (400, "900.00"), page=2),
    )
    found = load.from_grid(words.grid(df))
    rows = [(r["narration"], r["direction"], r["amount"], r["balance"]) for r in found.transactions.orderBy("seq").collect()]
    assert rows == [("UPI SWIGGY more text", "debit", 10_000, 90_000), ("SALARY of January", "credit", 5_000, 95_000), ("ATM", "debit", 5_000, 90_000)]
    bank = found.banks.first()
    assert (bank["bank"], bank["opening"], bank["closing"], bank["closing_source"]) == ("HDFC", 100_000, 90_000, "explicit")


def test_values_below_labels(spark):
    df = frame(
        spark,
        line(100, (10, "TOTAL DUES"), (120, "PAYMENTS/CREDITS"), (250, "Due Date")),
        line(110, (120, "RECEIVED")),
        line(120, (12, "1,500.00"), (105, "+"), (122, "200.00"), (250, "05/02/2024")),
        line(300, (10, "TOTAL DUES")),
        line(310, (10, "9.00")),
        line(400, (10, "Minimum dues")),
        line(450, (10, "7.00")),
    )
    out = {r["field"]: r["value"] for r in words.labelled_values(df, {"total": "total dues", "payments": "payments", "due": "due date", "minimum": "minimum"}).collect()}
    assert out == {"total": "1,500.00", "payments": "200.00", "due": "05/02/2024"}
