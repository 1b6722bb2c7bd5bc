"""Tables on pages: drawn rules, headings, white space, and what is refused."""


from tarazu.session import shuffled
from tarazu.sources import cards, load, tables, words

WORDS = "statement_id string, page int, top double, x0 double, x1 double, text string"
RULES = "statement_id string, page int, x0 double, y0 double, x1 double, y1 double"
HEADER = ("Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance")
LEFTS = (10, 80, 220, 320, 420, 540)
LEDGER = [("01-Jan-2024", "UPI SWIGGY ORDER", "100.00", "", "900.00"), ("02-Jan-2024", "SALARY ACME", "", "5,000.00", "5,900.00"), ("03-Jan-2024", "RENT", "2,000.00", "", "3,900.00")]


def put(sid, page, top, x, text):
    out = []
    for w in text.split():
        out.append((sid, page, float(top), float(x), x + 4.0 * len(w), w))
        x += 4.0 * len(w) + 2
    return out


def box(sid, page, lefts, tops):
    """The rules of a grid, each line in two pieces that overlap a little or lie a little off."""
    out = [(sid, page, float(lefts[0]), float(y), float(lefts[2]) + 1, y + 0.5) for y in tops] + [(sid, page, float(lefts[-1]), float(y), float(lefts[2]) - 1, float(y)) for y in tops]
    out += [(sid, page, float(x), float(tops[0]), x + 0.4, float(tops[2])) for x in lefts] + [(sid, page, float(x), float(tops[2]) + 1, float(x), float(tops[-1])) for x in lefts]
    return out


def drawn(sid="r"):
    words, rules = put(sid, 1, 20, 10, "HDFC Bank statement"), []
    tops = [100, 120, 150, 180]
    rules += box(sid, 1, LEFTS, tops)
    for k, name in enumerate(HEADER):
        words += put(sid, 1, 105, LEFTS[k] + 3, name)
    for row, top in zip(LEDGER[:2], tops[1:], strict=False):
        for k, text in enumerate(row):
            if k == 1 and " " in text:  # a cell's text on two lines
                words += put(sid, 1, top + 4, LEFTS[k] + 3, text.split()[0]) + put(sid, 1, top + 15, LEFTS[k] + 3, " ".join(text.split()[1:]))
            else:
                words += put(sid, 1, top + 4, LEFTS[k] + 3, text)
    rules += box(sid, 2, LEFTS, [50, 70, 90])
    for k, name in enumerate(HEADER):
        words += put(sid, 2, 55, LEFTS[k] + 3, name) + put(sid, 2, 75, LEFTS[k] + 3, LEDGER[2][k])
    return words, rules


def test_a_drawn_table_gives_its_cells(spark):
    words, rules = drawn()
    rules += [("r", 1, 0.0, 0.0, 50.0, 40.0), ("r", 1, 5.0, 5.0, 5.0, 5.0)]  # a slanted line and a dot
    rows = tables.numbered(tables.ruled_rows(spark.createDataFrame(words, WORDS).repartition(3), spark.createDataFrame(rules, RULES).repartition(2)))
    assert [tuple(r["cells"]) for r in rows.orderBy("number").collect()] == [("HDFC Bank statement",), HEADER, *LEDGER]


def test_cells_that_span_columns_and_rows(spark):
    """A title over all columns, a foot over two, and a left cell over two rows."""
    across = [(0, 0, 90), (20, 0, 90), (40, 30, 90), (60, 0, 90), (80, 0, 90)]
    upright = [(0, 0, 80), (30, 20, 80), (60, 20, 60), (90, 0, 80)]
    rules = [("s", 1, float(a), float(y), float(b), float(y)) for y, a, b in across] + [("s", 1, float(x), float(a), float(x), float(b)) for x, a, b in upright]
    found = tables.ruled_cells(tables.crossings(tables.merged_rules(spark.createDataFrame(rules, RULES))))
    cells = {(r["x0"], r["y0"], r["x1"], r["y1"]) for r in found.collect()}
    assert cells == {(0, 0, 90, 20), (0, 20, 30, 60), (30, 20, 60, 40), (60, 20, 90, 40), (30, 40, 60, 60), (60, 40, 90, 60), (0, 60, 30, 80), (30, 60, 90, 80)}


def test_tables_beside_and_below_one_another_keep_their_columns(spark):
    rules, words = [], []
    for n, (x, y) in enumerate([(0, 0), (200, 0), (0, 100)]):
        rules += [("s", 1, x + a, y + 0.0, x + a, y + 40.0) for a in (0.0, 50.0, 100.0)] + [("s", 1, x + 0.0, y + b, x + 100.0, y + b) for b in (0.0, 20.0, 40.0)]
        for k in range(4):
            words += put("s", 1, y + 5 + 20 * (k // 2), x + 5 + 50 * (k % 2), f"t{n}c{k}")
    out = tables.ruled_rows(spark.createDataFrame(words, WORDS), spark.createDataFrame(rules, RULES)).orderBy("table", "top").collect()
    assert [(r["table"], r["cells"]) for r in out] == [(n + 1, [f"t{m}c{k}", f"t{m}c{k + 1}"]) for n, m in enumerate((0, 1, 2)) for k in (0, 2)]


def spaced(sid="w"):
    """Headings with wide gaps inside, as wide as those between columns, and no balance column: labels can't read them."""
    lefts, words = (10, 100, 260, 380), put(sid, 1, 20, 10, "ICICI Bank")
    heads = (("Date",), ("Description",), ("Paid", "Out"), ("Paid", "In"))
    for x, parts in zip(lefts, heads, strict=True):
        for p in parts:
            words += put(sid, 1, 50, x, p)
            x += 4 * len(p) + 14
    words += put(sid, 1, 61, 100, "Opening Balance") + put(sid, 1, 61, 260, "1,000.00")
    for k, (day, text, out, into, _) in enumerate(LEDGER):
        for x, cell in zip(lefts, (day, text, out, into), strict=True):
            words += put(sid, 1, 72 + 11 * k, x, cell)
    return words + put(sid, 1, 105, 100, "Closing Balance") + put(sid, 1, 105, 380, "3,900.00")


def test_gutters_recover_what_headings_cannot(spark):
    grid = tables.numbered(tables.spaced_rows(spark.createDataFrame(spaced(), WORDS).repartition(2)))
    rows = [tuple(r["cells"]) for r in grid.orderBy("number").collect()]
    assert ("Date", "Description", "Paid Out", "Paid In") in rows and ("02-Jan-2024", "SALARY ACME", "", "5,000.00") in rows


def test_three_ways_in_order_and_refusals(spark):
    words, rules = drawn()
    printed = [w for k, name in enumerate(HEADER) for w in put("p", 1, 50, LEFTS[k], name)]
    for n, row in enumerate(LEDGER):
        printed += [w for k, text in enumerate(row) for w in put("p", 1, 61 + 11 * n, LEFTS[k], text)]
    letter = put("l", 1, 72, 72, "Dear customer, thank you for banking with us.")
    # rules that make no table leave a file to the other ways
    framed = [("f" if w[0] == "p" else w[0], *w[1:]) for w in printed]
    rules += [("f", 1, 5.0, 45.0, 545.0, 45.0), ("f", 1, 5.0, 58.0, 545.0, 58.0)]
    files = spark.createDataFrame([(x,) for x in "rpwlfs"], "statement_id string")
    grid, rejects = tables.recovered(files, spark.createDataFrame(words + printed + letter + framed + spaced(), WORDS).repartition(4), spark.createDataFrame(rules, RULES))
    assert {(r["statement_id"], r["how"]) for r in grid.collect()} == {("r", "ruled"), ("p", "headings"), ("f", "headings"), ("w", "spaces")}
    assert {r["statement_id"]: r["reason"] for r in rejects.collect()} == {"l": tables.NO_TABLE, "s": tables.NO_TEXT}
    found = load.from_grid(grid.drop("how"), rejects)
    assert {r["statement_id"]: (r["opening"], r["closing"]) for r in found.banks.collect()} == {"r": (100_000, 390_000), "p": (100_000, 390_000), "f": (100_000, 390_000), "w": (100_000, 390_000)}
    ledger = {s: sorted((r["seq"], str(r["date"]), r["narration"], r["direction"], r["amount"]) for r in found.transactions.collect() if r["statement_id"] == s) for s in "rpwf"}
    assert ledger["r"] == ledger["p"] == ledger["w"] == ledger["f"] and len(ledger["r"]) == 3
    assert {r["statement_id"] for r in found.rejects.collect()} == {"l", "s"}


def test_no_files_give_no_rows(spark):
    empty = lambda s: spark.createDataFrame([], s)
    grid, rejects = tables.recovered(empty("statement_id string"), empty(WORDS), empty(RULES))
    assert grid.count() == 0 and rejects.count() == 0


def test_a_card_box_on_a_page_overrides_the_grid(spark):
    """Two labels side by side with figures below: cells pair them wrongly, places don't; what places don't give stays the grid's."""
    page = put("c", 1, 10, 10, "ICICI credit card") + put("c", 1, 30, 10, "Total Dues") + put("c", 1, 30, 200, "Minimum Due") + put("c", 1, 45, 205, "150.00") + put("c", 1, 45, 12, "1,150.00") + put("c", 1, 30, 330, "Payment Due Date") + put("c", 1, 45, 335, "15-Feb-2024")
    words_ = spark.createDataFrame(page, WORDS).repartition(2)
    grid = [["ICICI credit card"], ["Total Dues", "9.00"], ["Previous Balance", "1000.00"], ["Date", "Details", "Amount (INR)"], ["05-Jan-2024", "POS ZOMATO", "250.00"]]
    table = spark.createDataFrame([("c", k, row) for k, row in enumerate(grid, 1)], "statement_id string, number int, cells array<string>")
    labelled = words.labelled_values(words_, cards.box_patterns())
    plain, placed = (load.from_grid(table, labelled=x).cards.first() for x in (None, labelled))
    assert (plain["total_due"], plain["minimum_due"], plain["due_date"], plain["previous_balance"]) == (900, None, None, 100_000)
    assert (placed["total_due"], placed["minimum_due"], str(placed["due_date"]), placed["previous_balance"]) == (115_000, 15_000, "2024-02-15", 100_000)


def test_joins_of_recovered_rows_shuffle(spark):
    """Repeated values make small files of many rows, which a broadcast would gather in the driver."""
    points = shuffled(spark.createDataFrame([("a", 1, h, v, 10.0 * v, 10.0 * h) for h in range(1, 4) for v in range(4, 8)], "statement_id string, page int, h int, v int, x double, y double"), "points")
    found = tables.ruled_cells(points)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 6
