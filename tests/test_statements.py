"""Statement files of several shapes, proved against their own balances."""

import pytest
from tarazu.operators import reconcile
from tarazu.sources import statements

FILES = {
    "pair_hdfc.csv": "Some Bank of HDFC\nAccount No :50100123454471\n\nDate,Narration,Chq./Ref.No.,Value Dt,Withdrawal Amt.,Deposit Amt.,Closing Balance\n,OPENING BALANCE,,,,,\"1,000.00\"\n01/04/25,RENT,1,01/04/25,200.00,,800.00\n*****,,,,,,\n15/04/25,SALARY,2,15/04/25,,\"5,000.50\",\"5,800.50\"\n,FROM WORK,,,,,\n,CLOSING BALANCE,,,,,\"5,800.50\"\n16/04/25,AFTER,3,,1.00,,1.00\n",
    "signed.tsv": "Transaction Date\tTransaction Remarks\tAmount (INR)\tBalance (INR)\n13/05/2025\tTEA\t-20.00\t80.00\n14/05/2025\tPAY\t100.00\t180.00\n",
    "noughts.csv": "XXXXXXXX1234;;;;\nTransaction Date;Remarks;Withdrawals(INR);Deposits(INR);Balance(INR)\n13-05-2025;TEA;20.00;0.00;80.00\n14-05-2025;PAY;0.00;100.00;180.00\nTRANSACTION TOTAL;;20.00;100.00;\n",
    "month.csv": "Date,Description,Debit,Credit,Balance\n03/04/2025,TEA,20.00,,80.00\n03/14/2025,PAY,,100.00,180.00\nStatement Summary,,,,\nOpening Balance,Closing Balance,,,\n100.00,180.00,,,\n",
    "garbled.csv": "Date,Description,Debit,Credit,Balance\n03/04/2025,TEA,2x0,,80.00\n",
    "both.csv": "Date,Description,Debit,Credit,Balance\n03/04/2025,TEA,20.00,5.00,80.00\n",
    "prose.txt": "no table here\n",
    "empty.csv": "Date,Description,Debit,Credit,Balance\n",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("statements")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8-sig")
    return tuple(x.cache() for x in statements.parsed(statements.read_grid(spark, str(folder)).cache()))


def short(path):
    return path.rsplit("/", 1)[1]


def test_statements(found):
    rows = {short(r["statement_id"]): r for r in found[0].collect()}
    brief = {k: (r["bank"], r["account_hint"], r["opening"], r["closing"], r["opening_source"], r["closing_source"], r["stated_debits"], r["stated_credits"], r["date_order"], str(r["period_start"])) for k, r in rows.items()}
    assert brief == {
        "pair_hdfc.csv": ("HDFC", "XXXXXXXXXX4471", 100_000, 580_050, "explicit", "explicit", None, None, "day_first", "2025-04-01"),
        "signed.tsv": ("unknown", "", 10_000, 18_000, "derived", "derived", None, None, "day_first", "2025-05-13"),
        "noughts.csv": ("unknown", "XXXXXXXX1234", 10_000, 18_000, "derived", "derived", 2_000, 10_000, "day_first", "2025-05-13"),
        "month.csv": ("unknown", "", 10_000, 18_000, "explicit", "explicit", None, None, "month_first", "2025-03-04"),
    }


def test_transactions(found):
    rows = sorted((short(r["statement_id"]), r["seq"], r["row"], r["narration"], r["direction"], r["amount"], r["balance"]) for r in found[1].collect())
    assert rows[3:5] == [("noughts.csv", 2, 4, "PAY", "credit", 10_000, 18_000), ("pair_hdfc.csv", 1, 6, "RENT", "debit", 20_000, 80_000)]
    assert rows[5] == ("pair_hdfc.csv", 2, 8, "SALARY FROM WORK", "credit", 500_050, 580_050) and len(rows) == 8


def test_rejects(found):
    assert {short(r["statement_id"]): r["reason"] for r in found[2].collect()} == {"garbled.csv": "row 2 can't be read", "both.csv": "row 2 can't be read", "prose.txt": "no header row", "empty.csv": "no transaction rows under the header"}


def test_ledgers_are_proved(found):
    assert all(r["ok"] for r in reconcile.verdicts(found[1], found[0]).collect())
