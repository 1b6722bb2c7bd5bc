"""Documents of statements."""

import json

from tarazu.sinks import payload


def test_documents_hold_every_table(spark):
    totals = spark.createDataFrame([("a", 1, None), ('q"\\', 2, "x")], "statement_id string, opening long, note string")
    rows = spark.createDataFrame([("a", 10, "z"), ("a", -3, "y"), ("a", None, "n"), ("b", 2, 'say "hi"\n')], "statement_id string, seq long, text string")
    none = spark.createDataFrame([], "statement_id string, k int")
    out = {r["statement_id"]: json.loads(r["payload"]) for r in payload.payloads({"totals": totals}, {"rows": (rows, ["seq"]), "none": (none, ["k"])}).collect()}
    assert out["a"] == {"statement_id": "a", "totals": {"opening": 1, "note": None}, "rows": [{"seq": None, "text": "n"}, {"seq": -3, "text": "y"}, {"seq": 10, "text": "z"}], "none": []}
    assert out["b"] == {"statement_id": "b", "totals": None, "rows": [{"seq": 2, "text": 'say "hi"\n'}], "none": []}
    assert out['q"\\'] == {"statement_id": 'q"\\', "totals": {"opening": 2, "note": "x"}, "rows": [], "none": []}
