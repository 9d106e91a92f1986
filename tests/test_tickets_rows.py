"""Issues become tickets where they are: one row a document, no shuffle."""

import json

from verdictlake.sources import tickets


def issue(key, **fields):
    return json.dumps({"key": key, "names": {"f1": "Acceptance Criteria"}, "fields": fields})


def test_repeated_documents_stay_and_nothing_is_shuffled(spark):
    doc = {"type": "doc", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}
    rows = [
        (issue("A", summary="s", description=doc, f1="Given x"), 1),
        (issue("A", summary="s", description=doc, f1="Given x"), 2),
        (issue("A", summary="other"), 3),
        ("{broken", 4),
        (None, 5),
        (json.dumps({"key": "B"}), 6),
        (issue("C", f1=["x", doc], description=None), 7),
    ]
    found = tickets.tickets(spark.createDataFrame(rows, "value string, i long"), "i")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.i: (r.ticket_id, r.summary, r.description, r.acceptance_criteria) for r in found.collect()}
    assert got == {1: ("A", "s", "a b", "Given x"), 2: ("A", "s", "a b", "Given x"), 3: ("A", "other", "", "other"), 6: ("B", "", "", ""), 7: ("C", "", "", "x\na b")}
