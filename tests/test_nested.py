"""Nested replies and usage records with odd input."""

from __future__ import annotations

from attesta.operators import assemble, reports


def test_trace_of_odd_replies(spark):
    replies = spark.createDataFrame(
        [("none", None, "T", 0), ("bad", "{oops", None, 1), ("list", "[1]", "T", 1),
         ("some", '{"children": [7, null, {"claim_ids": ["C1", "C1"], "evidence": ["C2"], "children": "x"}]}', "T", 1)],
        "paper_id string, body string, title string, n_spans int")
    claims = spark.createDataFrame(
        [("some", 0, "C1", "t"), ("some", 1, "C2", "u"), ("bad", 0, "C1", "t"), ("unasked", 0, "C1", "t")],
        "paper_id string, pos int, claim_id string, topic string")
    rows = {(r.paper_id, r.node_id): (r.support_level, r.summary, r.claim_ids) for r in assemble.nested_trace(replies, claims).collect()}
    assert rows == {
        ("none", "Q0"): ("inferred", "What does the paper 'T' establish?", []),
        ("bad", "Q0"): ("explicit", "What does the paper 'None' establish?", []), ("bad", "R1"): ("explicit", "Results on t", ["C1"]),
        ("list", "Q0"): ("explicit", "What does the paper 'T' establish?", []),
        ("some", "Q0"): ("explicit", "What does the paper 'T' establish?", []),
        ("some", "Q1"): ("inferred", "Not available from provided input", ["C1", "C1"]), ("some", "R2"): ("explicit", "Results on u", ["C2"])}


def test_usage_of_odd_records(spark):
    bodies = [None, "", "{oops", "[]", '{"usage": null}', '{"usage": {"prompt_tokens": null, "input_tokens": 3}, "cost": "4"}',
              '{"response": null, "_hidden_params": {"response_cost": 0.5}}']
    records = spark.createDataFrame(list(enumerate(bodies)), "record_id int, body string")
    rows = {r.record_id: (r.prompt_tokens, r.cost_usd, r.cost_kind) for r in reports.record_usage(records).collect()}
    assert rows == {5: (3, None, "unavailable"), 6: (None, 0.5, "estimated")}
