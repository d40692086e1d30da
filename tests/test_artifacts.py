"""The schema walk and the references of artifacts, on odd input."""

from __future__ import annotations

import json

import pytest

from attesta.operators import artifact_links, audit, schema_check
from attesta.plans.artifact_queries import SOUND

SHAPE = "paper_id string, body string"


def nested(depth: int) -> dict:
    node = {"node_id": f"R{depth}", "node_type": "result", "summary": 5}
    for i in reversed(range(depth)):
        node = {"node_id": f"R{i}", "node_type": "result", "summary": "s", "evidence": ["C1", "C7", "C7"], "children": [node]}
    return node


@pytest.fixture(scope="module")
def bodies(spark):
    deep = json.loads(SOUND) | {"trace": nested(14)}
    bare = {k: v for k, v in json.loads(SOUND).items() if k != "metadata"}
    rows = [("sound", SOUND), ("none", None), ("empty", ""), ("list", "[1]"), ("bad", "{oops"), ("nothing", "{}"),
            ("deep", json.dumps(deep)), ("bare", json.dumps(bare)),
            ("odd", '{"paper": {"paper_id": "p", "year": true, "authors": null, "title.x": 3}, "logic": {"claims": [null, 7, {}]},'
                    ' "evidence": {}, "trace": {"node_id": "n", "node_type": "t", "summary": "s", "children": [], "support_level": null},'
                    ' "src": [], "metadata": {}}')]
    return spark.createDataFrame(rows, SHAPE)


def test_violations(bodies):
    found = {}
    for r in schema_check.schema_violations(bodies).collect():
        found.setdefault(r.paper_id, set()).add((r.path, r.fault, r.expected, r.found))
    assert set(found) == {"nothing", "deep", "odd"}
    assert {(p, f) for p, f, *_ in found["nothing"]} == {(f"$.{k}", "missing") for k in ("paper", "logic", "evidence", "trace", "src")}
    assert found["deep"] == {("$.trace" + ".children[0]" * 14 + ".summary", "type", "string", "integer")}
    assert found["odd"] == {
        ("$.paper.authors", "type", "list of string", "null"), ("$.logic.claims[0]", "type", "Claim", "null"),
        ("$.logic.claims[1]", "type", "Claim", "integer"), ("$.trace.support_level", "enum", "one", "null"),
        ("$.src", "type", "SrcLayer", "array"),
        *((f"$.logic.claims[2].{k}", "missing", "string", "missing")
          for k in ("claim_id", "statement", "conditions", "status", "falsification_criteria"))}


def test_outcome_and_retry(spark, bodies):
    rows = {r.paper_id: (r.n_violations, r.no_layer, r.severity, r.usable) for r in schema_check.schema_outcome(bodies).collect()}
    assert rows == {"sound": (0, False, None, True), "nothing": (5, True, "blocker", False), "deep": (1, False, "critical", False),
                    "bare": (0, True, None, True), "odd": (10, False, "critical", False)}
    strict = {"Top": {"version": "required string", "notes": "list of integer"}}
    raw = spark.createDataFrame([("a", "{}"), ("b", '{"notes": [1, "2", "x"], "version": "1"}'), ("c", '{"version": "1"}')], SHAPE)
    rows = {r.paper_id: (r.n_violations, r.usable)
            for r in schema_check.schema_outcome(raw, strict, "Top", layers=(), defaults=("version",)).collect()}
    assert rows == {"a": (1, True), "b": (1, False), "c": (0, True)}
    assert [(r.paper_id, r.severity) for r in schema_check.schema_findings(raw, schema=strict, root="Top", layers=()).orderBy("paper_id").collect()] == [
        ("a", "critical"), ("b", "critical")]


def test_schema_must_name_its_kinds():
    with pytest.raises(ValueError):
        schema_check.rules_of({"Top": {"a": "required Thing"}})


def test_links_at_any_depth(bodies):
    targets = artifact_links.artifact_targets(bodies)
    assert targets.where("paper_id = 'deep' AND target_type = 'trace_node'").count() == 15
    gone = [(r.paper_id, r.target_type, r.detail) for r in artifact_links.artifact_unresolved(targets).collect()]
    assert sorted(set(gone)) == [("deep", "trace_node", "evidence:C7")] and len(gone) == 28
    assert artifact_links.artifact_duplicates(targets).count() == 0


def test_no_artifacts(spark):
    none = spark.createDataFrame([], SHAPE)
    assert schema_check.schema_outcome(none).count() == 0 and schema_check.schema_violations(none).count() == 0
    assert artifact_links.artifact_unresolved(artifact_links.artifact_targets(none)).count() == 0


def test_report_details_of_odd_findings(spark):
    papers = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", None)], "paper_id string, has_artifact boolean")
    findings = spark.createDataFrame(
        [("a", "rigor", 1, "C1", "x", "major"), ("a", "local", 0, "C1", "y", "odd"), ("a", "structural", 3, None, "z", None),
         ("a", "structural", 2, "C2", "z", "major"), ("c", "rigor", 1, "C1", "x", "major")],
        "paper_id string, pass_name string, finding_no long, target_id string, code string, severity string")
    rows = {r.paper_id: r for r in audit.report_details(papers, findings).collect()}
    assert [(f.pass_name, f.finding_no) for f in rows["a"].findings] == [("structural", 2), ("structural", 3), ("rigor", 1), ("local", 0)]
    assert rows["a"].severity_summary["major"] == 2 and sum(rows["a"].severity_summary.values()) == 2
    assert {k: (r.error, len(r.findings)) for k, r in rows.items()} == {
        "a": (None, 4), "b": (None, 0), "c": ("artifact missing", 0), "d": ("artifact missing", 0)}
    assert sum(rows["c"].severity_summary.values()) == 0
