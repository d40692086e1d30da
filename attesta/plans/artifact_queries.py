"""Audits of whole artifacts: the schema document, ids and references at any depth (AUD-3, AUD-4, AUD-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.operators import artifact_links, schema_check
from attesta.plans.registry import query
from attesta.plans.tables import spread

# A sound artifact; @ stands for the document's number, % for its language.
SOUND = (
    '{"ara_version": "1.0", "paper": {"paper_id": "@", "title": "On @", "authors": ["A @"], "year": 2020, "doi": null},'
    ' "logic": {"key_insight": "k", "gaps": ["g"], "claims": ['
    '{"claim_id": "C1", "statement": "s @", "conditions": "c", "status": "supported", "falsification_criteria": "f",'
    ' "proof": ["E1"], "evidence_ids": ["EV1"], "dependencies": ["C2"], "sources":'
    ' [{"source_id": "s1", "source_type": "span", "span_ids": ["@-span-0001"], "quote": null, "role": "result"}]},'
    ' {"claim_id": "C2", "statement": "t %", "conditions": "d", "status": "supported", "falsification_criteria": "g"}],'
    ' "concepts": [{"concept_id": "K1", "label": "l", "definition": "d"}],'
    ' "experiments": [{"experiment_id": "E1", "title": "x", "verifies": ["C1"], "setup": "u", "procedure": "p",'
    ' "expected_outcome": "o", "evidence_ids": ["EV1"]}]},'
    ' "evidence": {"records": [{"evidence_id": "EV1", "title": "v", "role": "result", "summary": "m", "linked_claim_ids": ["C1"]}]},'
    ' "trace": {"node_id": "Q0", "node_type": "question", "support_level": "explicit", "summary": "q", "evidence": ["C1"], "children":'
    ' [{"node_id": "Q1", "node_type": "question", "summary": "r", "evidence": ["EV1"], "children":'
    ' [{"node_id": "R2", "node_type": "result", "summary": "z", "evidence": ["K1"], "children":'
    ' [{"node_id": "R3", "node_type": "result", "summary": "y", "children":'
    ' [{"node_id": "R4", "node_type": "result", "support_level": "inferred", "summary": "w", "evidence": ["E1"]}]}]}]}]},'
    ' "src": {"environment": ["e"], "artifacts": []}, "metadata": {"n": 1}}'
)
# What the n-th kind of document has in place of a sound part; documents go round through them.
FLAWS = (
    ('"1.0"', '"1.0"'), ('"ara_version": "1.0", ', ""), ('"year": 2020', '"year": "2020"'), ('"year": 2020', '"year": 20.5'),
    ('"title": "On @"', '"title": null'), ('["A @"]', '["A @", 7, null]'), ('"paper_id": "@", ', ""), ('"statement": "s @", ', ""),
    ('"status": "supported"', '"status": ["supported"]'), ('"proof": ["E1"]', '"proof": "E1"'), ('"role": "result"}]}', '"role": "figure"}]}'),
    ('"role": "result"}]}', '"role": 3}]}'), ('"definition": "d"', '"definition": {"of": "%"}'), ('"setup": "u", ', ""),
    ('"records": [', '"records": ["loose", '), ('"support_level": "inferred"', '"support_level": "guessed"'),
    ('"summary": "w", ', ""), (' "src": {"environment": ["e"], "artifacts": []},', ""), (', "metadata": {"n": 1}', ""),
    ('"metadata": {"n": 1}', '"metadata": []'), ('"quote": null', '"quote": 5, "extra": {"role": "no"}'), ('"trace": {', '"trace": 4, "other": {'),
    ('"claim_id": "C2"', '"claim_id": "C1"'), ('"node_id": "R4"', '"node_id": "Q1"'), ('"concept_id": "K1"', '"concept_id": "K9"'),
    ('"evidence_id": "EV1"', '"evidence_id": "EV7"'), ('"experiment_id": "E1"', '"experiment_id": ""'), ('"summary": "y"', '"summary": "y", "evidence": ["C8", "C8"]'),
    ('"claim_id": "C1"', '"claim_id": "C5"'), ('"ara_version"', "ara_version"),
)


def artifacts(t):
    """An artifact text for every document, most with one flaw."""
    kind, number = F.pmod(F.col("doc_id"), F.lit(len(FLAWS))), F.col("doc_id").cast("string")
    body = F.lit(SOUND)
    flawed = reduce(lambda out, at: F.when(kind == at[0], F.replace(body, F.lit(at[1][0]), F.lit(at[1][1]))).otherwise(out),
                    enumerate(FLAWS), body)
    return spread(t.read("documents"), "doc_id").select(
        number.alias("paper_id"), F.replace(F.replace(flawed, F.lit("@"), number), F.lit("%"), F.coalesce("lang", F.lit(""))).alias("body"))


ARTIFACT = "SELECT CAST(doc_id AS VARCHAR) AS paper_id, replace(replace(CASE doc_id % {n} {cases} END, '@', CAST(doc_id AS VARCHAR)), '%', coalesce(lang, '')) AS body FROM documents".format(
    n=len(FLAWS), cases=" ".join(f"WHEN {i} THEN replace('{SOUND}', '{old}', '{new}')" for i, (old, new) in enumerate(FLAWS)))


def _value(rule: schema_check.Rule) -> str:
    allowed = "NULL" if rule.allowed is None else "[" + ", ".join(f"'{a}'" for a in rule.allowed) + "]"
    return f"('{rule.kind}', '{rule.field}', '{rule.type}', {rule.many}, {rule.nullable}, {rule.required}, {allowed})"


VIEWS = {
    "f_artifact": ARTIFACT,
    "f_sound_json": """
  SELECT paper_id, CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS body FROM f_artifact WHERE json_valid(body)""",
    "f_rule": "SELECT * FROM (VALUES " + ", ".join(map(_value, schema_check.rules_of(fv.ARTIFACT_SCHEMA)))
    + ") AS t(kind, field, type, many, nullable, required, allowed)",
    "f_walk": """/*rec*/
  SELECT paper_id, '$' AS path, 'Artifact' AS type, false AS many, false AS nullable, CAST(NULL AS VARCHAR[]) AS allowed, body AS node FROM f_sound_json
  UNION ALL (
  SELECT w.paper_id, w.path || '.' || r.field, r.type, r.many, r.nullable, r.allowed, json_extract(w.node, '$."' || r.field || '"')
  FROM f_walk w JOIN f_rule r ON r.kind = w.type WHERE NOT w.many AND json_type(w.node) = 'OBJECT' AND (r.required OR list_contains(json_keys(w.node), r.field))
  UNION ALL
  SELECT paper_id, path || '[' || i || ']', type, false, false, allowed, json_extract(node, '$[' || i || ']')
  FROM (SELECT *, unnest(range(CAST(json_array_length(node) AS BIGINT))) AS i FROM f_walk WHERE many AND json_type(node) = 'ARRAY'))""",
    "f_shape": """
  SELECT *, CASE WHEN node IS NULL THEN 'missing' ELSE CASE json_type(node) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END END AS found, node ->> '$' AS plain FROM f_walk""",
    "f_violation": """
  SELECT paper_id, path, found, CASE WHEN many THEN 'list of ' ELSE '' END || type AS expected,
    CASE WHEN found = 'missing' THEN 'missing' WHEN found = 'null' AND nullable THEN NULL
         WHEN many THEN CASE WHEN found <> 'array' THEN 'type' END
         WHEN type = 'one' THEN CASE WHEN found <> 'string' OR NOT list_contains(allowed, plain) THEN 'enum' END
         WHEN type = 'string' THEN CASE WHEN found <> 'string' THEN 'type' END
         WHEN type = 'integer' THEN CASE WHEN NOT (found IN ('integer', 'boolean') OR (found IN ('number', 'string') AND regexp_full_match(plain, '\\s*[-+]?\\d+(\\.0*)?\\s*'))) THEN 'type' END
         WHEN found <> 'object' THEN 'type' END AS fault
  FROM f_shape""",
}


@query("aud_03b_schema_rules", "SELECT paper_id, path, fault, expected, found FROM f_violation WHERE fault IS NOT NULL", VIEWS)
def _violations(t):
    return schema_check.schema_violations(artifacts(t))


@query("aud_03c_schema_outcome", """
SELECT o.paper_id, coalesce(n, 0) AS n_violations, no_layer, CASE WHEN n > 0 THEN CASE WHEN no_layer THEN 'blocker' ELSE 'critical' END END AS severity,
  coalesce(n, 0) = 0 OR (NOT no_layer AND rest = 0) AS usable
FROM (SELECT paper_id, NOT list_has_all(json_keys(body), ['paper', 'logic', 'evidence', 'trace', 'src', 'metadata']) AS no_layer FROM f_sound_json) o
LEFT JOIN (SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE NOT (fault = 'missing' AND path IN ('$.metadata', '$.ara_version'))) AS rest
           FROM f_violation WHERE fault IS NOT NULL GROUP BY paper_id) v USING (paper_id)""", VIEWS)
def _outcome(t):
    return schema_check.schema_outcome(artifacts(t))


# Targets and references in SQL: the walk visits each of them anyway.
LINK_VIEWS = {
    **VIEWS,
    "f_usable": """
  SELECT paper_id FROM f_sound_json WHERE list_has_all(json_keys(body), ['paper', 'logic', 'evidence', 'trace', 'src', 'metadata'])
    AND paper_id NOT IN (SELECT paper_id FROM f_violation WHERE fault IS NOT NULL)""",
    "f_target": """
  SELECT w.paper_id, k.target_type, w.node ->> k.id AS target_id, w.node
  FROM f_walk w JOIN (VALUES ('Claim', 'claim', 'claim_id'), ('Concept', 'concept', 'concept_id'), ('Experiment', 'experiment', 'experiment_id'),
    ('EvidenceRecord', 'evidence', 'evidence_id'), ('TraceNode', 'trace_node', 'node_id')) AS k(type, target_type, id) ON k.type = w.type
  WHERE NOT w.many AND w.paper_id IN (SELECT paper_id FROM f_usable)""",
}


def _usable(t):
    raw = artifacts(t)
    return raw.join(schema_check.schema_outcome(raw).where("usable").select("paper_id"), "paper_id", "left_semi")


@query("aud_04b_artifact_ids", """
SELECT paper_id, target_type, target_id, CAST(count(*) AS VARCHAR) AS detail FROM f_target
WHERE target_id <> '' GROUP BY paper_id, target_type, target_id HAVING count(*) > 1""", LINK_VIEWS)
def _ids(t):
    found = artifact_links.artifact_duplicates(artifact_links.artifact_targets(_usable(t)))
    return found.select("paper_id", "target_type", "target_id", "detail")


@query("aud_07b_artifact_references", """
SELECT paper_id, target_type, target_id, name || ':' || ref_id AS detail, severity FROM (
  SELECT t.paper_id, t.target_type, t.target_id, r.name, r.target, r.severity, unnest(CAST(json_extract(t.node, '$.' || r.field) AS VARCHAR[])) AS ref_id
  FROM f_target t JOIN (VALUES
    ('claim', 'evidence_ids', 'evidence_id', ['evidence'], 'critical'), ('claim', 'proof', 'proof', ['experiment'], 'critical'),
    ('claim', 'dependencies', 'dependency', ['claim'], 'major'), ('experiment', 'verifies', 'verifies', ['claim'], 'critical'),
    ('experiment', 'evidence_ids', 'evidence_id', ['evidence'], 'major'), ('evidence', 'linked_claim_ids', 'linked_claim_id', ['claim'], 'critical'),
    ('trace_node', 'evidence', 'evidence', ['claim', 'experiment', 'evidence', 'concept'], 'major')) AS r(target_type, field, name, target, severity)
  USING (target_type)) x
WHERE NOT EXISTS (SELECT 1 FROM f_target k WHERE k.paper_id = x.paper_id AND list_contains(x.target, k.target_type) AND k.target_id = x.ref_id)""", LINK_VIEWS)
def _references(t):
    found = artifact_links.artifact_unresolved(artifact_links.artifact_targets(_usable(t)))
    return found.select("paper_id", "target_type", "target_id", "detail", "severity")
