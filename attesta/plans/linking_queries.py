"""Retrieval, links, gating and link checks (LNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import text as X
from attesta.operators import linking as L
from attesta.plans import duck as D
from attesta.plans.registry import query

TERMS = f"SELECT paper_id, pos, claim_id, {D.content_terms('statement')} AS terms FROM f_claim"
RETRIEVED = """
  SELECT paper_id, claim_pos, claim_id, candidate_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, claim_pos ORDER BY score DESC, pos) AS k FROM (
      SELECT c.paper_id, c.pos AS claim_pos, c.claim_id, e.pos, 'e' || e.claim_id AS candidate_id,
        CASE WHEN len(c.terms) = 0 OR len(e.terms) = 0 THEN 0.0 ELSE CAST(len(list_intersect(c.terms, e.terms)) AS DOUBLE) / len(c.terms) END AS score
      FROM f_terms c JOIN f_terms e ON c.paper_id = e.paper_id))
  WHERE k <= 5"""


def dealt_terms(t):
    """Claims with their terms, dealt by paper: claims and evidence read the same shuffled rows."""
    return t.claim.select("paper_id", "pos", "claim_id", X.content_terms("statement").alias("terms")).repartition("paper_id")


def claim_terms(t):
    return dealt_terms(t).select("paper_id", F.col("pos").alias("claim_pos"), "claim_id", "terms")


def evidence_terms(t):
    return dealt_terms(t).select("paper_id", "pos", F.concat(F.lit("e"), "claim_id").alias("candidate_id"), "terms")


@query("lnk_01_topk_retrieval", """
SELECT paper_id, candidate_id, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, round_even(arg_max(score, claim_pos), 4) AS retrieval_score
FROM f_retrieved GROUP BY paper_id, candidate_id""", {"f_terms": TERMS, "f_retrieved": RETRIEVED})
def _retrieve(t):
    found = L.retrieved_candidates(L.retrieve_evidence(claim_terms(t), evidence_terms(t), 5))
    return found.withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("lnk_02_harvest_candidates", f"""
SELECT paper_id, coalesce(nullif(id, ''), 'c' || CAST(pos AS VARCHAR)) AS local_candidate_id,
  {D.stable('evidence_candidate', 'paper_id', 'section_name', "coalesce(nullif(id, ''), 'c' || CAST(pos AS VARCHAR))", D.strip('text'))} AS candidate_id
FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN '' ELSE 'n' || CAST(pos AS VARCHAR) END AS id FROM f_section_span) WHERE section_type <> 'ABSTRACT'""")
def _harvest(t):
    rows = t.section_span.select("paper_id", F.col("section_name").alias("section_id"), "section_type", F.col("pos").alias("index"),
                                 F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("pos").cast("string"))).alias("local_id"), F.col("text").alias("source_text"))
    return L.harvest_candidates(rows).select("paper_id", "local_candidate_id", "candidate_id")


@query("lnk_03_candidate_ids", """
WITH r AS (SELECT doc_id, unnest(range(len(p))) AS i, p FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)),
x AS (SELECT doc_id, i, trim(p[i + 1]) AS text, 'w' || CAST(i % 4 AS VARCHAR) AS id FROM r WHERE regexp_matches(p[i + 1], '\\S'))
SELECT doc_id, i AS index, CASE WHEN row_number() OVER (PARTITION BY doc_id, id ORDER BY i) > 1 THEN 'c' || CAST(i AS VARCHAR) ELSE id END AS candidate_id FROM x""")
def _ids(t):
    texts = F.split("text", r"\. ")
    ids = F.transform(texts, lambda x, i: F.concat(F.lit("w"), (i % 4).cast("string")))
    rows = t.read("documents").select("doc_id", texts.alias("texts"), ids.alias("ids"))
    return rows.select("doc_id", F.inline(L.normalize_candidate_ids(F.col("texts"), F.col("ids")))).select("doc_id", "index", "candidate_id")


KINDS = D.in_list(fv.EVIDENCE_KINDS)


@query("lnk_04_analysis_overlay", f"""
SELECT paper_id, claim_id AS candidate_id,
  CASE WHEN pos % 4 < 2 AND claim_type IN {KINDS} THEN claim_type ELSE {D.evidence_kind('statement', "'mixed'")} END AS evidence_kind,
  CASE WHEN pos % 4 = 0 THEN 'info' ELSE {D.strip('statement')} END AS new_information,
  CASE WHEN pos % 4 = 0 THEN 'high' ELSE 'unclear' END AS restatement_risk
FROM f_claim""")
def _overlay(t):
    candidates = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"), F.col("statement").alias("source_text"), F.lit("mixed").alias("role_hint"))
    analyses = t.claim.where("pos % 4 < 2").select(
        "paper_id", F.col("claim_id").alias("candidate_id"), F.col("claim_type").alias("evidence_kind"),
        F.when(F.col("pos") % 4 == 0, " info ").otherwise("").alias("new_information"),
        F.when(F.col("pos") % 4 == 0, "High").otherwise("odd").alias("restatement_risk"))
    return L.overlay_analysis(candidates, analyses).select("paper_id", "candidate_id", "evidence_kind", "new_information", "restatement_risk")


RAW_LINKS = """
  SELECT paper_id AS section_id, CASE WHEN pos % 7 = 0 THEN 'none' ELSE CAST(pos AS VARCHAR) END AS claim_index,
         CAST(pos + pos % 3 AS VARCHAR) AS evidence_index, CASE WHEN pos % 5 = 0 THEN ' ' ELSE 'refutes' END AS relation FROM f_claim"""


def raw_links(t):
    return t.claim.select(
        F.col("paper_id").alias("section_id"), F.when(F.col("pos") % 7 == 0, "none").otherwise(F.col("pos").cast("string")).alias("claim_index"),
        (F.col("pos") + F.col("pos") % 3).cast("string").alias("evidence_index"), F.when(F.col("pos") % 5 == 0, " ").otherwise("refutes").alias("relation"))


def indexed(t, name, source):
    return source.select(F.col("paper_id").alias("section_id"), F.col("pos").alias("index"), F.concat_ws("-", "paper_id", name).alias(name))


@query("lnk_05_index_links", f"""
SELECT section_id, claim_id, evidence_id, relation, {D.stable('claim_evidence_link', 'claim_id', 'evidence_id', 'relation')} AS link_id FROM (
  SELECT l.section_id, c.paper_id || '-' || c.claim_id AS claim_id, e.paper_id || '-' || e.evidence_id AS evidence_id,
    CASE WHEN trim(relation) = '' THEN 'supports' ELSE relation END AS relation
  FROM f_link l JOIN f_claim c ON c.paper_id = l.section_id AND c.pos = TRY_CAST(l.claim_index AS INTEGER)
  JOIN f_evidence e ON e.paper_id = l.section_id AND e.pos = TRY_CAST(l.evidence_index AS INTEGER))""", {"f_link": RAW_LINKS})
def _index_links(t):
    return L.index_links(raw_links(t), indexed(t, "claim_id", t.claim), indexed(t, "evidence_id", t.evidence))


@query("lnk_06_gate_by_links", """
SELECT paper_id, 'claim' AS kind, claim_id AS id FROM f_claim c WHERE EXISTS (SELECT 1 FROM f_claim_evidence l WHERE l.paper_id = c.paper_id AND l.claim_id = c.claim_id)
UNION ALL SELECT paper_id, 'evidence', evidence_id FROM f_evidence e WHERE EXISTS (SELECT 1 FROM f_claim_evidence l WHERE l.paper_id = e.paper_id AND l.evidence_id = e.evidence_id)
UNION ALL SELECT l.paper_id, 'link', l.claim_id || '>' || l.evidence_id FROM f_claim_evidence l
  WHERE EXISTS (SELECT 1 FROM f_evidence e WHERE l.paper_id = e.paper_id AND l.evidence_id = e.evidence_id)""")
def _gate(t):
    claims, evidence, links = L.gate_by_links(t.claim, t.evidence, t.claim_evidence, ["paper_id"])
    return (
        claims.select("paper_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
        .unionByName(evidence.select("paper_id", F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id")))
        .unionByName(links.select("paper_id", F.lit("link").alias("kind"), F.concat_ws(">", "claim_id", "evidence_id").alias("id")))
    )


@query("lnk_06b_gate_by_index", """
WITH l AS (SELECT section_id, TRY_CAST(claim_index AS INTEGER) AS c, TRY_CAST(evidence_index AS INTEGER) AS e FROM f_link WHERE TRY_CAST(claim_index AS INTEGER) IS NOT NULL),
cn AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS n FROM f_claim WHERE (paper_id, pos) IN (SELECT (section_id, c) FROM l)),
en AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS n FROM f_evidence WHERE (paper_id, pos) IN (SELECT (section_id, e) FROM l))
SELECT section_id, c AS old_claim_index, e AS old_evidence_index, cn.n AS claim_index, en.n AS evidence_index
FROM l JOIN cn ON cn.paper_id = section_id AND cn.pos = c JOIN en ON en.paper_id = section_id AND en.pos = e""", {"f_link": RAW_LINKS})
def _gate_index(t):
    return L.gate_by_index(indexed(t, "claim_id", t.claim), indexed(t, "evidence_id", t.evidence), raw_links(t))


@query("lnk_07_linked_evidence", """
SELECT paper_id, 'EV' || CAST(page AS VARCHAR) AS evidence_id, arg_min(claim_type, pos) AS evidence_kind, arg_min(statement, pos) AS new_information,
  coalesce(string_agg(topic, '; ' ORDER BY pos) FILTER (pos % 2 = 0), '') AS scope, string_agg(span_id, ',' ORDER BY pos) AS span_ids
FROM f_claim GROUP BY paper_id, page""")
def _rollup(t):
    items = t.claim.select(
        "paper_id", F.concat(F.lit("EV"), F.col("page").cast("string")).alias("evidence_id"), F.col("pos").alias("cand_pos"),
        F.array("span_id", "span_id").alias("span_ids"), F.col("claim_type").alias("evidence_kind"), F.col("statement").alias("new_information"),
        F.when(F.col("pos") % 2 == 0, F.col("topic")).otherwise(" ").alias("scope"))
    return L.linked_evidence_rollup(items).withColumn("span_ids", F.array_join("span_ids", ","))


WIDE = f"""
  SELECT l.paper_id, l.claim_id, l.evidence_id, l.ref_pos, c.statement AS claim_text, e.summary, CASE WHEN l.ref_pos = 2 THEN 'high' ELSE 'low' END AS risk,
    CASE WHEN c.pos % 4 = 0 THEN '' ELSE e.summary END AS info, {D.strip('e.summary')} AS ev,
    list_filter({D.content_terms('c.statement')}, lambda x: NOT list_contains({D.listing(fv.GENERIC_CLAIM_TERMS)}, x)) AS ct,
    {D.content_terms(D.strip('e.summary'))} AS et,
    list_filter({D.content_terms('c.topic')}, lambda x: NOT list_contains({D.listing(fv.GENERIC_CLAIM_TERMS)}, x)) AS needs
  FROM f_claim_evidence l JOIN f_claim c ON c.paper_id = l.paper_id AND c.claim_id = l.claim_id
  JOIN f_evidence e ON e.paper_id = l.paper_id AND e.evidence_id = l.evidence_id"""


@query("lnk_08_link_issues", f"""
SELECT paper_id, claim_id, evidence_id, code FROM f_wide, (VALUES ('weak_or_wrong_evidence_link'), ('restatement_only_evidence_link'),
  ('linked_evidence_missing_new_information'), ('missing_claim_numeric_payload'), ('missing_cognitive_function_support'), ('evidence_scope_mismatch')) x(code)
WHERE CASE code WHEN 'weak_or_wrong_evidence_link' THEN len(list_intersect(ct, et)) * 1.0 / greatest(len(ct), 1) < 0.25 AND len(ct) - len(list_intersect(ct, et)) >= 2
  WHEN 'restatement_only_evidence_link' THEN risk = 'high' WHEN 'linked_evidence_missing_new_information' THEN trim(info) = ''
  WHEN 'missing_claim_numeric_payload' THEN len(list_filter(regexp_extract_all(claim_text, {D.q(fv.NUMERIC_TERM_PATTERN)}), lambda n: NOT contains(ev, n))) > 0
  WHEN 'missing_cognitive_function_support' THEN regexp_matches(claim_text, '(?i)\\bcognitive function\\b') AND NOT regexp_matches(ev, '(?i)\\bcognitive function\\b')
  ELSE len(needs) > 0 AND len(needs) - len(list_intersect(needs, et)) >= greatest(1, least(3, len(needs))) END""", {"f_wide": WIDE})
def _link_issues(t):
    wide = t.claim_evidence.select("paper_id", "claim_id", "evidence_id", "ref_pos").join(
        t.claim.select("paper_id", "pos", "claim_id", F.col("statement").alias("claim_text"), F.array("topic").alias("requirements")), ["paper_id", "claim_id"]).join(
        t.evidence.select("paper_id", "evidence_id", F.col("summary").alias("summary_text")), ["paper_id", "evidence_id"])
    rows = wide.withColumn("source_text", F.lit("")).withColumn("evidence_kind", F.lit("observation")).withColumn(
        "restatement_risk", F.when(F.col("ref_pos") == 2, "high").otherwise("low")).withColumn(
        "new_information", F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("summary_text")))
    return L.link_issues(rows)


@query("lnk_08b_unlinked_claims", """
SELECT paper_id, claim_id, count(*) AS options FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, claim_pos ORDER BY score DESC, pos) AS k FROM (
    SELECT c.paper_id, c.pos AS claim_pos, c.claim_id, e.pos,
      CASE WHEN len(c.terms) = 0 OR len(e.terms) = 0 THEN 0.0 ELSE CAST(len(list_intersect(c.terms, e.terms)) AS DOUBLE) / len(c.terms) END AS score
    FROM f_terms c JOIN f_terms e ON c.paper_id = e.paper_id
    WHERE NOT EXISTS (SELECT 1 FROM f_claim_evidence l WHERE l.paper_id = c.paper_id AND l.claim_id = c.claim_id)))
WHERE k <= 3 AND score >= 0.2 GROUP BY paper_id, claim_id""", {"f_terms": TERMS})
def _unlinked(t):
    return L.unlinked_claims(claim_terms(t), evidence_terms(t), t.claim_evidence).drop("code")


@query("lnk_09_analysis_issues", """
SELECT paper_id, claim_id AS candidate_id, 'missing_new_information' AS code FROM f_claim WHERE pos % 3 = 0
UNION ALL SELECT paper_id, claim_id, 'restatement_not_flagged_high_risk' FROM f_claim WHERE pos % 2 = 0 AND pos % 5 <> 0""")
def _analysis(t):
    rows = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"), F.when(F.col("pos") % 3 == 0, " ").otherwise("x").alias("new_information"),
                          F.when(F.col("pos") % 2 == 0, "restatement_only").otherwise("result").alias("evidence_kind"),
                          F.when(F.col("pos") % 5 == 0, "high").otherwise("low").alias("restatement_risk"))
    return L.analysis_issues(rows)


def _code_sql(pattern):
    # Word boundaries are Unicode-aware in Spark and ASCII in RE2: put a letter where an accented one stands.
    plain = f"regexp_replace({D.strip('statement')}, '[^\\x00-\\x7F]', 'x', 'g')"
    return f"len(list_distinct(regexp_extract_all({plain}, {D.q(pattern)})))"


@query("lnk_10_atomicity_issues", f"""
SELECT paper_id, claim_id, code FROM f_claim, (VALUES ('bundled_multiple_identifiers'), ('bundled_both_and_targets'), ('bundled_phenotype_categories'), ('claim_contains_support_statistic')) x(code)
WHERE CASE code WHEN 'bundled_multiple_identifiers' THEN {_code_sql(fv.ENTITY_CODE_PATTERN)} > 1
  WHEN 'bundled_both_and_targets' THEN regexp_matches(statement, '(?i)\\bboth\\b') AND regexp_matches(statement, '(?i)\\band\\b')
  WHEN 'bundled_phenotype_categories' THEN regexp_matches(statement, '(?i)\\b(?:health|cognitive|central nervous system)\\b') AND regexp_matches(statement, '(?i)\\band\\b')
  ELSE regexp_matches(statement, {D.q('(?i)' + fv.SUPPORT_STATISTIC_PATTERN)}) AND NOT ({' OR '.join(f"contains(lower(statement), {D.q(p)})" for p in fv.NUMERIC_TARGET_PHRASES)}) END""")
def _atomicity(t):
    return L.atomicity_issues(t.claim.withColumn("claim_text", F.col("statement")), ["paper_id", "claim_id"])


@query("lnk_11_separation_issues", f"""
SELECT paper_id, claim_id, 'bundled_multiple_identifiers' AS code, NULL AS evidence_id FROM f_claim
  WHERE {_code_sql(fv.ENTITY_CODE_PATTERN)} > 1 AND regexp_matches(statement, '(?i)\\b(?:and|two|three|four|respectively)\\b')
UNION ALL SELECT paper_id, claim_id, 'claim_contains_support_statistic', NULL FROM f_claim WHERE regexp_matches(statement, {D.q('(?i)' + fv.SECTION_STATISTIC_PATTERN)})
UNION ALL SELECT l.paper_id, l.claim_id, 'evidence_repeats_claim', l.evidence_id FROM f_claim_evidence l JOIN f_claim c ON c.paper_id = l.paper_id AND c.claim_id = l.claim_id
  JOIN f_evidence e ON e.paper_id = l.paper_id AND e.evidence_id = l.evidence_id
  WHERE {D.collapse('c.statement')} <> '' AND (contains(lower({D.collapse('e.summary')}), lower({D.collapse('c.statement')})) OR contains(lower({D.collapse('c.statement')}), lower({D.collapse('e.summary')})))""")
def _separation(t):
    claims = t.claim.withColumn("claim_text", F.col("statement"))
    links = t.claim_evidence.select("paper_id", "claim_id", "evidence_id").join(claims.select("paper_id", "claim_id", "claim_text"), ["paper_id", "claim_id"]).join(
        t.evidence.select("paper_id", "evidence_id", F.col("summary").alias("summary_text")), ["paper_id", "evidence_id"])
    return L.separation_issues(claims, links, ["paper_id", "claim_id"])


@query("lnk_12_accept_no_worse", """
SELECT o_orderkey AS key, CASE WHEN o_custkey % 4 <> 0 AND o_orderkey % 5 <= o_orderkey % 7 THEN 1 ELSE 0 END AS attempt FROM orders""")
def _accept(t):
    orders = t.read("orders")
    first = orders.select(F.col("o_orderkey").alias("key"), F.lit(0).alias("attempt"), (F.col("o_orderkey") % 7).alias("issues"), F.lit(True).alias("usable"))
    retry = orders.select(F.col("o_orderkey").alias("key"), F.lit(1).alias("attempt"), (F.col("o_orderkey") % 5).alias("issues"), (F.col("o_custkey") % 4 != 0).alias("usable"))
    return L.accept_no_worse(first.unionByName(retry)).select("key", "attempt")


@query("lnk_13_contribution_filter", """
SELECT paper_id, claim_id, CASE WHEN pos % 3 = 0 THEN pos % 2 = 0 ELSE topic = 'Topic 1' OR claim_type = 'mechanism' END AS excluded FROM f_claim""")
def _contribution(t):
    flag = F.when(F.col("pos") % 3 == 0, F.when(F.col("pos") % 2 == 0, " No").otherwise("yes"))
    attribution = F.when(F.col("topic") == "Topic 1", "Prior_Literature").otherwise("own")
    role = F.when(F.col("claim_type") == "mechanism", "background").otherwise("result")
    return t.claim.select("paper_id", "claim_id", L.is_not_contribution(flag, attribution, role).alias("excluded"))


PROFILED = """
  SELECT paper_id, claim_id, pos, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'b' END AS profile, CASE WHEN pos % 5 = 0 THEN ' ' ELSE topic END AS subject,
    CASE WHEN pos % 7 = 0 THEN 'p = 0.05' ELSE claim_type END AS object,
    CASE pos % 3 WHEN 0 THEN ['species'] WHEN 1 THEN ['dose', 'cohort'] ELSE CAST([] AS VARCHAR[]) END AS ckeys FROM f_claim"""


def profiled(t):
    context = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("species"), F.lit("x"))).when(
        F.col("pos") % 3 == 1, F.create_map(F.lit("dose"), F.lit("x"), F.lit("cohort"), F.lit("y"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.claim.select(
        "paper_id", "claim_id", F.when(F.col("pos") % 2 == 0, "a").otherwise("b").alias("profile"),
        F.when(F.col("pos") % 5 == 0, " ").otherwise(F.col("topic")).alias("subject"), F.col("status").alias("predicate"),
        F.when(F.col("pos") % 7 == 0, "p = 0.05").otherwise(F.col("claim_type")).alias("object"), context.alias("context"),
        F.create_map().cast("map<string,string>").alias("details"))


def policies(t):
    rows = [("a", "context", "species", "allowed"), ("a", "context", "cohort", "allowed"), ("b", "context", "dose", "forbidden")]
    return t.spark.createDataFrame(rows, "profile string, area string, key string, policy string")


ERRORS = """
  SELECT paper_id, claim_id, 'missing_subject' AS code FROM f_profiled WHERE trim(subject) = ''
  UNION ALL SELECT paper_id, claim_id, 'statistical_payload_in_ontology_target.claim.object' FROM f_profiled WHERE object = 'p = 0.05'
  UNION ALL SELECT paper_id, claim_id, 'unexpected_context.dose' FROM f_profiled WHERE profile = 'a' AND list_contains(ckeys, 'dose')
  UNION ALL SELECT paper_id, claim_id, 'forbidden_context.dose' FROM f_profiled WHERE profile = 'b' AND list_contains(ckeys, 'dose')"""


@query("lnk_14_profile_validation", "SELECT * FROM f_error", {"f_profiled": PROFILED, "f_error": ERRORS})
def _profile(t):
    return L.profile_errors(profiled(t), policies(t), ["subject", "predicate", "object"])


@query("lnk_15_profile_gate", """
SELECT paper_id, claim_id FROM f_claim c WHERE (paper_id, claim_id) NOT IN (SELECT (paper_id, claim_id) FROM f_error)
AND EXISTS (SELECT 1 FROM f_claim_evidence l WHERE l.paper_id = c.paper_id AND l.claim_id = c.claim_id)""", {"f_profiled": PROFILED, "f_error": ERRORS})
def _profile_gate(t):
    errors = L.profile_errors(profiled(t), policies(t), ["subject", "predicate", "object"])
    return L.gate_by_profile(t.claim, t.evidence, t.claim_evidence, errors, ["paper_id"])[0].select("paper_id", "claim_id")


ENTRIES = """
  SELECT paper_id, claim_id, CASE WHEN page % 2 = 0 THEN 'a' ELSE 'b' END AS profile, 'context' AS origin, 1 AS pos,
    (['species', 'dosage', 'evidence_basis', 'odd'])[CAST(pos % 4 + 1 AS INTEGER)] AS key, CASE WHEN doc_no % 3 = 0 THEN 'cited work' ELSE topic END AS value FROM f_claim
  UNION ALL SELECT paper_id, claim_id, CASE WHEN page % 2 = 0 THEN 'a' ELSE 'b' END, 'details', 1,
    (['p_value', 'species', 'note'])[CAST(pos % 3 + 1 AS INTEGER)], claim_type FROM f_claim
  UNION ALL SELECT paper_id, claim_id, CASE WHEN page % 2 = 0 THEN 'a' ELSE 'b' END, 'details', 2, 'species', 'value = 3' FROM f_claim"""
ROUTED = """
  WITH n AS (SELECT *, CASE key WHEN 'dosage' THEN 'dose' WHEN 'evidence_basis' THEN CASE WHEN contains(value, 'cited') THEN 'citation_context' ELSE 'analysis_context' END ELSE key END AS name FROM f_entry),
  p AS (SELECT *, CASE WHEN origin = 'context' THEN CASE
        WHEN profile = 'b' AND name = 'dose' THEN 'details' WHEN profile = 'a' AND name = 'dose' THEN 'forbidden_context'
        WHEN (profile = 'a' AND name IN ('species', 'citation_context')) OR (profile = 'b' AND name = 'analysis_context') THEN 'context' ELSE 'legacy_context' END
      ELSE CASE WHEN profile = 'b' AND name = 'p_value' THEN 'forbidden_details' WHEN profile = 'a' AND name = 'p_value' THEN 'details'
        WHEN profile = 'a' AND name = 'species' THEN 'context' ELSE 'extra' END END AS place, CASE origin WHEN 'details' THEN 10 ELSE 0 END + pos AS o FROM n),
  h AS (SELECT *, CASE WHEN place = 'context' AND origin = 'details' AND o <> min(o) FILTER (place = 'context') OVER (PARTITION BY paper_id, claim_id, name) THEN 'extra' ELSE place END AS final FROM p)
  SELECT paper_id, claim_id, final AS place, CASE WHEN final IN ('context', 'details') THEN name ELSE key END AS key,
    arg_max(CASE WHEN final = 'context' AND name = 'species' AND contains(value, '=') THEN '' ELSE value END, o) AS value
  FROM h GROUP BY paper_id, claim_id, final, CASE WHEN final IN ('context', 'details') THEN name ELSE key END"""


def routed(t):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    base = ["paper_id", "claim_id", F.when(F.col("page") % 2 == 0, "a").otherwise("b").alias("profile")]
    entry = lambda origin, pos, key, value: F.struct(F.lit(origin).alias("origin"), F.lit(pos).alias("pos"), key.alias("key"), value.alias("value"))
    entries = t.claim.select(*base, F.inline(F.array(
        entry("context", 1, pick(("species", "dosage", "evidence_basis", "odd"), F.col("pos") % 4), F.when(F.col("doc_no") % 3 == 0, "cited work").otherwise(F.col("topic"))),
        entry("details", 1, pick(("p_value", "species", "note"), F.col("pos") % 3), F.col("claim_type")),
        entry("details", 2, F.lit("species"), F.lit("value = 3")))))
    rules = [("a", "context", "species", "allowed", True), ("a", "context", "citation_context", "allowed", False), ("a", "context", "dose", "forbidden", False),
             ("a", "details", "p_value", "allowed", False), ("b", "details", "dose", "allowed", False), ("b", "details", "p_value", "forbidden", False),
             ("b", "context", "analysis_context", "allowed", False)]
    policy = t.spark.createDataFrame(rules, "profile string, area string, key string, policy string, concept boolean")
    return L.route_keys(entries, policy, {"dosage": "dose"})


@query("lnk_16_key_routing", "SELECT * FROM f_routed", {"f_entry": ENTRIES, "f_routed": ROUTED})
def _routing(t):
    return routed(t)


@query("lnk_17_claim_payload", """
SELECT c.paper_id, c.claim_id, c.topic AS subject, coalesce(string_agg(CASE WHEN place IN ('context', 'details') THEN place || '.' || key ELSE 'metadata.' || place || '.' || key END || '=' || value, ';'
  ORDER BY CASE WHEN place IN ('context', 'details') THEN place || '.' || key ELSE 'metadata.' || place || '.' || key END), '') AS payload
FROM f_claim c LEFT JOIN f_routed r ON r.paper_id = c.paper_id AND r.claim_id = c.claim_id GROUP BY c.paper_id, c.claim_id, c.topic""", {"f_entry": ENTRIES, "f_routed": ROUTED})
def _payload(t):
    claims = t.claim.select("paper_id", "claim_id", F.concat("topic", F.lit(".")).alias("subject"), F.col("status").alias("predicate"), F.col("claim_type").alias("object"))
    wide = L.claim_payload(claims, routed(t))
    listed = lambda area: F.transform(F.map_entries(area), lambda e: F.concat(F.lit(area + "."), e["key"], F.lit("="), e["value"]))
    parts = [listed(area) for area in ("context", "details", "metadata")]
    return wide.select("paper_id", "claim_id", "subject", F.array_join(F.concat(*parts), ";").alias("payload"))


@query("lnk_18_legacy_evidence_type", """
SELECT event_id, CASE WHEN user_id % 6 = 0 THEN 'given' WHEN event_type IN ('view', 'click', 'error') THEN 'observation' WHEN event_type = 'signup' THEN NULL ELSE event_type END AS method,
  CASE WHEN user_id % 6 = 0 THEN NULL WHEN event_type IN ('view', 'click') THEN 'quantitative_measure' END AS outcome,
  CASE WHEN user_id % 6 = 0 OR event_type = 'signup' THEN NULL WHEN event_type = 'view' THEN 'table' WHEN event_type = 'click' THEN 'figure' ELSE 'text' END AS presentation FROM events""")
def _legacy(t):
    kind = F.col("event_type")
    old = F.when(kind == "view", "table_result").when(kind == "click", "figure_result").when(kind == "error", "text_statement").when(kind == "signup", "").otherwise(kind)
    method = F.when(F.col("user_id") % 6 == 0, "given")
    return t.read("events").select("event_id", L.migrate_evidence_type(method, old).alias("_m")).select("event_id", "_m.*")


@query("lnk_19_exact_reference_matching", f"""
WITH s AS (SELECT source AS paper_id, doc_no * 1000 + pos AS pos, doc_no // 20 % 2 AS side, lower({D.collapse('text')}) AS f FROM f_span)
SELECT l.paper_id, l.pos, r.p AS match_pos, CASE WHEN r.p IS NULL THEN 'none' ELSE 'semantic_equivalent' END AS relation
FROM s l LEFT JOIN (SELECT paper_id, f, min(pos) AS p FROM s WHERE side = 1 GROUP BY paper_id, f) r ON r.paper_id = l.paper_id AND r.f = l.f WHERE l.side = 0""")
def _exact(t):
    base = t.span.select(F.col("source").alias("paper_id"), (F.col("doc_no") * 1000 + F.col("pos")).alias("pos"), F.col("text").alias("statement"), (F.floor(F.col("doc_no") / 20) % 2).alias("side"))
    return L.exact_matches(base.where("side = 0"), base.where("side = 1"))
