"""Scalar functions over every document line (TXT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.plans import duck as D
from attesta.plans.registry import query

LINE = ["paper_id", "pos"]


def _lines(name, column, expr, sql_expr, view="f_span", attr="span"):
    """One query: line keys plus one computed column."""
    sql = f"SELECT paper_id, pos, {sql_expr} AS {column} FROM {view}" if sql_expr else None
    query(name, sql)(lambda t: getattr(t, attr).select(*LINE, expr().alias(column)))


_lines("txt_01_collapse_whitespace", "clean", lambda: X.collapse_ws("text"), D.collapse("text"))
_lines("txt_02_normalize_quote", "norm", lambda: X.normalize_quote("text"), D.norm_quote("text"))
_lines("txt_04_normalize_statement", "norm", lambda: X.normalize_statement("text"), D.norm_statement("text"))
_lines("txt_05_compact", "packed", lambda: X.compact("text"), D.compact("text"))
_lines("txt_06_token_set", "tokens", lambda: F.array_join(F.array_sort(X.tokens("text")), " "),
       f"array_to_string(list_sort({D.tokens('text')}), ' ')")
_lines("txt_08_content_terms", "terms", lambda: F.array_join(F.array_sort(X.content_terms("text")), " "),
       f"array_to_string(list_sort({D.content_terms('text')}), ' ')")
_lines("txt_09_number_tokens", "numbers", lambda: F.array_join(N.numbers_in(F.col("text")), " "),
       f"array_to_string({D.numbers('text')}, ' ')")
_lines("txt_11_numeric_terms", "terms", lambda: F.array_join(X.numeric_terms("text"), " "),
       f"array_to_string(regexp_extract_all(text, {D.q(fv.NUMERIC_TERM_PATTERN)}), ' ')")
_lines("txt_13_measurements", "values", lambda: F.array_join(N.measurements(F.col("text")), "; "),
       f"array_to_string({D.measurements('text')}, '; ')")
_lines("txt_14_non_claim", "non_claim", lambda: X.is_non_claim("text"), D.is_non_claim("text"))
_lines("txt_15_boilerplate_statement", "boilerplate",
       lambda: X.is_boilerplate_wording("text") & (F.size(N.numbers_in(F.col("text"))) == 0),
       f"regexp_matches(text, {D.q('(?i)' + fv.BOILERPLATE_STATEMENT_PATTERN)}) AND len({D.numbers('text')}) = 0")
_lines("txt_17_strip_numbers", "plain", lambda: N.strip_numbers(F.col("text")), None)
_lines("txt_18_short_concept", "concept", lambda: X.short_concept("text"),
       "(SELECT CASE WHEN len(list_filter(string_split(c, ' '), lambda w: w <> '')) > 10 THEN '' "
       "WHEN regexp_matches(c, '[=<>%]') THEN '' WHEN regexp_full_match(c, '\\d*\\.?\\d*') AND regexp_matches(c, '\\d') THEN '' "
       f"ELSE c END FROM (SELECT regexp_replace({D.collapse('text')}, '^[ .;:]+|[ .;:]+$', '', 'g') AS c))")
_lines("txt_19_statistical_payload", "payload", lambda: X.has_statistical_payload("text"),
       "(" + D.strip("text") + " <> '' AND (" + " OR ".join(
           f"contains(lower(text), {D.q(p)})" for p in fv.STATISTICAL_PAYLOAD_PHRASES)
       + f" OR regexp_matches(lower({D.strip('text')}), {D.q(fv.STATISTICAL_PAYLOAD_PATTERN)})))")
_lines("txt_25_counts", "n", lambda: X.word_count("text") * 100000 + F.length("text"),
       f"{D.words('text')} * 100000 + length(text)")


@query("txt_03_normalize_with_offsets", f"""
SELECT paper_id, pos, claim_id, instr({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}) AS norm_start
FROM f_quote q JOIN f_span s USING (paper_id, pos)
WHERE contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')})""")
def _offsets(t):
    joined = t.quote.join(t.span.select("paper_id", "pos", "text"), LINE)
    start = F.instr(X.normalize_quote("text"), X.normalize_quote("quote"))
    return joined.select(*LINE, "claim_id", start.alias("norm_start")).where("norm_start > 0")


@query("txt_07_jaccard_neighbours", f"""
SELECT a.paper_id, a.pos, round_even({D.jaccard('a.tok', 'b.tok')}, 4) AS score
FROM (SELECT *, {D.tokens('text')} AS tok FROM f_span) a
JOIN (SELECT paper_id, pos, {D.tokens('text')} AS tok FROM f_span) b ON a.paper_id = b.paper_id AND b.pos = a.pos + 1""")
def _neighbours(t):
    tok = t.span.select(*LINE, X.tokens("text").alias("tok"))
    after = tok.select("paper_id", (F.col("pos") - 1).alias("pos"), F.col("tok").alias("next_tok"))
    return tok.join(after, LINE).select(*LINE, F.bround(X.jaccard(F.col("tok"), F.col("next_tok")), 4).alias("score"))


@query("txt_10_ungrounded_numbers", f"""
SELECT s.paper_id, s.pos, array_to_string({D.missing_numbers('s.text', "[coalesce(q.quote, '')]")}, ', ') AS missing
FROM f_span s LEFT JOIN f_quote q ON q.paper_id = s.paper_id AND q.pos = s.pos + 1""")
def _ungrounded(t):
    """Numbers of a line that the quote of its neighbour line does not state."""
    quotes = t.quote.select("paper_id", (F.col("pos") - 1).alias("pos"), "quote")
    return t.span.join(quotes, LINE, "left").select(
        *LINE,
        F.array_join(
            N.ungrounded_numbers(F.col("text"), F.array(F.coalesce("quote", F.lit("")))), ", "
        ).alias("missing"),
    )


@query("txt_12_entity_identifiers", f"""
SELECT paper_id, pos, array_to_string(list_sort(list_distinct(list_filter(
    regexp_extract_all(text, {D.q(fv.IDENTIFIER_PATTERN)}),
    lambda t: length(t) >= 4 AND NOT list_contains({D.listing(fv.IDENTIFIER_EXCLUSIONS)}, lower(t))))), ' ') AS identifiers
FROM f_span""")
def _identifiers(t):
    return t.span.select(*LINE, F.array_join(X.identifiers("text"), " ").alias("identifiers"))


@query("txt_12b_identifiers_not_in_paper", f"""
SELECT c.paper_id, c.pos, array_to_string(list_sort(list_distinct(list_filter({D.identifiers("(c.statement || ' with ABC123')")},
  lambda t: NOT contains(d.packed, {D.compact('t')})))), ' ') AS missing
FROM f_claim c JOIN (SELECT doc_id, {D.compact('text')} AS packed FROM documents) d ON d.doc_id = c.doc_no""")
def _absent(t):
    papers = t.read("documents").select(F.col("doc_id").alias("doc_no"), X.compact("text").alias("packed"))
    said = F.concat("statement", F.lit(" with ABC123"))
    return t.claim.join(papers, "doc_no").select(*LINE, F.array_join(X.ungrounded_identifiers(said, F.col("packed")), " ").alias("missing"))


@query("txt_16c_status_and_flags", """
SELECT paper_id, pos, CASE pos % 5 WHEN 0 THEN 'mapped' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'rejected' ELSE 'unresolved' END AS mapping,
  CASE pos % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE topic = 'Topic 1' END AS flag FROM f_claim""")
def _status_flags(t):
    kind = F.col("pos") % 5
    raw = F.when(kind == 0, " Matched ").when(kind == 1, "UNCERTAIN").when(kind == 2, "reject").otherwise(F.col("topic"))
    flag = F.when(kind == 0, " Yes").when(kind == 1, "FALSE").otherwise(F.when(F.col("topic") == "Topic 1", "1").otherwise("?"))
    return t.claim.select(*LINE, X.coerce_mapping_status(raw).alias("mapping"), X.coerce_bool(flag, False).alias("flag"))


@query("txt_16_domain_coercion", f"""
SELECT paper_id, pos,
  CASE WHEN replace(lower(status), ' ', '_') IN {D.in_list(fv.STATUS_VALUES)} THEN replace(lower(status), ' ', '_') ELSE 'supported' END AS status,
  CASE WHEN lower(topic) = 'topic 1' THEN 'method' ELSE 'metadata' END AS role
FROM f_claim""")
def _coercion(t):
    role = X.coerce_source_role(F.when(F.col("topic") == "Topic 1", "Procedure ").otherwise(F.col("topic")))
    return t.claim.select(*LINE, X.pick("status", fv.STATUS_VALUES, "supported").alias("status"), role.alias("role"))


@query("txt_16b_labels_and_slugs", """
SELECT page_id, CASE WHEN a = '' THEN 'default' ELSE a END AS run_label, CASE WHEN s = '' THEN 'record' ELSE s END AS slug,
       regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') AS task_id
FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS a,
             regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM pages)""")
def _labels(t):
    return t.read("pages").select(
        "page_id", X.run_label("url").alias("run_label"), X.slug("url").alias("slug"), X.safe_task_id("url").alias("task_id")
    )


@query("txt_20_evidence_kind", f"""
SELECT paper_id, pos, {D.evidence_kind('statement', 'topic')} AS kind FROM f_claim""")
def _kind(t):
    return t.claim.select(*LINE, X.infer_evidence_kind(F.col("statement"), F.col("topic")).alias("kind"))


@query("txt_21_claim_profile", "SELECT paper_id, pos, CASE " + " ".join(
    "WHEN " + " OR ".join([f"contains(lower(x), {D.q(w)})" for w in ws] + (["mech"] if p == "mechanistic_claim" else []))
    + f" THEN '{p}'" for p, ws in fv.PROFILE_KEYWORDS)
    + " WHEN stat THEN 'regression_association_result' ELSE 'generic_claim' END AS profile FROM ("
    "SELECT paper_id, pos, statement || ' ' || claim_type AS x, (doc_no + pos) % 12 = 0 AS mech, (doc_no + pos) % 13 = 0 AS stat FROM f_claim)")
def _profile(t):
    key = F.col("doc_no") + F.col("pos")
    context = F.when(key % 12 == 0, F.array(F.lit("mechanism"))).otherwise(F.array().cast("array<string>"))
    details = F.when(key % 13 == 0, F.array(F.lit("p_value"))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws(" ", "statement", "claim_type")
    return t.claim.select(*LINE, X.infer_claim_profile(text, context, details).alias("profile"))


@query("txt_22_stable_id", f"SELECT paper_id, pos, {D.stable('claim', 'paper_id', 'pos', 'text')} AS id FROM f_span")
def _stable(t):
    return t.span.select(*LINE, X.stable_id("claim", F.col("paper_id"), F.col("pos"), F.col("text")).alias("id"))


@query("txt_23_task_fingerprint", """
SELECT page_id, sha256('{"paper_id":"' || CAST(page_id AS VARCHAR) || '","paper_url":"' || url || '","source_sha256":"' || sha256(html) || '"}') AS cache_key
FROM pages""")
def _fingerprint(t):
    body = F.to_json(F.struct(
        F.col("page_id").cast("string").alias("paper_id"), F.col("url").alias("paper_url"),
        F.sha2(F.encode("html", "UTF-8"), 256).alias("source_sha256"),
    ))
    return t.read("pages").select("page_id", F.sha2(body, 256).alias("cache_key"))


@query("txt_24_sequence_ids", """
SELECT paper_id, pos, printf('C%02d', row_number() OVER (PARTITION BY paper_id ORDER BY rank, pos)) AS claim_no
FROM (SELECT paper_id, pos, CASE importance WHEN 'central' THEN 0 WHEN 'minor' THEN 2 ELSE 1 END AS rank FROM f_claim)""")
def _sequence(t):
    from attesta.operators.frames import ordinal

    ranked = ordinal(t.claim.withColumn("_rank", X.importance_rank("importance")), ["paper_id"], ["_rank", "pos"], "_no")
    return ranked.select(*LINE, X.sequence_id("C", F.col("_no")).alias("claim_no"))


@query("txt_26_map_summary", """
SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '; type=' || event_type AS summary FROM events""")
def _map_summary(t):
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    entries = F.transform(F.map_entries(pairs), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.read("events").select("event_id", F.array_join(F.slice(entries, 1, 8), "; ").alias("summary"))


@query("txt_27_url_check", r"""
SELECT page_id, regexp_matches(trim(url), '^(?i:https?)://[^/?#]+') AS ok FROM pages""")
def _urls(t):
    return t.read("pages").select("page_id", X.url_ok("url").alias("ok"))


@query("txt_28_default_texts", f"""
SELECT paper_id, pos, {D.case_map('claim_type', fv.OUTCOME_TYPE, "'qualitative_result'")} AS outcome_type,
  topic || ' (p. ' || CAST(page AS VARCHAR) || '): ' || left(statement, 80) AS title,
  'Under ' || CASE WHEN conditions <> '' AND conditions <> {D.q(fv.NOT_AVAILABLE)} THEN conditions ELSE 'the same study design' END
  || ', observing the opposite direction or no difference for the relationship stated (''' || left(statement, 120)
  || ''') would refute this claim.' AS falsification
FROM f_claim""")
def _defaults(t):
    return t.claim.select(
        *LINE, X.outcome_type(F.col("claim_type")).alias("outcome_type"),
        X.evidence_title(F.col("topic"), F.col("page").cast("string"), F.col("statement")).alias("title"),
        X.default_falsification(F.col("statement"), F.col("conditions")).alias("falsification"),
    )
