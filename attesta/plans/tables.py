"""Input tables and the claim-shaped views derived from them.

Each view is written twice with one meaning: as a DataFrame here and as a
DuckDB CTE in ``VIEWS`` for the oracle.  Views cover whole tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import cut_lineage

SECTION_NAMES = ("Abstract", "Methods", "Results", "Fig", "", "Discussion")
CLAIM_TYPES = (
    "quantitative_result", "comparative_finding", "association", "mechanism", "method_contribution",
    "validation", "predictive_performance", "resource_description", "limitation", "implication",
)
IMPORTANCE = ("central", "supporting", "minor")
CONTESTANTS = 12


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class Tables:
    """Lazy access to one data folder."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return table.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else table

    # ---- documents -> spans and claims
    @cached_property
    def span(self) -> DataFrame:
        """One row per non-blank line of a document."""
        return (
            spread(self.read("documents"), "doc_id")
            .select(F.col("doc_id").alias("doc_no"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("_i", "text"))
            .where(F.col("text").rlike(r"\S"))
            .select(
                "doc_no",
                F.col("doc_no").cast("string").alias("paper_id"),
                (F.col("_i") + 1).alias("pos"),
                F.format_string("%d-span-%04d", F.col("doc_no"), F.col("_i") + 1).alias("span_id"),
                (F.floor(F.col("_i") / 10) + 1).cast("int").alias("page"),
                "text", "lang", "source",
            )
        )

    @cached_property
    def section_span(self) -> DataFrame:
        slot = (F.col("doc_no") + F.floor(F.col("pos") / 3)) % 6
        names = F.array(*[F.lit(n) for n in SECTION_NAMES])
        name = F.element_at(names, (slot + 1).cast("int"))
        return self.span.withColumn("section_name", name).withColumn(
            "section_type",
            F.when(F.col("section_name").isin("Fig", ""), "OTHER").otherwise(F.upper("section_name")),
        )

    @cached_property
    def claim(self) -> DataFrame:
        """One claim per span; fields chosen by residues of document and line number."""
        key = F.col("doc_no") + F.col("pos")
        pickers = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
        return self.span.select(
            "doc_no", "paper_id", "pos", "span_id", "page",
            F.format_string("C%02d", F.col("pos")).alias("claim_id"),
            F.col("text").alias("statement"),
            F.when(key % 7 == 0, "").when(key % 7 == 1, "Not available from provided input")
            .when(key % 7 == 2, "Short scope")
            .otherwise(F.concat(F.lit("Reported for documents of "), F.col("source"), F.lit(" in language "), F.col("lang")))
            .alias("conditions"),
            F.when(key % 5 == 0, "").when(key % 5 == 1, "The claim is false when nobody can repeat this result again.")
            .otherwise(F.concat(F.lit("Observing the opposite direction in documents of "), F.col("source"), F.lit(" would refute it.")))
            .alias("falsification"),
            pickers(IMPORTANCE, key).alias("importance"),
            pickers(CLAIM_TYPES, key).alias("claim_type"),
            F.concat(F.lit("Topic "), (key % 4).cast("string")).alias("topic"),
            F.when(key % 9 == 0, "unknown").otherwise("supported").alias("status"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Evidence records: four of five claims have one; some lack a summary."""
        key = F.col("doc_no") + F.col("pos")
        return self.claim.where(key % 5 != 4).select(
            "doc_no", "paper_id", "pos", "span_id",
            F.format_string("EV%02d", F.col("pos")).alias("evidence_id"),
            F.when(key % 13 == 0, " ").otherwise(F.col("statement")).alias("summary"),
        )

    @cached_property
    def claim_evidence(self) -> DataFrame:
        """Claim to evidence references, some of them dangling, some repeated."""
        key = F.col("doc_no") + F.col("pos")
        refs = F.array(
            F.struct(F.lit(0).alias("ref_pos"), F.when(key % 11 == 0, "EV9999").otherwise(F.format_string("EV%02d", F.col("pos"))).alias("evidence_id")),
            F.struct(F.lit(1).alias("ref_pos"), F.when(key % 3 == 0, F.format_string("EV%02d", F.col("pos") + 1)).alias("evidence_id")),
            F.struct(F.lit(2).alias("ref_pos"), F.when(key % 4 == 0, F.format_string("EV%02d", F.col("pos"))).alias("evidence_id")),
        )
        return self.claim.where(key % 17 != 0).select("doc_no", "paper_id", "pos", "claim_id", F.inline(refs)).where(
            F.col("evidence_id").isNotNull()
        )

    @cached_property
    def evidence_claim(self) -> DataFrame:
        """Evidence to claim references; some records link nothing, some a missing claim."""
        key = F.col("doc_no") + F.col("pos")
        return self.evidence.where(key % 6 != 0).select(
            "paper_id", "pos", "evidence_id",
            F.when(key % 19 == 0, "C9999").otherwise(F.format_string("C%02d", F.col("pos"))).alias("claim_id"),
        )

    @cached_property
    def experiment(self) -> DataFrame:
        """One experiment per page of a paper."""
        return self.claim.groupBy("doc_no", "paper_id", "page").agg(F.min("pos").alias("pos")).select(
            "doc_no", "paper_id", "page", "pos",
            F.format_string("E%02d", F.col("page")).alias("experiment_id"),
            F.when((F.col("doc_no") + F.col("page")) % 4 == 0, "").otherwise("Cohort under study").alias("setup"),
            F.when((F.col("doc_no") + F.col("page")) % 5 == 0, "  ").otherwise("Compare both arms").alias("procedure"),
            F.when((F.col("doc_no") + F.col("page")) % 6 == 0, "").otherwise("Higher in the treated arm").alias("expected_outcome"),
        )

    @cached_property
    def experiment_claim(self) -> DataFrame:
        """Which claims an experiment verifies; one claim in eight is in none."""
        key = F.col("doc_no") + F.col("pos")
        return self.claim.where(key % 8 != 0).select(
            "paper_id", "pos", F.format_string("E%02d", F.col("page")).alias("experiment_id"),
            F.when(key % 23 == 0, "C8888").otherwise(F.col("claim_id")).alias("claim_id"),
        )

    @cached_property
    def quote(self) -> DataFrame:
        """One quote per claim: exact, re-spaced upper case, reversed, or with one edited character."""
        key = F.col("doc_no") + F.col("pos")
        half = F.floor(F.length("statement") / 2).cast("int")
        edited = F.concat(F.left("statement", half), F.lit("#"), F.substring(F.col("statement"), half + 2, F.length("statement")))
        return self.claim.select(
            "doc_no", "paper_id", "pos", "claim_id", "span_id",
            F.when(key % 4 == 0, F.col("statement"))
            .when(key % 4 == 1, F.upper(F.replace("statement", F.lit(" "), F.lit("  "))))
            .when(key % 4 == 2, F.reverse("statement"))
            .otherwise(edited).alias("quote"),
            F.when(key % 6 == 0, "table").when(key % 6 == 1, "Methodology").otherwise("result").alias("role"),
            (F.when(key % 10 == 0, 0).when(key % 10 == 1, 2).otherwise(1)).alias("n_spans"),
        )

    # ---- events -> findings, usage, requests
    @cached_property
    def finding(self) -> DataFrame:
        codes = ("no_source_refs", "missing_required_field", "quote_not_in_source", "near_duplicate",
                 "long_statement", "no_evidence_records", "vague_conditions")
        severity = (
            F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "major")
            .when(F.col("event_type") == "click", "minor").when(F.col("event_type") == "view", "warning")
            .otherwise("suggestion")
        )
        return self.read("events").select(
            F.col("event_id").alias("finding_no"),
            F.floor(F.col("event_id") / 8).cast("string").alias("paper_id"),
            F.concat(F.lit("C"), (F.col("user_id") % 40).cast("string")).alias("target_id"),
            severity.alias("severity"),
            F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("event_id") % 7 + 1).cast("int")).alias("code"),
        )

    @cached_property
    def call(self) -> DataFrame:
        """Model calls: run by user, model and stage by type, some costs and tokens absent."""
        return self.read("events").select(
            F.col("event_id").alias("call_no"), "ts",
            F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
            F.concat(F.lit("vendor/m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            F.col("event_type").alias("stage"),
            F.when(F.col("event_id") % 9 != 0, F.get_json_object("props", "$.k").cast("bigint")).alias("prompt_tokens"),
            F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k").cast("bigint") * 2).alias("completion_tokens"),
            F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") * 100).cast("bigint")).alias("cost_micro"),
            F.when(F.col("event_id") % 7 == 0, "estimated").otherwise("actual").alias("cost_kind"),
        )

    # ---- lineitem -> units, coverage, votes
    @cached_property
    def unit(self) -> DataFrame:
        """One reference unit per line item; the paper is its part.  Written once, as members and rejected ones derive from it."""
        line = self.read("lineitem")
        key = F.col("l_orderkey") + F.col("l_linenumber")
        return cut_lineage(line.select(
            F.col("l_partkey").alias("paper_no"),
            F.col("l_partkey").cast("string").alias("paper_id"),
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")).alias("unit_id"),
            F.element_at(F.array(*[F.lit(v) for v in IMPORTANCE]), (key % 3 + 1).cast("int")).alias("importance"),
            (key % 4 != 3).alias("required"),
            F.when(key % 5 == 0, "accepted_improvement").otherwise("required").alias("scoring_mode"),
            F.col("l_suppkey").alias("supp"),
            F.col("l_quantity").cast("int").alias("qty"),
        ).groupBy("paper_no", "paper_id", "unit_id").agg(
            F.min("importance").alias("importance"), F.min("required").alias("required"),
            F.min("scoring_mode").alias("scoring_mode"), F.min("supp").alias("supp"), F.min("qty").alias("qty"),
        ))

    @cached_property
    def submission(self) -> DataFrame:
        """Which contestants submitted which paper; every paper misses one or none of them."""
        names = F.array(*[F.lit(f"k{i}") for i in range(CONTESTANTS)])
        papers = self.read("lineitem").select(F.col("l_partkey").alias("paper_no")).distinct()
        return papers.select(
            F.col("paper_no").cast("string").alias("paper_id"), "paper_no", F.posexplode(names).alias("_i", "contestant")
        ).where((F.col("paper_no") + F.col("_i")) % 31 != 0).select("paper_id", "contestant")

    @cached_property
    def unit_member(self) -> DataFrame:
        """Equivalent candidates of a unit: the contestants that cover it."""
        offsets = F.array(F.lit(0), F.col("qty"), F.col("qty") * 5 + 1)
        names = F.transform(offsets, lambda o: F.concat(F.lit("k"), ((F.col("supp") + o) % CONTESTANTS).cast("string")))
        return self.unit.select("paper_id", "unit_id", F.explode(F.array_distinct(names)).alias("contestant"))

    @cached_property
    def invalid(self) -> DataFrame:
        """Rejected candidates with a severity."""
        return self.unit.where(F.col("qty") > 47).select(
            "paper_id",
            F.concat(F.lit("k"), (F.col("supp") % CONTESTANTS).cast("string")).alias("contestant"),
            F.concat(F.lit("x-"), F.col("unit_id")).alias("candidate_id"),
            F.when(F.col("qty") == 50, "critical").when(F.col("qty") == 49, "major").otherwise("minor").alias("severity"),
        )

    @cached_property
    def vote(self) -> DataFrame:
        """One vote per line item: unit = order, pass = line number."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("unit_no"),
            F.col("l_linenumber").alias("pass_no"),
            F.col("l_partkey").alias("part"),
            F.when(F.col("l_returnflag") == "A", "semantic_equivalent")
            .when(F.col("l_returnflag") == "R", "partial_overlap")
            .otherwise(F.when(F.col("l_linestatus") == "O", "none").otherwise("compatible_refinement")).alias("relation"),
            F.when(F.col("l_partkey") % 6 == 0, "").when(F.col("l_partkey") % 6 == 1, "claim 3")
            .otherwise(F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string"))).alias("best_id"),
        )

    @cached_property
    def verdict(self) -> DataFrame:
        return self.read("labels").select(
            "doc_id", F.col("doc_id").cast("string").alias("paper_id"),
            F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("weak").alias("verdict"),
        )


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


VIEWS: dict[str, str] = {
    "f_span": """
        SELECT doc_no, CAST(doc_no AS VARCHAR) AS paper_id, CAST(i AS INTEGER) AS pos,
               printf('%d-span-%04d', doc_no, i) AS span_id, CAST((i - 1) // 10 + 1 AS INTEGER) AS page,
               parts[i] AS text, lang, source
        FROM (SELECT doc_id AS doc_no, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))
        WHERE regexp_matches(parts[i], '\\S')""",
    "f_section_span": f"""
        SELECT *, CASE WHEN section_name IN ('Fig', '') THEN 'OTHER' ELSE upper(section_name) END AS section_type
        FROM (SELECT *, ({_list(SECTION_NAMES)})[CAST((doc_no + pos // 3) % 6 + 1 AS INTEGER)] AS section_name FROM f_span)""",
    "f_claim": f"""
        SELECT doc_no, paper_id, pos, span_id, page, printf('C%02d', pos) AS claim_id, text AS statement,
               CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'Not available from provided input'
                    WHEN k % 7 = 2 THEN 'Short scope'
                    ELSE 'Reported for documents of ' || source || ' in language ' || lang END AS conditions,
               CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'The claim is false when nobody can repeat this result again.'
                    ELSE 'Observing the opposite direction in documents of ' || source || ' would refute it.' END AS falsification,
               ({_list(IMPORTANCE)})[CAST(k % 3 + 1 AS INTEGER)] AS importance,
               ({_list(CLAIM_TYPES)})[CAST(k % 10 + 1 AS INTEGER)] AS claim_type,
               'Topic ' || CAST(k % 4 AS VARCHAR) AS topic,
               CASE WHEN k % 9 = 0 THEN 'unknown' ELSE 'supported' END AS status
        FROM (SELECT *, doc_no + pos AS k FROM f_span)""",
    "f_evidence": """
        SELECT doc_no, paper_id, pos, span_id, printf('EV%02d', pos) AS evidence_id,
               CASE WHEN (doc_no + pos) % 13 = 0 THEN ' ' ELSE statement END AS summary
        FROM f_claim WHERE (doc_no + pos) % 5 <> 4""",
    "f_claim_evidence": """
        SELECT doc_no, paper_id, pos, claim_id, 0 AS ref_pos,
               CASE WHEN (doc_no + pos) % 11 = 0 THEN 'EV9999' ELSE printf('EV%02d', pos) END AS evidence_id
        FROM f_claim WHERE (doc_no + pos) % 17 <> 0
        UNION ALL
        SELECT doc_no, paper_id, pos, claim_id, 1, printf('EV%02d', pos + 1) FROM f_claim
        WHERE (doc_no + pos) % 17 <> 0 AND (doc_no + pos) % 3 = 0
        UNION ALL
        SELECT doc_no, paper_id, pos, claim_id, 2, printf('EV%02d', pos) FROM f_claim
        WHERE (doc_no + pos) % 17 <> 0 AND (doc_no + pos) % 4 = 0""",
    "f_evidence_claim": """
        SELECT paper_id, pos, evidence_id,
               CASE WHEN (doc_no + pos) % 19 = 0 THEN 'C9999' ELSE printf('C%02d', pos) END AS claim_id
        FROM f_evidence WHERE (doc_no + pos) % 6 <> 0""",
    "f_experiment": """
        SELECT doc_no, paper_id, page, min(pos) AS pos, printf('E%02d', page) AS experiment_id,
               CASE WHEN (doc_no + page) % 4 = 0 THEN '' ELSE 'Cohort under study' END AS setup,
               CASE WHEN (doc_no + page) % 5 = 0 THEN '  ' ELSE 'Compare both arms' END AS procedure,
               CASE WHEN (doc_no + page) % 6 = 0 THEN '' ELSE 'Higher in the treated arm' END AS expected_outcome
        FROM f_claim GROUP BY doc_no, paper_id, page""",
    "f_experiment_claim": """
        SELECT paper_id, pos, printf('E%02d', page) AS experiment_id,
               CASE WHEN (doc_no + pos) % 23 = 0 THEN 'C8888' ELSE claim_id END AS claim_id
        FROM f_claim WHERE (doc_no + pos) % 8 <> 0""",
    "f_quote": """
        SELECT doc_no, paper_id, pos, claim_id, span_id,
               CASE (doc_no + pos) % 4 WHEN 0 THEN statement WHEN 1 THEN upper(replace(replace(statement, 'ß', 'SS'), ' ', '  '))
                    WHEN 2 THEN array_to_string(list_reverse(string_split(statement, '')), '')
                    ELSE left(statement, length(statement) // 2) || '#' || substring(statement, length(statement) // 2 + 2) END AS quote,
               CASE (doc_no + pos) % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'Methodology' ELSE 'result' END AS role,
               CASE (doc_no + pos) % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_spans
        FROM f_claim""",
    "f_finding": """
        SELECT event_id AS finding_no, CAST(event_id // 8 AS VARCHAR) AS paper_id,
               'C' || CAST(user_id % 40 AS VARCHAR) AS target_id,
               CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'click' THEN 'minor'
                    WHEN 'view' THEN 'warning' ELSE 'suggestion' END AS severity,
               (['no_source_refs', 'missing_required_field', 'quote_not_in_source', 'near_duplicate',
                 'long_statement', 'no_evidence_records', 'vague_conditions'])[CAST(event_id % 7 + 1 AS INTEGER)] AS code
        FROM events""",
    "f_call": """
        SELECT event_id AS call_no, ts, 'run' || CAST(user_id AS VARCHAR) AS run_id,
               'vendor/m' || CAST(user_id % 3 AS VARCHAR) AS model, event_type AS stage,
               CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS prompt_tokens,
               CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 END AS completion_tokens,
               CASE WHEN event_id % 5 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cost_micro,
               CASE WHEN event_id % 7 = 0 THEN 'estimated' ELSE 'actual' END AS cost_kind
        FROM events""",
    "f_unit": f"""
        SELECT paper_no, paper_id, unit_id, min(importance) AS importance, min(required) AS required,
               min(scoring_mode) AS scoring_mode, min(supp) AS supp, min(qty) AS qty
        FROM (SELECT l_partkey AS paper_no, CAST(l_partkey AS VARCHAR) AS paper_id,
                     concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS unit_id,
                     ({_list(IMPORTANCE)})[CAST((l_orderkey + l_linenumber) % 3 + 1 AS INTEGER)] AS importance,
                     (l_orderkey + l_linenumber) % 4 <> 3 AS required,
                     CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'accepted_improvement' ELSE 'required' END AS scoring_mode,
                     l_suppkey AS supp, CAST(l_quantity AS INTEGER) AS qty FROM lineitem)
        GROUP BY paper_no, paper_id, unit_id""",
    "f_submission": f"""
        SELECT CAST(paper_no AS VARCHAR) AS paper_id, 'k' || CAST(i AS VARCHAR) AS contestant
        FROM (SELECT paper_no, unnest(range({CONTESTANTS})) AS i FROM (SELECT DISTINCT l_partkey AS paper_no FROM lineitem))
        WHERE (paper_no + i) % 31 <> 0""",
    "f_unit_member": f"""
        SELECT DISTINCT paper_id, unit_id, 'k' || CAST((supp + o) % {CONTESTANTS} AS VARCHAR) AS contestant
        FROM (SELECT *, unnest([0, qty, qty * 5 + 1]) AS o FROM f_unit)""",
    "f_invalid": f"""
        SELECT paper_id, 'k' || CAST(supp % {CONTESTANTS} AS VARCHAR) AS contestant, 'x-' || unit_id AS candidate_id,
               CASE qty WHEN 50 THEN 'critical' WHEN 49 THEN 'major' ELSE 'minor' END AS severity
        FROM f_unit WHERE qty > 47""",
    "f_vote": """
        SELECT l_orderkey AS unit_no, l_linenumber AS pass_no, l_partkey AS part,
               CASE WHEN l_returnflag = 'A' THEN 'semantic_equivalent' WHEN l_returnflag = 'R' THEN 'partial_overlap'
                    WHEN l_linestatus = 'O' THEN 'none' ELSE 'compatible_refinement' END AS relation,
               CASE l_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'claim 3' ELSE 's' || CAST(l_partkey % 40 AS VARCHAR) END AS best_id
        FROM lineitem""",
    "f_verdict": """
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS paper_id,
               CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'weak' END AS verdict FROM labels""",
}


def oracle(sql: str, views: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it uses, directly or through other views."""
    known = {**VIEWS, **(views or {})}
    needed: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in entered and re.search(rf"\b{name}\b", text):
                entered.add(name)  # a recursive view names itself
                visit(known[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    recursive = "RECURSIVE " if "RECURSIVE" in body or any("/*rec*/" in known[n] for n in needed) else ""
    ctes = [f"{name} AS ({known[name].strip()})" for name in needed]
    if body.upper().startswith("WITH "):
        rest = body[4:].strip()
        if rest.upper().startswith("RECURSIVE"):
            rest = rest[len("RECURSIVE"):].strip()
        return f"WITH {recursive}" + ",\n".join([*ctes, rest])
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" + body) if ctes else body
