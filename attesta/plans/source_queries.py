"""Source shaping over bodies kept in the given tables (SRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.plans import duck as D
from attesta.plans.registry import query
from attesta.sources import readers as S
from attesta.sources import sinks


def artifact_bodies(t):
    """Artifact JSON made from each document: its lines as spans, some ids and titles absent."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), i.cast("string"))).alias("span_id"), x.alias("text"),
        F.when(i % 2 == 0, "RESULTS").alias("section_type"), i.alias("page")))
    body = F.to_json(F.struct(
        F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("paper_id"),
                 F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("title"), F.col("lang").alias("venue")).alias("paper"), lines.alias("spans")))
    return t.read("documents").select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("stem"), body.alias("body"))


PID = "CASE WHEN doc_no % 2 = 0 THEN 'p' || paper_id ELSE 'file' || paper_id END"


@query("src_01_artifact_json", f"""
SELECT {PID} AS paper_id, pos, CASE WHEN (pos - 1) % 3 = 0 THEN printf('%s-span-%04d', {PID}, pos) ELSE 's' || CAST(pos - 1 AS VARCHAR) END AS span_id,
  CASE WHEN (pos - 1) % 2 = 0 THEN 'RESULTS' ELSE 'OTHER' END AS section_type, pos - 1 AS page, {D.strip('text')} AS text FROM f_span""")
def _artifact(t):
    return S.artifact_rows(artifact_bodies(t))[1].select("paper_id", "pos", "span_id", "section_type", "page", "text")


@query("src_01b_artifact_papers", f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE 'file' || doc_id END AS paper_id, CASE WHEN doc_id % 3 <> 0 THEN source WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE 'file' || doc_id END AS title, lang AS venue FROM documents""")
def _papers(t):
    return S.artifact_rows(artifact_bodies(t))[0].select("paper_id", "title", "venue")


@query("src_02_text_chunks", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(doc_id AS VARCHAR) || '-span-0001' AS span_id, 'Chunk 1' AS section_name,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def _text(t):
    bodies = t.read("documents").select(F.col("doc_id").cast("string").alias("stem"), F.col("text").alias("body"))
    return S.text_spans(bodies).select("paper_id", "span_id", "section_name", "text")


@query("src_03_page_paragraphs", """
WITH p AS (SELECT conv_id, turn, generate_subscripts(parts, 1) AS i, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS text FROM (
  SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS para FROM p WHERE text <> '')
SELECT CAST(conv_id AS VARCHAR) AS paper_id, pos, printf('%d-span-%04d', conv_id, pos) AS span_id, printf('%d-p%03d-%03d', conv_id, turn, para) AS reader_span_id, text FROM n""")
def _pages(t):
    pages = t.read("conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("page"), "text")
    return S.page_spans(pages, separator="\n").select("paper_id", "pos", "span_id", "reader_span_id", "text")


@query("src_04_markup_spans")
def _markup(t):
    return S.markup_spans(t.read("pages"), "page_id", "html")


def manifest_lines(t):
    kind = F.col("page_id") % 4
    number = F.col("page_id").cast("string")
    pair = F.to_json(F.struct(F.concat(F.lit("t "), number).alias("task_id"), F.lit("b/1").alias("batch_id"), F.array(
        F.struct(F.concat(F.lit("a"), number).alias("paper_id"), F.col("url").alias("paper_url")), F.struct(F.concat(F.lit("b"), number).alias("paper_id"), F.lit("").alias("paper_url"))).alias("papers")))
    line = F.when(kind == 0, pair).when(kind == 1, F.to_json(F.struct(F.concat(F.lit(" p"), number).alias("paper_id"), F.col("url").alias("paper_url")))).when(
        kind == 2, F.concat(F.lit("# "), F.col("url"))).otherwise(F.concat(F.lit("["), number, F.lit("]")))
    return t.read("pages").select(F.col("page_id").alias("line_no"), line.alias("line"))


@query("src_05_task_manifest", """
SELECT page_id AS line_no, 't_' || page_id AS task_id, 'b_1' AS batch_id, 'testnet' AS network, i AS paper_pos, CASE i WHEN 0 THEN 'a' ELSE 'b' END || page_id AS paper_id, CASE i WHEN 0 THEN url ELSE '' END AS paper_url
FROM (SELECT *, unnest([0, 1]) AS i FROM pages WHERE page_id % 4 = 0)
UNION ALL SELECT page_id, 'p' || page_id, '', 'testnet', 0, 'p' || page_id, url FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 4 = 3""")
def _tasks(t):
    rows, rejected = S.task_rows(manifest_lines(t))
    columns = ["line_no", "task_id", "batch_id", "network", "paper_pos", "paper_id", "paper_url"]
    return rows.select(*columns).unionByName(rejected.select("line_no"), allowMissingColumns=True)


@query("src_06_run_folders", """
SELECT 'run' || CAST(o_custkey AS VARCHAR) AS run_name, CAST(o_orderkey AS VARCHAR) AS paper_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'missing' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 150 END AS claims, o_orderkey % 2 = 0 AS has_artifact, o_orderkey % 5 = 0 AS has_evaluation FROM orders
WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""")
def _folders(t):
    key = F.col("o_orderkey")
    folder = F.concat(F.lit("/runs/run"), F.col("o_custkey").cast("string"), F.lit("/"), key.cast("string"), F.lit("/"))
    item = lambda cond, name, body: F.when(cond, F.struct(F.concat(folder, F.lit(name)).alias("path"), body.alias("body")))
    files = F.array(
        item(key % 3 == 0, "run_meta.json", F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.lit("failed").alias("status")))),
        item(key % 2 == 0, "agent_output.json", F.lit("{}")),
        item(key % 5 == 0, "evaluation.json", F.to_json(F.struct(F.struct((key % 150).alias("claims")).alias("stats")))))
    rows = t.read("orders").select(F.inline(F.filter(files, lambda f: f.isNotNull())))
    return S.run_folder_rows(rows).select("run_name", "paper_id", "title", "status", "claims", "has_artifact", "has_evaluation")


@query("src_07_run_labels", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '__run_' || source ELSE lang END AS name, lang AS base_name, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'default' END AS run_label FROM documents""")
def _labels(t):
    label = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" -"), "source", F.lit("-"))).otherwise(" ")
    named = t.read("documents").select("doc_id", X.versioned_name(F.col("lang"), label).alias("name"))
    return named.select("doc_id", "name", X.parse_versioned_name(F.col("name")).alias("_p")).select("doc_id", "name", "_p.*")


@query("src_08_file_manifest", """
SELECT 'conv' || conv_id AS pack, CAST(turn AS VARCHAR) || '.md' AS path, sha256(text) AS sha256, strlen(text) AS bytes, turn % 4 = 1 AS mismatch FROM conversations WHERE role <> 'system'""")
def _manifest(t):
    base = t.read("conversations").withColumn("pack", F.concat(F.lit("conv"), F.col("conv_id").cast("string")))
    hidden = F.when(F.col("role") == "system", ".cache/").otherwise("")
    files = base.select("pack", F.concat(hidden, F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    expected = base.select("pack", F.concat(F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("turn") % 4 == 1, "00").otherwise(F.upper(F.sha2(F.encode("text", "UTF-8"), 256))).alias("sha256"))
    return S.file_manifest(files, expected)


@query("src_08b_pack_digest", """
SELECT 'conv' || conv_id AS pack, count(*) AS files, sha256(string_agg(CAST(turn AS VARCHAR) || '.md' || chr(0) || sha256(text) || chr(0), '' ORDER BY CAST(turn AS VARCHAR) || '.md')) AS digest
FROM conversations GROUP BY conv_id""")
def _digest(t):
    files = t.read("conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("pack"), F.concat(F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return S.pack_digest(S.file_manifest(files))


@query("src_09_reply_parse", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'prose' ELSE NULL END AS found FROM documents""")
def _replies(t):
    """Bare, fenced, surrounded and broken JSON replies, each carrying its document."""
    quoted = F.to_json(F.struct(F.col("text").alias("t"), F.when(F.col("doc_id") % 4 == 0, "whole").when(F.col("doc_id") % 4 == 1, "fenced").otherwise("prose").alias("kind")))
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), quoted, F.lit("\n```\n"))).when(
        kind == 2, F.concat(F.lit("I think "), quoted, F.lit(" is right {"))).otherwise(F.concat(F.lit("{ broken "), F.translate("text", "{}", "")))
    parsed, rejected = S.parse_replies(t.read("documents").select("doc_id", body.alias("reply_text")))
    good = parsed.select("doc_id", F.get_json_object("object", "$.kind").alias("found"))
    return good.unionByName(rejected.select("doc_id", F.lit(None).cast("string").alias("found")))


@query("src_10_unit_pages", """
SELECT 'r' || CAST(conv_id % 3 AS VARCHAR) AS run_id, CAST(conv_id AS VARCHAR) AS paper_id, 'u' || CAST(turn AS VARCHAR) AS unit_id, text AS statement, turn % 4 AS candidate_count, 5 AS n_quotes FROM conversations WHERE conv_id % 5 <> 0
UNION ALL SELECT DISTINCT 'r' || CAST(conv_id % 3 AS VARCHAR), CAST(conv_id AS VARCHAR), NULL, NULL, NULL, NULL FROM conversations WHERE conv_id % 5 = 0""")
def _unit_pages(t):
    items = t.read("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(
        F.concat(F.lit("u"), F.col("turn").cast("string")).alias("unit_id"), F.col("text").alias("statement"),
        F.array_repeat("role", (F.col("turn") % 4).cast("int")).alias("equivalents"), F.array_repeat("role", 7).alias("source_quotes"))).alias("units"))
    other = F.when(F.col("conv_id") % 5 == 0, "other").otherwise(F.col("conv_id").cast("string"))
    run = F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string"))
    pages = items.select(run.alias("run_id"), F.col("conv_id").cast("string").alias("paper_id"), F.to_json(F.array(F.struct(run.alias("run_id"), other.alias("paper_id"), "units"))).alias("body"))
    units, errors = S.unit_rows(pages)
    good = units.select("run_id", "paper_id", "unit_id", "statement", "candidate_count", F.size("source_quotes").alias("n_quotes"))
    return good.unionByName(errors, allowMissingColumns=True)


@query("src_11_batch_manifest", "SELECT page_id AS position, url AS source_url FROM pages WHERE page_id IN (SELECT page_id FROM pages ORDER BY page_id LIMIT 100) AND page_id % 7 <> 0")
def _batch(t):
    papers = t.read("pages").select(F.col("page_id").alias("position"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url")).alias("source_url"))
    return S.batch_manifest(papers, limit=100)


@query("src_12_evaluation_rows", """
SELECT c.paper_id, claim_id, statement, conditions, c.importance, status, coalesce(verdict, '') AS llm_judge_verdict, CASE WHEN verdict IS NULL THEN '' ELSE 'minor' END AS llm_judge_importance
FROM f_claim c LEFT JOIN f_verdict v ON v.paper_id = c.paper_id AND c.pos % 2 = 0""")
def _evaluation(t):
    verdicts = t.claim.where("pos % 2 = 0").select("paper_id", "claim_id").join(t.verdict.select("paper_id", "verdict"), "paper_id").withColumn("importance", F.lit("minor"))
    return sinks.evaluation_rows(t.claim, verdicts)


@query("src_13_output_guard", """
SELECT CAST(o_orderkey AS VARCHAR) AS target, CAST(o_custkey AS VARCHAR) AS paper_id, CAST(o_custkey + 1 AS VARCHAR) AS held_by FROM orders WHERE o_orderkey % 10 = 0""")
def _guard(t):
    orders = t.read("orders")
    planned = orders.select(F.col("o_orderkey").cast("string").alias("target"), F.col("o_custkey").cast("string").alias("paper_id"))
    owner = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")
    return sinks.conflicting_targets(planned, orders.select(F.col("o_orderkey").cast("string").alias("target"), owner.alias("paper_id")))


@query("src_14_artifact_defaults", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS title, lang AS venue, CASE doc_id % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'metadata' ELSE '' END AS roles FROM documents""")
def _defaults(t):
    docs = t.read("documents").withColumn("paper_id", F.col("doc_id").cast("string"))
    rows = docs.select("paper_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("title"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("array<string>").alias("keywords"),
                       F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Protocol "))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("odd"))).alias("roles"))
    fallback = docs.select("paper_id", F.col("lang").alias("title"), F.col("lang").alias("venue"))
    return S.artifact_defaults(rows, fallback).select("paper_id", "title", "venue", F.array_join("roles", ",").alias("roles"))
