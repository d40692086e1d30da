"""Readers of artifacts, texts, pages, markup, manifests and run folders.

Each ``read_*`` scans files into rows of (path, body); each ``*_spans`` or
``*_rows`` shapes such rows, so the shaping also works on bodies kept in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators.documents import BLANK_LINE, chunk_spans
from attesta.operators.frames import ordinal

ARTIFACT_SCHEMA = """
    paper STRUCT<paper_id: STRING, title: STRING, authors: ARRAY<STRING>, year: INT, venue: STRING, journal: STRING, doi: STRING>,
    spans ARRAY<STRUCT<span_id: STRING, section_name: STRING, section_type: STRING, page: INT, text: STRING, span_type: STRING>>"""
TASK_SCHEMA = """
    task_id STRING, run_id STRING, batch_id STRING, paper_id STRING, paper_url STRING, title STRING, source_sha256 STRING,
    network STRING, papers ARRAY<STRUCT<paper_id: STRING, paper_url: STRING, title: STRING, source_sha256: STRING>>"""

# Section type by heading, first pattern that hits: fixed values.
SECTION_HEADS = (
    ("ABSTRACT", r"(?i)^abstract"),
    ("INTRO", r"(?i)^(intro|background|overview)"),
    ("METHODS", r"(?i)^(materials and methods|methods|patients and methods|methodology)"),
    ("RESULTS", r"(?i)^(results|findings|results and discussion)"),
    ("DISCUSSION", r"(?i)^(discussion|conclusion|conclusions)"),
)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, stem, body), one row per file, in parallel over files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    name = F.substring_index("path", "/", -1)
    return files.withColumn("stem", F.regexp_replace(F.url_decode(name), r"\.[^.]*$", ""))


def artifact_rows(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and spans of artifact JSON bodies (stem, body), defaults filled in."""
    parsed = bodies.select("stem", F.from_json("body", ARTIFACT_SCHEMA).alias("a"))
    given = F.nullif(F.col("a.paper.paper_id"), F.lit(""))
    named = parsed.withColumn("paper_id", F.coalesce(given, "stem"))
    papers = named.select(
        "paper_id", F.coalesce(F.nullif(F.col("a.paper.title"), F.lit("")), "paper_id").alias("title"),
        F.coalesce("a.paper.authors", F.array().cast("array<string>")).alias("authors"), F.col("a.paper.year").alias("year"),
        F.coalesce(F.nullif(F.col("a.paper.journal"), F.lit("")), F.col("a.paper.venue")).alias("venue"), F.col("a.paper.doi").alias("doi"))
    items = named.select("paper_id", F.posexplode("a.spans").alias("_i", "s"))
    default = F.format_string("%s-span-%04d", F.col("paper_id"), F.col("_i") + 1)
    spans = items.where(~X.is_blank("s.text")).select(
        "paper_id", (F.col("_i") + 1).alias("pos"), F.coalesce(F.nullif(F.col("s.span_id"), F.lit("")), default).alias("span_id"),
        F.coalesce("s.section_name", F.lit("")).alias("section_name"),
        F.coalesce(F.nullif(F.col("s.section_type"), F.lit("")), F.lit("OTHER")).alias("section_type"),
        F.col("s.page").alias("page"), X.strip("s.text").alias("text"),
        F.coalesce(F.nullif(F.col("s.span_type"), F.lit("")), F.lit("text")).alias("span_type"))
    return papers, spans


def text_spans(bodies: DataFrame, max_chars: int = 3500) -> DataFrame:
    return chunk_spans(bodies, "stem", "body", max_chars)


def page_spans(pages: DataFrame, paragraphs: bool = True, separator: str = BLANK_LINE) -> DataFrame:
    """Extracted page text to spans: one per paragraph, or one per page; empty pages keep their number.

    ``pages``: paper_id, page, text.  Span ids are dense over the survivors.
    """
    blocks = F.split("text", separator) if paragraphs else F.array("text")
    pieces = pages.select("paper_id", "page", F.posexplode(F.filter(F.transform(blocks, X.strip), lambda b: b != "")).alias("_i", "text"))
    numbered = ordinal(pieces.withColumn("_para", F.col("_i") + 1), ["paper_id"], ["page", "_para"], "pos")
    return numbered.select(
        "paper_id", "pos", F.format_string("%s-span-%04d", F.col("paper_id"), F.col("pos")).alias("span_id"),
        F.concat(F.lit("Page "), F.col("page").cast("string")).alias("section_name"), F.lit("PAGE").alias("section_type"), "page", "text",
        F.format_string("%s-p%03d-%03d", F.col("paper_id"), F.col("page"), F.col("_para")).alias("reader_span_id"))


def section_type_of(head: Column) -> Column:
    out = F.lit("OTHER")
    for kind, pattern in reversed(SECTION_HEADS):
        out = F.when(F.trim(head).rlike(pattern), F.lit(kind)).otherwise(out)
    return F.when(F.coalesce(head, F.lit("")) == "", "OTHER").otherwise(out)


def markup_spans(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Paragraphs of marked-up text with the heading above them and running character offsets.

    Headings and paragraphs come out of the text in order by one pattern; a fold
    over the page's own array carries the heading and the offset along.
    """
    body = F.regexp_replace(F.col(body_col), r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    block = r"(?is)<(h[1-6]|head|p)\b[^>]*>(.*?)(?=</?(?:h[1-6]|head|p|div|article|section|body|ul|table|nav|footer)\b|$)"
    names = F.regexp_extract_all(body, F.lit(block), F.lit(1))
    inner = F.transform(
        F.regexp_extract_all(body, F.lit(block), F.lit(2)), lambda t: X.collapse_ws(F.regexp_replace(t, r"(?s)<[^>]*>?", " ")))
    start = F.struct(
        F.lit("").alias("head"), F.lit(0).alias("at"),
        F.array().cast("array<struct<head:string,start:int,text:string>>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        text = item["text"]
        heading = ~(F.lower(item["tag"]) == "p")
        row = F.struct(acc["head"].alias("head"), acc["at"].alias("start"), text.alias("text"))
        return (
            F.when(heading, F.struct(text.alias("head"), acc["at"].alias("at"), acc["out"].alias("out")))
            .when(text == "", acc)
            .otherwise(F.struct(acc["head"].alias("head"), (acc["at"] + F.length(text) + 1).alias("at"), F.concat(acc["out"], F.array(row)).alias("out")))
        )

    blocks = pages.select(F.col(id_col).cast("string").alias("paper_id"), F.arrays_zip(names.alias("tag"), inner.alias("text")).alias("_b"))
    spans = blocks.select("paper_id", F.posexplode(F.aggregate("_b", start, step, lambda acc: acc["out"])).alias("_i", "_s"))
    return spans.select(
        "paper_id", (F.col("_i") + 1).alias("pos"), F.format_string("%s-span-%04d", F.col("paper_id"), F.col("_i") + 1).alias("span_id"),
        F.col("_s.head").alias("section_name"), section_type_of(F.col("_s.head")).alias("section_type"),
        F.col("_s.start").alias("char_start"), (F.col("_s.start") + F.length("_s.text")).alias("char_end"), F.col("_s.text").alias("text"))


def task_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of a task manifest (one JSON object per line) and its rejected lines.

    ``lines``: line_no, line.  Blank lines and comments are skipped.
    """
    live = lines.where(~X.is_blank("line") & ~X.strip("line").startswith("#"))
    shape = F.schema_of_variant(F.try_parse_json("line"))
    ok = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    parsed = live.where(ok).select("line_no", F.from_json("line", TASK_SCHEMA).alias("t"))
    blank = lambda c: F.nullif(X.strip(c), F.lit(""))
    task = F.coalesce(blank("t.task_id"), blank("t.paper_id"), F.lit("claims_task"))
    alone = F.array(F.struct("t.paper_id", "t.paper_url", "t.title", "t.source_sha256"))
    papers = F.when(F.size(F.coalesce("t.papers", F.array().cast("array<struct<paper_id:string,paper_url:string,title:string,source_sha256:string>>"))) > 0, F.col("t.papers")).otherwise(alone)
    rows = parsed.select(
        "line_no", X.safe_task_id(task).alias("task_id"),
        F.when(blank("t.batch_id").isNull(), "").otherwise(X.safe_task_id("t.batch_id")).alias("batch_id"),
        F.coalesce(blank("t.network"), F.lit("testnet")).alias("network"), F.posexplode(papers).alias("paper_pos", "p"))
    flat = rows.select(
        "line_no", "task_id", "batch_id", "network", "paper_pos", X.strip("p.paper_id").alias("paper_id"), X.strip("p.paper_url").alias("paper_url"),
        X.strip("p.title").alias("title"), F.lower(X.strip("p.source_sha256")).alias("source_sha256"))
    return flat, live.where(~ok).select("line_no", "line")


def read_task_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return task_rows(lines)


def run_folder_rows(files: DataFrame) -> DataFrame:
    """One row per run and paper from the result files lying in ``run/paper/name.json``.

    ``files``: path, body.  Missing files give NULLs; status is the recorded one,
    else completed where an artifact exists, else missing.
    """
    parts = F.split("path", "/")
    keyed = files.select(
        F.element_at(parts, -3).alias("run_name"), F.element_at(parts, -2).alias("paper_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("kind"), F.try_parse_json("body").alias("v"), F.octet_length("body").alias("bytes"))
    pick = lambda kind, path, type_: F.max(F.when(F.col("kind") == kind, F.try_variant_get("v", path, type_)))
    has = lambda kind: F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))
    grouped = keyed.groupBy("run_name", "paper_id").agg(
        pick("run_meta", "$.title", "string").alias("title"), pick("run_meta", "$.status", "string").alias("_status"),
        pick("run_meta", "$.wall_seconds", "double").alias("_wall"), pick("backend_manifest", "$.elapsed_seconds", "double").alias("_elapsed"),
        pick("evaluation", "$.quality_estimate", "double").alias("quality_estimate"), pick("evaluation", "$.stats.claims", "int").alias("claims"),
        pick("backend_manifest", "$.usage.cost_usd", "double").alias("_cost"), pick("evaluation", "$.stats.cost_usd", "double").alias("_cost2"),
        has("agent_output").alias("has_artifact"), has("staged_trace").alias("has_trace"), has("evaluation").alias("has_evaluation"),
        F.coalesce(F.max(F.when(F.col("kind") == "agent_output", F.col("bytes"))), F.lit(0)).alias("artifact_bytes"))
    return grouped.select(
        "run_name", "paper_id", F.coalesce("title", "paper_id").alias("title"),
        F.coalesce("_status", F.when(F.col("has_artifact"), "completed").otherwise("missing")).alias("status"),
        F.coalesce("_wall", "_elapsed").alias("wall_seconds"), F.coalesce("_cost", "_cost2").alias("cost_usd"),
        "claims", "quality_estimate", "has_artifact", "has_trace", "has_evaluation", "artifact_bytes")


def read_run_folders(spark: SparkSession, root: str) -> DataFrame:
    return run_folder_rows(read_bodies(spark, f"{root}/*/*/*.json").select("path", "body"))


def file_manifest(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """sha256 and bytes per file, hidden and cache paths left out; mismatches flagged when expected hashes are given.

    ``files``: pack, path, content; ``expected``: pack, path, sha256.
    """
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | (p == "__pycache__"))
    rows = files.where(~hidden).select("pack", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    if expected is None:
        return rows
    wanted = expected.select("pack", "path", F.lower("sha256").alias("_want"))
    return rows.join(wanted, ["pack", "path"], "left").withColumn(
        "mismatch", F.col("_want").isNotNull() & (F.col("_want") != F.col("sha256"))).drop("_want")


def pack_digest(manifest: DataFrame) -> DataFrame:
    """One digest per pack over its sorted (path, sha256) listing; only short listing rows are gathered, never contents."""
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(listed, lambda r: F.concat(r["path"], F.lit("\u0000"), r["sha256"], F.lit("\u0000"))), "")
    return manifest.groupBy("pack").agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("files"))


# A string (to its closing quote or the end), a brace, or what lies between; possessive, so no step is taken back.
JSON_STRETCH = r'''(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^"{}]++'''


def _balanced(body: Column) -> Column:
    """First balanced ``{...}`` of the text, or NULL: one fold over strings, braces and stretches between them."""
    tail = F.substring(body, F.instr(body, F.lit("{")), F.length(body))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(
            depth.alias("depth"), (acc["n"] + F.length(piece)).alias("n"), (depth == 0).alias("done")))

    pieces = F.regexp_extract_all(tail, F.lit(JSON_STRETCH), F.lit(0))
    end = F.aggregate(pieces, start, step, lambda acc: F.when(acc["done"], acc["n"]))
    return F.when((F.instr(body, F.lit("{")) > 0) & (F.instr(body, F.lit("}")) > 0), F.left(tail, end))


def parse_replies(replies: DataFrame, body_col: str = "reply_text") -> tuple[DataFrame, DataFrame]:
    """Model replies to JSON objects: whole text, then fenced blocks, then the first balanced object.

    Returns parsed rows (with ``object`` as text) and rejected rows.  The
    fold runs only on replies that the first two readings do not settle.
    """
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    body = X.strip(body_col)
    fences = F.regexp_extract_all(body, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    staged = replies.withColumn("_body", body).withColumn(
        "_early", F.when(is_object(F.col("_body")), F.col("_body")).otherwise(F.get(F.filter(fences, is_object), F.lit(0))))
    late = staged.withColumn("_late", F.when(F.col("_early").isNull() & (F.col("_body") != ""), _balanced(F.col("_body"))))
    final = late.withColumn("object", F.coalesce("_early", F.when(is_object(F.col("_late")), F.col("_late")))).drop("_body", "_early", "_late")
    return final.where("object IS NOT NULL"), final.where("object IS NULL").drop("object")


UNIT_PAGE_SCHEMA = """ARRAY<STRUCT<run_id: STRING, paper_id: STRING, record_id: STRING, units: ARRAY<STRUCT<unit_id: STRING, statement: STRING,
    importance: STRING, required: BOOLEAN, scoring_mode: STRING, equivalents: ARRAY<STRING>, source_span_ids: ARRAY<STRING>, source_quotes: ARRAY<STRING>>>>>"""


def unit_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of the record matching the asked run and paper, and pages holding other records.

    ``pages``: run_id, paper_id, body.
    """
    parsed = pages.withColumn("_r", F.from_json("body", UNIT_PAGE_SCHEMA))
    match = F.get(F.filter("_r", lambda r: (r["run_id"] == F.col("run_id")) & (r["paper_id"] == F.col("paper_id"))), F.lit(0))
    found = parsed.withColumn("_m", match)
    units = found.where("_m IS NOT NULL").select("run_id", "paper_id", F.col("_m.record_id").alias("record_id"), F.inline("_m.units")).select(
        "run_id", "paper_id", "record_id", "unit_id", "statement", "importance", "required", "scoring_mode",
        F.size(F.coalesce("equivalents", F.array().cast("array<string>"))).alias("candidate_count"), "source_span_ids",
        F.slice(F.coalesce("source_quotes", F.array().cast("array<string>")), 1, 5).alias("source_quotes"))
    return units, found.where("_m IS NULL").select("run_id", "paper_id")


def batch_manifest(papers: DataFrame, positions: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Papers of a batch in position order, chosen by position or by count, without those lacking a source."""
    rows = papers
    if positions is not None:
        rows = rows.where(F.col("position").isin(*positions))
    elif limit is not None:
        rows = rows.orderBy("position").limit(limit)
    return rows.where(F.coalesce("source_url", F.lit("")) != "")


def artifact_defaults(artifacts: DataFrame, fallback: DataFrame) -> DataFrame:
    """Paper fields overlaid on a fallback where non-empty, lists defaulted, roles coerced.

    ``artifacts``: paper_id, title, venue, keywords, roles; ``fallback``: paper_id, title, venue.
    """
    base = fallback.select("paper_id", F.col("title").alias("_t"), F.col("venue").alias("_v"))
    joined = artifacts.join(base, "paper_id", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "paper_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), "_t", F.lit("")).alias("title"),
        F.coalesce(F.nullif(F.col("venue"), F.lit("")), "_v").alias("venue"), F.coalesce("keywords", empty).alias("keywords"),
        F.transform(F.coalesce("roles", empty), X.coerce_source_role).alias("roles"))
