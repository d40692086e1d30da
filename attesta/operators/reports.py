"""Run, usage and claim rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.operators.frames import top_rows
from attesta.operators.scoring import score_units

SEVERITIES = ("blocker", "critical", "major", "minor", "warning", "suggestion")
TOKEN_FIELDS = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")


def run_rollup(papers: DataFrame) -> DataFrame:
    """One row per run; means are NULL where nothing counts.

    ``papers``: run_name, paper_pos, status, claims, quality (four places),
    cost_cents, runtime, updated_at.
    """
    done = F.col("status") == "completed"
    return papers.groupBy("run_name").agg(
        F.count("*").alias("paper_count"), F.count(F.when(done, 1)).alias("completed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.when(F.count(F.when(done, 1)) > 0, N.ratio(
            F.sum(F.when(done, F.coalesce("claims", F.lit(0)))), F.count(F.when(done, 1)), 1)).alias("avg_claims"),
        F.when(F.count(F.when(done, F.col("quality"))) > 0, N.ratio(
            F.sum(F.when(done, score_units(F.col("quality")))), F.count(F.when(done, F.col("quality"))) * 10000)).alias("avg_quality"),
        (F.sum(F.when(done, F.col("cost_cents"))) / 100).alias("total_cost_usd"),
        F.min_by("runtime", F.when(F.coalesce("runtime", F.lit("")) != "", F.col("paper_pos"))).alias("runtime"),
        F.max("updated_at").alias("updated_at"))


def merge_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """NULL-aware sums; the cost counts as actual only if every costed call is.

    ``calls``: keys, call_no, token fields, cost_units (integer 1e-8 dollars), cost_kind, source.
    """
    present = [f for f in TOKEN_FIELDS if f in calls.columns]
    costed = F.when(F.col("cost_units").isNotNull() & F.col("cost_kind").isin("actual", "estimated"), F.col("cost_kind") == "actual")
    merged = calls.groupBy(*keys).agg(
        *[F.sum(f).alias(f) for f in present], F.sum("cost_units").alias("_cost"), F.bool_and(costed).alias("_actual"))
    sources = calls.where(~X.is_blank("source")).groupBy(*keys, "source").agg(F.min("call_no").alias("_at")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_at", "source"))).alias("_s"))
    joined = merged.join(sources, keys, "left")
    names = F.array_join(F.transform("_s", lambda s: s["source"]), ",")
    return joined.select(
        *keys, *present, (F.col("_cost") / 1e8).alias("cost_usd"),
        F.when(F.col("_actual").isNull(), "unavailable").when(F.col("_actual"), "actual").otherwise("estimated").alias("cost_kind"),
        F.coalesce(F.nullif(names, F.lit("")), F.lit("unavailable")).alias("source"))


def severity_histogram(findings: DataFrame, keys: list[str]) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.groupBy(*keys, "severity").agg(F.count("*").alias("n")).withColumn("severity_order", order)


def _number(v: Column, kind: str, *paths: str) -> Column:
    """The first of ``paths`` that holds a number, not a text of digits; counts lose their fraction."""
    numeric = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return F.coalesce(*[F.when(numeric(p), F.try_variant_get(v, p, kind)) for p in paths])


def _usage_fields(v: Column) -> list[Column]:
    """Usage fields of one JSON object."""
    number = lambda kind, *paths: _number(v, kind, *paths)
    prompt = number("bigint", "$.prompt_tokens", "$.input_tokens")
    completion = number("bigint", "$.completion_tokens", "$.output_tokens")
    reasoning = number("bigint", "$.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens")
    actual = number("double", "$.actual_cost_usd", "$.cost_usd", "$.cost")
    estimated = number("double", "$.estimated_cost_usd", "$.response_cost")
    return [
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), reasoning.alias("reasoning_tokens"),
        number("bigint", "$.cache_read_tokens", "$.cached_tokens", "$.prompt_tokens_details.cached_tokens").alias("cache_read_tokens"),
        number("bigint", "$.cache_write_tokens").alias("cache_write_tokens"),
        F.coalesce(number("bigint", "$.total_tokens"), prompt + completion + F.coalesce(reasoning, F.lit(0))).alias("total_tokens"),
        F.coalesce(actual, estimated).alias("cost_usd"),
        F.when(actual.isNotNull(), "actual").when(estimated.isNotNull(), "estimated").otherwise("unavailable").alias("cost_kind")]


def normalize_usage(records: DataFrame) -> DataFrame:
    """Usage fields from mixed JSON shapes: aliases, detail sub-objects, derived total, actual before estimated cost.

    ``records``: record_id, body.
    """
    return records.select("record_id", *_usage_fields(F.try_parse_json("body")))


USAGE_PLACES = (
    "$.usage", "$.token_usage", "$.usage_metadata", "$.response.usage", "$.response.token_usage", "$.response.usage_metadata",
    "$.response._hidden_params", "$._hidden_params")


def record_usage(records: DataFrame) -> DataFrame:
    """Usage of whole call records, whose usage objects may lie in the record, its response or hidden parameters.

    ``records``: record_id, body.  Each field is taken from the first place that
    has it, the kind of the cost from the first place there is; a cost of the
    record itself comes before all.  Records without tokens and cost give no row.
    """
    v = F.try_parse_json("body")
    objects = F.filter(F.array(*[F.try_variant_get(v, p, "variant") for p in USAGE_PLACES]),
                       lambda c: F.coalesce(F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), F.lit(False)))
    found = records.select(
        "record_id", _number(v, "double", "$.actual_cost_usd").alias("_exact"), _number(v, "double", "$.cost_usd", "$.cost").alias("_near"),
        F.transform(objects, lambda c: F.struct(*_usage_fields(c))).alias("_found"))
    field = lambda name: F.get(F.filter(F.transform("_found", lambda u: u[name]), lambda x: x.isNotNull()), F.lit(0))
    usage = found.select(
        "record_id", *[field(name).alias(name) for name in TOKEN_FIELDS],
        F.coalesce("_exact", "_near", field("cost_usd")).alias("cost_usd"),
        F.when(F.col("_exact").isNotNull(), "actual").when(F.col("_near").isNotNull(), "estimated").otherwise(
            F.coalesce(F.get("_found", F.lit(0))["cost_kind"], F.lit("unavailable"))).alias("cost_kind"))
    return usage.where(F.coalesce("prompt_tokens", "completion_tokens", "total_tokens").isNotNull() | F.col("cost_usd").isNotNull())


def estimate_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Fill missing costs from a price list keyed by model or by its name after the first slash.

    ``usage``: model, prompt/completion/cache tokens, cost_usd, cost_kind;
    ``prices``: model, input, output, cache_read, cache_write (per million).
    """
    listed = lambda tag, key: prices.select(F.col("model").alias(key), *[F.col(c).alias(f"{tag}{c}") for c in ("input", "output", "cache_read", "cache_write")])
    short = F.when(F.contains(F.col("model"), F.lit("/")), F.expr("substring(model, instr(model, '/') + 1)"))
    joined = usage.withColumn("_short", short).join(listed("a_", "model"), "model", "left").join(listed("b_", "_short"), "_short", "left")
    own = F.col("a_input").isNotNull() | F.col("a_output").isNotNull()
    rate = lambda c: F.when(own, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    uncached = F.greatest(F.lit(0), zero("prompt_tokens") - zero("cache_read_tokens") - zero("cache_write_tokens"))
    cost = (
        uncached * rate("input") + zero("cache_read_tokens") * F.coalesce(rate("cache_read"), rate("input"))
        + zero("cache_write_tokens") * F.coalesce(rate("cache_write"), rate("input")) + zero("completion_tokens") * rate("output")
    ) / 1_000_000
    used = F.coalesce("prompt_tokens", "completion_tokens", "total_tokens").isNotNull()
    fill = F.col("cost_usd").isNull() & used & rate("input").isNotNull() & rate("output").isNotNull()
    return joined.select(
        *[c for c in usage.columns if c not in ("cost_usd", "cost_kind")],
        F.when(fill, F.bround(cost, 8)).otherwise(F.col("cost_usd")).alias("cost_usd"),
        F.when(fill, "estimated").otherwise(F.col("cost_kind")).alias("cost_kind"))


def stage_breakdown(calls: DataFrame) -> DataFrame:
    """Tokens and cost per model and stage with totals per model and overall (a rollup)."""
    return calls.rollup("model", "stage").agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost_units").alias("cost_units"))


def span_funnel(spans: DataFrame, raw: DataFrame, citing: DataFrame) -> DataFrame:
    """Raw candidates, grounded candidates and final claims citing, per span.

    ``raw``: paper_id, span_id, kept (bool); ``citing``: paper_id, span_id, claim_id.
    """
    keys = ["paper_id", "span_id"]
    counts = raw.groupBy(*keys).agg(F.count("*").alias("raw"), F.count(F.when(F.col("kept"), 1)).alias("grounded"))
    cited = citing.groupBy(*keys).agg(F.count_distinct("claim_id").alias("citing"))
    return spans.select(*keys).join(counts, keys, "left").join(cited, keys, "left").na.fill(0)


def claim_export(claims: DataFrame, sections: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """One flat row per claim with its section and linked evidence.

    ``links``: paper_id, claim_id, link_pos, evidence_id; the summary names the
    first three records and counts the rest.
    """
    keys = ["paper_id", "claim_id"]
    once = links.groupBy(*keys, "evidence_id").agg(F.min("link_pos").alias("link_pos"))
    named = once.join(evidence.select("paper_id", "evidence_id", "summary"), ["paper_id", "evidence_id"], "left")
    lists = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("link_pos", "evidence_id", "summary"))).alias("_l"))
    known = F.filter("_l", lambda x: x["summary"].isNotNull())
    shown = F.filter(F.transform(F.slice(known, 1, 3), lambda x: X.strip(x["summary"])), lambda s: s != "")
    more = F.when(F.size(known) > 3, F.array(F.concat(F.lit("... (+"), (F.size(known) - 3).cast("string"), F.lit(" more)")))).otherwise(
        F.array().cast("array<string>"))
    joined = claims.join(sections, keys, "left").join(lists, keys, "left")
    return joined.select(
        *keys, "statement", "section_name",
        F.coalesce(F.array_join(F.transform("_l", lambda x: x["evidence_id"]), "; "), F.lit("")).alias("linked_evidence_ids"),
        F.greatest(F.size(F.coalesce(known, F.array().cast(
            "array<struct<link_pos:int,evidence_id:string,summary:string>>"))), F.lit(0)).alias("linked_evidence_count"),
        F.coalesce(F.array_join(F.concat(shown, more), " | "), F.lit("")).alias("linked_evidence_summary"),
        F.to_json(F.coalesce(F.transform("_l", lambda x: x["evidence_id"]), F.array().cast("array<string>"))).alias("evidence_json"))


def contestant_matrix(scores: DataFrame, contestants: list[str]) -> DataFrame:
    """Papers by contestants; the column list is given, so the pivot needs no extra job."""
    return scores.groupBy("paper_id").pivot("contestant", contestants).agg(F.max("score"))


def paper_leaders(scores: DataFrame, mine: str) -> DataFrame:
    """Best contestant (first on ties), own score and mean per paper."""
    return scores.groupBy("paper_id").agg(
        F.max("score").alias("best_score"), F.min_by("contestant", F.struct((-F.col("score")).alias("s"), "contestant")).alias("best"),
        F.max(F.when(F.col("contestant") == mine, F.col("score"))).alias("mine"),
        N.ratio(F.sum(score_units(F.col("score"))), F.count("*") * 10000).alias("average"), F.count("*").alias("n"))


def filter_claims(claims: DataFrame, importance: str = "all", verdict: str = "all", text: str = "") -> DataFrame:
    out = claims
    if importance != "all":
        out = out.where(F.coalesce("importance", F.lit("unknown")) == importance)
    if verdict != "all":
        out = out.where(F.coalesce("verdict", F.lit("n/a")) == verdict)
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "claim_id", "statement", "conditions")), F.lit(text.lower())))
    return out


def lost_candidates(candidates: DataFrame, used: DataFrame, dropped: DataFrame) -> DataFrame:
    """Candidates neither used by a claim nor dropped on purpose."""
    keys = ["paper_id", "candidate_id"]
    return candidates.join(used.select(*keys).distinct(), keys, "left_anti").join(dropped.select(*keys).distinct(), keys, "left_anti")


def merge_rows(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Claims with more than one known member, and how many."""
    known = members.join(candidates.select("paper_id", "candidate_id").distinct(), ["paper_id", "candidate_id"], "left_semi")
    return known.groupBy("paper_id", "claim_key").agg(F.count("*").alias("members")).where("members > 1")


def claim_inspector(claims: DataFrame, evidence: DataFrame, experiments: DataFrame, quotes: DataFrame, findings: DataFrame) -> DataFrame:
    """Everything attached to a claim, as counts and ordered ids.

    The side tables are keyed paper_id, claim_id with evidence_id / experiment_id
    / span_id, quote / code.
    """
    keys = ["paper_id", "claim_id"]
    ids = lambda df, c, name: df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name))
    spans = quotes.groupBy(*keys).agg(F.count_distinct("span_id").alias("quoted_spans"), F.count("*").alias("quotes"))
    out = claims.join(ids(evidence, "evidence_id", "evidence_ids"), keys, "left").join(ids(experiments, "experiment_id", "experiment_ids"), keys, "left")
    return out.join(spans, keys, "left").join(ids(findings, "code", "finding_codes"), keys, "left").na.fill(0, ["quoted_spans", "quotes"]).na.fill(
        "", ["evidence_ids", "experiment_ids", "finding_codes"])


def throughput(rows: DataFrame, papers: int = 50, workers: int = 8) -> DataFrame:
    """Mean and slowest seconds of completed rows and the projected minutes for a batch."""
    done = F.col("status") == "completed"
    mean = F.sum(F.when(done, F.col("seconds"))) / F.greatest(F.count(F.when(done, 1)), F.lit(1))
    return rows.agg(
        F.count("*").alias("rows"), F.count(F.when(done, 1)).alias("completed"), mean.alias("avg_seconds"),
        F.coalesce(F.max(F.when(done, F.col("seconds"))), F.lit(0)).alias("slowest_seconds"), (mean * papers / workers / 60).alias("projected_minutes"))


def quality_bands(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("band", X.quality_band(F.col(column)))


def latest_open(runs: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The latest ``n`` runs and the agenda items not done."""
    return runs.orderBy(F.col("updated_at").desc(), "run_name").limit(n), items.where(F.col("status") != "done")


def task_results(papers: DataFrame) -> DataFrame:
    """Completed and failed counts per task beside its papers; failures stay as rows.

    ``papers``: task_id, batch_id, run_id, paper_id, payload, error.
    """
    per_task = papers.groupBy("task_id").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("completed"), F.count("error").alias("failed"))
    scope = F.coalesce(F.nullif(F.col("batch_id"), F.lit("")), F.col("run_id"))
    return papers.join(per_task, "task_id").select(
        "task_id", "paper_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"),
        F.octet_length("payload").alias("artifact_bytes"), F.sha2("payload", 256).alias("artifact_sha256"),
        X.stable_id("artifact", scope, F.col("paper_id")).alias("artifact_id"), "completed", "failed")
