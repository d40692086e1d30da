"""Quotes located in their spans, candidates verified against their quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.operators.fuzzy import fuzzy_locator
from attesta.session import cut_lineage
from attesta.settings import CLAIMS, ClaimSettings


BLANKS = (
    "\t", "\n", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0", "\u1680", *[chr(c) for c in range(0x2000, 0x200B)],
    "\u2028", "\u2029", "\u202f", "\u205f", "\u3000",
)


def offsets(text: Column) -> Column:
    """Array: source position of every character of ``normalize_quote(text)``.

    Each character is paired with its predecessor by one ``zip_with``, so the
    whole map is linear in the text.
    """
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.concat(F.array(F.lit(" ")), chars), lambda c, p: F.struct(c.alias("c"), p.alias("p")))
    placed = F.transform(pairs, lambda s, i: F.struct(s["c"].alias("c"), s["p"].alias("p"), (i + 1).alias("at")))
    kept = F.filter(placed, lambda s: s["c"].isNotNull() & ~(s["c"].isin(*BLANKS) & s["p"].isin(*BLANKS)))
    wide = [source for source, _ in fv.QUOTE_EXPANSIONS]
    return F.flatten(F.transform(kept, lambda s: F.when(s["c"].isin(*wide), F.array(s["at"], s["at"])).otherwise(F.array(s["at"]))))


def _with_piece(df: DataFrame, needed: Column, first: Column, last: Column) -> DataFrame:
    """Add ``_piece``: the source substring behind normalised positions first..last (1-based, inclusive)."""
    mapped = df.withColumn("_map", F.when(needed, offsets(F.col("_span")))).withColumn("_from", F.get("_map", first - 1))
    return mapped.withColumn("_piece", F.substring(F.col("_span"), F.col("_from"), F.get("_map", last - 1) - F.col("_from") + 1))


def locate_quotes(
    quotes: DataFrame, spans: DataFrame, settings: ClaimSettings = CLAIMS, min_chars: int | None = None, fuzzy: bool = True,
    sure: float | None = None,
) -> DataFrame:
    """Add method (exact, normalized, fuzzy, failed), similarity and the located source text.

    ``quotes`` has paper_id, span_id, quote and any key columns; ``spans`` has
    paper_id, span_id, text.  Only texts that miss the first two stages are
    handed to Python; the others go there as nulls.  ``sure`` is the similarity
    that the caller asks for in the end: a quote with one edited character that
    has it is then found whole, even where the fuzzy stage alone finds less of it.
    """
    least = settings.min_quote_chars if min_chars is None else min_chars
    texts = spans.select("paper_id", "span_id", F.col("text").alias("_span"))
    columns = quotes.columns
    # Texts are spread by span before they meet; each is normalised once, in the one pass that all three stages share.
    spread = quotes.repartition("paper_id", "span_id") if fuzzy else quotes
    joined = spread.join(texts, ["paper_id", "span_id"], "left").withColumn("_quote", X.strip("quote"))
    usable = F.col("_span").isNotNull() & (F.length("_quote") >= least)
    exact = usable & F.contains("_span", "_quote")
    staged = joined.withColumn(
        "_stage", F.when(~usable, "failed").when(exact, "exact").otherwise("open")
    ).withColumn("_norm", F.when(F.col("_stage") == "open", X.normalize_quote("_span"))).withColumn(
        "_want", F.when(F.col("_stage") == "open", X.normalize_quote("_quote"))
    ).withColumn("_at", F.when((F.col("_stage") == "open") & (F.col("_want") != ""), F.instr("_norm", F.col("_want"))).otherwise(0))
    first, last = F.col("_at"), F.col("_at") + F.length("_want") - 1
    method = F.when(F.col("_at") > 0, "normalized")
    similarity = F.lit(1.0)
    if fuzzy:
        missed = (F.col("_stage") == "open") & (F.col("_at") == 0)
        find = fuzzy_locator(settings.min_fuzzy_ratio, least, sure)
        staged = staged.withColumn("_hit", find(F.when(missed, F.col("_norm")), F.when(missed, F.col("_want"))))
        hit = F.col("_hit.start").isNotNull()
        first, last = F.when(hit, F.col("_hit.start") + 1).otherwise(first), F.when(hit, F.col("_hit.stop")).otherwise(last)
        method, similarity = method.when(hit, "fuzzy"), F.coalesce(F.col("_hit.similarity"), similarity)
    method = method.when(F.col("_stage") == "open", "failed").otherwise(F.col("_stage"))
    found = _with_piece(staged.withColumn("_method", method), F.col("_method").isin("normalized", "fuzzy"), first, last)
    return found.select(
        *columns, F.col("_method").alias("method"), F.when(F.col("_method") != "failed", similarity).alias("similarity"),
        F.when(F.col("_method") == "exact", F.col("_quote")).when(F.col("_method") != "failed", F.col("_piece")).alias("located"),
    )


def quote_in_span(text: Column, quote: Column) -> Column:
    return (quote != "") & (F.contains(text, quote) | F.contains(X.normalize_quote(text), X.normalize_quote(quote)))


def cut_quote(located: Column, settings: ClaimSettings = CLAIMS) -> Column:
    """A located quote is a substring of its span, and so is its head."""
    return F.left(located, F.lit(settings.max_quote_chars))


def verify_candidates(
    proposals: DataFrame, quotes: DataFrame, spans: DataFrame, settings: ClaimSettings = CLAIMS, fuzzy: bool = True
) -> DataFrame:
    """Proposals with their grounded quotes and a route: kept, repair or dropped.

    ``proposals``: paper_id, candidate_id, span_id, statement, conditions,
    claim_type, status, importance; ``quotes``: paper_id, candidate_id, span_id,
    quote_pos, quote, role.
    """
    keys = ["paper_id", "candidate_id"]
    statement = X.collapse_ws("statement")
    clean = proposals.withColumn("statement", statement).withColumn("conditions", X.collapse_ws("conditions"))
    early = F.when(F.length("statement") < 20, "empty_statement").when(
        X.is_boilerplate_wording("statement") & (F.size(N.numbers_in(F.col("statement"))) == 0), "boilerplate_statement")
    checked = clean.withColumn("_early", early)
    wanted = quotes.join(checked.where(F.col("_early").isNull()).select(*keys), keys, "left_semi").withColumn("quote", X.collapse_ws("quote"))
    located = locate_quotes(wanted, spans, settings, fuzzy=fuzzy).where(F.col("method") != "failed")
    role = F.lower(X.strip("role"))
    kept = located.select(
        *keys, "quote_pos", cut_quote(F.col("located"), settings).alias("quote"),
        F.when(role.isin(*fv.ROLE_VALUES), role).otherwise(fv.DEFAULT_ROLE).alias("role"), "method")
    distinct = kept.groupBy(*keys, "quote").agg(F.min("quote_pos").alias("quote_pos"), F.min_by("role", "quote_pos").alias("role"))
    lists = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("quote_pos", "quote", "role"))).alias("quotes"))
    joined = checked.join(lists, keys, "left")
    texts = F.transform(F.coalesce("quotes", F.array().cast("array<struct<quote_pos:int,quote:string,role:string>>")), lambda x: x["quote"])
    missing = N.ungrounded_numbers(F.concat_ws(" ", "statement", "conditions"), texts)
    reason = F.coalesce(
        F.col("_early"),
        F.when(F.col("quotes").isNull(), "no_grounded_quote"),
        F.when(F.size("missing_numbers") > 0, "ungrounded_numbers"),
    )
    return (
        joined.withColumn("missing_numbers", F.when(F.col("_early").isNull() & F.col("quotes").isNotNull(), missing))
        .withColumn("reason", reason)
        .select(
            *keys, "span_id", "statement",
            F.when(F.col("conditions") == "", fv.NOT_AVAILABLE).otherwise(F.col("conditions")).alias("conditions"),
            X.pick("claim_type", fv.CLAIM_TYPE_VALUES, "comparative_finding").alias("claim_type"),
            X.pick("status", fv.STATUS_VALUES, "supported").alias("status"),
            X.pick("importance", fv.IMPORTANCE_VALUES, "supporting").alias("importance"),
            "quotes", "missing_numbers", "reason",
            F.when(F.col("reason").isNull(), "kept").when(F.col("reason") == "ungrounded_numbers", "repair").otherwise("dropped").alias("route"),
        )
    )


def repair_pass(repaired: DataFrame, quotes: DataFrame, spans: DataFrame, settings: ClaimSettings = CLAIMS, fuzzy: bool = True) -> DataFrame:
    """Verify supplied repaired rows again; only fully grounded ones stay, flagged ``repaired``."""
    again = verify_candidates(repaired, quotes, spans, settings, fuzzy)
    return again.where("route = 'kept'").withColumn("repaired", F.lit(True))


def grounding_report(verified: DataFrame, located: DataFrame) -> DataFrame:
    """Counts per span: quotes by method, candidates by route."""
    methods = located.groupBy("paper_id", "span_id").agg(
        *[F.count(F.when(F.col("method") == m, 1)).alias(f"n_{m}") for m in ("exact", "normalized", "fuzzy", "failed")])
    routes = verified.groupBy("paper_id", "span_id").agg(
        F.count("*").alias("raw"), *[F.count(F.when(F.col("route") == r, 1)).alias(r) for r in ("kept", "repair", "dropped")])
    return routes.join(methods, ["paper_id", "span_id"], "full").na.fill(0)


SURE = 0.999    # similarity that the final guard asks of a fuzzy quote


def guard_quotes(sources: DataFrame, spans: DataFrame, settings: ClaimSettings = CLAIMS) -> DataFrame:
    """Final guard: quotes must relocate; a claim keeps its old list if none of them does.

    ``sources`` has paper_id, claim_id, pos, span_id, quote, role.
    """
    located = locate_quotes(sources, spans, settings, min_chars=1, sure=SURE).withColumn(
        "_good", (F.col("method") != "failed") & ((F.col("method") != "fuzzy") | (F.col("similarity") >= SURE)))
    any_good = located.groupBy("paper_id", "claim_id").agg(F.bool_or("_good").alias("_any"))
    return located.join(any_good, ["paper_id", "claim_id"]).where(F.col("_good") | ~F.col("_any")).select(
        "paper_id", "claim_id", "pos", "span_id",
        F.when(F.col("_good"), F.col("located")).otherwise(F.col("quote")).alias("quote"), "role", F.col("_good").alias("verified"))


def verified_refs(wanted: DataFrame, spans: DataFrame, settings: ClaimSettings = CLAIMS, fuzzy: bool = True) -> DataFrame:
    """First valid span where the quote is found, else the first valid span without a quote.

    ``wanted`` has paper_id, ref_key, span_pos, span_id, quote (one row per span id).
    """
    valid = wanted.join(spans.select("paper_id", "span_id").distinct(), ["paper_id", "span_id"], "left_semi")
    located = locate_quotes(valid, spans, settings, fuzzy=fuzzy)
    order = F.struct((F.col("method") == "failed").alias("miss"), "span_pos")
    value = F.struct("span_id", cut_quote(F.col("located"), settings).alias("quote"))
    return located.groupBy("paper_id", "ref_key").agg(F.min_by(value, order).alias("_v")).select("paper_id", "ref_key", "_v.*")


def occurrences(spans: DataFrame, quotes: DataFrame, min_chars: int = 8) -> DataFrame:
    """Every non-overlapping normalised occurrence of a quote in its span as [start, stop).

    Splitting the normalised text at the quote gives the pieces between the
    occurrences, so their starts are running lengths.
    """
    texts = spans.select("paper_id", "span_id", F.lower(X.collapse_ws("text")).alias("_norm"))
    wanted = quotes.select("paper_id", "span_id", F.lower(X.collapse_ws("quote")).alias("_q")).where(F.length("_q") >= min_chars).distinct()
    joined = wanted.join(texts, ["paper_id", "span_id"]).where(F.contains("_norm", "_q"))
    literal = F.concat(F.lit("\\Q"), F.replace("_q", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = joined.withColumn("_pieces", F.transform(F.split("_norm", literal, -1), F.length))
    starts = F.transform(
        F.sequence(F.lit(1), F.size("_pieces") - 1),
        lambda k: F.aggregate(F.slice("_pieces", F.lit(1), k), F.lit(0), lambda acc, n: acc + n) + (k - 1) * F.length("_q"),
    )
    return pieces.select("paper_id", "span_id", F.explode(starts).alias("start"), F.length("_q").alias("_n")).select(
        "paper_id", "span_id", "start", (F.col("start") + F.col("_n")).alias("stop"))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a span merged; a span's text bounds the group."""
    from pyspark.sql import Window as W

    order = W.partitionBy("paper_id", "span_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = intervals.distinct().withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("paper_id", "span_id", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def find_passages(spans: DataFrame, passages: DataFrame, size: int = 8, gram: int = 6) -> DataFrame:
    """Which spans contain which passages (normalised), when the span is unknown.

    The first and last word of a passage may be parts of words in the span, but
    the words between stand there whole: windows of up to ``size`` of them are
    the keys.  A passage without inner words is keyed by windows of up to
    ``gram`` characters.  A passage is looked up by its *rarest* window only
    (rarity counted over the spans), and ``contains`` verifies the hit.

    ``passages`` has passage_id, text.
    """
    wanted = passages.select("passage_id", X.normalize_quote("text").alias("_p")).where("_p <> ''").withColumn(
        "_inner", F.split("_p", " ")).withColumn("_inner", F.slice("_inner", F.lit(2), F.greatest(F.size("_inner") - 2, F.lit(0))))
    # negative lengths count characters; windows are hashed, as a key only proposes a span and the text decides
    length = F.when(F.size("_inner") > 0, F.least(F.size("_inner"), F.lit(size))).otherwise(-F.least(F.length("_p"), F.lit(gram)))
    wanted = wanted.withColumn("_k", length)

    def windows(words: Column, text: Column, k: Column) -> Column:
        of_words = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))
        of_chars = F.transform(F.sequence(F.lit(1), F.length(text) + k + 1), lambda i: F.xxhash64(F.substring(text, i, -k)))
        fits = F.when(k > 0, F.size(words) >= k).otherwise(F.length(text) >= -k)
        return F.when(fits, F.array_distinct(F.when(k > 0, of_words).otherwise(of_chars)))

    keys = wanted.select("passage_id", "_k", F.explode(windows(F.col("_inner"), F.col("_p"), F.col("_k"))).alias("_key"))
    needed = wanted.agg(F.array_sort(F.collect_set("_k"))).scalar()      # at most size + gram lengths
    texts = spans.select("paper_id", "span_id", X.normalize_quote("text").alias("_n")).where("_n <> ''")
    words = texts.withColumn("_words", F.split("_n", " ")).withColumn("_k", F.explode(needed))
    grams = words.select("paper_id", "span_id", "_k", F.explode(windows(F.col("_words"), F.col("_n"), F.col("_k"))).alias("_key"))
    live = cut_lineage(grams.join(keys.select("_k", "_key").distinct(), ["_k", "_key"], "left_semi"))
    frequency = live.groupBy("_k", "_key").agg(F.count("*").alias("_f"))
    rarest = keys.join(frequency, ["_k", "_key"], "left").groupBy("passage_id", "_k").agg(
        F.min_by("_key", F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "_key")).alias("_key"))
    hits = live.join(rarest, ["_k", "_key"]).select("paper_id", "span_id", "passage_id")
    checked = hits.join(wanted.select("passage_id", "_p"), "passage_id").join(texts, ["paper_id", "span_id"])
    return checked.where(F.contains("_n", "_p")).select("paper_id", "span_id", "passage_id")
