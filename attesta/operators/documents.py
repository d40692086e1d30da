"""Documents to spans to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import text as T
from attesta.operators.frames import ordinal, previous, running_total, top_rows
from attesta.session import cut_lineage
from attesta.settings import CLAIMS

BLANK_LINE = r"\n\s*\n"


def _pack(paragraphs: Column, max_chars: int, count_separator_always: bool) -> Column:
    """Greedy packing as one ordered fold inside the row: a paragraph joins while it fits.

    ``count_separator_always`` charges two separator characters for every
    paragraph, the first included; otherwise the real joined length counts.
    """
    start = F.struct(
        F.lit("").alias("cur"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("done")
    )

    def step(acc: Column, paragraph: Column) -> Column:
        full = (acc["used"] > 0) & (
            acc["used"] + F.length(paragraph) + 2 > max_chars
        )
        extra = F.length(paragraph) + 2 if count_separator_always else F.length(paragraph)
        joined = F.when(acc["used"] > 0, F.concat(acc["cur"], F.lit("\n\n"), paragraph)).otherwise(paragraph)
        grown = (
            acc["used"] + extra
            if count_separator_always
            else F.when(acc["used"] > 0, acc["used"] + 2 + extra).otherwise(extra)
        )
        return F.when(
            full,
            F.struct(
                paragraph.alias("cur"),
                extra.cast("int").alias("used"),
                F.concat(acc["done"], F.array(acc["cur"])).alias("done"),
            ),
        ).otherwise(F.struct(joined.alias("cur"), grown.cast("int").alias("used"), acc["done"].alias("done")))

    def finish(acc: Column) -> Column:
        return F.when(acc["used"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(paragraphs, start, step, finish)


def ingest_chunks(text: Column, max_chars: int = CLAIMS.ingest_chunk_chars, separator: str = BLANK_LINE) -> Column:
    """Stripped non-empty paragraphs packed into chunks; never an empty result."""
    paragraphs = F.filter(F.transform(F.split(text, separator), T.strip), lambda p: p != "")
    chunks = _pack(paragraphs, max_chars, True)
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.left(text, F.lit(max_chars))))


def split_parts(text: Column, max_chars: int = CLAIMS.max_span_chars, separator: str = BLANK_LINE) -> Column:
    """Unstripped paragraphs packed by real joined length."""
    parts = _pack(F.split(text, separator), max_chars, False)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def chunk_spans(docs: DataFrame, id_col: str, text_col: str, max_chars: int = CLAIMS.ingest_chunk_chars,
                separator: str = BLANK_LINE) -> DataFrame:
    """One span per packed chunk, numbered from 1."""
    paper = F.col(id_col).cast("string")
    return docs.select(
        paper.alias("paper_id"), F.posexplode(ingest_chunks(F.col(text_col), max_chars, separator)).alias("_i", "text")
    ).select(
        "paper_id",
        (F.col("_i") + 1).alias("pos"),
        F.format_string("%s-span-%04d", F.col("paper_id"), F.col("_i") + 1).alias("span_id"),
        F.concat(F.lit("Chunk "), (F.col("_i") + 1).cast("string")).alias("section_name"),
        F.lit("OTHER").alias("section_type"),
        "text",
    )


def span_jobs(spans: DataFrame, max_chars: int = CLAIMS.max_span_chars, separator: str = BLANK_LINE) -> DataFrame:
    """Spans over the limit become several part rows; the others stay part 0."""
    parts = F.when(F.length("text") <= max_chars, F.array("text")).otherwise(
        split_parts(F.col("text"), max_chars, separator)
    )
    keep = [c for c in spans.columns if c != "text"]
    return spans.select(*keep, F.posexplode(parts).alias("part", "text"))


def truncate_spans(spans: DataFrame, max_chars: int) -> DataFrame:
    """Keep spans in order until ``max_chars`` characters are used, cutting the last one.

    Characters trimmed from the cut end are given back, so later spans may use
    them.  Rows before the first overflow are exact prefix sums (two-level, so a
    huge paper stays distributed); only the overflowing span and the few spans
    that can share its given-back characters are folded.
    """
    sized = spans.withColumn("_len", F.length("text"))
    summed = running_total(sized, ["paper_id"], ["pos"], "_len", "_before")
    whole = summed.where(F.col("_before") + F.col("_len") <= max_chars)
    over = summed.where((F.col("_before") + F.col("_len") > max_chars))
    # Where does the paper overflow first, and how much of the budget is left there?
    cut = over.groupBy("paper_id").agg(F.min("pos").alias("_cut"), F.min_by("_before", "pos").alias("_used"))
    fits = whole.join(cut, "paper_id", "left").where(
        F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))
    ).where(F.col("_len") > 0).select(*spans.columns)
    # After the cut at most (remaining) characters can still be used, one or more per non-blank span.
    tail = (
        summed.join(cut, "paper_id")
        .where((F.col("pos") >= F.col("_cut")) & (F.col("_used") < max_chars))
        .withColumn("_left", F.lit(max_chars) - F.col("_used"))
        .withColumn("_piece", F.regexp_replace(F.expr("left(text, _left)"), r"(?U)\s+$", ""))
    )
    # Each step spends the trimmed length of its piece; iterate only while something was given back.
    first = tail.where(F.col("pos") == F.col("_cut")).withColumn("text", F.col("_piece"))
    back = first.select("paper_id", (F.col("_left") - F.length("_piece")).alias("_back"), F.col("_cut").alias("_from"))
    # Every span that starts with a visible character spends at least one, so at most ``_back`` of them matter.
    later = (
        tail.join(back.where(F.col("_back") > 0), "paper_id")
        .where(F.col("pos") > F.col("_from"))
        .withColumn("_solid", F.col("text").rlike(r"(?U)^\S").cast("int"))
    )
    later = running_total(later, ["paper_id"], ["pos"], "_solid", "_spent").where(F.col("_spent") < F.col("_back"))
    later = later.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*spans.columns).alias("row")))).alias("_rows"),
        F.first("_back").alias("_back"),
    )
    fold_type = f"struct<left:int,kept:array<{_struct_type(spans)}>>"

    def spend(acc: Column, item: Column) -> Column:
        row = item["row"]
        piece = F.regexp_replace(F.substring(row["text"], F.lit(1), acc["left"]), r"(?U)\s+$", "")
        cut_row = F.struct(*[(piece if c == "text" else row[c]).alias(c) for c in spans.columns])
        return F.when(
            (acc["left"] > 0) & (piece != ""),
            F.struct((acc["left"] - F.length(piece)).alias("left"), F.concat(acc["kept"], F.array(cut_row)).alias("kept")),
        ).otherwise(acc)

    start = F.struct(F.col("_back").cast("int").alias("left"), F.array().alias("kept")).cast(fold_type)
    extra = later.select(F.explode(F.aggregate("_rows", start, spend, lambda acc: acc["kept"])).alias("_row")).select("_row.*")
    return fits.unionByName(first.where(F.col("text") != "").select(*spans.columns)).unionByName(extra)


def _struct_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def title_assessment(name: Column, section_type: Column) -> Column:
    """Struct (name, type, reliable, quality, reason) by the first rule that applies."""
    clean_type = T.collapse_ws(section_type)
    kind = F.when(clean_type == "", "OTHER").otherwise(clean_type)
    given = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(
        F.when(F.coalesce(section_type, F.lit("")) != "", section_type).otherwise(F.lit("Unlabeled Section"))
    )
    title = T.collapse_ws(given)
    words = T.word_count(title)
    letters = F.length(F.regexp_replace(title, "[^A-Za-z]", ""))
    reason = (
        F.when((title == "") | (title == "Unlabeled Section"), "missing_section_name")
        .when(F.length(title) <= 3, "section_name_too_short")
        .when(letters < 3, "insufficient_alphabetic_content")
        .when((words == 1) & (F.length(title) <= 4), "single_short_token_header")
        .when(words > 12, "section_name_too_long")
        .when((kind == "OTHER") & (words == 1) & (title == F.upper(title)) & (title != F.lower(title)),
              "all_caps_single_token_other_header")
        .when((kind == "OTHER") & F.lower(title).isin(*fv.NOISY_HEADERS), "generic_or_noisy_other_header")
        .otherwise("trusted_header")
    )
    return F.struct(
        F.when(title == "", "Unlabeled Section").otherwise(title).alias("name"),
        kind.alias("type"),
        (reason == "trusted_header").alias("reliable"),
        F.when(reason == "trusted_header", "high").otherwise("low").alias("quality"),
        reason.alias("reason"),
    )


def section_runs(spans: DataFrame) -> DataFrame:
    """Mark runs of consecutive spans with the same (reliable, type, name) key; texts are left out."""
    title = title_assessment(F.col("section_name"), F.col("section_type"))
    slim = spans.select("paper_id", "pos", "span_id", "page", F.length("text").alias("_len"), title.alias("_title"))
    slim = slim.withColumn("_key", F.concat_ws("\u0001", F.col("_title.reliable").cast("string"), "_title.type", "_title.name"))
    marked = previous(slim, ["paper_id"], "pos", "_key", "_prev").withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("_key")), 1).otherwise(0)
    ).drop("_prev", "_key")
    numbered = running_total(marked, ["paper_id"], ["pos"], "_start", "_run")
    return numbered.withColumn("_run", F.col("_run") + F.col("_start")).drop("_start")


def fallback_chunks(runs: DataFrame, max_chars: int, max_spans: int, slot: int = 1024) -> DataFrame:
    """Cut unreliable runs into chunks of at most ``max_spans`` spans and ``max_chars`` characters.

    Where a chunk begins depends on where the last one did, so this is a fold in
    span order; but a run may hold much of the table, so it is cut into slots of
    positions.  A chunk open at a slot's start takes at most ``max_spans - 1`` of
    its spans.  Each slot works out its closing state for each such number, the
    run then only chains these few states slot by slot, and every slot finishes
    on its own.  Only positions and lengths take part, never texts.
    """
    loose = runs.where(~F.col("_title.reliable")).withColumn("_slot", F.floor(F.col("pos") / slot))
    keys = ["paper_id", "_run", "_slot"]
    slots = loose.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_len").cast("bigint").alias("len")))).alias("_items"))
    state = "struct<n:int,used:bigint,start:int>"
    fresh = F.lit(None).cast("int")
    closed = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), fresh.alias("start")).cast(state)

    def take(acc: Column, item: Column) -> Column:
        opens = (acc["n"] == 0) | (acc["n"] >= max_spans) | (acc["used"] + item["len"] > max_chars)
        return F.when(opens, F.struct(F.lit(1).alias("n"), item["len"].alias("used"), item["pos"].alias("start"))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), (acc["used"] + item["len"]).alias("used"), acc["start"].alias("start"))).cast(state)

    rest = lambda items, taken: F.slice(items, taken + 1, F.size(items))
    ends = F.transform(
        F.sequence(F.lit(0), F.least(F.size("_items"), F.lit(max_spans)) - 1),
        lambda taken: F.aggregate(rest(F.col("_items"), taken), closed, take))
    heads = F.transform(F.slice("_items", 1, max(max_spans - 1, 1)), lambda x: x["len"])
    # Only runs that span several slots need the chain.
    several = slots.groupBy("paper_id", "_run").agg(F.count("*").alias("_n")).where("_n > 1")
    long_runs = slots.join(several, ["paper_id", "_run"], "left_semi")
    summary = long_runs.select(*keys, F.size("_items").alias("size"), heads.alias("heads"), ends.alias("ends"))
    chain = summary.groupBy("paper_id", "_run").agg(F.array_sort(F.collect_list(F.struct("_slot", "size", "heads", "ends"))).alias("_chain"))

    def enter(acc: Column, part: Column) -> Column:
        total = lambda k: F.aggregate(F.slice(part["heads"], F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x)
        fits = F.filter(
            F.sequence(F.lit(1), F.size(part["heads"])),
            lambda k: (acc["open"]["n"] + k <= max_spans) & (acc["open"]["used"] + total(k) <= max_chars))
        taken = F.when(acc["open"]["n"] == 0, 0).otherwise(F.size(fits))
        swallowed = F.struct(
            (acc["open"]["n"] + taken).alias("n"), (acc["open"]["used"] + total(taken)).alias("used"), acc["open"]["start"].alias("start")).cast(state)
        after = F.when(taken >= part["size"], swallowed).otherwise(F.get(part["ends"], taken))
        row = F.struct(part["_slot"].alias("_slot"), taken.alias("taken"), acc["open"]["start"].alias("start"))
        return F.struct(after.alias("open"), F.concat(acc["out"], F.array(row)).alias("out"))

    begin = F.struct(closed.alias("open"), F.array().cast("array<struct<_slot:bigint,taken:int,start:int>>").alias("out"))
    entries = chain.select("paper_id", "_run", F.inline(F.aggregate("_chain", begin, enter, lambda acc: acc["out"])))

    def place(acc: Column, item: Column) -> Column:
        now = take(acc["open"], item)
        return F.struct(now.alias("open"), F.concat(acc["out"], F.array(F.struct(item["pos"].alias("pos"), now["start"].alias("chunk")))).alias("out"))

    first = F.struct(closed.alias("open"), F.array().cast("array<struct<pos:int,chunk:int>>").alias("out"))
    joined = slots.join(entries, keys, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    carried = F.transform(F.slice("_items", F.lit(1), F.col("taken")), lambda x: F.struct(x["pos"].alias("pos"), F.col("start").alias("chunk")))
    own = F.aggregate(rest(F.col("_items"), F.col("taken")), first, place, lambda acc: acc["out"])
    return joined.select("paper_id", F.explode(F.concat(carried, own)).alias("_c")).select(
        "paper_id", F.col("_c.pos").alias("pos"), F.col("_c.chunk").alias("_chunk"))


def section_inventory(
    spans: DataFrame,
    max_chars: int = CLAIMS.fallback_section_max_chars,
    max_spans: int = CLAIMS.fallback_section_max_spans,
) -> DataFrame:
    """Sections of each paper in span order.

    ``spans`` has paper_id, pos, span_id, section_name, section_type, page,
    text.  Placement is worked out on a slim table without texts, which is
    materialised once; the texts join back by (paper, position) at the end.
    """
    runs = cut_lineage(section_runs(spans))
    chunks = fallback_chunks(runs, max_chars, max_spans)
    placed = runs.join(chunks, ["paper_id", "pos"], "left").withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
    texts = spans.select("paper_id", "pos", "text")
    grouped = placed.join(texts, ["paper_id", "pos"]).groupBy("paper_id", "_run", "_chunk").agg(
        F.min("pos").alias("section_pos"),
        F.min_by("_title", "pos").alias("_title"),
        F.min_by("span_id", "pos").alias("first_span_id"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.array_sort(F.collect_list(F.struct("pos", "span_id", "text"))).alias("_spans"),
    )
    # A fallback number is used up even when its chunk turns out to be blank.
    heads = placed.where(F.col("_chunk") > 0).groupBy("paper_id", "_run", "_chunk").agg(F.min("pos").alias("section_pos"))
    loose = ordinal(heads.select("paper_id", "section_pos"), ["paper_id"], ["section_pos"], "_fallback")
    named = grouped.join(loose, ["paper_id", "section_pos"], "left")
    base = F.format_string("fallback_section_%03d", F.col("_fallback"))
    first_page = F.element_at("pages", 1).cast("string")
    last_page = F.element_at("pages", -1).cast("string")
    name = (
        F.when(F.col("_chunk") == 0, F.col("_title.name"))
        .when(F.size("pages") == 0, base)
        .when(F.size("pages") == 1, F.concat(base, F.lit("_page_"), first_page))
        .otherwise(F.concat(base, F.lit("_pages_"), first_page, F.lit("_"), last_page))
    )
    text = T.collapse_ws(
        F.array_join(F.filter(F.transform("_spans", lambda s: s["text"]), lambda t: t != ""), "\n\n")
    )
    full = named.withColumn("section_name", name).withColumn("text", text).where(F.col("text") != "")
    return full.select(
        "paper_id",
        T.stable_id("section", F.col("paper_id"), F.col("_title.type"), F.col("section_name"), F.col("first_span_id")).alias("section_id"),
        "section_pos",
        "section_name",
        F.col("_title.type").alias("section_type"),
        F.when(F.col("_chunk") == 0, "tei_header").otherwise("fallback_chunk").alias("section_source"),
        F.col("_title.quality").alias("title_quality"),
        F.col("_title.name").alias("original_section_name"),
        "pages",
        F.transform("_spans", lambda s: s["span_id"]).alias("span_ids"),
        "text",
        T.word_count("text").alias("token_count"),
        F.length("text").alias("char_count"),
    )


def plan_extraction(sections: DataFrame, summaries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Supplied decision per section, else the result-like heuristic."""
    joined = sections.join(summaries, ["section_id"], "left").join(decisions, ["section_id"], "left")
    heuristic = (
        F.col("section_type").isin(*fv.EXTRACT_SECTION_TYPES)
        & F.coalesce(F.col("section_role").isin(*fv.EXTRACT_SECTION_ROLES), F.lit(False))
        & (F.coalesce("summary_text", F.lit("")) != "")
    )
    return joined.select(
        *[F.col(c) for c in sections.columns],
        F.coalesce("should_extract", heuristic).alias("should_extract"),
        F.when(F.coalesce("decision_reason", F.lit("")) != "", F.col("decision_reason"))
        .when(heuristic, "heuristic_result_like_section")
        .otherwise("section_not_prioritized").alias("reason"),
    )


def abstract_section(sections: DataFrame) -> DataFrame:
    """First section per paper of type ABSTRACT or named "abstract"."""
    hits = sections.where((F.upper("section_type") == "ABSTRACT") | (F.lower(T.strip("section_name")) == "abstract"))
    return hits.groupBy("paper_id").agg(
        F.min_by("section_id", "section_pos").alias("section_id"), F.min("section_pos").alias("section_pos")
    )


def papers_without_abstract(sections: DataFrame) -> DataFrame:
    return sections.select("paper_id").distinct().join(abstract_section(sections), "paper_id", "left_anti")


def section_of_claim(claim_spans: DataFrame, sections: DataFrame) -> DataFrame:
    """Section of the claim's first span that has one; a span belongs to its first section.

    ``claim_spans`` has paper_id, claim_id, ref_pos, span_id.
    """
    spans = sections.select("paper_id", "section_id", "section_name", "section_pos", F.explode("span_ids").alias("span_id"))
    first = spans.groupBy("paper_id", "span_id").agg(
        F.min_by(F.struct("section_id", "section_name"), "section_pos").alias("_section")
    )
    hits = claim_spans.join(first, ["paper_id", "span_id"])
    return hits.groupBy("paper_id", "claim_id").agg(F.min_by("_section", "ref_pos").alias("_section")).select(
        "paper_id", "claim_id", "_section.*"
    )


def override_paper_id(spans: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rename papers and the span ids that start with the old id.

    ``overrides`` has paper_id, new_paper_id; blank new ids change nothing.
    """
    joined = spans.join(overrides, "paper_id", "left")
    new_id = T.strip("new_paper_id")
    changed = (new_id != "") & (new_id != F.col("paper_id"))
    prefixed = F.col("span_id").startswith(F.concat(F.col("paper_id"), F.lit("-")))
    renamed = F.concat(new_id, F.substring(F.col("span_id"), F.length("paper_id") + 1, F.length("span_id")))
    rest = [c for c in spans.columns if c not in ("paper_id", "span_id")]
    return joined.select(
        F.when(changed, new_id).otherwise(F.col("paper_id")).alias("paper_id"),
        F.when(changed & prefixed, renamed).otherwise(F.col("span_id")).alias("span_id"),
        *rest,
    )


def search_spans(spans: DataFrame, query: str, limit: int = 20, width: int = 1200) -> DataFrame:
    """Case-insensitive substring search per paper, first ``limit`` hits each."""
    hits = spans.where(F.contains(F.lower("text"), F.lit(query.lower())))
    best = top_rows(hits, ["paper_id"], [F.col("pos")], limit)
    return best.select("paper_id", "pos", "span_id", F.left("text", F.lit(width)).alias("text"))


def paper_context(spans: DataFrame, excerpt: int = 2500, preview: int = 110) -> DataFrame:
    """First span's excerpt per paper and one preview line per span (kept as rows)."""
    first = spans.groupBy("paper_id").agg(F.min("pos").alias("_first"))
    flat = F.replace(F.left("text", F.lit(preview)), F.lit("\n"), F.lit(" "))
    line = F.concat(
        F.lit("- "), F.col("span_id"), F.lit(" (page "), F.coalesce(F.col("page").cast("string"), F.lit("None")),
        F.lit("): "), flat, F.lit("..."),
    )
    return spans.join(first, "paper_id").select(
        "paper_id", "pos", line.alias("preview"),
        F.when(F.col("pos") == F.col("_first"), F.left("text", F.lit(excerpt))).alias("excerpt"),
    )
