"""Golden cases of the scalar functions that SQL cannot follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.operators.fuzzy import locate
from attesta.operators.grounding import locate_quotes, offsets


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("v")).first()
    return row.v


def test_number_tokens(spark):
    text = "CD8 rose 1,200 to 0.50 (p<1.2 × 10^-3) IL-6 3.4x10-2 -7"
    assert one(spark, N.numbers_in(F.col("t")), t=text) == ["1200", "0.50", "1.2x10^-3", "3.4x10-2", "7"]


def test_ungrounded_numbers(spark):
    expr = N.ungrounded_numbers(F.col("t"), F.array(F.col("q")))
    assert one(spark, expr, t="5 of 1000 with 0.5 and 77", q="five (5) in 1,000 at 0.50") == ["77"]
    assert one(spark, expr, t="no numbers", q="") == []


def test_measurements(spark):
    assert one(spark, N.measurements(F.col("t")), t="2 µM and 5mg/mL, 3 mM; 7mm") == ["2 µM", "5 mg/mL", "3 mM"]
    missing = N.ungrounded_measurements(F.col("t"), X.compact("p"))
    assert one(spark, missing, t="2 mM and 4 nM", p="we used 4 nM and 2 uM") == ["2 mM"]


def test_strip_numbers(spark):
    assert one(spark, N.strip_numbers(F.col("t")), t="given 12 mg (45%) , twice in IL-6 .") == "given mg, twice in IL-6."


def test_rounding_ties_to_even(spark):
    row = spark.sql("select 1 as n").select(
        N.ratio(F.lit(3125), F.lit(100000)).alias("a"), N.ratio(F.lit(9375), F.lit(100000)).alias("b")).first()
    assert (row.a, row.b) == (0.0312, 0.0938)


def test_non_claims(spark):
    assert one(spark, X.is_non_claim("t"), t="Data are available upon request from the authors.")
    assert one(spark, X.is_non_claim("t"), t="Too short")
    assert not one(spark, X.is_non_claim("t"), t="Treated mice lived longer than controls did.")


def test_offsets_cover_the_text(spark):
    text = "  A  ß ﬁn  "
    norm = one(spark, X.normalize_quote("t"), t=text)
    places = one(spark, offsets(F.col("t")), t=text)
    assert norm == "a ss fin"
    assert [text[i - 1] for i in places][: len(norm)] == ["A", " ", "ß", "ß", " ", "ﬁ", "ﬁ", "n"]


def test_locate_quotes(spark):
    span = "The “treated” mice   lived longer than the untreated controls in every cohort we measured."
    quotes = [
        ("p", "s", 0, "lived longer than the untreated controls"),
        ("p", "s", 1, 'the "TREATED" mice lived longer than'),
        ("p", "s", 2, "lived longer then the untreated controls in every cohort"),
        ("p", "s", 3, "an entirely different sentence about something else"),
        ("p", "s", 4, "too short"),
        ("p", "missing", 5, "lived longer than the untreated controls"),
    ]
    spans = spark.createDataFrame([("p", "s", span)], "paper_id string, span_id string, text string")
    rows = spark.createDataFrame(quotes, "paper_id string, span_id string, k int, quote string")
    found = {r.k: r for r in locate_quotes(rows, spans).collect()}
    assert [found[k].method for k in range(6)] == ["exact", "normalized", "fuzzy", "failed", "failed", "failed"]
    assert all(r.located is None or r.located in span for r in found.values())
    assert found[1].located == "The “treated” mice   lived longer than"


def test_fuzzy_matches_definition():
    from difflib import SequenceMatcher

    span = "lived longer than the untreated controls in every cohort we measured"
    quote = "lived longer then the untreated controls in every cohort"
    start, stop, score = locate(span, quote, 0.86, 20)
    window = span[start:stop]
    assert score == round(SequenceMatcher(None, window, quote, autojunk=False).ratio(), 4)


def test_versioned_names(spark):
    expr = X.parse_versioned_name(F.col("n"))
    assert tuple(one(spark, expr, n="paper__run_x")) == ("paper", "x")
    assert tuple(one(spark, expr, n="__run_x")) == ("__run_x", "default")
    assert one(spark, X.versioned_name(F.col("n"), F.lit(" - ")), n="paper") == "paper"
