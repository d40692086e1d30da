"""The registered refs, report and funnel with the fuzzy stage find the quotes with one edited character."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from attesta.plans.registry import runnable
from attesta.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def test_one_edit_quotes_are_found(spark):
    t = Tables(spark, FOLDER)
    edited = t.quote.where("length(trim(quote)) >= 25 and (doc_no + pos) % 4 = 3").select("paper_id", F.col("pos").alias("ref_key"))
    refs = runnable("grd_07b_verified_ref_with_fuzzy")(spark, FOLDER).join(edited, ["paper_id", "ref_key"])
    texts = t.span.select("paper_id", "span_id", "text")
    assert refs.count() == edited.count() > 0
    assert refs.join(texts, ["paper_id", "span_id"]).where("quote is null or not contains(text, quote)").count() == 0
    report = runnable("grd_05b_report_with_fuzzy")(spark, FOLDER).join(refs.select("paper_id", "span_id"), ["paper_id", "span_id"])
    found = report.agg(F.sum("n_fuzzy"), F.sum("n_failed")).first()
    assert found[0] > 0 and found[1] == 0


def test_edited_quotes_need_neither_hashes_nor_the_quadratic_bound(monkeypatch):
    import difflib

    from attesta.operators import fuzzy

    def never(*_):
        raise AssertionError("this step grows faster than the text")

    monkeypatch.setattr(fuzzy._Blocks, "_hashed", never)
    monkeypatch.setattr(fuzzy, "_shared_subsequence", never)
    text = " ".join(f"w{i * 7919 % 10007} of item {i}" for i in range(1500))
    half = len(text) // 2
    for edited in (text[:half] + "#" + text[half + 1:], text[:half] + text[half + 40:], "now " + text[:-9]):
        start, stop, score = fuzzy.locate(text, edited, 0.86, 25)
        matcher = difflib.SequenceMatcher(None, text, edited, autojunk=False)
        block = matcher.find_longest_match()
        if block.size >= int(0.86 * len(edited)):
            assert (start, stop, score) == (block.a, block.a + block.size, round(block.size / len(edited), 4))
        else:
            matcher.set_seq1(text[start:stop])
            assert start == max(0, block.a - block.b) and score == round(matcher.ratio(), 4)
    assert fuzzy.locate(text, text[::-1], 0.86, 25) is None


def test_texts_are_normalised_in_one_pass(spark):
    from attesta.operators.grounding import locate_quotes

    t = Tables(spark, FOLDER)
    plan = locate_quotes(t.quote, t.span).select("paper_id", "pos", "method")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan and "Filter (CASE" not in plan


REPEATED = (  # the longest block takes the edited character and stands far left, or one half is longer than it looks
    "Of the ering and anonxxxxxxxxxxxxx###" + " Is onhe." * 20,
    "Das istxxx###" + " Ist ßonhe." * 20,
    "Das istx###" + " Ist ßonhe." * 20,
)


def test_edited_quotes_of_repeated_text_are_found():
    from attesta.operators.fuzzy import locate

    for source in REPEATED:
        half = len(source) // 2
        text, edited = source.replace("ß", "ss"), (source[:half] + "#" + source[half + 1:]).replace("ß", "ss")
        start, stop, score = locate(text, edited, 0.86, 25)
        assert start == 0 and stop == len(edited) and score >= round((len(edited) - 2) / len(edited), 4)
        assert locate(text, edited[::-1], 0.86, 25) is None


def test_funnel_of_repeated_text_equals_its_sql(spark, tmp_path):
    import duckdb

    from attesta.plans.registry import QUERIES

    name, path = "rpt_07b_span_funnel_with_fuzzy", f"{tmp_path}/documents.parquet"
    rows = [(4 * n + key, text, "en", "web", len(text)) for n, text in enumerate(REPEATED) for key in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    columns = ("paper_id", "span_id", "raw", "grounded", "citing")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({QUERIES[name].sql})").fetchall()
    assert sorted(map(tuple, runnable(name)(spark, f"{tmp_path}").select(*columns).collect())) == sorted(expected)


def _words(n):
    return " ".join(f"w{i * 7919 % 10007}" for i in range(n))


LONG = (  # one line each; the edited character is `ß`, or the text repeats itself, or both
    "Anfang " + _words(88) + "ß" + _words(90)[:-2] + "uvw",
    "Of the ering and anon" + " Is onhe and it." * 80,
    "Of the ering" + "x" * 620 + " Is onhe and it." * 40,
    "Das ist" + " Ist ßonhe." * 150,
    "Das" + " Ist onhe so." * 220,
)


def test_guard_of_long_edited_quotes_equals_its_sql(spark, tmp_path):
    import duckdb

    from attesta.plans.registry import QUERIES

    lines = [*LONG, *(text[:n] + "ß" + text[n + 1:] for text in LONG for n in [len(text) // 2])]
    lines += [text + "q" * extra for text in lines for extra in (1, 2)]
    name, path = "grd_06_final_quote_guard", f"{tmp_path}/documents.parquet"
    rows = [(4 * n + key, text, "de", "web", len(text)) for n, text in enumerate(lines) for key in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    columns = ("paper_id", "claim_id", "pos", "span_id", "role", "verified", "quote")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({QUERIES[name].sql})").fetchall()
    found = runnable(name)(spark, f"{tmp_path}").select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
