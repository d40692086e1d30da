from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesta.llm.line_windows import drop_repeated_lines
from attesta.llm.url_reputation import ReputationSettings, host_reputation, judge_urls


def lines(spark, *texts):
    rows = drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r["text"], r["n_lines"], r["n_removed"], r["n_spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_windows(spark):
    done = lines(spark, "a\nb\nc\nd", "x\na\nb\nc\nd\ny\na\nb\nc", "a\nb\nq", "r\nr\nr\nr\nr", "b\n\nc\nd\nz")
    assert done[0] == ("a\nb\nc\nd", 4, 0, 0)
    assert done[1] == ("x\ny", 9, 7, 2)
    assert done[2] == ("a\nb\nq", 3, 0, 0)
    assert done[3] == ("r", 5, 4, 1)
    assert done[4] == ("z", 5, 4, 1)                     # the blank line inside goes too


def test_odd_lines(odd_docs, no_docs):
    rows = drop_repeated_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and drop_repeated_lines(no_docs).count() == 0
    assert all(r["n_removed"] == 0 and r["n_lines"] == (0 if r["text"] is None else r["text"].count("\n") + 1) for r in rows)


HELPERS = ("_h", "_n", "_id", "_lines", "_kept", "_from", "_to", "_at", "_begin", "_starts", "_said", "_w", "_c1", "a.b")


def test_clashing_names_keep_their_values(spark):
    rows = [(1, "a\nb\nc", "x"), (2, "q\na\nb\nc", "y"), (None, "a\nb\nc", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumns(
        {c: F.concat(F.lit("mine"), "own") for c in HELPERS})
    out = {r["own"]: r for r in drop_repeated_lines(docs).collect()}
    assert all(r[c] == f"mine{own}" for own, r in out.items() for c in HELPERS)
    assert {own: r["text"] for own, r in out.items()} == {"x": "a\nb\nc", "y": "q", "z": ""}


def test_plan_has_no_python(spark, small_docs):
    plan = drop_repeated_lines(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


URLS = [
    (1, "HTTPS://Www.Shop.Example.COM:80/de/a?x#y"), (2, "http://foo.net"), (3, "http://foo.net/"),
    (4, "http://a.example.net/en/1"), (5, "http://org/fr/1"), (6, "notorg/fr/"), (7, None), (8, "http://xexample.net/en/1"),
    (9, "ftp://u@h.co.uk?q"), (9, "ftp://u@h.co.uk?q"), (None, "http://ÄB.example.com/de/"),
]


def test_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    rows = judge_urls(pages, spark.createDataFrame([], "host string, good int")).collect()
    assert len(rows) == len(URLS)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1][:3] == ("www.shop.example.com:80", "/de/a", None)
    assert got[2][1:3] == ("", None)
    assert got[3] == ("foo.net", "/", "net/", "block") and got[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "block") and got[7] == ("", "", None, "block")
    assert got[8][2:] == ("net/", "block") and got[9][:2] == ("u@h.co.uk", "")
    assert got[None] == ("Äb.example.com", "/de/", "example.com/de/", "block")


def test_shrinkage(spark):
    seen = ([("a.bad.org", 0)] * 60 + [("b.bad.org", 0)] * 2 + [("a.fine.org", 1)] * 60 + [("b.fine.org", 1)] * 2
            + [("c.bad.org", None), ("d.fine.org", None)] + [(f"h{i}.mixed{i % 7}.com", i % 3 > 0) for i in range(70)])
    outcomes = spark.createDataFrame([(h, None if g is None else int(g)) for h, g in seen], "host string, good int")
    bound = {r["host"]: r["lower_bound"] for r in host_reputation(outcomes, ReputationSettings()).collect()}
    assert bound["a.bad.org"] < bound["b.bad.org"] < 0.5 and bound["c.bad.org"] < bound["d.fine.org"]
    assert bound["a.fine.org"] > bound["b.fine.org"] > bound["d.fine.org"] * 0.99


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, spark.createDataFrame([], "host string, good int")).count() == 0


@pytest.mark.parametrize("host,domain", [("a.b.example.com", "example.com"), ("x.co.uk", "x.co.uk"), ("a.x.co.uk:8", "x.co.uk"), ("localhost", "localhost")])
def test_domains(spark, host, domain):
    from pyspark.sql import functions as F

    from attesta.llm.url_reputation import domain_of

    assert spark.range(1).select(domain_of(F.lit(host))).first()[0] == domain
