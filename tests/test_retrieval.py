"""Best partners by shared terms against all pairs, and what a term in every row costs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators.retrieval import best_partners, containment, jaccard

SHAPE = "paper_id string, {} int, terms array<bigint>"


def plain(asked, offered, k, kind, sign):
    out = set()
    for paper, a, terms in asked:
        scored = []
        for other, o, theirs in offered:
            n = len(set(terms) & set(theirs))
            if other == paper and n:
                scored.append((-(n / len(terms) if kind is containment else n / (len(terms) + len(theirs) - n)), sign * o))
        out |= {(paper, a, sign * o, -s) for s, o in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("often", [0, 3, 64])
@pytest.mark.parametrize("kind,sign,k", [(containment, 1, 4), (jaccard, -1, 1)])
def test_equals_all_pairs(spark, often, kind, sign, k):
    rng = random.Random(often + k)
    draw = lambda: sorted({min(int(rng.paretovariate(0.6)), 60) for _ in range(rng.randint(0, 9))})
    asked = [(p, i, draw()) for p in ("p", "q") for i in range(60)]
    offered = [(p, i, draw()) for p in ("p", "q", "r") for i in range(80)]
    found = best_partners(spark.createDataFrame(asked, SHAPE.format("a")), spark.createDataFrame(offered, SHAPE.format("o")), k, kind,
                          F.col("o") * sign, often)
    assert {(r.paper_id, r.a, r.o, r.score) for r in found.collect()} == plain(asked, offered, k, kind, sign)


def test_term_in_every_row_costs_k_rows(spark):
    """3,000 x 3,000 rows that share two stop words and nothing else."""
    asked = spark.createDataFrame([("p", i, [1, 2, 10_000 + i]) for i in range(3000)], SHAPE.format("a"))
    offered = spark.createDataFrame([("p", i, [1, 2, 20_000 + i]) for i in range(3000)], SHAPE.format("o"))
    found = best_partners(asked, offered, 5, containment, F.col("o"))
    assert found.count() == 15_000 and {r.o for r in found.select("o").distinct().collect()} == set(range(5))
    made = [m["numOutputRows"] for m in join_rows(found)]
    assert made and max(made) <= 60_000


def join_rows(df):
    """Output rows of every join that ran in the final plan."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan.executedPlan() if hasattr(plan, "executedPlan") else plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append({"numOutputRows": node.metrics().apply("numOutputRows").value()})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def drawn_terms(seed, papers=3, size=12):
    rng = random.Random(seed)
    return [(f"p{p}", i, f"C{i}", [f"t{rng.randint(0, 15)}" for _ in range(rng.randint(0, 6))]) for p in range(papers) for i in range(size + p)]


def test_small_papers_are_compared_row_by_row(spark, monkeypatch):
    """Same evidence and matches as by shared terms, without that path's tables."""
    from attesta.operators import compare, linking

    claims = spark.createDataFrame([(*r[:3], sorted(set(r[3]))) for r in drawn_terms(1)], "paper_id string, claim_pos int, claim_id string, terms array<string>")
    texts = claims.select("paper_id", F.col("claim_pos").alias("pos"), F.concat(F.lit("e"), "claim_id").alias("candidate_id"), "terms")
    units = claims.select("paper_id", F.col("claim_pos").alias("unit_id"), F.when(F.col("claim_pos") % 3 == 0, "s1").otherwise("s999").alias("best_id"), F.col("terms").alias("tokens"))
    ours = claims.select("paper_id", F.col("claim_pos").alias("idx"), F.slice("terms", 1, 3).alias("tokens"))
    evidence = lambda few: {tuple(r[c] for c in ("paper_id", "claim_pos", "claim_id", "candidate_id", "score"))
                            for r in linking.retrieve_evidence(claims, texts, 4, few).collect()}
    match = lambda few: {tuple(r) for r in compare.best_match(units, ours, few).collect()}
    by_terms, mixed = (evidence(0), match(0)), (evidence(13), match(13))
    for module in (compare, linking):
        monkeypatch.setattr(module, "best_partners", lambda *a: pytest.fail("small papers went through lists of terms"))
    assert by_terms == mixed == (evidence(1024), match(1024))
    assert len(by_terms[0]) == claims.count() * 4 and len(by_terms[1]) == claims.count()
