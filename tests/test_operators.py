"""Operators against hand-computed or brute-force results on small fixtures."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.operators import documents as docs
from attesta.operators import grounding, linking, merge, scoring
from attesta.operators.frames import ordinal, previous, running_total
from attesta.settings import PayoutSettings
from attesta.sources import readers, sinks


def spans_frame(spark, texts):
    rows = [("p", i, f"p-span-{i:04d}", t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "paper_id string, pos int, span_id string, text string")


def test_two_level_windows(spark):
    rows = [("g", i, i % 7) for i in random.Random(1).sample(range(1, 200), 120)] + [("h", 3, 5)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    out = running_total(ordinal(df, ["k"], ["pos"], "n", bucket=16), ["k"], ["pos"], "v", "before", bucket=16)
    out = previous(out, ["k"], "pos", "v", "prev", bucket=16).collect()
    ordered = sorted((r for r in rows if r[0] == "g"), key=lambda r: r[1])
    want = {r[1]: (i + 1, sum(x[2] for x in ordered[:i]), ordered[i - 1][2] if i else None) for i, r in enumerate(ordered)}
    assert {r.pos: (r.n, r.before, r.prev) for r in out if r.k == "g"} == want


def truncate(texts, limit):
    kept, total = [], 0
    for text in texts:
        if total >= limit:
            break
        if len(text) > limit - total:
            text = text[: limit - total].rstrip()
        if text:
            kept.append(text)
            total += len(text)
    return kept


@pytest.mark.parametrize("limit", [1, 5, 9, 12, 14, 20, 100])
def test_character_budget(spark, limit):
    texts = ["abcde", "fg   hi", "j", "k    l", "mn"]
    found = docs.truncate_spans(spans_frame(spark, texts), limit).orderBy("pos").collect()
    assert [r.text for r in found] == truncate(texts, limit)


def test_packing(spark):
    df = spark.createDataFrame([("aa\n\nbbb\n\n \n\ncccc\n\nd",)], ["t"])
    row = df.select(docs.ingest_chunks(F.col("t"), 9).alias("a"), docs.split_parts(F.col("t"), 9).alias("b")).first()
    assert row.a == ["aa\n\nbbb", "cccc\n\nd"]
    assert [len(p) <= 9 for p in row.b] == [True] * len(row.b)


def test_sections_cut_fallback_runs(spark):
    rows = [("p", i, f"s{i}", "Results" if i < 3 else "", "RESULTS" if i < 3 else "", i, "x" * 1500) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "paper_id string, pos int, span_id string, section_name string, section_type string, page int, text string")
    found = docs.section_inventory(df).orderBy("section_pos").collect()
    assert [len(r.span_ids) for r in found] == [2, 2, 2, 2, 2, 1]
    assert found[1].section_name == "fallback_section_001_pages_3_4"


@pytest.mark.parametrize("slot", [1, 2, 5, 1024])
def test_fallback_chunks_equal_sequential(spark, slot):
    rnd = random.Random(slot)
    rows = []
    for paper in range(8):
        for pos in sorted(rnd.sample(range(1, 60), 35)):
            rows.append((f"p{paper}", 1 + pos // 30, pos, rnd.choice([0, 5, 30, 60, 95, 120])))
    df = spark.createDataFrame(rows, "paper_id string, _run int, pos int, _len int").withColumn("_title", F.struct(F.lit(False).alias("reliable")))
    want, key, n, used, start = {}, None, 0, 0, 0
    for paper, run, pos, size in rows:
        if key != (paper, run) or n >= 4 or used + size > 100:
            n, used, start = 0, 0, pos
        key, n, used = (paper, run), n + 1, used + size
        want[(paper, pos)] = start
    found = docs.fallback_chunks(df, 100, 4, slot).collect()
    assert {(r.paper_id, r.pos): r._chunk for r in found} == want


def test_payout_ties_share(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.5), ("d", 0.0)], "contestant string, batch_score double")
    paid = {r.contestant: r.payout_weight for r in scoring.winner_takes_most(df).collect()}
    assert paid == {"a": 0.45, "b": 0.45, "c": 0.1, "d": 0.0}
    alone = scoring.winner_takes_most(df.where("contestant = 'c'")).first()
    assert alone.payout_weight == 1.0
    with pytest.raises(ValueError):
        scoring.winner_takes_most(df, PayoutSettings(winner_share=2.0))


def test_minor_tier_is_capped(spark):
    units = spark.createDataFrame(
        [("p", "u1", "central", True, "required"), ("p", "u2", "supporting", True, "required"), ("p", "u3", "minor", True, "required"),
         ("q", "u4", "minor", True, "required"), ("r", "u5", "central", False, "required")],
        "paper_id string, unit_id string, importance string, required boolean, scoring_mode string")
    members = spark.createDataFrame([("p", "u3", "a"), ("q", "u4", "a")], "paper_id string, unit_id string, contestant string")
    submitted = spark.createDataFrame([(p, "a") for p in "pqr"], "paper_id string, contestant string")
    got = {r.paper_id: r.coverage for r in scoring.coverage(units, members, submitted).collect()}
    assert got == {"p": round((1 / 19) / (1 + 1 / 19), 4), "q": 1.0, "r": 1.0}


def test_topk_fills_with_zero_scores(spark):
    claims = spark.createDataFrame([("p", 1, "c1", ["a", "b"]), ("p", 2, "c2", [])], "paper_id string, claim_pos int, claim_id string, terms array<string>")
    cands = spark.createDataFrame(
        [("p", 1, "e1", ["z"]), ("p", 2, "e2", ["a"]), ("p", 3, "e3", ["a", "b"]), ("p", 4, "e4", ["a"]), ("p", 5, "e5", ["q"])],
        "paper_id string, pos int, candidate_id string, terms array<string>")
    rows = linking.retrieve_evidence(claims, cands, 4).collect()
    by = {c: [r.candidate_id for r in sorted(rows, key=lambda r: (-r.score, r.pos)) if r.claim_id == c] for c in ("c1", "c2")}
    assert by == {"c1": ["e3", "e2", "e4", "e1"], "c2": ["e1", "e2", "e3", "e4"]}


def test_hygiene_reads_across_spans(spark):
    claims = spark.createDataFrame([("p", 1, "Cells were treated with 25 mg of the compound."), ("p", 2, "Cells were treated with 26 mg of the compound.")],
                                   "paper_id string, pos int, statement string")
    spans = spans_frame(spark, ["the dose was 25", "mg per day"])
    found = {r.pos: r.reason for r in merge.hygiene(claims, spans).collect()}
    assert found == {1: None, 2: "measurement_not_in_paper"}


def test_readers_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "paper one.json").write_text('{"paper": {"title": "", "journal": "J"}, "spans": [{"text": " "}, {"text": " hello ", "page": 2}]}')
    papers, spans = readers.artifact_rows(readers.read_bodies(spark, str(folder)))
    assert papers.first().asDict() == {"paper_id": "paper one", "title": "paper one", "authors": [], "year": None, "venue": "J", "doi": None}
    assert [(r.span_id, r.text, r.section_type) for r in spans.collect()] == [("paper one-span-0002", "hello", "OTHER")]
    (tmp_path / "t.jsonl").write_text('# note\n\n{"papers": [{"paper_id": "a"}, {"paper_id": "b"}], "task_id": "x y"}\n[1]\n')
    rows, rejected = readers.read_task_manifest(spark, str(tmp_path / "t.jsonl"))
    assert sorted((r.task_id, r.paper_id) for r in rows.collect()) == [("x_y", "a"), ("x_y", "b")] and rejected.count() == 1
    run = tmp_path / "runs" / "r1" / "p1"
    run.mkdir(parents=True)
    (run / "agent_output.json").write_text("{}")
    (run / "evaluation.json").write_text('{"quality_estimate": 0.5, "stats": {"claims": 3}}')
    found = readers.read_run_folders(spark, str(tmp_path / "runs")).first()
    assert (found.run_name, found.paper_id, found.status, found.claims, found.quality_estimate) == ("r1", "p1", "completed", 3, 0.5)
    out = str(tmp_path / "out")
    sinks.write_table(papers.drop("authors").withColumn("run_id", F.lit("r")), out, "csv", ["run_id"])
    assert spark.read.option("header", True).csv(out).count() == 1
    with pytest.raises(Exception):
        sinks.write_table(papers, out)


def test_replies(spark):
    rows = [(0, '{"a": 1}'), (1, 'x ```json\n{"a": {"b": 2}}\n``` y'), (2, 'so {"a": "}"} then'), (3, "[1]"), (4, '{"a": '), (5, "")]
    parsed, rejected = readers.parse_replies(spark.createDataFrame(rows, "k int, reply_text string"))
    assert {r.k: r.object for r in parsed.collect()} == {0: '{"a": 1}', 1: '{"a": {"b": 2}}', 2: '{"a": "}"}'}
    assert sorted(r.k for r in rejected.collect()) == [3, 4, 5]


def test_replies_are_folded_by_pieces(spark):
    prose = "word " * 2000
    bodies = ['so {"a": "' + prose + '\\\\\\"}", "b": {"c": "{"}} and {', 'so {"a": "' + prose, 'so {"a": "x\\', "so } {" + prose + "} {}", '\U0001f600 {"a": "\U0001f600"} x']
    parsed, _ = readers.parse_replies(spark.createDataFrame(list(enumerate(bodies)), "k int, reply_text string"))
    assert {r.k: r.object for r in parsed.collect()} == {0: bodies[0][3:-6], 4: '{"a": "\U0001f600"}'}
    pieces = spark.createDataFrame([(bodies[0],)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(readers.JSON_STRETCH), F.lit(0))))
    assert pieces.first()[0] < 20  # not one for each character


def test_units_meet_contestants_before_submissions(spark):
    units = spark.createDataFrame(
        [("p", "u1", "central", True, "required"), ("p", "u2", "minor", False, "accepted_improvement"), ("p", "u3", "minor", False, "required"),
         ("q", "u1", "supporting", True, "required")], "paper_id string, unit_id string, importance string, required boolean, scoring_mode string")
    members = spark.createDataFrame(
        [("p", "u1", "a"), ("p", "u1", "a"), ("p", "u2", "b"), ("p", "u3", "a"), ("p", "u1", None)], "paper_id string, unit_id string, contestant string")
    submissions = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "paper_id string, contestant string")
    status = scoring.unit_status(units, members, submissions)
    assert sorted((r.paper_id, r.contestant, r.unit_id, r.improvement, r.missing_severity) for r in status.collect()) == [
        ("p", "a", "u2", False, "minor"), ("p", "b", "u1", False, "critical"), ("p", "b", "u2", True, None), ("q", "a", "u1", False, "major")]
    got = {(r.paper_id, r.contestant): r.coverage for r in scoring.coverage(units, members, submissions).collect()}
    assert got[("p", "a")] > got[("p", "b")] > 0 and got[("q", "a")] == 0
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"contestant#\d+ = contestant#\d+", plan)  # no shuffle of units x contestants


def test_guard_targets(spark):
    planned = spark.createDataFrame([("t1", "a")], "target string, paper_id string")
    held = spark.createDataFrame([("t1", "b")], "target string, paper_id string")
    with pytest.raises(ValueError):
        sinks.guard_targets(spark, planned, held)
    sinks.guard_targets(spark, planned, planned)


def test_hygiene_searches_the_whole_paper(spark):
    texts = ["the dose was 2", "5", "mg per day, then", "1", "0", "0", " nM of it and 4 mg"]
    statements = ["Patients were given 25 mg of the compound daily.", "Cells were treated with 100 nM of the compound.",
                  "Cells were treated with 250 mg of the compound.", "Too short", "A second dose of 4 mg was given to all patients."]
    claims = spark.createDataFrame([("p", i, s) for i, s in enumerate(statements)], "paper_id string, pos int, statement string")
    found = {r.pos: (r.reason, r.detail) for r in merge.hygiene(claims, spans_frame(spark, texts)).collect()}
    assert found == {0: (None, None), 1: (None, None), 2: ("measurement_not_in_paper", ["250 mg"]),
                     3: ("not_a_scientific_claim", None), 4: (None, None)}


def test_passages_touching_punctuation_and_word_parts(spark):
    inner = "alpha beta gamma delta epsilon zeta eta theta iota"
    texts = [f"x ({inner}.)", f"pre{inner}post", "alpha beta", "x(zeta eta)", "zet", "nothing here"]
    passages = spark.createDataFrame([(1, inner), (2, "zeta eta"), (3, "ph"), (4, "a  BETA"), (5, " ")], "passage_id int, text string")
    found = {(r.span_id[-1], r.passage_id) for r in grounding.find_passages(spans_frame(spark, texts), passages).collect()}
    want = {(str(i), k) for i, text in enumerate(texts, 1) for k, p in ((1, inner), (2, "zeta eta"), (3, "ph"), (4, "a beta")) if p in text.lower()}
    assert found == want
