from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm.mixing import IndexPermutation, MixSettings, mix_pieces, mix_report, mixed_documents, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = IndexPermutation(n, 5)
    seen = p.forward(np.arange(n))
    assert sorted(seen) == list(range(n)) and (p.inverse(seen) == np.arange(n)).all()


def plain_targets(sizes, weights, most=3):
    capped: set[int] = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped and sizes[i]]
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = {i for i in rest if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share.get(i, 0) for i in range(len(sizes))]
        capped |= over


def test_targets():
    sizes, weights = np.array([10.0, 500.0, 3.0, 900.0, 0.0]), np.array([5.0, 2, 1, 5, 2])
    assert np.allclose(targets(sizes, weights, 3), plain_targets(list(sizes), list(weights)))


@pytest.mark.parametrize("block", [16, 100, 2048])
def test_report_meets_targets(small_docs, block):
    rows = mix_report(small_docs, MixSettings(block=block)).collect()
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    by_source: dict[str, list] = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source)
    sizes = [sum(r["size"] for r in by_source[n]) for n in names]
    goal = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, size, want in zip(names, sizes, goal, strict=True):
        assert {r["source_size"] for r in by_source[name]} == {size}
        assert by_source[name][0]["target"] == pytest.approx(want)
        assert abs(sum(r["taken"] for r in by_source[name]) - want) <= 1


def test_pieces_agree_with_report_and_reruns(small_docs):
    s = MixSettings(block=64)
    took = {r["doc_id"]: r["taken"] for r in mix_report(small_docs, s).collect()}
    texts: dict[int, int] = {}
    once = mixed_documents(small_docs, s).collect()
    for r in once:
        texts[r["doc_id"]] = texts.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert texts == {k: v for k, v in took.items() if v}
    key = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows)
    assert key(once) == key(mixed_documents(small_docs, s).collect())
    _, pieces = mix_pieces(small_docs, s)
    fill: dict[int, int] = {}
    for r in pieces.collect():
        fill[r["slot"]] = fill.get(r["slot"], 0) + r["word_to"] - r["word_from"]
    assert max(fill.values()) <= 64


def test_odd_rows(odd_docs, no_docs):
    rows = mix_report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixed_documents(odd_docs).columns == odd_docs.columns and mixed_documents(odd_docs).count() > 0
    assert mix_report(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_rows_keep_their_own_columns(spark):
    """Rows that share id and text keep their source and other columns, clashing names included."""
    from attesta.llm.mixing import mixed_documents
    from attesta.llm.order_minhash import keep_one_per_group
    from attesta.llm.templates import drop_leaking

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s1", 1), (1, text, "de", "s2", 2), (1, text, "fr", "s2", 3), (1, text, "fr", "s2", 3), (2, text + " x", "en", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit("mine"), F.coalesce("source", F.lit("-")), "lang") for c in ("_h", "_doc", "_piece", "_gone", "_text", "_g", "_copy")})
    mixed = mixed_documents(docs).collect()
    assert {(r.doc_id, r.lang, r.source) for r in mixed} == {(1, "en", "s1"), (1, "de", "s2"), (1, "fr", "s2"), (2, "en", None)}
    items = spark.createDataFrame([(1, "never found in any of these texts at all")], "item_id long, text string")
    for out in (mixed, keep_one_per_group(docs).collect(), drop_leaking(docs, items).collect()):
        assert out and all(r[c] == f"mine{r.source or '-'}{r.lang}" for r in out for c in ("_h", "_doc", "_piece", "_gone", "_text", "_g", "_copy"))
