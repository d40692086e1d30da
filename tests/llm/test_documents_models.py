"""Quality, language and near-duplicate operators against held-out labels and brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from attesta.llm.langid_crf import LanguageSettings, _gradient, forward_backward, identify_languages, label_words
from attesta.llm.order_minhash import OrderSettings, alignment_similarity, group_documents, keep_one_per_group, shingles
from attesta.llm.quality import QualitySettings, keep_good, score_documents

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_quality_on_held_out_rows(docs, labels):
    rows = {r["doc_id"]: r for r in score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    told = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    right = {q: [r["predicted"] == q for r, y in told if y == q] for q in (0, 1)}
    assert np.mean(right[0]) >= 0.8 and np.mean(right[1]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_quality_odd_rows(spark, odd_docs, no_docs, labels):
    assert score_documents(odd_docs.drop("score"), labels).count() == odd_docs.count()
    assert score_documents(no_docs, labels).count() == 0
    none = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = score_documents(odd_docs, none).collect()
    assert {r["score"] for r in rows} == {0.5}
    assert keep_good(odd_docs, none, QualitySettings(threshold=0.4)).columns == odd_docs.columns


def brute_posterior(e, t):
    n, k = e.shape
    total, mass = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(e[i, path[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False))) * np.exp(t[:, path[0]]).sum()
        total += w
        for i in range(n):
            mass[i, path[i]] += w
    return mass / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([5, 0, 1, 7, 3])
    e, t = rng.normal(size=(16, 3)), rng.normal(size=(3, 3))
    for piece in (1, 2, 3, 64):
        got, at = forward_backward(e, counts, t, piece), 0
        for n in counts:
            assert np.allclose(got[at:at + n], brute_posterior(e[at:at + n], t)) if n else True
            if n > 1:
                assert np.allclose(got[at:at + n], _gradient(e[at:at + n], t)[0])
            at += n


def test_language_on_held_out_rows(docs):
    rows = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert np.mean([r["lang_pred"] == truth[i] for i, r in rows.items() if r["held_out"]]) > 0.97


def test_words_of_code_switched_text(spark, docs):
    taken = {r["lang"]: r["text"].split() for r in docs.where("lang in ('en', 'es') and doc_id in (621, 184)").collect()}
    mixed = " ".join(taken["en"][10:40] + taken["es"][10:40] + taken["en"][60:90])
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, mixed, None)], "doc_id long, text string, lang string"))
    runs = label_words(both).where("doc_id = -1").first()["stretches"]
    said = [r["lang"] for r in runs for _ in r["words"].split()]
    want = ["en"] * 30 + ["es"] * 30 + ["en"] * 30
    assert np.mean([a == b for a, b in zip(said, want, strict=True)]) > 0.9


def test_language_odd_rows(spark, odd_docs, no_docs):
    s = LanguageSettings(sequences=20, epochs=1)
    rows = identify_languages(odd_docs, s).collect()
    assert len(rows) == odd_docs.count() and identify_languages(no_docs, s).count() == 0
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_groups(pairs, s=OrderSettings()):
    """Smallest id of each component of all pairs that are similar enough, by comparing every pair."""
    items = shingles([t for _, t in pairs], s)
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(pairs)), 2):
        if len(items[a]) and len(items[b]) and alignment_similarity(items[a], items[b], s.similarity) >= s.similarity:
            u, v = find(pairs[a][0]), find(pairs[b][0])
            root[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in pairs}


def test_groups_equal_brute_force(small_docs):
    rows = {r["doc_id"]: r for r in group_documents(small_docs).collect()}
    want = brute_groups([(r["doc_id"], r["text"]) for r in small_docs.collect()])
    assert {i: r["class_id"] for i, r in rows.items()} == want
    assert all(r["kept"] == (i == r["class_id"]) for i, r in rows.items())


def test_large_drifting_group(spark):
    """Copies of one text with ever more edits: large buckets, whose members are not all similar to their leader."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(120)]
    pairs = []
    for i in range(60):
        mine = list(words)
        for at in rng.choice(120, i % 12, replace=False):
            mine[at] = f"x{i}_{at}"
        pairs.append((i, " ".join(mine)))
    pairs += [(100 + i, " ".join(f"y{i}_{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in group_documents(docs, OrderSettings(pairs_up_to=3, block=8)).collect()}
    assert got == brute_groups(pairs)


def test_rows_that_can_join_nothing_leave_the_bucket(spark):
    from attesta.llm.order_minhash import _joinable

    base = list(range(1000, 1100))
    texts = {1: base, 2: base[:95] + list(range(5)), 3: base[:60] + list(range(10, 50)), 4: list(range(200, 300)), 5: base[10:]}
    items = spark.createDataFrame(list(texts.items()), "node long, items array<long>")
    member = spark.createDataFrame([(7, n, n, n > 2) for n in texts] + [(8, 1, 1, False), (8, 2, 2, False)], "key long, node long, comp long, left_over boolean")
    left = {(r["key"], r["node"]) for r in _joinable(member, items, OrderSettings()).collect()}
    assert left == {(7, 1), (7, 2), (7, 5)}


def test_alignment_keeps_order():
    s = OrderSettings()
    a, b = ("one two three four five six seven eight nine ten " * 2).split(), [f"t{i}" for i in range(40)]
    x, y, z = shingles([" ".join(b), " ".join(b[20:] + b[:20]), " ".join(a)], s)
    assert alignment_similarity(x, x, 0.8) == 1.0 and alignment_similarity(x, y, 0.8) < 0.8
    assert len(set(z.tolist())) == len(z) == 16


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = group_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and group_documents(no_docs).count() == 0
    assert [r["class_id"] for r in rows if r["doc_id"] == 2] == [1, 1]
    assert all(r["kept"] for r in rows if r["doc_id"] != 2)
    kept = keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
