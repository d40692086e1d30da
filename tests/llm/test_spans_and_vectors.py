"""Byte spans, benchmark leaks and vectors against brute force."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest

from attesta.llm.prefix_free import ParseSettings, drop_repeated_bytes
from attesta.llm.templates import drop_leaking, find_leaks
from attesta.llm.vector_dedup import VectorSettings, dedup_vectors


def brute_bytes(pairs, length=100):
    seen, out = set(), {}
    for i, text in sorted(pairs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for x in range(len(data) - length + 1):
            piece = data[x:x + length]
            if piece in seen:
                gone[x:x + length] = b"\1" * length
            seen.add(piece)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def spans(df, s=ParseSettings()):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
            for r in drop_repeated_bytes(df, s).collect()}


def planted(n=40, seed=3):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("abcdefgh éü\n"), 3000))
    texts = []
    for i in range(n):
        own = "".join(rng.choice(list("abcdefgh éü\n"), int(rng.integers(0, 500))))
        at, size = int(rng.integers(0, 2500)), int(rng.integers(80, 500))
        texts.append((i, own[:200] + base[at:at + size] + own[200:]))
    texts += [(n, "a" * 900), (n + 1, "ab" * 300), (n + 2, "a" * 99), (n + 3, base), (n + 4, base + base), (n + 5, ""), (n + 6, None)]
    return texts


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_bytes_equal_brute_force(spark, slice_bytes):
    texts = planted()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert spans(df, ParseSettings(slice_bytes=slice_bytes)) == brute_bytes(texts)


def test_bytes_of_the_table(small_docs):
    assert spans(small_docs) == brute_bytes([(r["doc_id"], r["text"]) for r in small_docs.collect()])


def test_bytes_odd_rows(spark, odd_docs, no_docs):
    rows = drop_repeated_bytes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and drop_repeated_bytes(no_docs).count() == 0
    text = "".join(map(chr, range(200, 400)))
    twice = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in drop_repeated_bytes(twice).collect()}
    assert got == {(1, 0), (None, len(text.encode()))}


def colliding(spark, texts):
    """Pairs of texts whose hashes agree in 16 bits."""
    from pyspark.sql import functions as F

    from attesta.llm.common import text_hash

    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", text_hash().bitwiseAND(F.lit(0xFFFF)).alias("h")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["h"], []).append(r["text"])
    return [g for g in groups.values() if len(g) > 1]


@pytest.mark.parametrize("shared_id", [7, None])
def test_bytes_of_texts_that_share_an_id(spark, shared_id):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh"), 300))
    own = ["".join(rng.choice(list("abcdefgh"), 150)) for _ in range(3000)]
    texts = [f"{i:05d}{o}" + (base[:200] if i % 2 else "") for i, o in enumerate(own)]
    pair = next(g for g in colliding(spark, texts) if len(g[0]) != len(g[1]))
    df = spark.createDataFrame([(0, base), *[(shared_id, t) for t in pair]], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in drop_repeated_bytes(df).collect())
    assert got == [(155, 0, 0), (300, 0, 0), (355, 200, 1)]

    pair = colliding(spark, [f"{base}{i:05d}" for i in range(3000)])[0][:2]   # equal content at equal start
    df = spark.createDataFrame([(shared_id, t) for t in pair], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in drop_repeated_bytes(df).collect()) == [0, 300 + len(os.path.commonprefix([t[300:] for t in pair]))]


ITEM = "Tom has 12 apples and gives 5 of them to Anna, so Tom keeps 7 apples after walking 3 km home."


def test_reparameterised_question(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "Short one."), (3, None), (None, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro words here. " + ITEM + " More words."),
        (2, "He said: " + ITEM.replace("Tom", "Sue").replace("12", "40").replace("Anna", "Bob").replace("5", "15").replace("7", "25")),
        (3, "Nothing of the kind is in this text, which only has 12 apples and gives 5."),
        (4, ""), (5, None), (None, ITEM),
    ], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in find_leaks(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (None, 1): True}
    assert sorted(r["doc_id"] for r in drop_leaking(docs, items).collect()) == [3, 4, 5]


def test_inconsistent_values_do_not_match(spark):
    item = "x 7 then we add 7 to the sum of 7 and 7 or so and 7 is what we get at last"
    other = "x 1 then we add 2 to the sum of 3 and 4 or so and 5 is what we get at last"
    items, docs = (spark.createDataFrame([(1, t)], f"{c} long, text string") for t, c in ((item, "item_id"), (other, "doc_id")))
    assert find_leaks(docs, items).count() == 0


def test_leaks_of_the_table(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = {(d["doc_id"], b["item_id"]) for d in small_docs.collect() for b in items.collect() if b["text"] in d["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(small_docs, items).collect()} == want


def leaks(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["coverage"], r["verbatim"]) for r in find_leaks(docs, items).collect()}


def test_names_that_open_sentences(spark):
    ben = "Ben buys 4 pens at the store. Ben gives 2 pens to Ann. Ben then loses 1 pen. How many pens has Ben?"
    maria = "Maria has 3 apples. Maria gives 2 to Tom."
    other = (ben.replace("Ben", "Zoe").replace("Ann", "Kim").replace("4", "9").replace("2", "5").replace("1", "3"),
             maria.replace("Maria", "Lea").replace("Tom", "Jon").replace("3", "8").replace("2", "6"))
    mixed = maria.replace("Maria gives", "Kim gives")      # one name turned into two
    got = leaks(spark, [ben, maria], ["Here it is: " + other[0], "They said " + other[1], ben + " " + maria, mixed])
    assert got == {(0, 0): (1.0, False), (1, 1): (1.0, False), (2, 0): (1.0, True), (2, 1): (1.0, True)}


def test_items_of_placeholders_and_short_items(spark):
    sums, short, units = "Compute 12 + 7 - 3 * 4 / 2 = 17", "Name Paris.", "5 km 3 kg 2 l 8 min 7 cm 4 oz 6 ft"
    got = leaks(spark, [sums, short, units], [
        f"Now: {sums} is it.", "They said 'Name Paris.' aloud", f"Of {units} and more", sums.replace("+", "*"), sums.replace("12", "13"),
        "Name of Paris", units.replace("7", "9").replace("8", "1")])
    assert got == {(i, i): (1.0, True) for i in range(3)}


def test_items_without_id(spark):
    items = spark.createDataFrame([(None, ITEM), (None, "Which river runs through the old town of Bern?"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, "So: Which river runs through the old town of Bern? " + ITEM), (3, "None.")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in find_leaks(docs, items).collect()) == [1, 2, 2]
    assert [r["doc_id"] for r in drop_leaking(docs, items).collect()] == [3]


def test_short_items_in_other_places_and_case(spark):
    items = ["What is the capital of France?", "Who wrote Dead Souls?", "Name the largest moon of planet Saturn now."]
    docs = [f(q) for q in items for f in (lambda q: f"they asked {q} again", lambda q: f"1) {q}", lambda q: f"- {q}",
                                          lambda q: "so " + q.lower(), lambda q: "SO " + q.upper(), lambda q: "they asked: " + q[0].lower() + q[1:])]
    got = leaks(spark, [*items, ITEM], [*docs, "Intro. " + ITEM.lower(), "Intro. " + ITEM.upper(), "what is the capital for France?"])
    assert got.keys() == {(i, i // 6) for i in range(18)} | {(18, 3), (19, 3)}
    assert all(coverage == 1 and verbatim for coverage, verbatim in got.values())


def test_leaks_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(odd_docs, items).count() == find_leaks(no_docs, items).count() == find_leaks(odd_docs, none).count() == 0
    assert drop_leaking(odd_docs, items).columns == odd_docs.columns and drop_leaking(odd_docs, items).count() == odd_docs.count()


def brute_vectors(rows, least=0.95):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    ids = sorted(unit)
    near = {i: [j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("dims,per_cell,block", [(8, 16, 8), (64, 32, 16), (64, 512, 1024)])
def test_vectors_equal_brute_force(spark, dims, per_cell, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(300)]
    for i in range(300, 420):
        base = np.array(rows[int(rng.integers(40))][1])
        rows.append((i, (base + rng.normal(size=dims) * np.linalg.norm(base) / np.sqrt(dims) * rng.choice([0, 0.1, 0.25, 0.3])).tolist()))
    rows.append((420, (np.array(rows[0][1]) * 3).tolist()))
    rows.append((421, rows[0][1] + [1.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in dedup_vectors(df, VectorSettings(per_cell=per_cell, block=block)).collect()}
    want = brute_vectors(rows)
    found = sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())
    assert got.keys() == want.keys() and found >= 0.99
    if dims == 8 or per_cell == 512:
        assert got == want


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1e300, 1e290])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in dedup_vectors(df).collect()]
    assert len(got) == len(rows) and got.count((2, 3, 1, False)) == 2 and (1, 3, 1, True) in got and (9, 3, 1, False) in got
    assert all(g[1] == 0 and g[2] == g[0] and g[3] for g in got if g[0] in (3, 4, 5, 6, 7, 8, None))
    assert dedup_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("kind", ["isotropic", "one coordinate", "low rank"])
def test_vector_recall_whatever_way_pairs_differ(spark, kind, capsys):
    """Pairs at cosine 0.953 across 8,000 vectors in 31 cells a fit."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = {"isotropic": lambda: rng.normal(size=x.shape), "one coordinate": lambda: np.eye(64)[rng.integers(0, 64, len(x))],
         "low rank": lambda: rng.normal(size=(len(x), 3)) @ rng.normal(size=(3, 64))}[kind]()
    g -= (g * x).sum(axis=1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    y = 0.953 * x + np.sqrt(1 - 0.953 ** 2) * g
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    rows = dedup_vectors(df).collect()
    recall = sum(r["n_links"] for r in rows) / 8000
    with capsys.disabled():
        print(f"\nrecall, {kind}: {recall:.4f}")
    assert 0.99 <= recall <= 1 and all(r["component_id"] in (r["vec_id"], r["vec_id"] - 4000) for r in rows)


def test_later_places_are_written_without_the_first_ones(spark):
    from attesta.llm import prefix_free as P

    rows = spark.range(6000).selectExpr("int(id % 3000) * 7 AS content", "0 AS key", "id", "0 AS start", "id AS tag", "0 AS size").selectExpr(
        "CASE WHEN id >= 5000 THEN 3 ELSE content END AS content", "key", "id", "start", "tag", "size").selectExpr(
        "bigint(content) AS content", "key", "id", "start", "tag", "size")
    whole, few = P._sorted_places(rows), P._sorted_places(rows, firsts=False)
    later = [sorted(map(tuple, P._split(*both)[1].collect())) for both in (whole, few)]
    assert later[0] == later[1] and len(later[0]) == 2000 + 999
    assert few[0].where("lead").count() <= 2 * few[0].select("part").distinct().count() < 100 < whole[0].where("lead").count()
