"""Ranked lexical search by two trees: items and documents under nodes of coordinate maxima.

Documents are read once into term vectors over the terms that items use.  A
task holds one block of them: documents that share their most telling term lie
together, ``fan`` of them under a node whose coordinates are the largest
impacts below it.  Items have such a tree too, with the largest weights.  The
product of a document node and an item node bounds every score below the pair;
a pair whose bound is under the weakest kth score of its items is left out with
everything below it, so the result is exact.

A first pass over the best-bounded node of each block gives every item scores
that k documents do reach; the second pass prunes with these and raises them
further inside each task.  All arithmetic is on integers below 2**53, held in
doubles for the matrix products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.common import key_filter, mix64, passes, small_batches, text_hash
from attesta.operators.frames import top_rows
from attesta.session import cut_lineage

EXACT = float(1 << 53)


@dataclass(frozen=True)
class SearchSettings:
    """``top`` documents an item.  ``fan`` documents or nodes lie under a node.

    Items are searched in batches of at most ``batch_terms`` terms (one longer
    item is a batch of its own); that bounds what is broadcast.  A block holds
    up to ``block_rows`` documents, fewer where a batch has many terms, so a
    block's matrix stays near ``cells`` numbers.  The first pass reads
    ``first_nodes`` lowest nodes of a block for each item.  Texts are cut into slices of
    about ``slice_bytes`` for reading; a longer text is a slice of its own.
    """

    top: int = 50
    fan: int = 8
    batch_terms: int = 16_384
    block_rows: int = 2_048
    first_nodes: int = 2
    cells: int = 4_000_000
    slice_bytes: int = 1 << 20


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to terms (letters, digits, all beyond ASCII), and a 64-bit value for each, A-Z as a-z."""
    b = np.arange(256)
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    inside = upper | lower | ((b >= 48) & (b <= 57)) | (b >= 128)
    return inside, mix64(np.where(upper, b + 32, b).astype(np.uint64), 11)


INSIDE, VALUE = _byte_classes()
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class TermReader:
    """Terms of UTF-8 texts as 64-bit hashes: differences of one running polynomial, so each byte is read once."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_FACTOR, 1 << 16), _powers(_INVERSE, 1 << 16)

    def terms(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every term in texts that lie one behind the other, ``starts`` their first bytes and the end."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_FACTOR, 2 * n), _powers(_INVERSE, 2 * n)
        inside = INSIDE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = starts[:-1][starts[:-1] < starts[1:]]
        opens[first] |= inside[first]
        begin = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[first[1:] - 1] |= inside[first[1:] - 1]
        end = np.flatnonzero(closes) + 1
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUE[data] * self.up[:n], out=run[1:])
        hashes = mix64((run[end] - run[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        return hashes, np.searchsorted(starts, begin, side="right") - 1


def _texts(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) of runs of rows with about ``most`` bytes; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with how often each occurs, by owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def term_vectors(rows: DataFrame, keep=None, slice_bytes: int = SearchSettings.slice_bytes) -> DataFrame:
    """(id, tie, text) to (id, tie, n, terms, tfs): all terms of a text counted, those kept that ``keep``'s bitmap lets through."""
    small_batches(rows)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bitmap = TermReader(), keep.value if keep is not None else None
        for batch in batches:
            text = batch.column(2)
            for row, data, starts in _texts(text, slice_bytes):
                size = len(starts) - 1
                hashes, owner = reader.terms(data, starts)
                n = np.bincount(owner, minlength=size)
                if bitmap is not None:
                    kept = passes(bitmap, hashes)
                    hashes, owner = hashes[kept], owner[kept]
                h, o, tf = _counted(hashes, owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, size), batch.column(1).slice(row, size), pa.array(n, pa.int64()),
                     _lists(h.view(np.int64), o, size, pa.int64()), _lists(tf, o, size, pa.int32())],
                    names=["id", "tie", "n", "terms", "tfs"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, tie long, n long, terms array<long>, tfs array<int>")


def _numeric_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(len(column)), sizes)


class ItemTree:
    """A batch of items: weights over the batch's terms, and levels of maxima above them up to one root."""

    def __init__(self, keys: list[int], terms: list[np.ndarray], weights: list[np.ndarray], fan: int):
        leading = [int(t[w.argmax()]) if len(t) else 0 for t, w in zip(terms, weights)]
        order = sorted(range(len(keys)), key=lambda i: (leading[i], keys[i]))  # items that share a telling term together
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]))
        level = np.zeros((len(keys), len(self.vocabulary)))
        for row, i in enumerate(order):
            level[row, np.searchsorted(self.vocabulary, terms[i])] = weights[i]
        self.levels = _tree(level, fan)
        if self.levels[-1].sum() * 1e6 >= EXACT:  # an item of hundreds of thousands of terms: Python's whole numbers
            self.levels = [x.astype(np.int64).astype(object) for x in self.levels]

    @property
    def kind(self) -> np.dtype:
        return self.levels[0].dtype


def _tree(level: np.ndarray, fan: int) -> list[np.ndarray]:
    """A level and the maxima of every ``fan`` of its rows, up to one row."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), fan), axis=0))
    return levels


class Best:
    """The k best documents of each item so far, and the score that a kth is known to reach (0: none is known)."""

    def __init__(self, known: np.ndarray, k: int):
        self.k, self.known, self.weakest = k, known, known.copy()
        self.held: list[list[tuple]] = [[] for _ in known]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        """Equal scores by ascending id, then tie."""
        if len(scores) > self.k:
            keep = scores >= np.sort(scores)[-self.k]
            scores, ids, ties = scores[keep], ids[keep], ties[keep]
        held = self.held[item]
        for score, i, tie in zip(scores.tolist(), ids.tolist(), ties.tolist()):
            entry = (score, -i, -tie)
            if len(held) < self.k:
                heapq.heappush(held, entry)
            elif entry > held[0]:
                heapq.heapreplace(held, entry)
        if len(held) == self.k:
            self.weakest[item] = max(self.weakest[item], held[0][0])

    def rows(self) -> Iterator[tuple]:
        for item, held in enumerate(self.held):
            for score, i, tie in held:
                if score >= self.known[item]:
                    yield item, -i, -tie, int(score)


def search_block(impacts: np.ndarray, ids: np.ndarray, ties: np.ndarray, tree: ItemTree, best: Best, fan: int,
                 nodes: int | None = None) -> int:
    """Bring the best documents of a block, the rows of ``impacts``, to ``best``.

    ``nodes`` limits the visit to that many best-bounded lowest nodes an item
    (for first thresholds).  Returns how many (document, item) scores were taken.
    """
    levels = _tree(impacts, fan)
    level, height = len(levels) - 1, len(tree.levels) - 1
    weakest = [np.minimum.reduceat(best.weakest, np.arange(0, len(best.weakest), fan ** h)) for h in range(height + 1)]
    doc, item = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = _products(levels[level], tree.levels[height], doc, item)
    down = True  # the two sides take turns on the way down to single items and the lowest document nodes
    while level > 1 or height > 0:
        if height > 0 and (down or level <= 1):
            height -= 1
            doc, item = _expanded(item, doc, fan, len(tree.levels[height]))[::-1]
        else:
            level -= 1
            doc, item = _expanded(doc, item, fan, len(levels[level]))
        down = not down
        bound = _products(levels[level], tree.levels[height], doc, item)
        keep = (bound > 0) & (bound >= weakest[height][item])
        doc, item, bound = doc[keep], item[keep], bound[keep]
    order = np.lexsort((-bound.astype(float), item))  # each item's best-bounded nodes first, so that its kth score rises early
    doc, item, bound = doc[order], item[order], bound[order]
    rank = np.arange(len(order)) - np.searchsorted(item, item, side="left")
    scored, step = 0, 0
    while len(item):  # twice as many nodes an item each time; what falls under the risen kth score stays unread
        now = (rank < fan << step) & (bound >= best.weakest[item])
        if nodes is not None:
            now &= rank < nodes
        d, i = _expanded(doc[now], item[now], fan, len(impacts)) if level else (doc[now], item[now])
        score = _products(impacts, tree.levels[0], d, i)
        scored += len(score)
        good = np.flatnonzero((score > 0) & (score >= best.weakest[i]))
        good = good[np.argsort(i[good], kind="stable")]
        cut = np.flatnonzero(np.diff(i[good], prepend=-1))
        for at, to in zip(cut, np.append(cut[1:], len(good))):
            mine = good[at:to]
            best.add(int(i[mine[0]]), score[mine], ids[d[mine]], ties[d[mine]])
        left = (rank >= fan << step) & (bound >= best.weakest[item])
        if nodes is not None:
            left &= rank < nodes
        doc, item, bound, rank = doc[left], item[left], bound[left], rank[left]
        step += 1
    return scored


def _expanded(parents: np.ndarray, others: np.ndarray, fan: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each parent, of which there are ``below``, with what the parent was paired with."""
    children = (parents[:, None] * fan + np.arange(fan)).ravel()
    there = children < below
    return children[there], np.repeat(others, fan)[there]


def _products(docs: np.ndarray, items: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Scores or bounds of the pairs: one matrix product for each item (node), over its own terms."""
    out = np.zeros(len(doc), items.dtype)
    by = np.argsort(item, kind="stable")
    cut = np.flatnonzero(np.diff(item[by], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(by))):
        mine = by[a:b]
        weights = items[item[mine[0]]]
        terms = np.flatnonzero(weights)
        out[mine] = docs[np.ix_(doc[mine], terms)] @ weights[terms]
    return out


def _impacts(part: pa.RecordBatch, tree: ItemTree, docs: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, impacts): whole numbers 10**9 * tf div (1000 * tf + 20 * m), a row for each document."""
    terms, owner = _numeric_lists(part.column(3))
    tf = _numeric_lists(part.column(4))[0].astype(np.int64)
    m = 50 + (50 * part.column(2).to_numpy() * docs) // max(length, 1)
    out = np.zeros((part.num_rows, len(tree.vocabulary)), tree.kind)
    if len(tree.vocabulary):
        code = np.minimum(np.searchsorted(tree.vocabulary, terms), len(tree.vocabulary) - 1)
        real = tree.vocabulary[code] == terms
        code, owner, tf = code[real], owner[real], tf[real]
        out[owner, code] = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])).astype(tree.kind)
    return m, out


LAST_ID = (1 << 63) - 1  # a null id sorts behind all others


def _searched(vectors: DataFrame, shared, s: SearchSettings, nodes: int | None) -> DataFrame:
    """(item, id, tie, score): each task's best documents of every item of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, docs, length = shared.value
        best = Best(known, s.top)
        most = max(s.fan, min(s.block_rows, s.cells // max(1, len(tree.vocabulary))))
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                m, impacts = _impacts(part, tree, docs, length)
                telling = (impacts * tree.levels[-1][0]).argmax(axis=1) if impacts.size else m
                order = np.lexsort((m, telling))  # documents with the same telling term side by side
                ids = part.column(0).fill_null(LAST_ID).to_numpy()[order]
                search_block(impacts[order], ids, part.column(1).to_numpy()[order], tree, best, s.fan, nodes)
        rows = list(best.rows())
        if rows:
            item, i, tie, score = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(tree.keys[item]), pa.array(i), pa.array(tie), pa.array(score)],
                                             names=["item", "id", "tie", "score"])

    return vectors.mapInArrow(run, "item long, id long, tie long, score long")


def _weighted_items(items: DataFrame, vectors: DataFrame, docs: int) -> DataFrame:
    """(item, terms, weights) of items that share a term with some document; floor(1000 ln((2N + 2) / (2 df + 1)))."""
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1).cast("double")))
    told = (items.select(F.col("id").alias("item"), F.explode("terms").alias("term")).join(df, "term")
            .select("item", "term", weight.alias("w")).where("w > 0"))
    return told.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("held"), F.max_by("term", "w").alias("leading")).select(
        "item", "leading", F.col("held.term").alias("terms"), F.col("held.w").alias("weights"))


def _batches(items: DataFrame, s: SearchSettings) -> Iterator[ItemTree]:
    """Items in batches of a bounded number of terms; the driver holds one batch (and one partition of items) at a time."""
    keys, terms, weights, held = [], [], [], 0
    for row in items.orderBy("leading", "item").toLocalIterator():
        if keys and held + len(row["terms"]) > s.batch_terms:
            yield ItemTree(keys, terms, weights, s.fan)
            keys, terms, weights, held = [], [], [], 0
        keys.append(row["item"])
        terms.append(np.array(row["terms"], np.int64))
        weights.append(np.array(row["weights"], np.int64))
        held += len(row["terms"])
    if keys:
        yield ItemTree(keys, terms, weights, s.fan)


def _best_first(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, ["item"], [F.col("score").desc(), "id", "tie"], k)


def search(docs: DataFrame, items: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, all documents searched.

    ``docs`` has doc_id (whole numbers) and text, ``items`` item_id and text.
    Documents without terms (null, empty) count in nothing and are never found;
    items without terms, or whose terms no document holds, return nothing.
    Equal scores rank by doc_id (null last), then by text hash.  A repeated
    document row is a document of its own; rows that repeat item_id and text
    are one item, and an item_id with several texts has a ranking for each.
    Terms are told apart by 64-bit hashes.
    """
    s, spark = settings, docs.sparkSession
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct().withColumn(
        "item", F.xxhash64(F.col("item_id").isNull(), "item_id", F.col("text").isNull(), "text"))
    item_terms = cut_lineage(term_vectors(asked.select(F.col("item").alias("id"), F.lit(0).cast("long").alias("tie"), "text")))
    keep = spark.sparkContext.broadcast(key_filter(item_terms.select(F.explode("terms").alias("term")), "term"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    vectors = cut_lineage(term_vectors(texts.select("id", text_hash().alias("tie"), "text"), keep, s.slice_bytes).where("n > 0"))
    whole = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    some = vectors.where(F.size("terms") > 0)
    weighted = cut_lineage(_weighted_items(item_terms, vectors, whole["docs"]))
    done = [weighted.select("item", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)]
    for tree in _batches(weighted, s):
        zero = np.zeros(len(tree.keys), tree.kind)
        shared = spark.sparkContext.broadcast((tree, zero, whole["docs"], whole["length"]))
        first = _best_first(_searched(some, shared, s, s.first_nodes), s.top)
        kth = dict(first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
                   .where(F.col("n") == s.top).select("item", "kth").collect())  # a row an item of the batch
        known = np.array([kth.get(int(key), 0) for key in tree.keys], tree.kind)
        shared = spark.sparkContext.broadcast((tree, known, whole["docs"], whole["length"]))
        order = W.partitionBy("item").orderBy(F.col("score").desc(), "id", "tie")
        done.append(cut_lineage(_best_first(_searched(some, shared, s, None), s.top).select(
            "item", "id", "score", F.row_number().over(order).alias("rank"))))
    found = done[-1] if len(done) == 2 else reduce(DataFrame.union, done)
    return asked.select("item", "item_id").join(found, "item").select(
        "item_id", "rank", F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "score")
