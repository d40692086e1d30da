"""Near-duplicate documents by Order MinHash over five-word shingles.

Shingles carry the number of their occurrence, so a document is a sequence of
distinct items.  A sketch takes the items with the smallest hashes and keeps
them in text order: two documents share it only when they share those items in
the same order.  Documents that share any sketch are candidates; a banded
alignment of their shingle sequences, matched / (all - matched) >= 0.8,
decides.  Groups are the connected components of such links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import (
    batch_words,
    connected_components,
    distinct_words,
    free_name,
    key_filter,
    mix64,
    passes,
    slices,
    small_batches,
    text_hash,
    word_hashes,
)
from attesta.session import cut_lineage


@dataclass(frozen=True)
class OrderSettings:
    words: int = 5
    similarity: float = 0.8
    # (items kept per sketch, sketches, longest document in shingles): at similarity 0.8 a long
    # pair shares none with probability (1 - 0.8**4)**20 = 3e-5, a short one with (1 - 0.8**2)**12 = 5e-6;
    # short documents get both kinds, up to a length that covers every partner of a 40-shingle one
    kinds: tuple[tuple[int, int, int | None], ...] = ((4, 20, None), (2, 12, 50))
    pairs_up_to: int = 8        # a bucket of at most so many is compared pair by pair
    block: int = 512            # rows of one side of a block comparison
    batch_chars: int = 500_000


def shingles(texts: list[str | None], s: OrderSettings) -> list[np.ndarray]:
    """Occurrence-labelled shingle hashes of each text in order; a text of fewer words is one shingle."""
    words, counts = batch_words(texts, lower=True)
    codes, distinct = distinct_words(words)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    out, start = [], 0
    for n in counts:
        mine, k = h[start:start + n], min(s.words, n)
        start += n
        g = np.zeros(max(n - k + 1, 0) if n else 0, np.uint64)
        for i in range(k):
            g = g * np.uint64(0x100000001B3) + mix64(mine[i:len(mine) - k + 1 + i])
        if len(g) > 1:
            order = np.argsort(g, kind="stable")
            same = np.concatenate([[False], g[order][1:] == g[order][:-1]])
            if same.any():
                at = np.arange(len(g))
                nth = at - np.maximum.accumulate(np.where(same, 0, at))
                g[order] += (nth * 0x9E3779B1).astype(np.uint64)
        out.append(mix64(g))
    return out


def sketches(items: np.ndarray, s: OrderSettings) -> np.ndarray:
    """Keys of a document's sketches: the items of smallest hash, in text order."""
    keys = []
    for kind, (kept, number, longest) in enumerate(s.kinds):
        if not len(items) or (longest is not None and len(items) > longest):
            continue
        if kind == 0 and len(items) < kept:
            continue                                     # the short kind serves these
        salts = mix64(np.arange(number), 100 + kind)
        odd = mix64(np.arange(number), 200 + kind) | np.uint64(1)
        take, step = min(kept, len(items)), max(1, 2_000_000 // len(items))
        for at in range(0, number, step):
            ranks = (items[None, :] ^ salts[at:at + step, None]) * odd[at:at + step, None]
            low = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < len(items) else np.tile(np.arange(take), (len(ranks), 1))
            low.sort(axis=1)
            key = salts[at:at + step].copy()
            for i in range(take):
                key = mix64(key * np.uint64(31) + items[low[:, i]])
            keys.append(key)
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def alignment_similarity(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """Shingles matched in order / shingles of either text; below ``least`` an upper bound may be returned.

    At most (1 - least) / (1 + least) of both texts' shingles may stay unmatched,
    so a match off the diagonal by more than that number is out of the band.
    """
    both = len(x) + len(y)
    if not both or min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    bound = len(common) / (both - len(common))
    if bound < least:
        return bound
    band = int(both * (1 - least) / (1 + least)) + 1
    order = np.argsort(ix)
    ix, iy = ix[order], iy[order]
    iy = iy[np.abs(ix - iy) <= band]
    matched = len(iy)
    if matched > 1 and (np.diff(iy) < 0).any():          # longest increasing run of matched places
        tails: list[int] = []
        for j in iy.tolist():
            at = bisect_left(tails, j)
            tails[at:at + 1] = [j]
        matched = len(tails)
    return matched / (both - matched)


def sketch_documents(docs: DataFrame, s: OrderSettings) -> DataFrame:
    """(_h, doc, keys): one row per distinct text that has words, with its smallest doc_id."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(batch["text"].str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
                part = batch.iloc[a:b]
                keys = [sketches(g, s) for g in shingles(list(part["text"]), s)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "_h": part["_h"].to_numpy(), "keys": keys})

    named = docs.where("doc_id is not null").select("doc_id", "text", text_hash().alias("_h"))
    made = named.mapInPandas(work, "doc_id long, _h long, keys array<long>").where(F.size("keys") > 0)
    return made.groupBy("_h").agg(F.min("doc_id").alias("doc"), F.any_value("keys").alias("keys"))


def _items_of(docs: DataFrame, wanted: DataFrame, s: OrderSettings) -> DataFrame:
    """(node, items): shingle sequences of the wanted texts, one row per text."""
    bitmap = key_filter(wanted, "node")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[passes(bitmap, batch["node"].to_numpy())]
            for a, b in slices(batch["text"].str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
                part = batch.iloc[a:b].drop_duplicates("node")
                yield pd.DataFrame({"node": part["node"].to_numpy(),
                                    "items": [g.view(np.int64) for g in shingles(list(part["text"]), s)]})

    found = docs.where("doc_id is not null").select(text_hash().alias("node"), "text").mapInPandas(work, "node long, items array<long>")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("items").alias("items"))


def _verified_pairs(pairs: DataFrame, items: DataFrame, s: OrderSettings) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the similarity."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [alignment_similarity(x.view(np.uint64), y.view(np.uint64), s.similarity) >= s.similarity
                    for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    both = (pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInPandas(work, "a long, b long")


def _block_links(s: OrderSettings):
    """Links between rows of two blocks of one bucket, as many as join what can be joined."""

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        xs = [v.view(np.uint64) for v in left["items"]]
        ys = [v.view(np.uint64) for v in right["items"]]
        nx, ny = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
        vocabulary, code = np.unique(np.concatenate(xs + ys), return_inverse=True)
        shared = np.bincount(code) > 1
        column = np.cumsum(shared) - 1
        cut = np.cumsum([len(v) for v in xs + ys])[:-1]
        codes = [column[c[shared[c]]] for c in np.split(code, cut)]
        width, common = int(shared.sum()), np.zeros((len(xs), len(ys)), np.float32)
        step = max(1, 8_000_000 // (len(codes) or 1))    # columns at a time, so a block stays within memory
        for at in range(0, width, step):
            one = np.zeros((len(codes), min(step, width - at)), np.float32)
            for i, c in enumerate(codes):
                one[i, c[(c >= at) & (c < at + step)] - at] = 1
            common += one[:len(xs)] @ one[len(xs):].T
        near = common / (nx[:, None] + ny[None, :] - common) >= s.similarity
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        ca, cb = left["comp"].to_numpy(), right["comp"].to_numpy()
        near &= ca[:, None] != cb[None, :]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            u, v = find(int(ca[i])), find(int(cb[j]))
            if u != v and alignment_similarity(xs[i], ys[j], s.similarity) >= s.similarity:
                root[u] = v
                out.append((int(a[i]), int(b[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def _joinable(member: DataFrame, items: DataFrame, s: OrderSettings) -> DataFrame:
    """Members of buckets with left-over rows that some other text of these buckets can still be similar to.

    A shingle that only one text holds is matched by none, and similar texts
    share ``similarity`` of the longer one's shingles at least.  The shingles
    that occur twice travel as a bitmap, which only lets too many rows through.
    """
    open_rows = member.join(member.where("left_over").select("key").distinct(), "key", "left_semi")
    theirs = cut_lineage(items.join(open_rows.select("node").distinct(), "node", "left_semi"))
    again = theirs.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = key_filter(again, "item")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alive = [passes(bitmap, v).sum() >= s.similarity * len(v) - 1e-6 for v in batch["items"]]
            yield batch.loc[np.array(alive, bool), ["node"]]

    return open_rows.join(theirs.mapInPandas(work, "node long"), "node", "left_semi")


def _grouped(docs: DataFrame, s: OrderSettings) -> DataFrame:
    small_batches(docs)
    classes = cut_lineage(sketch_documents(docs, s))
    entries = cut_lineage(classes.select(F.col("_h").alias("node"), F.explode("keys").alias("key")))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(entries.join(sizes, "key"))
    # a large bucket is led by the member whose buckets are the fullest: the text that most others stem from
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    small = shared.where(F.col("n") <= s.pairs_up_to).select("key", "node")
    large = cut_lineage(shared.where(F.col("n") > s.pairs_up_to).join(fame, "node"))
    leads = large.groupBy("key").agg(F.max(F.struct("fame", "node")).getField("node").alias("lead"))
    within = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b")
    star = large.join(leads, "key").where("node <> lead").select(
        F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    pairs = cut_lineage(within.select("a", "b").union(star).distinct())
    items = cut_lineage(_items_of(docs, shared.select("node").distinct(), s))
    links = cut_lineage(_verified_pairs(pairs, items, s))
    found = cut_lineage(connected_components(links))
    # members that their leader did not join are compared with all of the bucket, block by block
    comps = large.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    led = leads.join(found, leads["lead"] == found["node"], "left").select("key", F.coalesce("component", "lead").alias("led"))
    member = cut_lineage(comps.join(led, "key").withColumn("left_over", F.col("comp") != F.col("led")).drop("led"))
    member = cut_lineage(_joinable(member, items, s))
    open_keys = member.where("left_over").groupBy("key").agg(F.count("*").alias("r"))
    sizes = member.groupBy("key").agg(F.count("*").alias("n"))
    parts = lambda c: F.ceil(F.col(c) / s.block).cast("int")                                     # noqa: E731
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")                            # noqa: E731
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))                              # noqa: E731
    rest = member.join(open_keys, "key").join(sizes, "key").withColumns({"ps": parts("r"), "qs": parts("n")})
    left = rest.where("left_over").withColumns({"side": F.lit(0), "p": mine("ps")}).withColumn("q", every("qs"))
    right = rest.withColumns({"side": F.lit(1), "q": mine("qs")}).withColumn("p", every("ps"))
    work = left.unionByName(right).select("key", "p", "q", "side", "node", "comp").join(items, "node")
    more = work.groupBy("key", "p", "q").applyInPandas(_block_links(s), "a long, b long")
    joined = connected_components(links.union(cut_lineage(more)))
    named = joined.join(classes.select(F.col("_h").alias("node"), "doc"), "node")
    firsts = named.groupBy("component").agg(F.min("doc").alias("first"))
    group_of = classes.select("_h", "doc").join(
        named.join(firsts, "component").select(F.col("node").alias("_h"), "first"), "_h", "left").select(
        "_h", F.coalesce("first", "doc").alias("class_id"))
    rows = docs.select("doc_id", text_hash().alias("_h"))
    out = rows.join(group_of, "_h", "left")
    class_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "_h", class_id.alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def group_documents(docs: DataFrame, s: OrderSettings = OrderSettings()) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group) and kept (the group's one document) for every row.

    Equal texts are one group.  Texts without words, null texts and rows
    without an id are groups of their own and kept.  Rows that repeat an id and
    a text are one document; both are kept or neither.
    """
    return _grouped(docs, s).drop("_h")


def keep_one_per_group(docs: DataFrame, s: OrderSettings = OrderSettings()) -> DataFrame:
    """The rows of ``docs`` that are their group's one document, with their columns.

    A row goes by its id and its text, as two texts may share an id.
    """
    of_id, of_text = free_name(docs, "_gone"), free_name(docs, "_text")
    gone = _grouped(docs.select("doc_id", "text"), s).where("not kept").select(
        F.col("doc_id").alias(of_id), F.col("_h").alias(of_text)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(of_id)) & (text_hash() == F.col(of_text)), "left_anti")
