"""Mixing sources to target weights by fixed-length word blocks.

Each source's documents are laid end to end in a pseudorandom order and packed
into blocks of ``block`` words.  Source shares become word quotas; multinomial
draws, one per output shard and without replacement from what is left of the
quotas, say how many blocks of each source the shard takes, so the whole mix
meets its quotas without sampling error.  A source's slots run through a
pseudorandom permutation of its block indices, one permutation per pass over
the source, and slots and blocks are joined by index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.common import mix64, small_batches, text_hash
from attesta.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # given to the sources in code-point order, repeating
    most_repeats: int = 3
    block: int = 2048
    shards: int = 64
    buckets: int = 1024                           # pieces into which a source's document order is cut
    seed: int = 7


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of the total by weight, each at most ``most`` times its size; excess is reshared by weight."""
    total, out = float(sizes.sum()), np.zeros(len(sizes))
    free = sizes > 0
    while free.any():
        left = total - out[~free].sum()
        share = left * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        free &= ~over
    return out


class IndexPermutation:
    """Keyed bijection of 0..n-1: a four-round Feistel network with cycle walking, vectorised both ways."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _rounds(self, x: np.ndarray, order) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for r in order[0]:
            if order[1]:
                left, right = right, left ^ (mix64(right, self.key * 8 + r) & self.mask)
            else:
                left, right = right ^ (mix64(left, self.key * 8 + r) & self.mask), left
        return (left << shift) | right

    def _walk(self, index: np.ndarray, order) -> np.ndarray:
        x = self._rounds(index.astype(np.uint64), order)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._rounds(x[out], order)
        return x.astype(np.int64)

    def forward(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, ((0, 1, 2, 3), True))

    def inverse(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, ((3, 2, 1, 0), False))


@dataclass(frozen=True)
class SourcePlan:
    """What one source contributes: ``slots`` blocks, the last one cut to ``last`` words."""

    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def plan_source(source: str | None, size: int, target: float, number: int, s: MixSettings) -> SourcePlan:
    blocks = -(-size // s.block)
    quota = min(int(round(target)), s.most_repeats * size)
    if quota <= 0:
        return SourcePlan(source, size, target, blocks, 0, 0)
    passes, rest = divmod(quota - 1, size)
    rest += 1                                     # 1..size words of the last pass
    short = blocks * s.block - size               # words that the final block lacks
    at = int(IndexPermutation(blocks, pass_key(s, number, passes)).inverse(np.array([blocks - 1]))[0])
    slots = -(-rest // s.block)
    if slots > at:                                # the short block comes within these slots
        slots = -(-(rest + short) // s.block)
    before = (slots - 1) * s.block - (short if slots - 1 > at else 0)
    return SourcePlan(source, size, target, blocks, passes * blocks + slots, rest - before)


def pass_key(s: MixSettings, number: int, passes: int) -> int:
    return s.seed * 1_000_003 + number * 17 + passes


def draw_counts(slots: np.ndarray, s: MixSettings) -> np.ndarray:
    """(output shard, source) slot counts: multinomial draws in turn from the slots that are left."""
    rng = np.random.default_rng(s.seed)
    left, counts = slots.astype(np.int64).copy(), np.zeros((s.shards, len(slots)), np.int64)
    for shard in range(s.shards):
        want = int(left.sum() // (s.shards - shard))
        while want > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            counts[shard] += got
            left -= got
            want -= int(got.sum())
    return counts


def place_documents(docs: DataFrame, s: MixSettings) -> tuple[DataFrame, list[SourcePlan]]:
    """One row per document with its source's number and its first word's place in that source's stream."""
    slim = docs.select("doc_id", "source", word_count().alias("size"), text_hash().alias("_h"))
    totals = [(r["source"], int(r["n"])) for r in slim.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = np.array([n for _, n in totals], dtype=np.float64)
    weights = np.array([s.weights[i % len(s.weights)] for i in range(len(totals))])
    goals = targets(sizes, weights, s.most_repeats) if len(totals) else []
    plans = [plan_source(name, n, float(goals[i]), i, s) for i, (name, n) in enumerate(totals)]
    spark = docs.sparkSession
    numbers = spark.createDataFrame(
        [(p.source, i, p.size, p.target) for i, p in enumerate(plans)],
        "_name string, _src int, source_size long, target double")
    # repeated rows are told apart by a copy number, so every row has its own place
    copies = (slim.groupBy("doc_id", "source", "size", "_h").agg(F.count("*").alias("_n"))
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))))
    known = copies.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "_n")
    cut = known.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_h", F.lit(s.seed)), F.lit(s.buckets)).cast("int"))
    written = cut_lineage(cut)
    before = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (written.groupBy("_src", "_bucket").agg(F.sum("size").alias("_b"))
             .withColumn("_base", F.coalesce(F.sum("_b").over(before), F.lit(0))).drop("_b"))
    inside = W.partitionBy("_src", "_bucket").orderBy("doc_id", "_h", "_copy").rowsBetween(W.unboundedPreceding, -1)
    placed = written.join(bases, ["_src", "_bucket"]).withColumn(
        "_off", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return cut_lineage(placed.drop("_bucket", "_base")), plans


def slots_of(docs: DataFrame, plans: list[SourcePlan], s: MixSettings) -> DataFrame:
    """(out_shard, slot, _src, _block, _take): every slot of the mix and the block that fills it."""
    counts = draw_counts(np.array([p.slots for p in plans], dtype=np.int64), s) if plans else np.zeros((1, 1), np.int64)
    ends = np.cumsum(counts.ravel())              # slots in order of output shard, then source
    first = np.cumsum(counts, axis=0) - counts    # a source's slots already given to earlier shards
    n_sources = counts.shape[1]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["id"].to_numpy(np.int64)
            cell = np.searchsorted(ends, slot, "right")
            shard, src = cell // n_sources, cell % n_sources
            nth = slot - (ends[cell] - counts.ravel()[cell]) + first[shard, src]
            block = np.zeros(len(slot), np.int64)
            take = np.full(len(slot), s.block, np.int64)
            for i in np.unique(src):
                plan, mine = plans[i], np.flatnonzero(src == i)
                turn = nth[mine] // plan.blocks
                for t in np.unique(turn):
                    rows = mine[turn == t]
                    block[rows] = IndexPermutation(plan.blocks, pass_key(s, int(i), int(t))).forward(nth[rows] % plan.blocks)
                take[mine[nth[mine] == plan.slots - 1]] = plan.last
            yield pd.DataFrame({"out_shard": shard, "slot": slot, "_src": src, "_block": block, "_take": take})

    every = docs.sparkSession.range(int(ends[-1]) if len(ends) else 0)
    return every.mapInPandas(fill, "out_shard int, slot long, _src int, _block long, _take long")


def mix_pieces(docs: DataFrame, s: MixSettings = MixSettings()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents with source size and target; pieces are the mix itself.

    A piece (out_shard, slot, doc_id, source, word_from, word_to, and the
    document's _src, _off, _h, _copy) says which words of a document fill which part of a slot.
    Documents without words take no part.  A null source is a source of its
    own, after all others; a repeated row is one more document of its source.
    """
    placed, plans = place_documents(docs, s)
    parts = placed.where("size > 0").withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("_off") / s.block), F.floor((F.col("_off") + F.col("size") - 1) / s.block))))
    inside = F.col("_block") * s.block
    parts = parts.select(
        "doc_id", "source", "_h", "_copy", "_src", "_off", "_block", F.greatest(F.lit(0), inside - F.col("_off")).alias("word_from"),
        F.least(F.col("size"), inside + s.block - F.col("_off")).alias("word_to"),
        F.greatest(F.lit(0), F.col("_off") - inside).alias("_at"))
    joined = slots_of(docs, plans, s).join(parts, ["_src", "_block"]).where("_at < _take")
    pieces = joined.withColumn(
        "word_to", F.least("word_to", F.col("word_from") + F.col("_take") - F.col("_at"))).drop("_take")
    return placed, pieces


def mix_report(docs: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words of it that the mix takes."""
    placed, pieces = mix_pieces(docs, s)
    took = pieces.groupBy("_src", "_off").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_took"))
    took = took.withColumn("_some", F.lit(True))
    out = placed.withColumn("_some", F.col("size") > 0).join(took, ["_src", "_off", "_some"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target",
                      F.coalesce("_took", F.lit(0)).cast("long").alias("taken"))


def _cut_words(text: str, pieces: list[tuple[int, int]]) -> list[str]:
    """The text from the first to the last word of each piece, white space between them kept."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    return [text if (a, b) == (0, len(spans)) else text[spans[a][0]:spans[b - 1][1]] for a, b in pieces]


def mixed_documents(docs: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """The mix as a table of the columns of ``docs``: a row for every piece of a document in a slot.

    ``text`` holds the piece's words and ``n_chars`` (where present) its
    length; other columns are the document's own, also where rows share id and
    text.  Rows without words (null, empty, blank texts) take no part; a
    repeated row is mixed as often as it stands there.
    """
    small_batches(docs)
    _, pieces = mix_pieces(docs, s)
    lists = pieces.groupBy("doc_id", "source", "_h", "_copy").agg(  # at most most_repeats + 1 entries a block of one document
        F.collect_list(F.struct("word_from", "word_to")).alias("_pieces"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    mark = [*own, *[c.isNull() for c in own]]               # two hashes tell rows apart; equal rows are one, with copies
    rows = docs.select(F.struct(*own).alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                       text_hash().alias("_g"), F.xxhash64(*mark).alias("_v"), F.xxhash64(F.lit(1), *reversed(mark)).alias("_w"))
    same = rows.groupBy("_id", "_source", "_g", "_v", "_w").agg(F.count("*").alias("_n"))
    numbered = same.withColumn("_to", F.sum("_n").over(W.partitionBy("_id", "_source", "_g").orderBy("_v", "_w")))
    wanted = numbered.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (
        F.col("_h") == F.col("_g")) & (F.col("_copy") <= F.col("_to")) & (F.col("_copy") > F.col("_to") - F.col("_n"))).select("_v", "_w", "_pieces")
    both = rows.groupBy("_v", "_w").agg(F.any_value("_doc").alias("_doc")).join(wanted, ["_v", "_w"])

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([_cut_words(t, sorted((p["word_from"], p["word_to"]) for p in w)) for t, w in zip(text, wanted, strict=True)], dtype=object)

    made = both.select("_doc", F.explode(cut(F.col("_doc.text"), F.col("_pieces"))).alias("_piece"))
    columns = [F.col("_piece").alias(c) if c == "text" else F.length("_piece").cast(t).alias(c) if c == "n_chars"
               else F.col(f"_doc.`{c}`").alias(c) for c, t in docs.dtypes]
    return made.select(*columns)
