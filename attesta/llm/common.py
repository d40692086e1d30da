"""Helpers shared by the training-data operators: word batches, row identity, connected components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import cut_lineage


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Send rows to Python in batches of at most ``BATCH_ROWS``, as whole texts are long; a smaller setting stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def text_hash(column: str = "text") -> Column:
    """64-bit hash that tells a null text from an empty one."""
    return F.xxhash64(F.col(column).isNull(), F.col(column))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position, so that no helper column can clash, and each column's new name."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word (wrapping arithmetic)."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def batch_words(texts: Iterable[str | None], lower: bool = False) -> tuple[list[str], np.ndarray]:
    """All white-space separated words of a batch of texts, and how many each text has."""
    words: list[str] = []
    counts = []
    for text in texts:
        mine = (text.lower() if lower else text).split() if text else []
        counts.append(len(mine))
        words += mine
    return words, np.array(counts, dtype=np.int64)


def slices(counts: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Cut rows into runs whose counts add up to about ``most``; a longer row is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(counts):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(counts):
        yield start, len(counts)


def distinct_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes into the distinct words of a batch, and those words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, object)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes, distinct


def word_hashes(words: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``; only nodes with an edge appear.

    Alternates two star steps until no edge changes: every node hands its
    smallest neighbour to its larger neighbours, then to its smaller ones.
    The number of rounds grows with the logarithm of the longest path.  A
    round's edges are written to the shared checkpoint folder, so a lost
    executor re-reads one table.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        links = cut_lineage(small)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    stars = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("u").alias("node"), "component").union(roots)


def char_grams(words: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of each word written as ``<word>``, and the word each belongs to."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    framed = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the word's end
    hashes, owners = [], []
    for n in sizes:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + points[i:len(points) - n + 1 + i]
        keep = left[:len(h)] >= n
        hashes.append(h[keep])
        owners.append(owner[:len(h)][keep])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix64(np.concatenate(hashes)), np.concatenate(owners)


def key_filter(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit set for every key's low bits: at most 2**bits / 8 bytes whatever the input.

    It only ever lets too many rows through, so an exact join must follow it.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(low, 15).alias("w"), low.bitwiseAND(F.lit(32767)).alias("b"))
    made = words.groupBy("w").agg(F.bitmap_construct_agg("b").alias("bits"))
    out = np.zeros((1 << max(bits - 15, 0), 4096), np.uint8)
    for row in made.toLocalIterator():
        out[row["w"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
