"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors become one row first.  Several k-means fits, apart from each
other, divide the vectors into cells; a vector belongs to the ``nearest`` cells
of each fit and is compared within its cells only, so rows and products grow in
proportion to the vectors.  Two vectors at the threshold share no cell with a
probability of about 0.06 a fit, whatever way they differ (isotropic, in one
coordinate or in a few directions; measured on 64 dimensions), 2e-4 for three.
A pair counts in the first cell that its vectors share.  Cells are cut into
blocks, and a task multiplies two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import connected_components
from attesta.session import cut_lineage


@dataclass(frozen=True)
class VectorSettings:
    threshold: float = 0.95
    fits: int = 3
    nearest: int = 2            # cells of each fit that a vector belongs to
    per_cell: int = 256
    most_cells: int = 2048      # beyond per_cell x most_cells vectors cells grow and are cut into more blocks
    sample_per_cell: int = 32   # at most most_cells x sample_per_cell vectors fit the cells
    rounds: int = 8
    block: int = 1024


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an emptied cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        good = norms > 1e-9
        centres[good] = sums[good] / norms[good, None]
    return centres


def _usable() -> Column:
    """A row with an id whose vector is not zero and holds finite numbers only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows with the hashes of their vector, and one row (id, n, embedding) per distinct vector."""
    usable = vectors.select("vec_id", "embedding").where(_usable())
    keyed = usable.withColumns({"_g": F.xxhash64("embedding"), "_g2": F.xxhash64(F.lit(1), "embedding")})
    classes = keyed.groupBy("_g", "_g2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("x"))
    return keyed, cut_lineage(classes)


def _block_links(threshold: float):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, p, q = key
        left = rows[rows["mine"] == p]
        right = left if p == q else rows[rows["mine"] == q]
        none = pd.DataFrame({"id": [], "links": [], "label": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        close = unit_rows(left["x"]) @ unit_rows(right["x"]).T >= threshold
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if p == q:
            close &= a[:, None] < b[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            return none
        mine, other = np.stack(left["cells"].to_numpy())[i], np.stack(right["cells"].to_numpy())[j]
        both = (mine[:, :, None] == other[:, None, :]).any(axis=2)
        first = np.where(both, mine, np.iinfo(mine.dtype).max).min(axis=1) == cell   # the pair counts here, not in another cell
        i, j = i[first], j[first]
        ids, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        u, v = place[:len(i)], place[len(i):]
        count = (np.bincount(u, weights=right["n"].to_numpy()[j], minlength=len(ids))
                 + np.bincount(v, weights=left["n"].to_numpy()[i], minlength=len(ids)))
        label, before = ids.copy(), None
        while before is None or (label != before).any():     # smallest id joined inside this pair of blocks
            before = label.copy()
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
        return pd.DataFrame({"id": ids, "links": count.astype(np.int64), "label": label})

    return links


def link_vectors(classes: DataFrame, s: VectorSettings) -> DataFrame:
    """(id, links, label) from every pair of blocks that found links: partial link counts, and a joined id."""
    n = classes.count()
    cells = int(min(max(n // s.per_cell, 1), s.most_cells))
    sample = classes.orderBy(F.xxhash64("id")).limit(cells * s.sample_per_cell).toArrow().to_pandas()
    length = int(sample["x"].map(len).mode().iloc[0]) if len(sample) else 1
    fit = sample[sample["x"].map(len) == length]
    known = unit_rows(fit["x"]) if len(fit) else np.zeros((1, 1))
    fits = s.fits if cells > s.nearest else 1               # so few cells hold every pair at once
    centres = classes.sparkSession.sparkContext.broadcast([
        fit_cells(known[np.random.default_rng(i).permutation(len(known))], min(cells, len(known)), s.rounds) for i in range(fits)])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                size = part["x"].map(len).to_numpy(np.int64)
                usual = size == length
                homes = [[-k] for k in size]                 # vectors of another length: a cell of their own
                if usual.any():
                    x, found = unit_rows(part["x"][usual]), []
                    for i, c in enumerate(centres.value):
                        near = min(s.nearest, len(c))
                        found.append(np.argpartition(-(x @ c.T), near - 1, axis=1)[:, :near] + i * s.most_cells)
                    for row, own in zip(np.flatnonzero(usual), np.concatenate(found, axis=1)):
                        homes[row] = own.tolist()
                yield part.assign(cells=homes)[["id", "n", "x", "cells"]]

    kind = dict(classes.dtypes)["x"]
    homed = cut_lineage(classes.select("id", "n", "x").mapInPandas(assign, f"id long, n long, x {kind}, cells array<long>"))
    sizes = homed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("_n"))
    parts = sizes.select("cell", F.ceil(F.col("_n") / s.block).cast("int").alias("_parts"))
    rows = homed.withColumn("cell", F.explode("cells")).join(F.broadcast(parts), "cell")   # a row a cell: fits x most_cells and a few
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    work = rows.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "id", "n", "x", "cells")
    return work.groupBy("cell", "p", "q").applyInPandas(_block_links(s.threshold), "id long, links long, label long")


def dedup_vectors(vectors: DataFrame, s: VectorSettings = VectorSettings()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows whose vector is null, empty, zero or holds null or non-finite numbers,
    and rows without an id, link with nothing and are kept.  Rows that repeat a
    vector are linked with each other; vectors of different lengths never are.
    """
    keyed, classes = distinct_vectors(vectors)
    found = cut_lineage(link_vectors(classes, s))
    degree = found.groupBy("id").agg(F.sum("links").alias("_links"))
    joined = connected_components(found.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    reps = (classes.drop("x").join(degree, "id", "left")
            .join(joined.select(F.col("node").alias("id"), F.col("component").alias("_c")), "id", "left")
            .select("_g", "_g2", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
                    F.coalesce("_c", "id").alias("component_id")))
    linked = keyed.join(reps, ["_g", "_g2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select("vec_id", "embedding").where(~_usable())
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
