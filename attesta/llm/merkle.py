"""Merkle manifest with incremental witnesses.

Leaves of a group are appended in order to a stack of open subtrees.  A node
that joins an open run starts a partial witness with its siblings to the left;
each sibling completed later extends it to the right.  A group's leaves are cut
into aligned blocks of ``fan ** height`` that tasks append apart from each
other; block roots are then appended in the same way, until each group has one
root, and group roots are appended to one last tree.  A later batch of leaves
opens only the last block of each group again (``append``).

A witness is a list of steps, bottom up: the joined digests left and right of
the node in its run.  A run may be a node alone; its step is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import cut_lineage

STEPS = "array<struct<left: string, right: string>>"
_ARROW_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class MerkleSettings:
    """``fan`` children a node; a block holds ``fan ** height`` leaves (729), all that a task keeps at once."""

    fan: int = 3
    height: int = 6

    @property
    def block(self) -> int:
        return self.fan**self.height


def encoded(column: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value as text."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def fold(steps: Column, digest: Column) -> Column:
    """The root that a digest and a witness give."""
    return F.aggregate(steps, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


class Node:
    """A digest in an open run; ``left`` and ``right`` are its partial witness."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, digest: str, left: str):
        self.digest, self.left, self.right, self.parent = digest, left, "", None

    def steps(self) -> list[dict[str, str]]:
        node, out = self, []
        while node.parent is not None:
            out.append({"left": node.left, "right": node.right})
            node = node.parent
        return out


class OpenSubtrees:
    """Streaming append: at most one open run a level."""

    def __init__(self, fan: int):
        self.fan, self.runs = fan, [[]]

    def append(self, digest: str, level: int = 0) -> Node:
        run = self.runs[level]
        node = Node(digest, "".join(n.digest for n in run))
        for earlier in run:
            earlier.right += digest
        run.append(node)
        if len(run) == self.fan:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        if level + 1 == len(self.runs):
            self.runs.append([])
        parent = self.append(hashlib.sha256("".join(n.digest for n in run).encode()).hexdigest(), level + 1)
        for node in run:
            node.parent = parent

    def close(self, height: int | None) -> str:
        """Complete open runs, up to one node, or up to ``height`` levels where more blocks follow or precede."""
        level = 0
        while True:
            alone = len(self.runs[level]) == 1 and not any(self.runs[level + 1:])
            if alone and (height is None or level == height):
                return self.runs[level][0].digest
            if self.runs[level]:
                self._complete(level)
            level += 1


def _witnessed(batches: Iterable[pa.RecordBatch], s: MerkleSettings) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and position, with their steps inside the block and the block's root."""
    key, trees, nodes, parts, whole = None, None, [], [], True

    def closed() -> Iterator[pa.RecordBatch]:
        root = trees.close(None if whole else s.height)
        done = 0
        for part in parts:
            mine = nodes[done:done + part.num_rows]
            done += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([n.steps() for n in mine], _ARROW_STEPS), pa.array([root] * len(mine), pa.string())],
                names=[*part.schema.names, "steps", "block_root"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "pos", "n", "digest")]
        start = 0
        for i, (grp, pos, n, digest) in enumerate(zip(*columns)):
            if key != (grp, pos // s.block):
                if key is not None:
                    parts.append(batch.slice(start, i - start))
                    yield from closed()
                key, trees, nodes, parts, start, whole = (grp, pos // s.block), OpenSubtrees(s.fan), [], [], i, n <= s.block
            nodes.append(trees.append(digest))
        parts.append(batch.slice(start))
    if key is not None:
        yield from closed()


def _with_blocks(rows: DataFrame, s: MerkleSettings) -> DataFrame:
    """``rows`` (grp, pos, n, digest and others) with ``steps`` inside their block and ``block_root``, as a table."""
    base = rows.drop("steps", "block_root")
    dealt = (base.repartition("grp", F.floor(F.col("pos") / s.block)).sortWithinPartitions("grp", "pos"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return cut_lineage(dealt.mapInArrow(lambda batches: _witnessed(batches, s), f"{fields}, steps {STEPS}, block_root string"))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 in each group, and ``n``, the group's size.

    Rows are range-sorted as a whole, so a group may span many tasks; only
    counts by group and task meet.
    """
    placed = cut_lineage(rows.repartitionByRange("grp", *order).withColumn("_part", F.spark_partition_id()))
    earlier = W.partitionBy("grp").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("grp", "_part").agg(F.count("*").alias("_rows")).select(
        "grp", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_rows").over(W.partitionBy("grp")).alias("n"))
    inside = F.row_number().over(W.partitionBy("grp", "_part").orderBy(*order))
    return placed.join(sizes, ["grp", "_part"]).withColumn("pos", F.col("_base") + inside - 1).drop("_part", "_base")


@dataclass(frozen=True)
class Manifest:
    """``rows``: leaves with grp, pos, n, digest, steps inside their block and block_root, as a table."""

    rows: DataFrame
    settings: MerkleSettings


def _leaves(docs: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """Rows as leaves: a null group sorts first, ties in ``order`` by digest, equal rows in any order."""
    grp = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), grp.alias("grp"), F.col(order).alias("_o"), F.col(digest).alias("digest"),
                       F.monotonically_increasing_id().alias("_tie"))


def build(docs: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf",
          settings: MerkleSettings = MerkleSettings()) -> Manifest:
    """A manifest over ``docs``, one leaf a row.  The row rides along as one struct, so no name can clash."""
    leaves = cut_lineage(_leaves(docs, group, order, digest))
    return Manifest(_with_blocks(_numbered(leaves, ["_o", "digest", "_tie"]).drop("_o", "_tie"), settings), settings)


def append(manifest: Manifest, docs: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf") -> Manifest:
    """The manifest with further leaves behind those of their group; closed blocks are not touched."""
    s, old = manifest.settings, manifest.rows
    fresh = _numbered(cut_lineage(_leaves(docs, group, order, digest)), ["_o", "digest", "_tie"]).drop("_o", "_tie")
    held = old.groupBy("grp").agg(F.count("*").alias("_held"))
    added = fresh.groupBy("grp").agg(F.count("*").alias("_added"))
    sizes = held.join(added, "grp", "full").select("grp", F.coalesce("_held", F.lit(0)).alias("_held"),
                                                   F.coalesce("_added", F.lit(0)).alias("_added"))
    fresh = fresh.join(sizes, "grp").withColumns({"pos": F.col("pos") + F.col("_held"), "n": F.col("_held") + F.col("_added")})
    old = old.join(sizes, "grp").withColumns({
        "n": F.col("_held") + F.col("_added"),
        "_open": (F.col("_added") > 0) & (F.col("pos") >= F.col("_held") - F.col("_held") % s.block)})
    columns = ["row", "grp", "pos", "n", "digest"]
    again = _with_blocks(old.where("_open").select(*columns).union(fresh.select(*columns)), s)
    closed = old.where(~F.col("_open")).select(*columns, "steps", "block_root")
    return Manifest(cut_lineage(closed.union(again.select(*columns, "steps", "block_root"))), s)


def _above(level: DataFrame, s: MerkleSettings) -> DataFrame:
    """The blocks of a level as the nodes of the next one."""
    return level.where(F.col("pos") % s.block == 0).select(
        "grp", F.floor(F.col("pos") / s.block).alias("pos"), F.ceil(F.col("n") / s.block).alias("n"),
        F.col("block_root").alias("digest"))


def _levels(leaves: DataFrame, s: MerkleSettings) -> list[DataFrame]:
    """Leaves, block roots, roots of blocks of these, and so on until no group has more than one block."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > s.block:
        levels.append(_with_blocks(_above(levels[-1], s), s))
    return levels


def _descended(levels: list[DataFrame], over: DataFrame, s: MerkleSettings) -> DataFrame:
    """The lowest level with ``path``, its steps followed by those of all levels above and of its group in ``over``."""
    top, *lower = reversed(levels)
    done = top.join(over, "grp").withColumn("path", F.concat("steps", "_path"))
    for level in lower:
        above = done.select("grp", F.col("pos").alias("_block"), F.col("path").alias("_path"), "subroot")
        done = (level.withColumn("_block", F.floor(F.col("pos") / s.block)).join(above, ["grp", "_block"])
                .withColumn("path", F.concat("steps", "_path")))
    return done


def _group_roots(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].where("pos = 0").select("grp", F.col("block_root").alias("digest"))


def witnesses(manifest: Manifest) -> DataFrame:
    """(row, digest, steps, subroot, root): each leaf with its whole witness, its group's root and the root of all.

    A group of one leaf has that leaf as its root, one group's root is the root
    of all, and no leaves give no rows.  Witnesses grow with the logarithm of
    the leaves.
    """
    s = manifest.settings
    levels = _levels(manifest.rows, s)
    top = _numbered(_group_roots(levels).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"])
    tops = _levels(_with_blocks(top, s), s)
    root = _group_roots(tops).first()  # at most one row
    nothing = tops[-1].select("grp", F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("_path")).distinct()
    groups = _descended(tops, nothing, s).select(F.col("of").alias("grp"), F.col("path").alias("_path"), F.col("digest").alias("subroot"))
    return _descended(levels, groups, s).select(
        "row", "digest", F.col("path").alias("steps"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"))
