"""A Merkle tree over all rows of a dataset, with a proof per row that can be checked alone.

Every row is a leaf; the leaves of a language form a tree in the order of their ids, and the
roots of the languages form the tree of the dataset. Only hashes move: rows are hashed where
they are read. Leaves get their global positions from stored ranges, and positions are cut
into superblocks of ``1 << block_bits`` leaves, whose subtrees no other superblock takes part
in. Upwards, each superblock is reduced to one node, which is a leaf of the next round, until
every tree is one node. Downwards, the nodes outside a superblock that its proofs need are
cogrouped with its members, where the local reduction, the joining of proofs and the folding
happen at once. No task holds more than a superblock and one node per level above it.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import keep
from ticketlens.operators.batching import number_rows, place_rows

#: Leaves of a superblock are 2 to this power.
BLOCK_BITS = 12
#: Columns that a leaf is the hash of, in order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODES = "tree string, pos bigint, size bigint, hash string"
#: ``path``: what a node is hashed with, level by level: a neighbour with its side (L or R
#: and the hash), or an empty text for a node without one.
_OUTER = "tree string, pos bigint, path array<string>, subroot string, root string"
MANIFEST_SCHEMA = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row; ``changed`` replaces values of some columns."""
    fields = [_field(changed.get(c, F.col(c))) for c in LEAF_COLUMNS]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def manifest_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, and the leaf as it would be after tampering (null where it is not).

    ``tampered`` says whose ``n_chars`` grows by one; unknown counts stay. The tree is the
    language as a text that is never null, sorts like the language and has null first.
    """
    found = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        leaf_hash().alias("leaf"),
        F.when(found, leaf_hash(n_chars=more)).alias("changed"),
    )


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves with their position in their tree (by id, then hash; null ids first) and its size."""
    order = F.struct("tree", "doc_id", "leaf").alias("_order")
    ranges = place_rows(keep(leaves, "leaves").select("*", order), "_order")
    # One row per range, and one more for every tree that begins inside a range.
    counts = ranges.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(tree).alias("size"),
    )
    placed = ranges.join(keep(starts, "starts"), ["tree", "_range"])
    # As text: pandas would turn ids into floats beside a null.
    doc_id = F.col("doc_id").cast("string").alias("doc_id")
    return placed.select(doc_id, "tree", "leaf", "changed", (F.col("_place") + F.col("_shift")).alias("pos"), "size")


# -- one superblock ------------------------------------------------------------------


def local_levels(hashes: list[str], size: int, block_bits: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, up to its root; ``size`` is that of the whole tree."""
    levels = [hashes]
    for _ in range(min(block_bits, (size - 1).bit_length())):
        below = levels[-1]
        levels.append([hashed("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def local_path(levels: list[list[str]], at: int) -> list[str]:
    """What the node at a place of the superblock is hashed with on the way to the superblock's root."""
    path = []
    for level in levels[:-1]:
        other = at ^ 1
        path.append("" if other >= len(level) else "LR"[other > at] + level[other])
        at >>= 1
    return path


def folded(leaf: str, path: list[str]) -> str:
    """The root that follows from a leaf and what it is hashed with."""
    for step in path:
        if not step:
            leaf = hashed(leaf)
        else:
            leaf = hashed(step[1:] + leaf if step[0] == "L" else leaf + step[1:])
    return leaf


# -- rounds --------------------------------------------------------------------------


def _by_block(nodes: DataFrame, block_bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", block_bits))


def _climbed(nodes: DataFrame, block_bits: int) -> DataFrame:
    """One node per superblock, at the superblock's number."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        top = local_levels(rows.sort_values("pos")["hash"].tolist(), size, block_bits)[-1]
        return pd.DataFrame([(key[0], key[1], -(-size >> block_bits), top[0])])

    return _by_block(nodes, block_bits).groupBy("tree", "block").applyInPandas(reduce, _NODES)


def _rounds(nodes: DataFrame, block_bits: int) -> list[DataFrame]:
    """The nodes of every round, the last with one node per tree."""
    rounds, most = [nodes], nodes.agg(F.max("size")).head()[0] or 0
    while most > 1:
        rounds.append(keep(_climbed(rounds[-1], block_bits), "nodes"))
        most = -(-most >> block_bits)
    return rounds


def _descended(nodes: DataFrame, outer: DataFrame, block_bits: int) -> DataFrame:
    """``outer`` of superblocks turned into that of their members."""

    def exchange(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = local_levels(rows["hash"].tolist(), int(rows["size"].iloc[0]), block_bits)
        path, subroot, root = (above[c].iloc[0] for c in ("path", "subroot", "root"))
        known = [
            (key[0], pos, local_path(levels, at) + list(path), subroot, root) for at, pos in enumerate(rows["pos"].tolist())
        ]
        return pd.DataFrame(known)

    blocks = outer.withColumnRenamed("pos", "block")
    return (
        _by_block(nodes, block_bits)
        .groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInPandas(exchange, _OUTER)
    )


def _all_descended(rounds: list[DataFrame], outer: DataFrame, block_bits: int) -> DataFrame:
    for nodes in reversed(rounds):
        outer = keep(_descended(nodes, outer, block_bits), "outer")
    return outer


def _proved(leaves: DataFrame, outer: DataFrame, block_bits: int) -> DataFrame:
    """Every leaf with its roots, proof and folded root."""

    def prove(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = local_levels(rows["leaf"].tolist(), int(rows["size"].iloc[0]), block_bits)
        path, subroot, root = (above[c].iloc[0] for c in ("path", "subroot", "root"))
        out = []
        for at, (doc_id, leaf, changed) in enumerate(zip(*(rows[c].tolist() for c in ("doc_id", "leaf", "changed")))):
            steps = local_path(levels, at) + list(path)
            top = folded(changed if isinstance(changed, str) else leaf, steps)
            out.append((doc_id, leaf, subroot, root, hashed("".join(s[1:] for s in steps)), top, top == root))
        return pd.DataFrame(out)

    blocks = outer.withColumnRenamed("pos", "block")
    return (
        _by_block(leaves, block_bits)
        .groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInPandas(prove, MANIFEST_SCHEMA)
    )


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` has the columns of ``LEAF_COLUMNS``; others are not looked at. A leaf is the hash
    of the row's values, each with its length in bytes, or ``-`` for a null. Per language
    (null is one) leaves ascend by id, null ids first; of equal ids the smaller hash comes
    first, and equal rows, which nothing tells apart, get neighbouring places. Pairs of nodes
    are hashed until one is left (``subroot``); the last of an odd number is hashed alone; a
    lone leaf is its own subroot. Subroots in the order of their languages, null first, lead
    to ``root`` in the same way. The proof is the hash of all neighbours on the way to the
    root, that of an empty text if there are none. ``folded_root`` is what the leaf, changed
    where ``tampered`` holds, and the original neighbours lead to. An empty table gives no rows.
    """
    leaves = keep(placed_leaves(manifest_leaves(docs, tampered)), "placed_leaves")
    rounds = _rounds(leaves.select("tree", "pos", "size", F.col("leaf").alias("hash")), block_bits)
    subroots = keep(number_rows(rounds[-1].select(F.col("tree").alias("lang"), "hash"), "lang", "pos"), "subroots")
    trees = subroots.select(F.lit("").alias("tree"), "pos", F.lit(subroots.count()).cast("bigint").alias("size"), "hash")
    tops = _rounds(trees, block_bits)
    root = tops[-1].select("tree", F.lit(0).cast("bigint").alias("pos"), F.expr("CAST(array() AS array<string>) AS path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    # From the dataset's root down to the languages, then from their roots to the superblocks.
    of_tree = _all_descended(tops[:-1], root, block_bits).select("pos", "path", "root")
    outer = subroots.join(of_tree, "pos").select(
        F.col("lang").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("hash").alias("subroot"), "root"
    )
    outer = _all_descended(rounds[1:-1], outer, block_bits)
    proved = _proved(leaves, outer, block_bits)
    return proved.withColumn("doc_id", F.col("doc_id").cast("bigint"))
