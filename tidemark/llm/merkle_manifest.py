"""A Merkle manifest of a table: one root for all rows, and for each row a proof against it.

H is SHA-256 in lowercase hex of its inputs one after another; digests go in as hex. A leaf is H of the row's columns, each `-`
if null, else the count of its UTF-8 bytes, a colon and the value. The rows of a source, in order of doc_id, are the leaves of its
tree: every `FAN` consecutive nodes become one, the last run having fewer, as long as there are several nodes. What remains
is the source's subroot; subroots in order of their sources are the leaves of one more tree, and its last node is the root.

Work is dealt by superblock, `FAN`**`DEPTH` consecutive nodes of a tree, and a node's place is exact: rows are sorted by range,
stored, and numbered by their place in the partition and the counts of the partitions before. Upwards, each superblock becomes
its top node in one group; the tops are the nodes of the next round, until every tree is one node. Downwards, a superblock's
nodes are cogrouped with the outer nodes that it needs: the siblings on the way from its top to the root, which the round above
has returned. Each group builds its local levels again, joins the siblings inside with those outside, and folds its rows'
leaves, all in one pass. A group holds `FAN`**`DEPTH` digests however large the source, and texts are hashed where they are read.

Defined cases: a null source comes first, before ''; rows of one doc_id are ordered by their leaves, a null doc_id first; rows
that are alike have leaves that are alike and each their own place and proof; a tree of one leaf is that leaf; without any sibling
a proof is empty; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import free, stored

FAN, DEPTH = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings by level, upwards: those before the node, then those after it, each as hex one after another.
PATH = "array<string>"


def leaf(columns: Sequence[str] = COLUMNS, **instead: Column) -> Column:
    """The digest of a row; instead: other values for some columns."""
    parts = []
    for c in columns:
        value = instead.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows with place (from 0, in its tree by order) and nodes (how many its tree has).

    A range sort that is stored, then prefix sums over one row for each tree in each partition.
    """
    by = [F.asc_nulls_first(c) for c in (tree, *order)]
    # The row's number in its partition lies in the low 33 bits.
    at = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id()))
    at = at.withColumns({"slice_": F.shiftright("at_", 33), "at_": F.col("at_").bitwiseAND((1 << 33) - 1)})
    before = Window.partitionBy(tree).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    slices = at.groupBy(tree, "slice_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    slices = slices.select(tree, "slice_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("n_").over(Window.partitionBy(tree)).alias("nodes"))
    found = at.join(slices, [tree, "slice_"])
    return found.select(*rows.columns, (F.col("at_") + F.col("shift_")).alias("place"), "nodes")


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(nodes: list[str], all_nodes: int, depth: int = DEPTH) -> list[list[str]]:
    """Levels of a superblock from its nodes up to its top: as many as its tree has, `depth` at most."""
    levels = [nodes]
    while all_nodes > 1 and len(levels) <= depth:
        nodes = [hashed("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        all_nodes = -(-all_nodes // FAN)
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """The path of a node up to the top of its superblock."""
    out = []
    for level in levels[:-1]:
        a = i - i % FAN
        out += ["".join(level[a:i]), "".join(level[i + 1 : a + FAN])]
        i //= FAN
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and its path give."""
    for i in range(0, len(path), 2):
        node = hashed(path[i] + node + path[i + 1])
    return node


def _block(depth: int) -> Column:
    return F.expr(f"place div {FAN**depth}")


def raised(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, place, nodes, node: the top of each superblock of tree, place, nodes, node."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        n = int(rows["nodes"].iloc[0])
        node = local_levels(rows["node"].tolist(), n, depth)[-1][0]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [int(rows["place"].iloc[0]) // FAN**depth], "nodes": [-(-n // FAN**depth)], "node": [node]})

    return nodes.select("tree", _block(depth).alias("block"), "place", "nodes", "node").groupBy("tree", "block").applyInPandas(top, "tree string, place long, nodes long, node string")


def rounds(nodes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Nodes of every round, the last with one node a tree; each but the first is stored."""
    out = [nodes]
    while (out[-1].agg(F.max("nodes")).first()[0] or 0) > 1:
        out.append(stored(raised(out[-1], depth)))
    return out


def lowered(nodes: DataFrame, above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes with path and subroot: the siblings inside their superblock, then what above (tree, place, path, subroot of its top) tells of those outside.

    nodes has tree, place, nodes, node, and now or not: then the root that now, or else node, folds to is added as folded_root.
    """

    def exchange(inner: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("place")
        own = inner["node"].tolist()
        levels = local_levels(own, int(inner["nodes"].iloc[0]), depth)
        rest = list(top["path"].iloc[0])
        paths = [siblings(levels, i) + rest for i in range(len(own))]
        out = inner.drop(columns="block").assign(path=paths, subroot=top["subroot"].iloc[0])
        if "now" in out:
            out["folded_root"] = [folded(now or node, path) for now, node, path in zip(out.pop("now"), own, paths, strict=True)]
        return out

    kept = ", ".join(f"{c} {kind}" for c, kind in nodes.dtypes if c != "now")
    more = ", folded_root string" if "now" in nodes.columns else ""
    inner = nodes.withColumn("block", _block(depth)).groupBy("tree", "block")
    tops = above.select("tree", F.col("place").alias("block"), "path", "subroot").groupBy("tree", "block")
    return inner.cogroup(tops).applyInPandas(exchange, f"{kept}, path {PATH}, subroot string{more}")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, changed: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, source, place, leaf, subroot, root, path and folded_root of every row of docs.

    path holds the siblings of each level up to the root. folded_root is what leaf and path fold to; of rows that were changed after
    the manifest was made (changed: their new values of some columns) it is what their new leaf folds to, so it differs from root.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(columns).alias("node"), leaf(columns, **(changed or {})).alias("now"))
    # A tree's name sorts as its source does: null first, then by bytes. Rows that are alike are parted by where they were read.
    rows = rows.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tree"), "node", F.when(F.col("now") != F.col("node"), F.col("now")).alias("now"), F.monotonically_increasing_id().alias("read"))
    rows = stored(rows)
    leaves = stored(placed(rows, "tree", ("doc_id", "node", "read")).drop("read"))
    free(rows)
    below = rounds(leaves.select("tree", "place", "nodes", "node"), depth)
    subroots = stored(placed(below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "node"), "tree", ("source_tree",)))
    over = rounds(subroots.select("tree", "place", "nodes", "node"), depth)
    last = over[-1].first()
    root = F.lit(last["node"] if last else None).cast("string")
    # Down again; the last node has no siblings.
    paths = over[-1].select("tree", "place", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(over[:-1]):
        paths = stored(lowered(nodes, paths, depth))
    paths = subroots.join(paths.select("place", "path"), "place").select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"))
    for nodes in reversed(below[1:-1]):
        paths = stored(lowered(nodes, paths, depth))
    return lowered(leaves, paths, depth).select("doc_id", "source", "place", F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", "folded_root")


def verified(row: Column, path: Column, root: Column) -> Column:
    """Whether a leaf and its path fold to a root, as a column: a proof is checked without its tree."""
    pairs = F.sequence(F.lit(0), F.size(path) - 2, F.lit(2))
    fold = F.aggregate(pairs, row, lambda node, i: F.sha2(F.concat(path[i], node, path[i + 1]), 256))
    return F.when(F.size(path) == 0, row).otherwise(fold).eqNullSafe(root)
