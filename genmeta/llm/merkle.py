"""A Merkle manifest of a data set: a tree of each source's rows, one tree over the sources, and a proof of every row.

A leaf is the sha256 of a row's columns, each written as its length and value, so no two rows share a text of columns. The leaves of
a source stand in order of doc_id; runs of FAN consecutive nodes are hashed into one until one is left, the source's subroot. The
subroots, in order of the source's bytes, are the leaves of the last tree. A last run may be short, and even of one node.

How it runs. Leaves are numbered by a sort over ranges of (source, doc_id, leaf), so a source of any size is spread over many
tasks, and texts never leave the scan: only two digests of a row do. A superblock is FAN ** LEVELS consecutive nodes of one tree.
Going up, the nodes of each superblock are hashed into its one top, and the tops are the nodes of the next round: rounds grow with
the logarithm of the largest source. Going down, cogrouped subtree exchange: applyInPandas brings the nodes of a superblock
together with the outer siblings of its top, hashes the block's own levels again, joins both into each node's proof and, for
leaves, folds it. A task holds one superblock and one list of outer siblings, whatever the size of a source.

Defined results: a null in any column is written as "-". Rows with a null doc_id come first in their source. Rows with the same
doc_id stand in the order of their leaves; rows alike in all five columns have the same leaf but each its own place. Further columns
don't count. An empty table gives an empty result. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, written

FAN = 16
LEVELS = 3
Path = list[tuple[list[str], int]]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each as its number of UTF-8 bytes, a colon and itself; "-" where it is null."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block and those of the levels above, the block's top last."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[list[str], int]]:
    """For each level up to the top, the others of the node's run and its place among them."""
    for below in levels[:-1]:
        start = at // FAN * FAN
        run = below[start : start + FAN]
        yield run[: at - start] + run[at - start + 1 :], at - start
        at //= FAN


def folded(node: str, path: Path) -> str:
    for others, at in path:
        node = digest([*others[:at], node, *others[at:]])
    return node


def numbered(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """df with pos, the row's place in its tree, and n, the tree's rows: sorted ranges, counted apart, then shifted."""
    ordered = written(df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33)
    counts = ordered.groupBy(tree, part.alias("part")).agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    of_tree = Window.partitionBy(tree)  # one row for each task at most
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(tree, "part", F.sum("rows").over(of_tree).alias("n"), (before - F.col("first")).alias("shift"))
    return ordered.withColumn("part", part).join(shifts, [tree, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**LEVELS).cast("long"))


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, node): the top of each superblock of nodes (tree, pos, n, node)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        top = reduced(block["node"].tolist(), min(LEVELS, height(n)))[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [block["block"].iloc[0]], "n": [-(-n // FAN**LEVELS)], "node": [top]})

    return blocked(nodes.select("tree", "pos", "n", "node")).groupBy("tree", "block").applyInPandas(run, "tree string, pos long, n long, node string")


def exchanged(nodes: DataFrame, outer: DataFrame, finish: Callable[[pd.DataFrame, list[Path], list[str]], pd.DataFrame], schema: str) -> DataFrame:
    """Cogroups the nodes of each superblock with the outer siblings (tree, block, marks, others, at) of its top; finish gets a block's rows in order, a proof for each, and the marks."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if block.empty:
            return finish(block, [], [])
        block = block.sort_values("pos")
        levels = reduced(block["node"].tolist(), min(LEVELS, height(int(block["n"].iloc[0]))))
        outside = above.iloc[0]
        rest = [(list(o), int(a)) for o, a in zip(outside["others"], outside["at"], strict=True)]
        return finish(block, [[*siblings(levels, i), *rest] for i in range(len(block))], list(outside["marks"]))

    return blocked(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


OUTER = "tree string, block long, marks array<string>, others array<array<string>>, at array<int>"


def handed_down(block: pd.DataFrame, proofs: list[Path], marks: list[str]) -> pd.DataFrame:
    """What the superblocks below need: a node's proof is their outer siblings. marks are the roots above: the root, then the subroot."""
    return pd.DataFrame({"tree": block["tree"], "block": block["pos"], "marks": [marks] * len(block), "others": [[o for o, _ in p] for p in proofs], "at": [[a for _, a in p] for p in proofs]})


def to_sources(block: pd.DataFrame, proofs: list[Path], marks: list[str]) -> pd.DataFrame:
    """Each subroot's proof, for the one block at the top of its source's tree."""
    down = handed_down(block.assign(tree=block["source_tree"], pos=0), proofs, marks)
    return down.assign(marks=[[*marks, node] for node in block["node"]])


def climbed(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round of superblocks, and the last tops (tree, pos, n, node): one for each tree."""
    rounds, top = [nodes], written(tops(nodes), name)
    while not top.filter("n > 1").isEmpty():
        rounds.append(top)
        top = written(tops(top), name)
    return rounds, top


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    proof_sha256 is the hash of all siblings of the row, from its leaf to the root. folded_root starts from the leaf of the row as
    it is now (where tampered holds, its text in lower case stands for a changed one) and folds the proof; verified says whether
    that gives the root.
    """
    values = [F.col(f) for f in FIELDS]
    changed = F.when(F.lit(False) if tampered is None else tampered, leaf_hash(*values[:-1], lower_ascii(F.col("text").cast("string"))))
    # the tree of a source: null sorts before all others, also before the empty one
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"), leaf_hash(*values).alias("node"), changed.alias("now"))
    leaves = written(numbered(leaves, "tree", ["doc_id", "node"], "ordered"), "leaves")
    rounds, subroots = climbed(leaves, "tops")
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "node")
    sources = written(numbered(sources, "tree", ["source_tree"], "ordered"), "subroots")
    upper, root = climbed(sources, "tops")

    nothing = F.array()
    start = root.select("tree", F.lit(0).cast("long").alias("block"), F.array("node").alias("marks"), nothing.cast("array<array<string>>").alias("others"), nothing.cast("array<int>").alias("at"))
    for nodes in reversed(upper[1:]):
        start = written(exchanged(nodes, start, handed_down, OUTER), "outer")
    start = written(exchanged(sources, start, to_sources, OUTER), "outer")
    for nodes in reversed(rounds[1:]):
        start = written(exchanged(nodes, start, handed_down, OUTER), "outer")

    def finish(block: pd.DataFrame, proofs: list[Path], marks: list[str]) -> pd.DataFrame:
        now = block["now"].where(block["now"].notna(), block["node"])
        root, subroot = marks or (None, None)
        return pd.DataFrame({
            "doc_id": block["doc_id"], "leaf": block["node"], "subroot": subroot, "root": root, "proof_sha256": [digest([x for o, _ in p for x in o]) for p in proofs],
            "folded_root": [folded(x, p) for x, p in zip(now, proofs, strict=True)],
        })

    rows = exchanged(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), start, finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "verified": F.col("folded_root") == F.col("root")})


def every_fifth() -> Column:
    """Rows whose crc32 of the decimal doc_id is divisible by 5; a null doc_id has no decimal and counts as untouched."""
    return F.col("doc_id").isNotNull() & (fold(5) == 0)
