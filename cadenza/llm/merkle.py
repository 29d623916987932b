"""A Merkle manifest of a dataset: digests, authentication paths and their check, per source and over all.

Method: fractal traversal.  The tree is ternary: of every three consecutive nodes (the last
run has fewer, even one) one digest is made.  The leaves of a source, in order, fall into
aligned blocks of ``3 ** HEIGHT``; one task walks a block from left to right with a stack of
*existing* subtrees, one per band of ``STEP`` levels, from which the path of the leaf at hand
is read, and a *desired* subtree beside each, which grows by one leaf at every step and takes
its neighbour's place when that is used up.  Nodes below a subtree's own levels are dropped as
soon as their parent is there, so that a walk holds ``2 * 3 ** STEP`` nodes a band beside the
block's own digests.

Plan: (1) leaf digests come from one scan with built-in functions, and only they go on;
(2) places within a source come from a range sort by source and id, whose rows are numbered
as they lie, and a running sum over (part, source) counts, so that a source with a third of all
rows is spread over a third of the parts; (3) blocks give their roots, roots form blocks of
their own until one node a source is left, and the sources' nodes go through the same; (4) paths
come down again: each block meets the path of its root (one row per block) and puts its own
before it.  A round cuts the rows by ``3 ** HEIGHT``, so that 50 thousand million leaves take four.

Edge cases: null columns count as ``-``; a null source is a source of its own, first in order;
null ids come first within a source and are never tampered with; rows of one id are ordered by
leaf; equal rows are leaves as often as they occur, each with its own path; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialise

HEIGHT = 7
STEP = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATHS = "tree string, pos long, name string, digest string, path array<string>, subroot string, root string"


def digest_of(run: list[str]) -> str:
    """The digest of digests in a row, read as lowercase hexadecimal text."""
    return sha256("".join(run).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    found, room = 0, 1
    while room < n:
        found, room = found + 1, room * 3
    return found


class Subtree:
    """The nodes of height ``low`` to below ``high`` under one node of height ``high``, built leaf by leaf."""

    def __init__(self, leaves: list[str], index: int, low: int, high: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.at = min(index * 3**high, len(leaves))
        self.end = min((index + 1) * 3**high, len(leaves))
        self.levels: list[list[str]] = [[] for _ in range(high - low)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root: str | None = None

    def grow(self) -> None:
        """Take in one more leaf; after the last one also close the runs that lack nodes."""
        if self.at == self.end:
            return
        self._put(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for height, run in enumerate(self.open):
                if run:
                    self.open[height] = []
                    self._put(height + 1, digest_of(run))

    def grown(self) -> Subtree:
        while self.at < self.end:
            self.grow()
        return self

    def _put(self, height: int, digest: str) -> None:
        if height == self.high:
            self.root = digest
            return
        if height >= self.low:
            self.levels[height - self.low].append(digest)
        run = self.open[height]
        run.append(digest)
        if len(run) == 3:
            self.open[height] = []
            self._put(height + 1, digest_of(run))


def block_root(leaves: list[str], height: int) -> str:
    return Subtree(leaves, 0, height, height).grown().root if height else leaves[0]


def walk(leaves: list[str], height: int, step: int = STEP) -> Iterator[list[str]]:
    """Of each leaf in order, by level: the siblings left of its node, those right of it (each joined)."""
    bands = [(low, min(low + step, height)) for low in range(0, height, step)]
    existing = [Subtree(leaves, 0, low, high).grown() for low, high in bands]
    desired = [Subtree(leaves, 1, low, high) for low, high in bands]
    for at in range(len(leaves)):
        path = []
        for (low, high), tree in zip(bands, existing, strict=True):
            first = at // 3**high
            for h in range(low, high):
                node = at // 3**h
                place, inside = node % 3, node - node % 3 - first * 3 ** (high - h)
                run = tree.levels[h - low][inside : inside + 3]
                path += ["".join(run[:place]), "".join(run[place + 1 :])]
        yield path
        for k, (low, high) in enumerate(bands):
            desired[k].grow()
            if (at + 1) % 3**high == 0:
                existing[k] = desired[k]
                desired[k] = Subtree(leaves, (at + 1) // 3**high + 1, low, high)


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest_of([left, leaf, right])
    return leaf


def leaf_digest(text: str | Column = "text") -> Column:
    """The digest of a document's fields, each as its length in bytes and its value."""

    def field(value: Column) -> Column:
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value))

    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col(text) if isinstance(text, str) else text]
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(docs: DataFrame) -> Column:
    """The digest after a text lost its line feeds, in documents that tampering meets; null elsewhere."""
    met = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(met, leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Rows with pos, their place from 0 within ``tree`` by ``order``, and n, the rows of that tree.

    Neither needs a tree's rows in one task: parts of a range sort are numbered as they lie.
    """
    spark = rows.sparkSession
    kept = materialise(rows, "merkle-rows").withColumn("_k", F.monotonically_increasing_id())  # parts equal rows
    by = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("_k")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lying = kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_k")
    lying = materialise(lying.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    runs = lying.groupBy(tree, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy(tree)  # one row per part that the tree spans
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "_part", "_first", before.alias("_before"), F.sum("_rows").over(w).alias("n"))
    found = lying.withColumn("_part", part).join(runs, [tree, "_part"])
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(3**height)).cast("long"))


def _levels(n: int, height: int) -> int:
    return min(height, depth(n))


def _climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, of these, and so on to one node a tree."""

    def roots(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        digest = block_root(block["digest"].to_pylist(), _levels(n, height))
        return pa.table({"tree": block["tree"][:1], "pos": block["block"][:1], "n": pa.array([-(-n // 3**height)], pa.int64()), "digest": [digest], "name": pa.array([None], pa.string())})

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = _blocks(rounds[-1], height).select("tree", "pos", "n", "digest", "block").groupBy("tree", "block")
        rounds.append(materialise(up.applyInArrow(roots, "tree string, pos long, n long, digest string, name string"), "merkle-nodes"))
    return rounds


def _meet(nodes: DataFrame, upper: DataFrame, height: int, run, schema: str) -> DataFrame:
    """``run`` on each block of nodes and the path of the block's root."""
    above = upper.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    return _blocks(nodes, height).groupBy("tree", "block").cogroup(above).applyInArrow(run, schema)


def _descend(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """The path of each node, given those of the blocks' roots."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        top = above.to_pylist()[0]
        paths = [p + top["path"] for p in walk(block["digest"].to_pylist(), _levels(block["n"][0].as_py(), height))]
        m = len(paths)
        return pa.table({"tree": block["tree"], "pos": block["pos"], "name": block["name"], "digest": block["digest"], "path": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([top["subroot"]] * m, pa.string()), "root": pa.array([top["root"]] * m, pa.string())})

    return _meet(nodes.select("tree", "pos", "n", "digest", "name"), upper, height, run, PATHS)


def _proofs(leaves: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """The proof of each leaf and what it folds to."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        top = above.to_pylist()[0]
        digests, now = block["digest"].to_pylist(), block["now"].to_pylist()
        proofs, folded = [], []
        for own, found, path in zip(digests, now, walk(digests, _levels(block["n"][0].as_py(), height)), strict=True):
            path += top["path"]
            proofs.append(digest_of(path))
            folded.append(fold(found or own, path))
        m = len(digests)
        return pa.table({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": [top["subroot"]] * m, "root": [top["root"]] * m, "proof_sha256": proofs, "folded_root": folded, "verified": [x == top["root"] for x in folded]})

    return _meet(leaves.select("tree", "pos", "n", "digest", "doc_id", "now"), upper, height, run, PROOFS)


def _paths_of_trees(tops: DataFrame, height: int) -> DataFrame:
    """tree, pos 0, path, subroot and root: the way from each source's root to the root over all."""
    named = tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    rounds = _climb(materialise(placed(named, "all", "name").withColumnRenamed("all", "tree"), "merkle-sources"), height)
    top = rounds[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(rounds[: max(len(rounds) - 1, 1)]):
        top = _descend(nodes, top, height)
    return top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")


def manifest(docs: DataFrame, now: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    ``now``: the leaf's digest as found today, null where it is the original's; by default
    that of ``tampered``.  A leaf is verified if it and the original siblings fold to the root.
    """
    tree = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))  # null first, else by bytes
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), (tampered(docs) if now is None else now).alias("now"))
    rounds = _climb(materialise(placed(rows, "tree", "doc_id", "digest"), "merkle-leaves"), height)
    upper = _paths_of_trees(rounds[-1], height)
    for nodes in reversed(rounds[1:-1]):
        upper = _descend(nodes, upper, height)
    return _proofs(rounds[0], upper, height)
