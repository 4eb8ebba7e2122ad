"""Similarity join of documents on n-gram Jaccard, by a MinHash LSH forest.

Texts with the same set of word shingles form one class.  Every class has a label of
`MAX_DEPTH` MinHash values in each of `trees` prefix tries; a trie node is the hash of a label's
prefix.  Matched prefixes are shortened from the full depth until a pair at the threshold is
found with the target recall.  Classes that meet in a node form candidate groups; their
shingle sets are compared exactly, in tiles of at most 2 x `TILE` sets: a tile returns a link
count per set and a spanning forest of its links, never its pairs, so a group of n near
copies moves about n * n / TILE rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmap.llm.components import components
from voltmap.llm.text import distinct, lists, mix, pieces, reduce_ranges, seeded, shingles, words
from voltmap.session import cut

WIDTH = 5
SIMILARITY = 0.8
TREES = 16
MAX_DEPTH = 8
RECALL = 0.9995
TILE = 256


def forest_depth(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair at `similarity` with probability `recall`."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def row_key(doc_id: str, text: str) -> Column:
    """A hash of id and text: rows that share it are repeats of one row."""
    return F.xxhash64(F.lit(37), F.col(doc_id).cast("string"), F.col(text))


def labels(docs: DataFrame, depth: int, trees: int = TREES, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, set_a, set_b, shingles, nodes) of each row.

    (set_a, set_b) identify the set of shingles; nodes are its trie nodes at `depth`.
    Texts without words have no shingles and no nodes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                found = words(p.column("text"))
                runs = shingles(found, found.hashes(), width)
                full = np.diff(runs.bounds) > 0
                nodes = np.empty((int(full.sum()), trees), dtype=np.uint64)
                for tree in range(trees):
                    node = np.full(len(nodes), tree, dtype=np.uint64)
                    for level in range(depth):
                        value = runs.values * np.uint64(_factor(tree * MAX_DEPTH + level))
                        value ^= value >> np.uint64(32)
                        least = reduce_ranges(np.minimum, value, runs.bounds, np.uint64(0))[full]
                        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + least)
                    nodes[:, tree] = node
                sets, bounds = distinct(runs.values, runs.bounds)
                a = reduce_ranges(np.add, seeded(sets, 1), bounds, np.uint64(0))
                c = reduce_ranges(np.add, seeded(sets, 2), bounds, np.uint64(0))
                ends = np.concatenate([[0], np.cumsum(full * trees)])
                yield pa.RecordBatch.from_arrays(
                    [p.column("id"), p.column("key"), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)),
                     pa.array(np.diff(bounds), pa.int64()), lists(nodes.ravel().view(np.int64), ends, pa.int64())],
                    ["id", "key", "set_a", "set_b", "shingles", "nodes"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(
        rows, f"id {kind}, key long, set_a long, set_b long, shingles long, nodes array<long>"
    )


def _factor(i: int) -> int:
    """An odd multiplier per MinHash function."""
    return int(mix(np.array([i * 2 + 1], dtype=np.uint64))[0]) | 1


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    trees: int = TREES, recall: float = RECALL, width: int = WIDTH,
) -> DataFrame:
    """One row per document row: id, key, class_id, n_links, n_copies, keep.

    class_id is the least id of all documents connected by links; n_links the number of other
    distinct shingle sets at or above the similarity; n_copies the number of rows with the
    same set; keep marks the one row kept of the class (least id, then key; repeats of one row
    all carry the mark).

    A text shorter than `width` words is one shingle of all its words.  Null and empty texts
    are classes of their own, with no links.  Null ids sort first and give a null class_id.
    An empty table gives no rows.
    """
    rows = cut(labels(docs, forest_depth(similarity, trees, recall), trees, width, doc_id, text))
    sets = cut(
        rows.filter("shingles > 0").groupBy("set_a", "set_b").agg(
            F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("n_copies"),
            F.first("nodes").alias("nodes"),
        ).select("*", F.col("first.key").alias("rep"))
    )
    met = sets.select("rep", F.posexplode("nodes").alias("tree", "node"))
    nodes = met.groupBy("tree", "node").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    met = cut(met.join(nodes, ["tree", "node"]).select("rep", "tree", "node", "pivot"))
    groups = components(met.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    links = cut(_links(docs, met, groups, similarity, width, doc_id, text))
    linked = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    known = sets.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left").select(
        "set_a", "set_b", "first", "n_copies", F.coalesce("label", "rep").alias("label"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    known = cut(known)
    heads = known.groupBy("label").agg(F.min("first").alias("head"))
    known = known.join(heads, "label").select("set_a", "set_b", "n_copies", "n_links", "head")
    full = rows.filter("shingles > 0").drop("nodes", "shingles").join(known, ["set_a", "set_b"]).select(
        "id", "key", F.col("head.id").alias("class_id"), "n_links", "n_copies",
        (F.col("key") == F.col("head.key")).alias("keep"),
    )
    bare = rows.filter("shingles = 0").select(
        "id", "key", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("keep"),
    )
    return full.unionByName(bare)


def _links(docs: DataFrame, met: DataFrame, groups: DataFrame, similarity: float, width: int, doc_id: str, text: str) -> DataFrame:
    """(rep, root, n_links) per tile: root is the least set that a set's links reach there."""
    # Blocks of TILE sets in the order of their groups: a group fills as few blocks as it can.
    parts = groups.sparkSession.sparkContext.defaultParallelism
    order = F.monotonically_increasing_id()
    placed = cut(
        groups.repartitionByRange(parts, "label", "node").sortWithinPartitions("label", "node")
        .select(F.col("node").alias("rep"), F.col("label").alias("group"), order.alias("at"))
    )
    part, nth = F.shiftright("at", 33), F.expr(f"(at & {(1 << 33) - 1}) div {TILE}")
    placed = placed.select("rep", "group", (F.shiftleft(part, 33) + nth).alias("block"))
    own = placed.select(F.col("block").alias("low"), F.col("block").alias("high")).distinct()
    seen = met.join(placed, "rep").select("tree", "node", "block").distinct()
    many = seen.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    seen = seen.join(many, ["tree", "node"])
    across = (
        seen.withColumnRenamed("block", "low").join(seen.withColumnRenamed("block", "high"), ["tree", "node"])
        .filter("low < high").select("low", "high").distinct()
    )
    tiles = own.unionByName(across).withColumn("tile", F.xxhash64("low", "high"))
    sides = tiles.select("tile", F.col("low").alias("block"), F.lit(0).alias("side")).unionByName(
        tiles.filter("low < high").select("tile", F.col("high").alias("block"), F.lit(1).alias("side"))
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                found = words(p.column("text"))
                runs = shingles(found, found.hashes(), width)
                sets, bounds = distinct(runs.values, runs.bounds)
                yield pa.RecordBatch.from_arrays(
                    [p.column("rep"), p.column("group"), p.column("block"), lists(sets.view(np.int64), bounds, pa.int64())],
                    ["rep", "group", "block", "set"],
                )

    # Repeats of one row have one key: any of them serves.
    chosen = docs.select(row_key(doc_id, text).alias("rep"), F.col(text).alias("text")).join(placed, "rep")
    held = chosen.mapInArrow(gather, "rep long, group long, block long, set array<long>").join(sides, "block").select(
        "tile", "side", "rep", "group", "set"
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("rep", "ascending")]).combine_chunks()
        rep, group = table.column("rep").to_numpy(), table.column("group").to_numpy()
        first = np.ones(len(rep), dtype=bool)
        first[1:] = rep[1:] != rep[:-1]
        table = table.filter(pa.array(first)).combine_chunks()
        rep, group, side = (table.column(c).to_numpy() for c in ("rep", "group", "side"))
        column = table.column("set").combine_chunks()
        bounds = column.offsets.to_numpy()
        values = column.values.to_numpy()
        two = bool(side.max()) if len(side) else False
        count, root = np.zeros(len(rep), dtype=np.int64), rep.copy()
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1 and not (two and side[a:b].min() == side[a:b].max()):
                near = _near(values[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], similarity)
                if two:
                    near &= side[a:b, None] != side[None, a:b]
                count[a:b] = near.sum(axis=1)
                root[a:b] = rep[a:b][_roots(near)]
        return pa.table({"rep": rep, "root": root, "n_links": count})

    return held.groupBy("tile").applyInArrow(compare, "rep long, root long, n_links long").filter("n_links > 0")


def _near(values: np.ndarray, bounds: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets (ranges of values) have a Jaccard of `similarity` or more, exactly."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    o, column = o[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((len(size), len(size)), dtype=np.float32)
    width = 1 << 13
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(size), width), dtype=np.float32)
        part[o[i:j], column[i:j] - low] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    near = common >= similarity * union - 1e-6
    np.fill_diagonal(near, False)
    return near


def _roots(near: np.ndarray) -> np.ndarray:
    """The least member that each member reaches."""
    root = np.arange(len(near))
    while True:
        reach = np.where(near, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, reach)
        new = new[new]
        if (new == root).all():
            return root
        root = new
