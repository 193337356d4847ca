"""Sets of trees: subtrees of node tables by Merkle digests.

A node's digest is that of its own content and of its children's digests in order, so equal digests are equal subtrees,
wherever they stand. Contents are digested by native expressions. Digests are then built bottom-up in one pass over the nodes
of each document in reverse order, in which children come before their parents: what waits at each level goes from one
batch of rows to the next, so a document of any length or depth is a stream. Everything after that (which subtrees recur,
union, intersection and difference of documents or versions) is aggregates of digests; no pair of trees is compared.

Documents with a null key are left out; documents without nodes have no subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT = ("node_type", "name", "namespace", "value", "public_id", "system_id")
#: Bytes of a digest.
SIZE = 16


class Levels:
    """Digests of the nodes of a document in reverse order; waiting: of each level, the digests whose parent is to come."""

    def __init__(self):
        self.key, self.waiting = None, {}

    def digest(self, key, depth: int, content: bytes) -> bytes:
        if key != self.key:
            self.key, self.waiting = key, {}
        h = hashlib.blake2b(content, digest_size=SIZE)
        for child in reversed(self.waiting.pop(depth + 1, ())):
            h.update(child)
        self.waiting.setdefault(depth, []).append(own := h.digest())
        return own


def subtrees(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node_id, parent_id, name, n_nodes, digest of the subtree at each node. Attributes count in any order."""
    attrs = F.array_sort(F.transform("attrs", lambda a: F.to_json(F.array(a["name"], a["value"], a["prefix"], a["namespace"]))))
    content = F.unhex(F.md5(F.to_json(F.struct(*(F.col(c) for c in CONTENT), attrs.alias("attrs")), {"ignoreNullFields": "false"})))
    rows = nodes.where(F.col(key).isNotNull()).select(key, "node_id", "parent_id", "name", (F.col("subtree_end") - F.col("node_id") + 1).alias("n_nodes"), "depth", content.alias("content"))
    rows = rows.repartition(key).sortWithinPartitions(key, F.desc("node_id"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        for batch in batches:
            keys, depths, contents = (batch.column(c).to_pylist() for c in (0, 5, 6))
            digests = list(map(levels.digest, keys, depths, contents))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(digests, pa.binary())], [*batch.schema.names[:5], "digest"])

    return rows.mapInArrow(build, T.StructType([*rows.schema.fields[:5], T.StructField("digest", T.BinaryType())]))


def recurring(trees: DataFrame, key: str = "page_id", least: int = 2) -> DataFrame:
    """digest, n_nodes, n_places, n_documents of the subtrees of `least` nodes or more that stand in two places or more."""
    found = trees.where(F.col("n_nodes") >= least).groupBy("digest", key).agg(F.max("n_nodes").alias("n_nodes"), F.count("*").alias("n"))
    found = found.groupBy("digest").agg(F.max("n_nodes").alias("n_nodes"), F.sum("n").alias("n_places"), F.count("*").alias("n_documents"))
    return found.where("n_places > 1")


def counted(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, digest, n_nodes, in_a, in_b: how often each subtree stands in either."""
    sides = a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    return sides.groupBy(*by, "digest").agg(F.max("n_nodes").alias("n_nodes"), F.sum("a").alias("in_a"), F.sum("b").alias("in_b"))


def union(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The subtrees of either (by, digest, n_nodes, n): as multisets, the higher count."""
    return counted(a, b, *by).select(*by, "digest", "n_nodes", F.greatest("in_a", "in_b").alias("n"))


def intersection(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    return counted(a, b, *by).where("in_a > 0 AND in_b > 0").select(*by, "digest", "n_nodes", F.least("in_a", "in_b").alias("n"))


def difference(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """What a has more often than b."""
    return counted(a, b, *by).where("in_a > in_b").select(*by, "digest", "n_nodes", (F.col("in_a") - F.col("in_b")).alias("n"))


def changes(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """key, side ('old' or 'new'), node_id, name, n_nodes of the nodes where two versions of a document part: the other version
    lacks their subtree, but holds those of all their children. A changed text is one on both sides; where
    a child only went, came or moved, its old parent is one."""
    held = counted(old, new, key).select(F.col(key).alias("k"), F.col("digest").alias("d"), "in_a", "in_b")
    own = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    lacking = F.when(F.col("side") == "old", F.col("in_b")).otherwise(F.col("in_a")) == 0
    marked = own.join(held.hint("merge"), (F.col(key) == F.col("k")) & (F.col("digest") == F.col("d"))).where(lacking).select(key, "side", "node_id", "parent_id", "name", "n_nodes")
    deeper = marked.select(F.col(key).alias("k"), F.col("side").alias("s"), F.col("parent_id").alias("of"))  # their parents part further down
    return marked.join(deeper.hint("merge"), (F.col(key) == F.col("k")) & (F.col("side") == F.col("s")) & (F.col("node_id") == F.col("of")), "left_anti").drop("parent_id")
