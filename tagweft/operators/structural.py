"""The structural join: ancestors and descendants from the intervals (node_id, subtree_end) of node tables.

Both lists are sorted once by document and place and read as one stream. The ancestors that are still open are the stack
that goes from one batch of rows to the next; within a batch, each ancestor's descendants are a run of the list of
descendants, found by a search and expanded at once. So the cost is that of sorting, of the rows, and of the pairs.

A document of any length is cut into blocks of BLOCK places. An ancestor goes to the blocks that its interval meets; as
intervals nest, a block gets those that begin in it and those open at its start, no more than the tree is deep. Rows with a
null key, and nodes without descendants, have no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of a block, and pairs of a batch of results.
BLOCK, PAIRS = 1 << 16, 1 << 19


class Merge:
    """Pairs of a stream of rows (key, block, node_id, last, payload) in order of the first three; last is null of descendants."""

    def __init__(self):
        self.group = None  # key and block of the last row
        self.open = np.zeros((0, 2), np.int64)  # node_id and last of the ancestors open there

    def pairs(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ancestor_id, row of the batch) of the pairs whose descendant is in the batch."""
        keys, blocks = batch.column(0), batch.column(1).to_numpy()
        place = batch.column(2).to_numpy().astype(np.int64)
        changed = np.append(False, blocks[1:] != blocks[:-1])
        if len(keys) > 1:
            changed[1:] |= pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(changed)
        is_above = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        last = pc.fill_null(batch.column(3), 0).to_numpy().astype(np.int64)
        if self.group != (keys[0].as_py(), blocks[0]):
            self.open = self.open[:0]
        above = np.concatenate([np.column_stack([np.zeros(len(self.open), np.int64), self.open]), np.column_stack([group, place, last])[is_above]])
        below = np.flatnonzero(~is_above)
        at = (group[below] << 32) + place[below]
        first = np.searchsorted(at, (above[:, 0] << 32) + above[:, 1], "right")
        each = np.maximum(np.searchsorted(at, (above[:, 0] << 32) + above[:, 2], "right") - first, 0)
        ends = np.cumsum(each)
        i = 0
        while i < len(above):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = each[i:j]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(above[i:j, 1], n), below[np.repeat(first[i:j], n) + within]
            i = j
        self.group = (keys[-1].as_py(), blocks[-1])
        self.open = above[(above[:, 0] == group[-1]) & (above[:, 2] > place[-1]), 1:]


def descendants_within(nodes: DataFrame, above: Column, below: Column, key: str = "page_id") -> DataFrame:
    """descendants of the rows of one table that two conditions choose, where the table is dealt out by document already (as a
    bucketed one): it is scanned once and only sorted, not shuffled, and a document is read by one task."""
    columns = [c for c in nodes.columns if c != key]
    payload = F.struct(*(F.col(c) for c in columns))
    kind = T.StructType([nodes.schema[c] for c in columns])
    place, last = F.col("node_id").cast("long"), F.col("subtree_end").cast("long")
    roles = F.array(
        F.when(above & (last > place), F.struct(place.alias("place"), last.alias("last"), F.lit(None).cast(kind).alias("payload"))),
        F.when(below, F.struct(place.alias("place"), F.lit(None).cast("long").alias("last"), payload.alias("payload"))),
    )
    rows = nodes.where((above | below) & F.col(key).isNotNull()).select(F.col(key), F.lit(0).cast("long").alias("block"), F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    rows = rows.select(key, "block", "r.place", "r.last", "r.payload").sortWithinPartitions(key, "place")
    return _merged(rows, nodes, columns, key)


def descendants(above: DataFrame, below: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs of a node of `above` (its node_id as ancestor_id) and its descendants in `below`, with all columns of below."""
    columns = [c for c in below.columns if c != key]
    payload = F.struct(*(F.col(c) for c in columns))
    kind = T.StructType([below.schema[c] for c in columns])
    block = lambda x: F.floor(x / BLOCK).cast("long")
    first, last = F.col("node_id") + 1, F.col("subtree_end")
    a = above.where((last >= first) & F.col(key).isNotNull()).select(F.col(key), F.explode(F.sequence(block(first), block(last))).alias("block"), F.col("node_id").cast("long").alias("place"), last.cast("long").alias("last"), F.lit(None).cast(kind).alias("payload"))
    b = below.where(F.col(key).isNotNull()).select(F.col(key), block(F.col("node_id")).alias("block"), F.col("node_id").cast("long").alias("place"), F.lit(None).cast("long").alias("last"), payload.alias("payload"))
    rows = a.union(b).repartition(key, "block").sortWithinPartitions(key, "block", "place")
    return _merged(rows, below, columns, key)


def _merged(rows: DataFrame, below: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The pairs of sorted rows (key, block, place, last, payload)."""
    names = [key, "ancestor_id", *columns]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Merge()
        for batch in batches:
            if not batch.num_rows:
                continue
            for ancestor, row in own.pairs(batch):
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), pa.array(ancestor, pa.int32()), *batch.column(4).take(taken).flatten()], names)

    schema = T.StructType([below.schema[key], T.StructField("ancestor_id", T.IntegerType()), *(below.schema[c] for c in columns)])
    return rows.mapInArrow(merge, schema)
