"""Paths from parent pointers, for node tables without interval codes.

Pointers are doubled: each round joins every node to the ancestor that its pointer has reached and takes over that one's
pointer and path, so a document of depth d takes about log2(d) rounds, where a walk level by level takes d. A round is stored,
which cuts its lineage. Nodes that are their own ancestors, or whose parent isn't in the table, are refused by `limit` rounds
and end their path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths(nodes: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "page_id", limit: int = 40) -> DataFrame:
    """key, node_id, path (the names from the root down, joined by /) of a table (key, node_id, parent_id, name).

    keep: writes a table where all executors reach it, and gives it back."""
    own = nodes.select(key, F.col("node_id").alias("node_id"), F.col("parent_id").alias("up"), F.coalesce("name", F.lit("")).alias("path"))
    for _ in range(limit):
        own = keep(own)
        if own.where("up IS NOT NULL").isEmpty():
            return own.drop("up")
        above = own.select(F.col(key).alias("k"), F.col("node_id").alias("n"), F.col("up").alias("next"), F.col("path").alias("before"))
        found = own.join(above.hint("merge"), (F.col(key) == F.col("k")) & (F.col("up") == F.col("n")), "left")
        own = found.select(key, "node_id", F.col("next").alias("up"), F.concat_ws("/", "before", "path").alias("path"))
    raise ValueError("the parent pointers go round in a circle")
