"""Edits of node tables: insertion before a node, at a node's end, and detachment, without numbering a document anew.

A node has two labels, where it begins and where it ends, that are arrays of numbers and sort in document order. A label
between two neighbours is always to be had: the left one and a further number sorts behind it and before whatever follows,
and where the right one is itself such an extension, the number before its own comes between. So labels are never used up, an
edit makes labels for its new nodes alone, and those of all others stay: they are what edits refer to.

A batch of edits is applied at once: first all insertions (several at one place in order of `edit`), then all detachments,
which take with them what was inserted inside. Edits that refer to no node are ignored. All of it is windows and joins by
document; the nodes that a detachment covers are found by a running sum, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html as H

CONTENT = ["node_type", "name", "namespace", "value", "public_id", "system_id", "attrs"]
BEFORE, APPEND, DETACH = "before", "append", "detach"


def _places(node: Column | None = None) -> tuple[Column, Column]:
    """The numbers of a node's begin and end among those of its document."""
    at = (lambda c: F.col(c)) if node is None else (lambda c: node[c])
    begin = (2 * at("node_id") - at("depth")).cast("long")
    return begin, begin + 2 * (at("subtree_end") - at("node_id")) + 1


def labelled(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, begin_label, end_label and the content of each node."""
    begin, end = _places()
    return nodes.select(key, F.array(begin).alias("begin_label"), F.array(end).alias("end_label"), *CONTENT)


def _events(table: DataFrame, key: str, *columns) -> DataFrame:
    both = F.array(F.struct(F.lit(1).alias("step"), F.col("begin_label").alias("at")), F.struct(F.lit(-1).alias("step"), F.col("end_label").alias("at")))
    return table.select(key, *columns, F.inline(both))


def _between(low: Column, high: Column) -> Column:
    """What the labels between two neighbours begin with."""
    n = F.size(low)
    return F.when(low.isNull(), F.array(high[0] - 1)).when((F.size(high) > n) & (F.slice(high, 1, n) == low), F.concat(low, F.array(F.get(high, n) - 1))).otherwise(low)


def inserted(table: DataFrame, edits: DataFrame, key: str = "page_id", context: str = "body") -> DataFrame:
    """The new nodes of edits (key, edit, op, begin_label, html), with their labels."""
    asked = edits.where(F.col("op").isin(BEFORE, APPEND)).select(F.col(key).alias("k"), "edit", "op", F.col("begin_label").alias("of"), "html")
    ends = table.select(key, "begin_label", "end_label")
    placed = asked.join(ends.hint("merge"), (F.col("k") == F.col(key)) & (F.col("of") == F.col("begin_label")))
    placed = placed.select("k", "edit", "html", F.when(F.col("op") == BEFORE, F.col("begin_label")).otherwise(F.col("end_label")).alias("high"))
    touched = table.join(placed.select(F.col("k").alias(key)).distinct().hint("merge"), key, "left_semi")
    neighbours = _events(touched, key).select(key, "at", F.lag("at").over(Window.partitionBy(key).orderBy("at")).alias("low"))
    placed = placed.join(neighbours.hint("merge"), (F.col("k") == F.col(key)) & (F.col("high") == F.col("at"))).select("k", "edit", "html", "high", "low")
    parsed = placed.select("k", "edit", "high", _between(F.col("low"), F.col("high")).alias("base"), H.html_parse_fragment(context=context)("html").alias("p"))
    size = 2 * (F.size("p.nodes") - 1)
    before = Window.partitionBy("k", "high").orderBy("edit").rowsBetween(Window.unboundedPreceding, -1)
    parsed = parsed.select("k", "base", "p", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"))
    rows = parsed.select(F.col("k").alias(key), "base", "offset", F.inline(F.slice("p.nodes", 2, F.greatest(F.size("p.nodes") - 1, F.lit(0)))))
    begin, end = (F.concat("base", F.array(F.col("offset") + x)) for x in _places())
    return rows.select(key, begin.alias("begin_label"), end.alias("end_label"), *CONTENT)


def applied(table: DataFrame, edits: DataFrame, key: str = "page_id", context: str = "body") -> DataFrame:
    """The labelled table after edits (key, edit, op, begin_label of the node, html of what is inserted)."""
    whole = table.unionByName(inserted(table, edits, key, context))
    gone = edits.where(F.col("op") == DETACH).select(F.col(key).alias("k"), F.col("begin_label").alias("of")).distinct()
    marked = whole.join(gone.hint("merge"), (F.col(key) == F.col("k")) & (F.col("begin_label") == F.col("of")), "left")
    marked = marked.select(*whole.columns, F.when(F.col("of").isNotNull(), 1).otherwise(0).alias("gone"))
    content = F.struct("end_label", *CONTENT).alias("content")
    events = _events(marked, key, "gone", F.col("begin_label").alias("label"), content)
    covered = F.sum(F.col("gone") * F.col("step")).over(Window.partitionBy(key).orderBy("at"))
    kept = events.withColumn("covered", covered).where("step = 1 AND covered = 0")
    return kept.select(key, F.col("label").alias("begin_label"), "content.*")


def renumbered(table: DataFrame, key: str = "page_id") -> DataFrame:
    """The node table (node_id, parent_id, sib_idx, depth, subtree_end, content) of a labelled one, with begin_label."""
    content = F.struct(*CONTENT).alias("content")
    order = Window.partitionBy(key).orderBy("at")
    events = _events(table, key, F.col("begin_label").alias("label"), content)
    opened = F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(order) - 1
    events = events.select(key, "label", "step", F.when(F.col("step") == 1, F.col("content")).alias("content"), opened.cast("int").alias("opened"), F.sum("step").over(order).cast("int").alias("level"))
    at_begin = lambda c: F.max(F.when(F.col("step") == 1, F.col(c)))
    nodes = events.groupBy(key, "label").agg(at_begin("opened").alias("node_id"), (at_begin("level") - 1).alias("depth"), F.max(F.when(F.col("step") == -1, F.col("opened"))).alias("subtree_end"), F.first("content", True).alias("content"))
    # a node's parent is the last one before it on the level above
    levels = nodes.select(key, F.inline(F.array(*(F.struct((F.col("depth") - up).alias("level"), F.col("node_id").alias("place"), F.lit(up).alias("up"), *(F.when(F.lit(bool(up)), F.col(c)).alias(c) for c in ("label", "depth", "subtree_end", "content"))) for up in (0, 1)))))
    parent = F.last(F.when(F.col("up") == 0, F.col("place")), True).over(Window.partitionBy(key, "level").orderBy("place"))
    found = levels.withColumn("parent_id", parent).where("up = 1").withColumnRenamed("place", "node_id")
    index = F.when(F.col("parent_id").isNull(), 0).otherwise(F.row_number().over(Window.partitionBy(key, "parent_id").orderBy("node_id")) - 1)
    return found.select(key, "node_id", "parent_id", index.cast("int").alias("sib_idx"), "depth", "subtree_end", "content.*", F.col("label").alias("begin_label"))


def serialized(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key and html of a node table; the rows of a document meet in one array."""
    row = F.struct(*((F.col(f.name) if f.name in nodes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.NODE))
    whole = nodes.groupBy(key).agg(F.array_sort(F.collect_list(row.dropFields("attr_locs"))).alias("nodes"))
    typed = F.transform("nodes", lambda n: F.struct(*((n[f.name] if f.name != "attr_locs" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.NODE)))
    return whole.select(key, H.html_serialize()(typed, F.lit(0)).alias("html"))
