"""Tables of parse results: nodes, tokens, events, errors; and what is asked of node tables, as plain joins and windows.

One parse makes a row a document; `inline_outer` spreads its arrays (it is evaluated once and keeps filters on the key at
the scan, which `inline` and filters on the result do not). Parsing is bound by CPU, so small inputs are dealt out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from .structural import descendants, descendants_within  # noqa: F401  among the operators on node tables


def text_only(df: DataFrame, column: str) -> None:
    """Markup is text; bytes must be decoded first."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"{column} must be a string column, not {kind.simpleString()}")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows over enough partitions to use all cores, if there are fewer. A large scan is left as it is."""
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parse(df: DataFrame, key: str = "page_id", column: str = "html", facets=(H.NODES,), **options) -> DataFrame:
    """key and p, the PARSED of each document."""
    text_only(df, column)
    return spread(df.select(key, column)).select(key, H.html_parse(facets, **options)(F.col(column)).alias("p"))


def _spread_array(df: DataFrame, key: str, array: Column, first: str) -> DataFrame:
    return df.select(key, F.inline_outer(array)).where(F.col(first).isNotNull())


def nodes(df: DataFrame, key: str = "page_id", column: str = "html", locations: bool = False, **options) -> DataFrame:
    facets = (H.NODES, H.LOC) if locations else (H.NODES,)
    return _spread_array(parse(df, key, column, facets, **options), key, F.col("p.nodes"), "node_id")


def errors(df: DataFrame, key: str = "page_id", column: str = "html", **options) -> DataFrame:
    return _spread_array(parse(df, key, column, (H.ERRORS,), **options), key, F.col("p.errors"), "err_idx")


def modes(df: DataFrame, key: str = "page_id", column: str = "html", **options) -> DataFrame:
    return parse(df, key, column, (), **options).select(key, F.col("p.mode").alias("mode"))


def serialized(df: DataFrame, key: str = "page_id", column: str = "html", **options) -> DataFrame:
    return parse(df, key, column, (H.TEXT_HTML,), **options).select(key, F.col("p.html").alias("html"))


def tokens(df: DataFrame, key: str = "page_id", column: str = "html", **options) -> DataFrame:
    text_only(df, column)
    return _spread_array(spread(df.select(key, column)).select(key, H.html_tokenize(**options)(F.col(column)).alias("t")), key, F.col("t"), "tok_idx")


def events(df: DataFrame, key: str = "page_id", column: str = "html", kinds=None, limit: int | None = None, locations: bool = False) -> DataFrame:
    text_only(df, column)
    return _spread_array(spread(df.select(key, column)).select(key, H.html_events(kinds, limit, locations)(F.col(column)).alias("t")), key, F.col("t"), "tok_idx")


def rewritten(df: DataFrame, rule, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and html, each event's markup replaced by rule(event column), a string column; null keeps the source. The pieces
    stay in one array a document, so nothing is shuffled. Where the rule gives null, and between events, the source stays as
    it is."""
    text_only(df, column)
    found = spread(df.select(key, column)).select(key, H.html_events(locations=False, source_kept=True)(F.col(column)).alias("t"))
    written = F.transform("t", lambda e: F.when(e["type"] == H.GAP, e["raw"]).otherwise(F.coalesce(rule(e), e["raw"])))
    return found.select(key, F.array_join(written, "").alias("html"))


# --- node tables ----------------------------------------------------------------------------------------------------------


def attributes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """A row an attribute, with its place in the element."""
    return nodes.select(key, "node_id", F.col("name").alias("element"), F.posexplode("attrs").alias("ord", "a")).select(key, "node_id", "element", "ord", "a.*")


def children(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, child_id, sib_idx) of every node with children: an equi-join.

    Columns of node tables take little room in files and much in memory, so Spark's estimates by size of file would have whole
    tables gathered by the driver and broadcast: joins of node tables ask for a merge."""
    child = nodes.select(F.col(key).alias("k"), F.col("parent_id").alias("p"), F.col("node_id").alias("child_id"), "sib_idx")
    return nodes.select(key, "node_id").join(child.hint("merge"), (F.col(key) == F.col("k")) & (F.col("node_id") == F.col("p"))).select(key, "node_id", "child_id", "sib_idx")


def text_of(nodes_array: Column, node: Column) -> Column:
    """The text below a node of a nodes array, in order, in one expression over the array."""
    below = F.slice(nodes_array, (node["node_id"] + 2).cast("int"), (node["subtree_end"] - node["node_id"]).cast("int"))  # node_id is the place in the array
    return F.array_join(F.transform(F.filter(below, lambda n: n["node_type"] == "text"), lambda n: n["value"]), "")


def elements(nodes_array: Column, name: str) -> Column:
    return F.filter(nodes_array, lambda n: (n["node_type"] == "element") & (n["name"] == name))


def siblings(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The second tree format: attributes as maps by plain name, with maps of their namespaces and prefixes; links to the
    siblings; a template's content as its first child; with locations, the offsets of the source."""
    order = Window.partitionBy(key, "parent_id").orderBy("sib_idx", "node_id")
    # of attributes that differ in their prefix alone, the last stays
    by_name = lambda field: F.map_from_entries(F.transform(F.filter("attrs", lambda a, i: ~F.exists(F.slice("attrs", i + 2, F.size("attrs")), lambda b: b["name"] == a["name"])), lambda a: F.struct(a["name"], a[field])))
    places = [F.col(f"loc.{x}_offset").alias(f"{x}_index") for x in ("start", "end")] if "loc" in nodes.columns else []
    kind = F.when(F.col("node_type").isin("document", "fragment", "template_content"), "root").when(F.col("node_type") == "doctype", "directive").when(F.col("name") == "script", "script").when(F.col("name") == "style", "style").when(F.col("node_type") == "element", "tag").otherwise(F.col("node_type"))
    data = F.when(F.col("node_type") == "doctype", H.doctype_data("name", "public_id", "system_id")).otherwise(F.col("value"))
    return nodes.select(key, "node_id", "parent_id", kind.alias("type"), "name", "namespace", data.alias("data"), by_name("value").alias("attribs"), by_name("namespace").alias("attribs_namespace"), by_name("prefix").alias("attribs_prefix"), *places, F.lag("node_id").over(order).alias("prev_id"), F.lead("node_id").over(order).alias("next_id"))


def links(df: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, ord, href, text) of each anchor with a href, in document order."""
    found = parse(df, key, column)
    anchors = F.filter(elements(F.col("p.nodes"), "a"), lambda n: F.exists(n["attrs"], lambda a: a["name"] == "href"))
    rows = F.transform(anchors, lambda n: F.struct(H.get_attribute(n["attrs"], "href").alias("href"), text_of(F.col("p.nodes"), n).alias("text")))
    return found.select(key, F.posexplode(rows).alias("ord", "r")).select(key, "ord", "r.href", "r.text")
