"""What a task or the driver holds at a time doesn't grow with the table."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagweft import schemas
from tagweft.functions import html as H
from tagweft.llm import negatives
from tagweft.operators import edits, trees, walks
from tagweft.operators import tables as X
from tagweft.plans import html_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nodes(spark, tmp_path):
    """A node table in files, as small there as node tables are: Spark's estimates would broadcast it."""
    pages = spark.createDataFrame([(k, f"<title>t</title><ul><li><a href=/{k}>x</a><li>y</ul>") for k in range(20)], "page_id long, html string")
    X.nodes(pages).write.parquet(str(tmp_path / "nodes"))
    return spark.read.parquet(str(tmp_path / "nodes"))


def test_large_batches_give_results_in_small_ones():
    texts = [f"<p>{k}" if k % 7 else None for k in range(1000)]
    found = list(H.html_parse().func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["<b>"])])))
    assert max(map(len, found)) <= H.ROWS and sum(map(len, found)) == 1001
    values = [x for a in found for x in a.to_pylist()]
    assert [x is None for x in values[:1000]] == [x is None for x in texts]
    assert [x["nodes"][-1]["value"] for x in values[:1000] if x] == [str(k) for k in range(1000) if k % 7]


def test_large_rows_stand_alone():
    found = list(H.html_tokenize().func(iter([pa.array(["a" * H.SIZE, "b", "c" * H.SIZE, "d"])])))
    assert [len(a) for a in found] == [1, 2, 1]


def test_rows_of_two_columns_come_in_small_batches():
    texts, spans = pa.array(["😀ab", None] * 100), pa.array([[{"start": 0, "end": 2}, {"start": 2, "end": 3}, {"start": None, "end": None}]] * 200)
    found = list(H.raw_slices.func(iter([(texts, spans)])))
    assert max(map(len, found)) <= H.ROWS and [x for a in found for x in a.to_pylist()] == [["😀", "a", None], None] * 100


def test_node_tables_are_read_by_columns(monkeypatch):
    """A call a value made serializing from node tables take several times as long as parsing."""
    html = "<!doctype html><p id=a class='é'>x<svg xlink:href=#></svg><template><td>1</template><!--c-->"
    made = pa.array([H.parsed(html, frozenset((H.NODES, H.LOC)), None, True), None, H.parsed("", frozenset((H.NODES,)), None, True), H.parsed("x", frozenset(), None, True)], to_arrow_type(schemas.PARSED))
    for a in (made, made.slice(1), made.slice(2, 1), made.field("nodes"), made.field("nodes").slice(1, 2), made.slice(1, 1)):
        assert H._plain(a) == a.to_pylist()
    calls = []
    monkeypatch.setattr(H, "_plain", lambda a, real=H._plain: calls.append(len(a)) or real(a))
    nodes = pa.array([made.field("nodes")[0].as_py()[:1] * 1000], made.field("nodes").type)
    assert len(H.html_dump.func(iter([nodes])).__next__()) == 1 and len(calls) < 100


def test_a_node_table_is_built_once_to_be_written(spark):
    assert plan(html_queries.serialize_from_nodes(spark, "/root/testdata/sf0.001")).count("ArrowEvalPython") == 2  # parsing, writing
    df = X.parse(spark.createDataFrame([(0, "<p>a<template>b</template>"), (1, None), (2, "")], "page_id long, html string"), facets=(H.NODES, H.TEXT_HTML, H.DUMP))
    found = df.select("page_id", "p.html", "p.dump", H.html_written()("p.nodes").alias("w")).orderBy("page_id").collect()
    assert [r.w and (r.w.html, r.w.dump) for r in found] == [(found[0].html, found[0].dump), None, (found[2].html, found[2].dump)] and found[0].html


def test_functions_in_one_select_and_in_a_chain(spark):
    df = spark.createDataFrame([(k, f"<p>{k}<b>x") for k in range(300)], "page_id long, html string").coalesce(1)
    p = df.select("page_id", H.html_parse((H.NODES, H.TEXT_HTML, H.DUMP))("html").alias("p"))
    both = p.select("page_id", (H.html_serialize()("p.nodes", F.lit(0)) == F.col("p.html")).alias("a"), (H.html_dump("p.nodes") == F.col("p.dump")).alias("b"))
    assert both.where("a AND b").count() == 300


def test_children_gather_no_table_in_the_driver(nodes):
    assert "Broadcast" not in plan(X.children(nodes))


def test_changes_and_edits_gather_no_table_in_the_driver(nodes, tmp_path):
    for name in ("old", "new"):
        trees.subtrees(nodes).write.parquet(str(tmp_path / name))
    old, new = (nodes.sparkSession.read.parquet(str(tmp_path / name)) for name in ("old", "new"))
    assert "Broadcast" not in plan(trees.changes(old, new))
    table = edits.labelled(nodes)
    asked = table.where("name = 'ul'").select("page_id", F.lit(1).alias("edit"), F.lit(edits.APPEND).alias("op"), "begin_label", F.lit("<li>z").alias("html"))
    assert "Broadcast" not in plan(edits.applied(table, asked))


@pytest.mark.parametrize("name", ["list_children", "ancestor_pairs", "element_paths"])
def test_queries_gather_no_table_in_the_driver(spark, monkeypatch, name):
    seen, real = [], walks.paths

    def paths(rows, keep, **options):
        return real(rows, lambda df: seen.append(plan(df)) or keep(df), **options)

    monkeypatch.setattr(walks, "paths", paths)
    seen.append(plan(html_queries.QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert not [p for p in seen if "Broadcast" in p]


def test_location_slices_joins_no_pages(spark):
    found = plan(html_queries.location_slices(spark, "/root/testdata/sf0.001"))
    assert "Join" not in found and found.count("FileScan") == 1


def test_a_cell_of_the_product_gives_one_tile_at_a_time(spark):
    rows = spark.createDataFrame([(0, [0], b"", b"", b"", [b"\0" * 8 * negatives.WIDTH])], negatives.BLOCK)
    tiles = negatives._partial_tiles(rows.withColumn("windows", F.lit(None).cast("binary")), rows, (1, 1), same=True)
    assert "CoGroup" not in plan(tiles) and tiles.count() == 1
