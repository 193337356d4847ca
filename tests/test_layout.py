"""Paths, headed texts, sketches and the stored layout, against windows, intervals and exact counts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweft.operators import blocks, sketches, walks
from tagweft.operators import tables as X
from tagweft.plans import html_queries as Q
from tagweft.sources import html as S

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, html string"


def keeper(tmp_path):
    made = []

    def keep(df):
        made.append(str(tmp_path / f"t{len(made)}"))
        df.write.parquet(made[-1])
        return df.sparkSession.read.schema(df.schema).parquet(made[-1])

    return keep, made


def test_paths_of_a_deep_document(spark, tmp_path):
    """A chain of 5,000 in 14 rounds, and random trees by their intervals."""
    keep, made = keeper(tmp_path)
    chain = [(1, k, k - 1 if k else None, "n") for k in range(5000)]
    nodes = spark.createDataFrame(chain, "page_id long, node_id int, parent_id int, name string")
    found = walks.paths(nodes, keep)
    assert found.where("length(path) <> 2 * node_id + 1").count() == 0 and found.count() == 5000 and len(made) <= 15
    html = Q.pages(spark, SF).limit(20)
    nodes = X.nodes(html).where("node_type = 'element'").cache()
    own = {(r.page_id, r.node_id): r.path for r in walks.paths(nodes.withColumn("parent_id", F.when(F.col("depth") > 1, F.col("parent_id"))), keep).collect()}
    rows = nodes.collect()
    by_interval = {(r.page_id, r.node_id): "/".join(a.name for a in rows if a.page_id == r.page_id and a.node_id <= r.node_id <= a.subtree_end) for r in rows}
    assert own == by_interval


def test_pointers_in_a_circle(spark, tmp_path):
    keep, _ = keeper(tmp_path)
    nodes = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 0, "b")], "page_id long, node_id int, parent_id int, name string")
    with pytest.raises(ValueError):
        walks.paths(nodes, keep, limit=4)
    lone = spark.createDataFrame([(1, 5, 3, "a"), (1, 6, 5, None)], "page_id long, node_id int, parent_id int, name string")
    assert sorted(map(tuple, walks.paths(lone, keep).collect())) == [(1, 5, "a"), (1, 6, "a/")]


def test_text_blocks_against_windows(spark):
    rng = random.Random(2)
    pages = [(k, "".join(rng.choice(["<h1>A<i>B</i></h1>", "<h2>C</h2>", "<p>x</p>", "y<b>z</b>", "<h3></h3>", "<!--c-->"]) for _ in range(rng.randint(0, 12)))) for k in range(30)]
    pages.append((99, "<h1>long</h1>" + "<p>t</p>" * 3000))
    nodes = X.nodes(spark.createDataFrame(pages, PAGES)).cache()
    got = blocks.text_blocks(nodes).select("page_id", "node_id", "heading_id", "level", "text")
    order = Window.partitionBy("page_id").orderBy("node_id")
    heading = F.when(F.col("name").isin(*blocks.HEADINGS), F.struct("node_id", "subtree_end", "name"))
    marked = nodes.withColumn("h", F.last(heading, True).over(order)).where("node_type = 'text' AND (h IS NULL OR node_id > h.subtree_end)")
    expected = marked.select("page_id", "node_id", F.col("h.node_id").alias("heading_id"), F.substring("h.name", 2, 1).cast("int").alias("level"), F.col("value").alias("text"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr) and got.count() > 3000


@pytest.mark.parametrize("n", [0, 3, 500, 20_000, 200_000])
def test_sketches(spark, n):
    rows = spark.range(3 * n).selectExpr("id % 3 AS part", "concat('v', id % greatest(1, cast(id / 3 AS long) + 1) % 1000000, '/', cast(id / 3 AS long)) AS v")
    exact = rows.agg(F.count_distinct("v")).first()[0]
    parts = sketches.registers(rows, F.col("v"), ["part"]).cache()
    orders = [parts, parts.orderBy(F.desc("part")), sketches.merged(parts.where("part < 2"), []).unionByName(parts.where("part = 2").drop("part"))]
    found = {tuple(r.estimate for r in sketches.estimated(sketches.merged(p, []), []).collect()) for p in orders}
    assert len(found) == 1
    estimate = next(iter(found))
    assert abs(estimate[0] - exact) <= 0.06 * exact
    assert sketches.registers(spark.createDataFrame([(1, None)], "k int, v string"), F.col("v"), ["k"]).count() == 0


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_a_stored_table_is_not_shuffled(spark, tmp_path):
    S.save_nodes(X.nodes(Q.pages(spark, SF)), "layout_nodes", str(tmp_path / "nodes"), buckets=4)
    try:
        nodes = S.bucketed(spark).table("layout_nodes")
        assert shuffles(X.children(nodes)) == shuffles(X.siblings(nodes)) == 0
        within = X.descendants_within(nodes, F.col("name") == "ul", F.col("name") == "a")
        assert shuffles(within) == 0
        plain = X.descendants(nodes.where("name = 'ul'"), nodes.where("name = 'a'"))
        assert sorted((r.page_id, r.ancestor_id, r.node_id) for r in within.collect()) == sorted((r.page_id, r.ancestor_id, r.node_id) for r in plain.collect())
        assert within.columns == plain.columns and within.count() > 0
    finally:
        spark.sql("DROP TABLE layout_nodes")
