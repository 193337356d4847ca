"""Every registered query of the HTML engine against its SQL on the smallest tables, and the parts that SQL can't show."""

import duckdb
import pytest

import __spark_entry__ as entry
from tagweft.functions import html as H
from tagweft.operators import tables as X
from tagweft.plans import html_queries
from tagweft.sources import html as sources
from tagweft.streaming import chunks as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("pages", "documents", "nation", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(html_queries.QUERIES))
def test_query(spark, duck, name):
    got = html_queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({html_queries.ORACLES[name]})").fetchall(), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_only(spark):
    with pytest.raises(TypeError):
        X.nodes(spark.createDataFrame([(1, bytearray(b"x"))], "page_id int, html binary"))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "page_id int, html string")
    assert {(r.page_id, r.name) for r in X.nodes(df).collect()} == {(2, None), (2, "html"), (2, "head"), (2, "body")}
    assert X.nodes(df.where("false")).count() == 0


def test_filter_on_the_key_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    plan = df.select("page_id", H.html_parse()("html").alias("p")).selectExpr("page_id", "inline_outer(p.nodes)").where("page_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(page_id,3)" in plan and plan.count("ArrowEvalPython") == 1


def test_siblings_format(spark):
    df = spark.createDataFrame([(1, '<!DOCTYPE html PUBLIC "a"><p a=1>x<b>y')], "page_id int, html string")
    rows = {(r.type, r.name): r for r in X.siblings(X.nodes(df)).collect()}
    assert rows["directive", "html"].data == '!DOCTYPE html PUBLIC "a"' and rows["tag", "p"].attribs == {"a": "1"}
    assert rows["tag", "p"].attribs_prefix == {"a": None} and rows["tag", "p"].start_index is None
    assert rows["tag", "b"].prev_id is not None and rows["tag", "b"].next_id is None


def test_chunks(spark):
    rows = [(1, 0, "<p>a", False), (1, 1, "b", True), (1, 1, "b", True), (2, 1, "x", True), (3, 0, None, True)]
    got = {r.doc_id: (r.html, r.complete) for r in C.assemble(spark.createDataFrame(rows, sources.CHUNKS)).collect()}
    assert got == {1: ("<p>ab", True), 2: ("x", False), 3: ("", True)}


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é")
    df = sources.read_html_files(spark, str(tmp_path / "*.html"))
    assert df.first().html == "<p>é"
    sources.drain(df)
    sources.write_html(df, str(tmp_path / "out"))
    sources.write_nodes(X.nodes(df, "url"), str(tmp_path / "nodes"), "url")
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 6


def test_a_file_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "FOLDER", 3)
    rows = [(i, f"<p>é{i}\n\n") for i in range(20)] + [(7, "again"), (-1, ""), (90, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(2)
    sources.write_files(df, str(tmp_path / "out"), by="page_id")
    files = list((tmp_path / "out").glob("*/*.txt"))
    assert len(files) == len(rows) and len({f.parent for f in files}) >= 8  # not a folder for each
    found = sources.read_files(spark, str(tmp_path / "out"))
    got = sorted((int(r.url.split("page_id=")[1].rsplit("-", 1)[0]), r.html) for r in found.collect())
    assert got == sorted((i, x or "") for i, x in rows)
    sources.write_files(df.where("false"), str(tmp_path / "none"), by="page_id")
    assert sources.read_files(spark, str(tmp_path / "none")).count() == 0


def test_events_limit_and_kinds(spark):
    df = spark.createDataFrame([(1, "<p>a<b>c")], "page_id int, html string")
    assert [r.name for r in X.events(df, kinds=("start",), limit=1).collect()] == ["p"]
