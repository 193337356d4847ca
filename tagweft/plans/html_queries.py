"""Registered queries of the HTML engine, and the SQL that must give the same rows.

Over `pages`, the SQL reads the pages' fixed grammar with regular expressions. For rules that pages don't exercise, inputs are
built from the rows of `nation`, and the SQL states the output that the standard asks for (cases.py).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.tokenizer import DATA
from ..functions import html as H
from ..operators import asof, blocks, edits, sketches
from ..operators import tables as X
from ..operators import trees, walks
from ..sources import archive
from ..sources import html as S
from ..streaming import chunks as C
from . import cases


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _shared(spark) -> str:
    """The folder that driver and executors share; one of our own only on local masters."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or f"file://{tempfile.mkdtemp(prefix='tagweft-')}"


def _kept(df: DataFrame) -> DataFrame:
    """Written once and read again, so that pages that several steps look at are parsed once."""
    at = f"{_shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _decoded(x: str) -> str:
    """SQL for the references that pages hold; a cut-off &am or & stays."""
    return rf"regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')".replace('\\"', '"')


# --- over pages ---------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page with the page's title and the link's text, in one pass over the parse."""
    found = X.parse(pages(spark, sf_dir))
    nodes = F.col("p.nodes")
    title = F.get(X.elements(nodes, "title"), F.lit(0))
    anchors = F.filter(X.elements(nodes, "a"), lambda n: F.exists(n["attrs"], lambda a: a["name"] == "href"))
    rows = F.transform(anchors, lambda n: F.struct(H.get_attribute(n["attrs"], "href").alias("href"), X.text_of(nodes, n).alias("text")))
    return found.select("page_id", X.text_of(nodes, title).alias("title"), F.posexplode_outer(rows).alias("ord", "r")).select("page_id", "title", "ord", "r.href", "r.text")


def _first_text(name: str):
    def run(spark, sf_dir):
        found = X.parse(pages(spark, sf_dir))
        return found.select("page_id", X.text_of(F.col("p.nodes"), F.get(X.elements(F.col("p.nodes"), name), F.lit(0))).alias("text"))

    return run


for _name, _tag in (("page_titles", "title"), ("h1_text", "h1"), ("footer_text", "footer")):
    QUERIES[_name] = _first_text(_tag)
    ORACLES[_name] = f"SELECT page_id, {_decoded(f"regexp_extract(html, '<{_tag}>([^<]*)', 1)")} AS text FROM pages"


@query(r"""SELECT page_id, (unnest(range(len(h))))::INTEGER AS ord, unnest(h) AS href, unnest(t) AS text FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)""")
def page_links(spark, sf_dir):
    return X.links(pages(spark, sf_dir))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset FROM pages""")
def page_meta_lang(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir))
    first = lambda name, attr: H.get_attribute(F.get(X.elements(F.col("p.nodes"), name), F.lit(0))["attrs"], attr)
    return found.select("page_id", first("html", "lang").alias("lang"), first("meta", "charset").alias("charset"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def page_comments(spark, sf_dir):
    return X.nodes(pages(spark, sf_dir)).where("node_type = 'comment'").select("page_id", F.col("value").alias("comment"))


@query("SELECT page_id, 'no-quirks' AS mode FROM pages")
def page_mode(spark, sf_dir):
    return X.modes(pages(spark, sf_dir))


@query("""SELECT name, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) WHERE name <> 'b' GROUP BY name""")
def tag_counts(spark, sf_dir):
    found = X.nodes(pages(spark, sf_dir)).where("node_type = 'element' AND name <> 'b'")
    return found.groupBy("name").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'), '<p>(?:<b>)?') AS p FROM pages),
    e AS (SELECT page_id, i, CASE WHEN p[i] = '<p><b>' THEN 1 ELSE 0 END AS b FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM o)),
    k AS (SELECT page_id, b, least(3, coalesce(sum(b) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM e)
    SELECT page_id, (coalesce(sum(k.k + b), 0) + least(3, coalesce(sum(b), 0)))::BIGINT AS n_b_elements FROM pages LEFT JOIN k USING (page_id) GROUP BY page_id""")
def b_reconstruction(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir))
    return found.select("page_id", F.size(X.elements(F.col("p.nodes"), "b")).cast("long").alias("n_b_elements"))


@query("""SELECT page_id, tag, text FROM (SELECT page_id, 'script' AS tag, regexp_extract(html, '<script>(.*?)</script>', 1) AS text FROM pages
    UNION ALL SELECT page_id, 'style', regexp_extract(html, '<style>(.*?)</style>', 1) FROM pages)""")
def script_style_text(spark, sf_dir):
    nodes = F.col("p.nodes")
    tags = F.filter(nodes, lambda n: (n["node_type"] == "element") & n["name"].isin("script", "style"))
    rows = F.transform(tags, lambda n: F.struct(n["name"].alias("tag"), X.text_of(nodes, n).alias("text")))
    return X.parse(pages(spark, sf_dir)).select("page_id", F.inline(rows))


@query(f"SELECT page_id, length({_decoded("regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', '', 'g')")})::BIGINT AS n FROM pages")
def article_text_len(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir))
    return found.select("page_id", F.length(X.text_of(F.col("p.nodes"), F.get(X.elements(F.col("p.nodes"), "article"), F.lit(0)))).cast("long").alias("n"))


@query("""WITH h AS (SELECT regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g') AS html FROM pages)
    SELECT type, n FROM (SELECT 'start' AS type, sum(len(regexp_extract_all(html, '<[a-z]')))::BIGINT AS n FROM h UNION ALL SELECT 'end', sum(len(regexp_extract_all(html, '</[a-z]')))::BIGINT FROM h
    UNION ALL SELECT 'comment', sum(len(regexp_extract_all(html, '<!--')))::BIGINT FROM h UNION ALL SELECT 'doctype', sum(len(regexp_extract_all(html, '<!DOCTYPE')))::BIGINT FROM h)""")
def events_type_counts(spark, sf_dir):
    found = X.events(pages(spark, sf_dir), kinds=("start", "end", "comment", "doctype"))
    return found.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT page_id, html FROM pages")
def raw_identity(spark, sf_dir):
    return X.rewritten(pages(spark, sf_dir), lambda e: F.lit(None).cast("string"))


@query("""SELECT page_id, regexp_replace(html, '<a href="([^"]*)">', '<a href="https://example.org\\1">', 'g') AS html FROM pages""")
def rewrite_href(spark, sf_dir):
    def rule(e: Column) -> Column:
        href = H.get_attribute(e["attrs"], "href")
        return F.when((e["type"] == "start") & (e["name"] == "a"), F.concat(F.lit('<a href="https://example.org'), H.escape_attribute(href), F.lit('">')))

    return X.rewritten(pages(spark, sf_dir), rule)


@query("SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'g') AS html FROM pages")
def rewrite_drop_comments(spark, sf_dir):
    return X.rewritten(pages(spark, sf_dir), lambda e: F.when(e["type"] == "comment", ""))


@query("""SELECT page_id, replace(html, '</h1>', '</h2>') AS html FROM pages""")
def rewrite_end_tags(spark, sf_dir):
    return X.rewritten(pages(spark, sf_dir), lambda e: F.when((e["type"] == "end") & (e["name"] == "h1"), "</h2>"))


@query("""SELECT page_id, regexp_replace(html, '<title>.*?</title>', '<title>x</title>') AS html FROM pages""")
def rewrite_callback(spark, sf_dir):
    def handler(event, raw):
        return "x" if event.kind == "text" and event.last_tag == "title" else None

    return X.spread(pages(spark, sf_dir)).select("page_id", H.html_rewrite(handler)("html").alias("html"))


@query("""SELECT page_id, tag, (strpos(html, pat) - 1)::INTEGER AS start_offset, (1 + length(substr(html, 1, strpos(html, pat) - 1)) - length(replace(substr(html, 1, strpos(html, pat) - 1), chr(10), '')))::INTEGER AS start_line
    FROM pages, (VALUES ('article', '<article>'), ('h1', '<h1>'), ('footer', '<footer>')) AS v(tag, pat)""")
def locations_line_col(spark, sf_dir):
    nodes = X.nodes(pages(spark, sf_dir), locations=True).where("name IN ('article', 'h1', 'footer')")
    return nodes.select("page_id", F.col("name").alias("tag"), "loc.start_offset", "loc.start_line")


@query("""SELECT page_id, count(*)::BIGINT AS n_nodes, true AS same FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>|<a href="[^"]*">[^<]*</a>')) FROM pages) GROUP BY page_id""")
def location_slices(spark, sf_dir):
    """The source at an element's location is what the element serializes to."""
    given = X.spread(pages(spark, sf_dir).select("page_id", "html"))
    found = given.select("page_id", "html", H.html_parse((H.NODES, H.LOC))("html").alias("p")).select("page_id", "html", F.col("p.nodes").alias("nodes"))
    chosen = F.filter("nodes", lambda n: n["name"].isin("li", "a"))
    outer = H.html_serialize_each()("nodes", F.transform(chosen, lambda n: n["node_id"]))  # all of a page in one call
    spans = F.transform(chosen, lambda n: F.struct(n["loc"]["start_offset"].alias("start"), n["loc"]["end_offset"].alias("end")))
    own = found.select("page_id", outer.alias("outer"), H.raw_slices("html", spans).alias("source"))  # pages meet no rows of others
    same = F.array_min(F.zip_with("source", "outer", lambda a, b: a == b))
    return own.groupBy("page_id").agg(F.sum(F.size("outer")).alias("n_nodes"), F.bool_and(same).alias("same")).where("n_nodes > 0")


@query("""SELECT page_id, len(h)::BIGINT AS n_items, (len(h) - 1)::BIGINT AS n_prev, (len(h) - 1)::BIGINT AS n_next FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS h FROM pages) WHERE len(h) > 0""")
def siblings_prev_next(spark, sf_dir):
    items = X.siblings(X.nodes(pages(spark, sf_dir))).where("name = 'li'")
    return items.groupBy("page_id").agg(F.count("*").alias("n_items"), F.count("prev_id").alias("n_prev"), F.count("next_id").alias("n_next"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href'))::BIGINT AS n FROM pages WHERE contains(html, '<a href')""")
def descendant_links_in_nav(spark, sf_dir):
    nodes = _kept(X.nodes(pages(spark, sf_dir)).where("node_type = 'element' AND name IN ('nav', 'a')"))
    pairs = X.descendants(nodes.where("name = 'nav'"), nodes.where("name = 'a'"))
    return pairs.groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT page_id, above, below, n FROM (SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM pages) JOIN (VALUES ('html', 'a'), ('html', 'li'), ('body', 'a'), ('body', 'li'), ('ul', 'a'), ('ul', 'li'), ('li', 'a')) AS v(above, below) ON n > 0
    UNION ALL SELECT page_id, above, 'h1', 1 FROM pages, (VALUES ('html'), ('body'), ('article')) AS v(above)""")
def ancestor_pairs(spark, sf_dir):
    """Pairs of elements by the names of both, by one structural join of a stored node table with itself."""
    nodes = _kept(X.nodes(pages(spark, sf_dir)).where("node_type = 'element'").select("page_id", "node_id", "subtree_end", "name"))
    above, below = nodes.where("name IN ('html', 'body', 'article', 'ul', 'li')"), nodes.where("name IN ('a', 'li', 'h1')")
    pairs = X.descendants(above, below.select("page_id", "node_id", F.col("name").alias("below")))
    names = nodes.select("page_id", F.col("node_id").alias("ancestor_id"), F.col("name").alias("above"))
    return pairs.join(names.hint("merge"), ["page_id", "ancestor_id"]).groupBy("page_id", "above", "below").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT page_id, 'li' AS name, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS x FROM pages UNION ALL SELECT page_id, 'nav', regexp_extract(html, '<nav>.*?</nav>') FROM pages WHERE contains(html, '<nav>') UNION ALL SELECT page_id, 'title', regexp_extract(html, '<title>.*?</title>') FROM pages),
    c AS (SELECT x, count(*) AS n, count(DISTINCT page_id) AS pages FROM e GROUP BY x)
    SELECT page_id, name, count(*)::BIGINT AS n, coalesce(sum(CASE WHEN c.n > 1 THEN 1 END), 0)::BIGINT AS n_recurring, coalesce(sum(CASE WHEN c.pages > 1 THEN 1 END), 0)::BIGINT AS n_across FROM e JOIN c USING (x) GROUP BY page_id, name""")
def recurring_subtrees(spark, sf_dir):
    """How many subtrees of some kinds stand elsewhere too, on any page and on others."""
    found = _kept(trees.subtrees(X.nodes(pages(spark, sf_dir))))
    known = trees.recurring(found).select("digest", "n_documents")
    own = found.where("name IN ('li', 'nav', 'title')").join(known.hint("merge"), "digest", "left")
    return own.groupBy("page_id", "name").agg(F.count("*").alias("n"), F.count("n_documents").alias("n_recurring"), F.count_if(F.col("n_documents") > 1).alias("n_across"))


@query("""SELECT page_id, CASE WHEN contains(html, '<h1>') THEN 'hr|p|i|u|h1' END AS before, CASE WHEN contains(html, '<ul>') THEN len(regexp_extract_all(html, '<li>')) + 2 ELSE 0 END::BIGINT AS n_items, 0::BIGINT AS n_footers, CASE WHEN contains(html, '<ul>') THEN '2' END AS last_item FROM pages""")
def edited_pages(spark, sf_dir):
    """Two batches of edits of each page's node table: before its heading twice, at the end of its list twice; its footer goes."""
    table = _kept(edits.labelled(X.nodes(pages(spark, sf_dir))))
    for turn, (heading, item) in enumerate([("<hr><p>note", "<li>1"), ("<i>a</i><u>b</u>", "<li>2")]):
        to = lambda name, op, html: table.where(F.col("name") == name).select("page_id", F.lit(turn).alias("edit"), F.lit(op).alias("op"), "begin_label", F.lit(html).alias("html"))  # noqa: B023, E731
        asked = to("h1", edits.BEFORE, heading).union(to("ul", edits.APPEND, item))
        if turn:
            asked = asked.union(to("footer", edits.DETACH, None))
        table = _kept(edits.applied(table, asked))
    nodes = _kept(edits.renumbered(table))
    headings = nodes.where("name = 'h1'").select("page_id", F.col("parent_id").alias("of"), F.col("sib_idx").alias("last"))
    beside = nodes.join(headings.hint("merge"), "page_id").where("parent_id = of AND sib_idx <= last").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("sib_idx", "name"))).alias("found"))
    before = beside.select("page_id", F.array_join(F.transform("found", lambda x: x["name"]), "|").alias("before"))
    texts = nodes.where("node_type = 'text'").select("page_id", F.col("parent_id").alias("of"), F.col("value").alias("text"))
    items = nodes.where("name = 'li'").join(texts.hint("merge"), "page_id").where("of = node_id").groupBy("page_id").agg(F.max_by("text", "node_id").alias("last_item"))
    counts = nodes.groupBy("page_id").agg(F.count_if(F.col("name") == "li").alias("n_items"), F.count_if(F.col("name") == "footer").alias("n_footers"))
    return counts.join(before.hint("merge"), "page_id", "left").join(items.hint("merge"), "page_id", "left").select("page_id", "before", "n_items", "n_footers", "last_item")


@query("""SELECT page_id, unnest(['html/head/title', 'html/body/article/h1', 'html/body/nav/ul/li/a']) AS path, unnest([len(regexp_extract_all(html, '<title>')), len(regexp_extract_all(html, '<h1>')), len(regexp_extract_all(html, '<a href'))])::BIGINT AS n FROM pages
    WHERE contains(html, '<a href') UNION ALL SELECT page_id, unnest(['html/head/title', 'html/body/article/h1']), unnest([1, 1]) FROM pages WHERE NOT contains(html, '<a href')""")
def element_paths(spark, sf_dir):
    """Elements by their path, from parent pointers alone."""
    elements = X.nodes(pages(spark, sf_dir)).where("node_type = 'element'")
    pointers = elements.select("page_id", "node_id", F.when(F.col("depth") > 1, F.col("parent_id")).alias("parent_id"), "name")
    found = walks.paths(pointers, _kept).where("path IN ('html/head/title', 'html/body/article/h1', 'html/body/nav/ul/li/a')")
    return found.groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, unnest(regexp_extract_all(html, '<(li|a|title|h1|nav)[ >]', 1)) AS tag FROM pages)
    SELECT lang, tag, 'http://www.w3.org/1999/xhtml' AS namespace, grouping_id(lang, tag)::BIGINT AS level, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY CUBE (lang, tag)
    UNION ALL SELECT lang, tag, NULL, (4 + grouping_id(lang, tag))::BIGINT, count(*), count(DISTINCT page_id) FROM t GROUP BY CUBE (lang, tag)""")
def tag_profile(spark, sf_dir):
    """Elements by language of the page, tag and namespace, in all groupings."""
    nodes = F.col("p.nodes")
    lang = H.get_attribute(F.get(X.elements(nodes, "html"), F.lit(0))["attrs"], "lang")
    wanted = F.filter(nodes, lambda n: (n["node_type"] == "element") & n["name"].isin("li", "a", "title", "h1", "nav"))
    rows = X.parse(pages(spark, sf_dir)).select("page_id", lang.alias("lang"), F.inline(F.transform(wanted, lambda n: F.struct(n["name"].alias("tag"), n["namespace"].alias("namespace")))))
    return rows.cube("namespace", "lang", "tag").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("""SELECT page_id, n > 0 AS headed, 1::INTEGER AS level, n AS n_texts FROM (SELECT page_id, len(regexp_extract_all(split_part(html, '</h1>', 2), '>[^<]+'))::BIGINT + CASE WHEN split_part(html, '</h1>', 2) SIMILAR TO '[^<].*' THEN 1 ELSE 0 END AS n FROM pages) WHERE n > 0
    UNION ALL SELECT page_id, false, NULL, len(regexp_extract_all(split_part(regexp_replace(html, '<(style|script)>.*?</(style|script)>', '<x>y</x>', 'g'), '<h1>', 1), '>[^<]+'))::BIGINT FROM pages""")
def headed_texts(spark, sf_dir):
    """Texts by the heading before them."""
    found = blocks.text_blocks(X.nodes(pages(spark, sf_dir)))
    return found.groupBy("page_id", F.col("heading").isNotNull().alias("headed"), "level").agg(F.count("*").alias("n_texts"))


@query("""WITH t AS (SELECT page_id % 4 AS part, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT part, count(DISTINCT href) AS exact, true AS near FROM t GROUP BY part UNION ALL SELECT NULL, count(DISTINCT href), true FROM t""")
def distinct_links(spark, sf_dir):
    """Distinct links of parts of the pages and, by merging the parts' sketches, of all: beside exact counts, within 6 %."""
    links = _kept(X.links(pages(spark, sf_dir)).select((F.col("page_id") % 4).alias("part"), "href"))
    parts = _kept(sketches.registers(links, F.col("href"), ["part"]))
    whole = lambda df: df.withColumn("part", F.lit(None).cast("long"))
    estimates = sketches.estimated(parts, ["part"]).unionByName(whole(sketches.estimated(sketches.merged(parts, []), [])))
    exact = links.groupBy(F.col("part").alias("p")).agg(F.count_distinct("href").alias("exact"))
    exact = exact.union(links.agg(F.lit(None).cast("long").alias("p"), F.count_distinct("href").alias("exact")))
    both = estimates.join(exact, F.col("part").eqNullSafe(F.col("p")))
    return both.select("part", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.06 * F.col("exact")).alias("near"))


@query("SELECT page_id AS doc_id, html AS text FROM pages")
def archive_round_trip(spark, sf_dir):
    """Pages written to an archive and read back by ranges of bytes."""
    spark.dataSource.register(archive.ArchiveSource)
    at = f"{_shared(spark)}/{uuid.uuid4().hex}"
    pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).write.format("tagweft_archive").mode("append").save(at)
    return spark.read.format("tagweft_archive").option("rangeBytes", 1 << 20).load(at)


@query("""SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(html, '<title>[^<]*</title>', '<title>T</title>'), '<!--.*?-->', '<!--x-->', 'g'), '<h1>', '<h2 class="t">'), '</h1>', '</h2>'), '<!DOCTYPE html>', '<!DOCTYPE html SYSTEM "about:legacy-compat">') AS html FROM pages""")
def rewrite_all_kinds(spark, sf_dir):
    """A rule with a case for each of the five kinds of events."""

    def rule(e: Column) -> Column:
        system = e.withField("system_id", F.lit("about:legacy-compat"))
        heading = e["name"] == "h1"
        return (
            F.when(e["type"] == "doctype", H.render_event(system))
            .when((e["type"] == "start") & heading, '<h2 class="t">')
            .when((e["type"] == "end") & heading, "</h2>")
            .when(e["type"] == "comment", H.render_event(e.withField("text", F.lit("x"))))
            .when((e["type"] == "text") & (e["last_start_tag"] == "title"), "T")
        )

    return X.rewritten(pages(spark, sf_dir), rule)


@query("""SELECT page_id, 'tag' AS type, name, CASE name WHEN 'html' THEN regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang, n_attribs, (strpos(html, '<' || name) - 1)::INTEGER AS start_index, CASE name WHEN 'title' THEN strpos(html, '</title>') + 7 WHEN 'h1' THEN strpos(html, '</h1>') + 4 END::INTEGER AS end_index
    FROM pages, (VALUES ('title', 0), ('h1', 0), ('html', 1)) AS v(name, n_attribs)""")
def second_format(spark, sf_dir):
    """The second tree format: maps of attributes, their namespaces and prefixes, and indices of the source."""
    found = X.siblings(X.nodes(pages(spark, sf_dir), locations=True)).where("name IN ('title', 'h1', 'html') AND type = 'tag'")
    plain = F.coalesce(F.array_compact(F.concat(F.map_values("attribs_namespace"), F.map_values("attribs_prefix"))), F.array())
    n = F.when(F.size(plain) == 0, F.size("attribs"))
    end = F.when(F.col("name") != "html", F.col("end_index"))
    return found.select("page_id", "type", "name", F.col("attribs")["lang"].alias("lang"), n.alias("n_attribs"), "start_index", end.alias("end_index"))


@query("SELECT page_id, html FROM pages")
def html_files(spark, sf_dir):
    """A file a page, written and read as a whole."""
    at = f"{_shared(spark)}/{uuid.uuid4().hex}"
    S.write_files(pages(spark, sf_dir), at, by="page_id")
    return S.read_files(spark, at).select(F.regexp_extract("url", "page_id=(-?[0-9]+)-", 1).cast("long").alias("page_id"), "html")


@query("""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items, len(regexp_extract_all(html, '<a href'))::BIGINT AS n_links FROM pages""")
def node_files(spark, sf_dir):
    """Node tables written in order of document and place, and read again."""
    at = f"{_shared(spark)}/{uuid.uuid4().hex}"
    S.write_nodes(X.nodes(pages(spark, sf_dir)), at)
    count = lambda name: F.count_if(F.col("name") == name)
    return spark.read.parquet(at).groupBy("page_id").agg(F.coalesce(count("li"), F.lit(0)).alias("n_items"), F.coalesce(count("a"), F.lit(0)).alias("n_links"))


@query("SELECT page_id AS doc_id, '<html><head></head><body></body></html>' AS html FROM pages")
def empty_pieces(spark, sf_dir):
    """Documents of which only empty pieces come are documents all the same."""
    empty = _cut(pages(spark, sf_dir)).withColumn("chunk", F.when(F.col("seq") % 2 == 0, "").cast("string"))
    return X.serialized(C.assemble(empty).where("complete"), "doc_id")


def _bucketed_nodes(spark, sf_dir) -> DataFrame:
    name = f"nodes_{uuid.uuid4().hex}"
    S.save_nodes(X.nodes(pages(spark, sf_dir)), name, f"{_shared(spark)}/{name}", buckets=16)
    return S.bucketed(spark).table(name)


@query("""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_children, greatest(len(regexp_extract_all(html, '<li>')) - 1, 0)::BIGINT AS n_next, len(regexp_extract_all(html, '<a href'))::BIGINT AS n_below FROM pages WHERE contains(html, '<li>')""")
def stored_layout(spark, sf_dir):
    """Children, siblings and descendants of a node table that is bucketed by document: none of them shuffles nodes."""
    nodes = _bucketed_nodes(spark, sf_dir)
    lists = nodes.where("name = 'ul'").select(F.col("page_id").alias("p"), F.col("node_id").alias("n"))
    children = X.children(nodes).join(lists, (F.col("page_id") == F.col("p")) & (F.col("node_id") == F.col("n")), "left_semi").groupBy("page_id").agg(F.count("*").alias("n_children"))
    after = X.siblings(nodes).where("name = 'li'").groupBy("page_id").agg(F.count("next_id").alias("n_next"))
    below = X.descendants_within(nodes, F.col("name") == "ul", F.col("name") == "a").groupBy("page_id").agg(F.count("*").alias("n_below"))
    return children.join(after, "page_id").join(below, "page_id")


@query("""SELECT page_id, tag, n FROM (SELECT page_id, unnest(['a', 'title', 'h1', 'style', 'script', 'footer']) AS tag, unnest([len(regexp_extract_all(html, '<a href="[^"]*">[^<]')), len(regexp_extract_all(html, '<title>[^<]')), len(regexp_extract_all(html, '<h1>[^<]')), len(regexp_extract_all(html, '<style>.')), len(regexp_extract_all(html, '<script>.')), len(regexp_extract_all(html, '<footer>[^<]'))])::BIGINT AS n FROM pages) WHERE n > 0""")
def text_after_tags(spark, sf_dir):
    """Texts by the last start tag before them: an as-of join of the text events with the start tags."""
    events = _kept(X.events(pages(spark, sf_dir), kinds=("start", "text")).select("page_id", "tok_idx", "type", "name"))
    found = asof.asof(events.where("type = 'text'"), events.where("type = 'start'").withColumnRenamed("name", "tag"), ["page_id"], "tok_idx", ["tag"])
    found = found.where("tag IN ('a', 'title', 'h1', 'style', 'script', 'footer')")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""SELECT a.event_id, a.user_id, b.event_id AS before_id, b.event_type AS before_type FROM events a ASOF LEFT JOIN (
    SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) b ON a.user_id = b.user_id AND a.ts > b.ts""")
def last_purchase(spark, sf_dir):
    """Each event with the purchase of the same user before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before_id"), F.col("event_type").alias("before_type"))
    return asof.asof(events, bought, ["user_id"], "ts", ["before_id", "before_type"], width=86_400e6, strict=True).select("event_id", "user_id", "before_id", "before_type")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Subtrees of pages as they are, and with another heading (page_id % 3 = 0), an item more in each list (1), or without
    the footer (2)."""
    html = F.col("html")
    edited = F.when(F.col("page_id") % 3 == 0, F.replace(html, F.lit("</h1>"), F.lit("!</h1>"))).when(F.col("page_id") % 3 == 1, F.replace(html, F.lit("</ul>"), F.lit("<li>new</ul>"))).otherwise(F.regexp_replace(html, "(?s)<footer>.*?</footer>", ""))
    given = pages(spark, sf_dir)
    return tuple(_kept(trees.subtrees(X.nodes(df))) for df in (given, given.select("page_id", edited.alias("html"))))


@query("""SELECT page_id, 'new' AS side, NULL AS name, 1::BIGINT AS n FROM pages WHERE page_id % 3 = 0 AND contains(html, '</h1>')
    UNION ALL SELECT page_id, 'old', 'h1', 1 FROM pages WHERE page_id % 3 = 0 AND contains(html, '</h1>')
    UNION ALL SELECT page_id, side, CASE side WHEN 'old' THEN 'ul' END, 1 FROM pages, (VALUES ('old'), ('new')) AS s(side) WHERE page_id % 3 = 1 AND contains(html, '</ul>')
    UNION ALL SELECT page_id, side, CASE side WHEN 'new' THEN 'body' END, 1 FROM pages, (VALUES ('old'), ('new')) AS s(side) WHERE page_id % 3 = 2 AND contains(html, '</footer>')""")
def tree_changes(spark, sf_dir):
    """Where two versions of each page part. (A heading's old text goes on as that of the title.)"""
    return trees.changes(*_versions(spark, sf_dir)).groupBy("page_id", "side", "name").agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM pages WHERE contains(html, '<li>')""")
def list_children(spark, sf_dir):
    nodes = _kept(X.nodes(pages(spark, sf_dir)).select("page_id", "node_id", "parent_id", "sib_idx", "name"))
    lists = nodes.where("name = 'ul'").select("page_id", "node_id")
    return X.children(nodes).join(lists.hint("merge"), ["page_id", "node_id"], "left_semi").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT page_id, (unnest(range(len(v))))::INTEGER AS n, unnest(v) AS value FROM (SELECT page_id, regexp_extract_all(html, ' (?:lang|charset|href|class)="([^"]*)"', 1) AS v FROM pages)""")
def attribute_values(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir))
    values = F.flatten(F.transform(F.filter(F.col("p.nodes"), lambda n: n["node_type"] == "element"), lambda n: F.transform(n["attrs"], lambda a: a["value"])))
    return found.select("page_id", F.posexplode(values).alias("n", "value"))


@query("SELECT page_id FROM pages WHERE NOT contains(html, '</html>')")
def pages_without_body_end(spark, sf_dir):
    ends = X.events(pages(spark, sf_dir), kinds=("end",)).where("name = 'html'")
    return pages(spark, sf_dir).select("page_id").join(ends, "page_id", "left_anti")


def _count(text: str, part: str) -> Column:
    return (F.size(F.split(text, part)) - 1).cast("long")


_SAME = "SELECT page_id, true AS same, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links FROM pages"


@query(_SAME)
def serialize_idempotent(spark, sf_dir):
    once = X.serialized(pages(spark, sf_dir)).withColumnRenamed("html", "a")
    twice = once.select("page_id", "a", H.html_parse((H.TEXT_HTML,))("a").alias("p"))
    return twice.select("page_id", (F.col("a") == F.col("p.html")).alias("same"), _count("p.html", "<a href=").alias("n_links"))


@query(_SAME)
def serialize_from_nodes(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir), facets=(H.NODES, H.TEXT_HTML, H.DUMP))
    again = found.select("page_id", F.col("p.html").alias("html"), F.col("p.dump").alias("dump"), H.html_written()("p.nodes").alias("again"))  # one tree a page
    return again.select("page_id", ((F.col("again.html") == F.col("html")) & (F.col("again.dump") == F.col("dump"))).alias("same"), _count("again.html", "<a href=").alias("n_links"))


def _cut(df: DataFrame, size: int = 700) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("html") - 1), F.lit(size))
    pieces = df.select(F.col("page_id").alias("doc_id"), "html", F.posexplode(starts).alias("seq", "at"))
    return pieces.select("doc_id", F.col("seq").cast("long").alias("seq"), F.substring("html", F.col("at") + 1, F.lit(size)).alias("chunk"), (F.col("at") + size >= F.length("html")).alias("is_last"))


@query(_SAME)
def chunked_equals_whole(spark, sf_dir):
    whole = X.serialized(pages(spark, sf_dir)).withColumnRenamed("html", "a")
    joined = C.assemble(_cut(pages(spark, sf_dir)))
    again = X.serialized(joined.where("complete"), "doc_id").withColumnRenamed("html", "b")
    both = whole.join(again, F.col("page_id") == F.col("doc_id"), "left")
    return both.select("page_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"), _count("b", "<a href=").alias("n_links"))


@query("SELECT page_id, 'pop' AS op, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id UNION ALL SELECT page_id, 'push', count(*)::BIGINT FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id")
def open_element_events(spark, sf_dir):
    found = X.parse(pages(spark, sf_dir), facets=(H.OPEN,)).select("page_id", F.inline_outer("p.open_events"))
    return found.where("name = 'li'").groupBy("page_id", "op").agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<!DOCTYPE|<!--'))::BIGINT AS n_marks, len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[a-z]'))::BIGINT AS n_article FROM pages""")
def token_counts(spark, sf_dir):
    """The tokenizer alone, from the data state; script text is markup to it, so counts are of what stands elsewhere."""
    found = X.spread(pages(spark, sf_dir)).select("page_id", H.html_tokenize(DATA)("html").alias("t"))
    at = lambda kind, name: F.array_position(F.transform("t", lambda x: F.concat(x["type"], F.lit(" "), F.coalesce(x["name"], F.lit("")))), f"{kind} {name}")
    inside = F.slice("t", (at("start", "article") + 1).cast("int"), (at("end", "article") - at("start", "article") - 1).cast("int"))
    count = lambda a, *kinds: F.size(F.filter(a, lambda x: x["type"].isin(*kinds))).cast("long")
    return found.select("page_id", count(F.col("t"), "comment", "doctype").alias("n_marks"), count(inside, "start").alias("n_article"))


# --- over documents -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;') AS value FROM documents")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.escape_text("text").alias("value"))


@query("""SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;'), '"', '&quot;') AS value FROM documents""")
def escape_attr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.escape_attribute("text").alias("value"))


@query("""SELECT doc_id, '<html><head></head><body><pre>' || chr(10) || replace(replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;') || '</pre></body></html>' AS html FROM documents""")
def plain_text_doc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.plain_text_document("text").alias("html"))


@query("SELECT doc_id, text AS value FROM documents")
def unescape_escaped(spark, sf_dir):
    docs = X.spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", H.html_unescape(H.escape_text("text")).alias("value"))


# --- cases ----------------------------------------------------------------------------------------------------------------


def _filled(template: str, name: Column) -> Column:
    parts = template.split("{n}")
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [name, F.lit(part)]
    return F.concat(*pieces)


def _sql(text: str) -> str:
    """A string literal; control characters by chr()."""
    out, plain = [], ""
    for c in text:
        if ord(c) < 32 or c == "�":
            out += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return " || ".join([*out, f"'{plain}'"])


def _sql_filled(template: str) -> str:
    return "(" + " || n_name || ".join(_sql(p) for p in template.split("{n}")) + ")"


def _inputs(spark, sf_dir, inputs: list[str]) -> DataFrame:
    """key and html: each input filled with each nation's name."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), _filled(x, F.col("n_name")).alias("html")) for k, x in enumerate(inputs)])
    found = table(spark, sf_dir, "nation").select("n_nationkey", F.inline(rows))
    return found.select((F.col("n_nationkey").cast("long") * 100 + F.col("k")).alias("key"), "html")


def _outputs(outputs: list[str], column: str) -> str:
    return " UNION ALL ".join(f"SELECT n_nationkey::BIGINT * 100 + {k} AS key, {_sql_filled(x)} AS {column} FROM nation" for k, x in enumerate(outputs))


def _case(name: str, inputs: list[str], outputs: list[str], **options) -> None:
    def run(spark, sf_dir):
        return X.serialized(_inputs(spark, sf_dir, inputs), "key", **options)

    QUERIES[name] = run
    ORACLES[name] = _outputs(outputs, "html")


for _name, _cases in cases.BODIES.items():
    _case(_name, [cases.START + a for a, _ in _cases], [cases.START + cases.BETWEEN + b + cases.FINISH for _, b in _cases])
for _name, _cases in cases.DOCUMENTS.items():
    _case(_name, [a for a, _ in _cases], [b for _, b in _cases])
for _name, (_context, _cases) in cases.FRAGMENTS.items():
    _case(_name, [a for a, _ in _cases], [b for _, b in _cases], context=_context)
_off = cases.NO_SCRIPTING
_case("noscript_scripting_off", [cases.START + a for a, _ in _off["noscript_scripting_off"]], [cases.START + cases.BETWEEN + b + cases.FINISH for _, b in _off["noscript_scripting_off"]], scripting=False)
_case("noscript_in_head", [a for a, _ in _off["noscript_in_head"]], [b for _, b in _off["noscript_in_head"]], scripting=False)


@query(_outputs(["<html><head></head><body><script>w{n}</script><p>{n}</p>z</body></html>"], "html"))
def document_write(spark, sf_dir):
    """The script hook: what it returns is parsed where the script ends."""
    hook = lambda script: f"<p>{script.children[0].value[1:]}</p>"
    return X.serialized(_inputs(spark, sf_dir, ["<body><script>w{n}</script>z"]), "key", on_script=hook)


def _doctype_rows(spark, sf_dir, doctypes: list[tuple]) -> DataFrame:
    """key, name, public_id, system_id: each doctype beside each nation; in ids, {n} is its name."""
    text = lambda x: F.lit(None).cast("string") if x is None else _filled(x, F.col("n_name"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), text(n).alias("name"), text(p).alias("public_id"), text(s).alias("system_id")) for k, (n, p, s, *_) in enumerate(doctypes)])
    found = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.inline(rows))
    return found.select((F.col("n_nationkey").cast("long") * 100 + F.col("k")).alias("key"), "name", "public_id", "system_id")


_MODES = _outputs([mode for *_, mode in cases.DOCTYPES], "mode")


@query(_MODES)
def doctype_modes(spark, sf_dir):
    return _doctype_rows(spark, sf_dir, cases.DOCTYPES).select("key", H.doctype_mode("name", "public_id", "system_id").alias("mode"))


@query(_MODES)
def doctype_modes_parsed(spark, sf_dir):
    rows = _doctype_rows(spark, sf_dir, cases.DOCTYPES).withColumn("d", H.doctype_data("name", "public_id", "system_id")).select("key", F.concat(F.lit("<!"), F.expr("substring(d, 2)"), F.lit(">")).alias("html"))
    return X.modes(rows, "key")


@query(_outputs([code for _, code in cases.ERRORS], "code"))
def error_codes(spark, sf_dir):
    found = X.errors(_inputs(spark, sf_dir, [a for a, _ in cases.ERRORS]), "key")
    return found.select("key", "code").distinct()


def _all_codes(found: list) -> str:
    return " UNION ALL ".join(f"SELECT n_nationkey::BIGINT * 100 + {k} AS key, '{code}' AS code FROM nation" for k, (_, codes) in enumerate(found) for code in codes)


@query(_all_codes(cases.MORE_ERRORS))
def error_codes_doctypes(spark, sf_dir):
    return X.errors(_inputs(spark, sf_dir, [a for a, _ in cases.MORE_ERRORS]), "key").select("key", "code").distinct()


@query(_all_codes(cases.NOSCRIPT_ERRORS))
def error_codes_noscript(spark, sf_dir):
    return X.errors(_inputs(spark, sf_dir, [a for a, _ in cases.NOSCRIPT_ERRORS]), "key", scripting=False).select("key", "code").distinct()


@query(_outputs([b for _, b in cases.EVENTS], "events"))
def events_foreign(spark, sf_dir):
    """Names that events give tags in foreign content, and where it ends."""
    found = X.spread(_inputs(spark, sf_dir, [a for a, _ in cases.EVENTS])).select("key", H.html_events(locations=False)("html").alias("t"))
    return found.select("key", F.array_join(F.transform("t", lambda e: F.concat_ws(" ", e["type"], F.coalesce(e["name"], e["text"]))), "|").alias("events"))


@query(_outputs(["xlink|href|http://www.w3.org/1999/xlink|{n}", "|viewBox||{n}", "|definitionURL||{n}"], "attr"))
def events_foreign_attributes(spark, sf_dir):
    inputs = ["<svg><a xlink:href='{n}'>", "<svg viewbox='{n}'>", "<math definitionurl='{n}'>"]
    found = X.events(_inputs(spark, sf_dir, inputs), "key").select("key", F.inline("attrs"))
    return found.select("key", F.concat_ws("|", F.coalesce("prefix", F.lit("")), "name", F.coalesce("namespace", F.lit("")), "value").alias("attr"))


@query(_outputs(cases.KEPT, "html"))
def rewritten_keeps_source(spark, sf_dir):
    """Without a rule the source stays byte for byte."""
    return X.rewritten(_inputs(spark, sf_dir, cases.KEPT), lambda e: F.lit(None).cast("string"), "key")


@query(_outputs(["<pre>\n#</pre>", "<b></>#", "<p>#</p"], "html"))
def rewritten_text(spark, sf_dir):
    """A rule for text; what stands between events stays."""
    return X.rewritten(_inputs(spark, sf_dir, ["<pre>\n{n}</pre>", "<b></>{n}", "<p>{n}</p"]), lambda e: F.when(e["type"] == "text", F.when(F.startswith(e["text"], F.lit("\n")), "\n#").otherwise("#")), "key")


@query(_outputs(['<!DOCTYPE html PUBLIC "{n}">', '<!DOCTYPE html SYSTEM "{n}">', '<!DOCTYPE html PUBLIC "a" "{n}">', "<!DOCTYPE null>{n}"], "html"))
def render_doctypes(spark, sf_dir):
    """Doctypes written anew."""
    inputs = ["<!doctype html public '{n}'>", "<!doctype html system '{n}'>", "<!doctype html public 'a' '{n}'>", "<!doctype>{n}"]
    return X.rewritten(_inputs(spark, sf_dir, inputs), lambda e: F.when(e["type"] == "doctype", H.render_event(e)), "key")


_CONFORMING = [("html", None, None, True), ("html", None, "about:legacy-compat", True), ("html", None, "{n}", False), ("html", "{n}", None, False), (None, None, None, False)]


@query(" UNION ALL ".join(f"SELECT n_nationkey::BIGINT * 100 + {k} AS key, {str(x[3]).lower()} AS mode FROM nation" for k, x in enumerate(_CONFORMING)))
def doctype_conforming(spark, sf_dir):
    return _doctype_rows(spark, sf_dir, _CONFORMING).select("key", H.doctype_conforming("name", "public_id", "system_id").alias("mode"))


@query("SELECT n_nationkey, 'a�' || n_name AS nul_replaced, translate(n_name || 'É', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, n_nationkey % 2 = 0 AS void FROM nation")
def text_functions(spark, sf_dir):
    tag = F.when(F.col("n_nationkey") % 2 == 0, "br").otherwise("b")
    return table(spark, sf_dir, "nation").select("n_nationkey", H.replace_nul(F.concat(F.lit("a\0"), "n_name")).alias("nul_replaced"), H.ascii_lower(F.concat("n_name", F.lit("É"))).alias("lowered"), H.is_void(tag).alias("void"))


@query("""SELECT p AS point, p IN (9, 10, 12, 32) AS white, chr(p::INTEGER) SIMILAR TO '[0-9]' AS digit, chr(p::INTEGER) SIMILAR TO '[A-Za-z]' AS letter, chr(p::INTEGER) SIMILAR TO '[0-9A-Fa-f]' AS hex_digit,
    p BETWEEN 1 AND 8 OR p = 11 OR p BETWEEN 14 AND 31 OR p BETWEEN 127 AND 159 AS control, p BETWEEN 64976 AND 65007 OR p IN (65534, 65535) AS nonchar, coalesce(n, 0)::BIGINT AS n_documents FROM (SELECT unnest(range(1, 55296)) AS p UNION ALL SELECT unnest(range(57344, 66000)))
    LEFT JOIN (SELECT unicode(c) AS u, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(text, ''))) AS c FROM documents) GROUP BY u) ON p = u""")
def character_classes(spark, sf_dir):
    """Of each character, its classes, and in how many documents it stands."""
    held = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''")
    counts = held.groupBy("c").agg(F.count("*").alias("n_documents")).select(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long").alias("u"), "n_documents")
    points = spark.range(1, 55296).union(spark.range(57344, 66000)).withColumnRenamed("id", "point")
    points = points.join(counts, F.col("point") == F.col("u"), "left")
    return points.select("point", H.is_white_space("point").alias("white"), H.is_ascii_digit("point").alias("digit"), H.is_ascii_letter("point").alias("letter"), H.is_ascii_hex_digit("point").alias("hex_digit"), H.is_control("point").alias("control"), H.is_noncharacter("point").alias("nonchar"), F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))


@query(_outputs(["{n}", "<b>{n}</b>", "é"], "part"))
def raw_slices(spark, sf_dir):
    """Slices by UTF-16 offsets, behind characters beyond U+FFFF."""
    rows = _inputs(spark, sf_dir, ["😀<p>{n}", "😀<p><b>{n}</b>", "😀😀<i>é"])
    nodes = X.nodes(rows, "key", locations=True).where("sib_idx = 0 and depth = 4 and (key % 100 <> 1 or name = 'b')").select(F.col("key").alias("k"), "loc")
    return rows.join(nodes, F.col("key") == F.col("k")).select("key", H.raw_slice("html", F.col("loc.start_offset"), F.col("loc.end_offset")).alias("part"))


@query(_outputs(["{n}|b", "<p a=\"&{n}\">", "&lt;{n}&gt;", "<!--{n}-->", "</{n}>"], "html"))
def render_events(spark, sf_dir):
    """Markup written anew from events, by a native expression."""
    kinds = "struct<type:string,name:string,text:string,attrs:array<struct<name:string,value:string,prefix:string,namespace:string>>,self_closing:boolean,public_id:string,system_id:string,last_start_tag:string>"
    made = lambda **x: F.struct(*[x.get(k, F.lit(None)).alias(k) for k in ("type", "name", "text", "attrs", "self_closing", "public_id", "system_id", "last_start_tag")]).cast(kinds)
    n, s = F.col("n_name"), F.lit
    attrs = F.array(F.struct(s("a").alias("name"), F.concat(s("\""), n).alias("value"), s(None).cast("string").alias("prefix"), s(None).cast("string").alias("namespace")))
    rows = [
        made(type=s("text"), text=F.concat(n, s("|b")), last_start_tag=s("p")),
        made(type=s("start"), name=s("p"), attrs=attrs, self_closing=s(False)),
        made(type=s("text"), text=F.concat(s("<"), n, s(">")), last_start_tag=s("p")),
        made(type=s("comment"), text=n),
        made(type=s("end"), name=n),
    ]
    found = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*rows)).alias("k", "e"))
    return found.select((F.col("n_nationkey").cast("long") * 100 + F.col("k")).alias("key"), F.replace(H.render_event(F.col("e")), F.lit("&quot;"), F.lit("&")).alias("html"))


@query("SELECT page_id AS doc_id, true AS complete, length(html)::BIGINT AS n FROM pages")
def stream_assembled(spark, sf_dir):
    """Chunks through Structured Streaming: state until a document is whole."""
    at = f"{_shared(spark)}/{uuid.uuid4().hex}"
    _cut(pages(spark, sf_dir)).repartition(4, "seq").write.parquet(f"{at}/in")
    found = C.take(C.assemble_stream(S.read_chunks(C.streaming_session(spark), f"{at}/in", streaming=True)), at)
    return found.select("doc_id", "complete", F.length("html").cast("long").alias("n"))


@query("""SELECT page_id AS doc_id, len(regexp_extract_all(a, '<p>'))::BIGINT AS n_paragraphs, len(regexp_extract_all(a, '<a href'))::BIGINT AS n_links, NOT contains(a, '<body') AS bare
    FROM (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS a FROM pages)""")
def fragments_from_pieces(spark, sf_dir):
    """The articles of pages as fragments that arrive in pieces."""
    articles = pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("html"))
    found = C.assemble_fragments(_cut(articles, 300), "article")
    count = lambda name: F.size(X.elements(F.col("p.nodes"), name)).cast("long")
    return found.select("doc_id", count("p").alias("n_paragraphs"), count("a").alias("n_links"), (count("body") == 0).alias("bare"))


def _late_stream(spark, sf_dir) -> DataFrame:
    """Pages in pieces, through three runs of one stream that goes on from its checkpoint. By page_id % 6: 1 sends each piece
    again in the second run, 2 its first piece only then, 3 its last one in the third, when the watermark has passed; 4 loses
    its second piece; 5 repeats what is long whole. Each run's last row only moves the watermark."""
    at, session = f"{_shared(spark)}/{uuid.uuid4().hex}", C.streaming_session(spark)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    pieces = _cut(pages(spark, sf_dir)).withColumn("at", start + F.make_dt_interval(secs=F.col("seq")))
    kind, seq, last = F.pmod("doc_id", F.lit(6)), F.col("seq"), F.col("is_last")
    runs = [
        (~((kind == 2) & (seq == 0) | (kind == 3) & last | (kind == 4) & (seq == 1)), 0),
        ((kind == 1) | (kind == 2) & (seq == 0), 1),
        ((kind == 3) & last | (kind == 5), 24),
    ]
    for sent, hour in runs:
        tick = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in pieces.dtypes if c != "at"), (start + F.make_dt_interval(hours=F.lit(hour))).alias("at"))
        pieces.where(sent).unionByName(tick).write.mode("append").parquet(f"{at}/in")
        found = C.take(C.assemble_events(S.read_chunks(session, f"{at}/in", streaming=True, timed=True)), at)
    return spark.read.schema(found.schema).parquet(f"{at}/out")


_NUMBERED = "(SELECT page_id, html, page_id % 6 AS k, (length(html) - 1) // 700 + 1 AS n FROM pages)"


@query(f"""SELECT page_id AS doc_id, n = 1 OR k NOT IN (3, 4) AS complete, CASE WHEN n = 1 OR k NOT IN (3, 4) THEN html WHEN k = 3 THEN substr(html, 1, ((n - 1) * 700)::BIGINT) ELSE substr(html, 1, 700) || substr(html, 1401) END AS html
    FROM {_NUMBERED} WHERE n > 1 OR k <> 3""")
def stream_late_pieces(spark, sf_dir):
    """Repeated, late and lost pieces: what each document came to."""
    return _late_stream(spark, sf_dir).select("doc_id", "complete", "html")


@query(f"SELECT page_id AS doc_id, (CASE k WHEN 3 THEN n - 1 ELSE 1 END)::BIGINT AS gap_first, CASE WHEN k = 4 AND n > 2 THEN 1::BIGINT END AS gap_last FROM {_NUMBERED} WHERE n > 1 AND k IN (3, 4)")
def stream_gaps(spark, sf_dir):
    """The ranges of pieces that never came, or came behind the watermark."""
    return C.gap_table(_late_stream(spark, sf_dir))
