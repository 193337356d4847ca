"""Digests of subtrees and sets of trees against plain versions over nested tuples."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tagweft.operators import tables as X
from tagweft.operators import trees

PAGES = "page_id long, html string"


def plain(rows):
    """node_id -> nested tuple of a document's node rows."""
    built = {}
    for r in sorted(rows, key=lambda r: -r.node_id):
        children = sorted((c for c in rows if c.parent_id == r.node_id), key=lambda c: c.sib_idx)
        attrs = tuple(sorted((a.name, a.value, a.prefix, a.namespace) for a in r.attrs or ()))
        built[r.node_id] = (r.node_type, r.name, r.namespace, r.value, r.public_id, r.system_id, attrs, tuple(built[c.node_id] for c in children))
    return built


def by_page(nodes):
    rows = {}
    for r in nodes.collect():
        rows.setdefault(r.page_id, []).append(r)
    return {k: plain(v) for k, v in rows.items()}


def random_pages(seed, n):
    rng = random.Random(seed)
    part = lambda d: rng.choice(["x", "y", "<!--c-->"]) if d == 0 or rng.random() < 0.3 else f"<{(t := rng.choice(['div', 'i', 'ul']))}{rng.choice(['', ' a=1 b=2', ' b=2 a=1'])}>{''.join(part(d - 1) for _ in range(rng.randint(0, 3)))}</{t}>"
    return [(k, "".join(part(4) for _ in range(3))) for k in range(n)]


def test_digests_are_equal_for_equal_subtrees(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        nodes = X.nodes(spark.createDataFrame(random_pages(1, 30), PAGES)).cache()
        built = by_page(nodes)
        rows = trees.subtrees(nodes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == sum(map(len, built.values()))
    pairs = {(bytes(r.digest), built[r.page_id][r.node_id]) for r in rows}
    assert len(pairs) == len({d for d, _ in pairs}) == len({t for _, t in pairs}) > 100
    found = {bytes(r.digest): (r.n_places, r.n_documents) for r in trees.recurring(trees.subtrees(nodes), least=1).collect()}
    places = Counter(t for p in built.values() for t in p.values())
    documents = Counter(t for p in built.values() for t in set(p.values()))
    assert found == {d: (places[t], documents[t]) for d, t in pairs if places[t] > 1}


def test_sets_and_changes(spark):
    old, new = (random_pages(2, 12) for _ in range(2))
    rng = random.Random(3)
    new = [(k, h.replace("x", "z", 1) if rng.random() < 0.5 else h.replace("<i>", "<u>", 1).replace("</i>", "</u>", 1)) for k, h in new]
    a, b = (X.nodes(spark.createDataFrame(p, PAGES)).cache() for p in (old, new))
    (left, right), (x, y) = map(by_page, (a, b)), map(trees.subtrees, (a, b))
    ca, cb = (Counter((k, t) for k, p in side.items() for t in p.values()) for side in (left, right))
    total = lambda df: {(r.page_id, r.n_nodes): r.n for r in df.groupBy("page_id", "n_nodes").agg(F.sum("n").alias("n")).collect()}
    size = lambda t: 1 + sum(map(size, t[-1]))

    def expected(counts):
        out = Counter()
        for (k, t), n in counts.items():
            out[k, size(t)] += n
        return dict(out)

    assert total(trees.union(x, y, "page_id")) == expected(ca | cb)
    assert total(trees.intersection(x, y, "page_id")) == expected(ca & cb)
    assert total(trees.difference(x, y, "page_id")) == expected(ca - cb)
    got = sorted((r.page_id, r.side, r.node_id) for r in trees.changes(x, y).collect())
    parted = sorted((k, side, i) for side, own, other in (("old", left, right), ("new", right, left)) for k in own for i, t in own[k].items() if t not in other[k].values() and all(c in other[k].values() for c in t[-1]))
    assert got == parted and got


def test_a_deep_document(spark):
    deep = "<i>" * 3000
    nodes = X.nodes(spark.createDataFrame([(1, deep), (2, deep + "x"), (None, "x")], PAGES))
    found = trees.subtrees(nodes).where("page_id = 1 AND name = 'i'")
    assert found.select("digest").distinct().count() == 3000
    assert trees.subtrees(nodes.where("false")).count() == 0
