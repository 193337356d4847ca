"""The structural join against a plain one, on random trees, long and deep documents."""

import random
import time

import pyarrow as pa
import pytest

from tagweft.operators import structural
from tagweft.operators import tables as X

NODES = "page_id string, node_id int, subtree_end int, name string, ancestor string"


def tree(rng, n):
    """(node_id, subtree_end) of a random tree in document order."""
    parents = [-1] + [rng.randrange(max(0, k - rng.choice([1, 2, 9])), k) for k in range(1, n)]
    for k in range(1, n):  # a parent must be open still
        above, p = [], k - 1
        while p >= 0:
            above.append(p)
            p = parents[p]
        parents[k] = rng.choice(above[: 1 + rng.randrange(len(above))])
    ends = list(range(n))
    for k in range(n - 1, 0, -1):
        ends[parents[k]] = max(ends[parents[k]], ends[k])
    return list(enumerate(ends))


@pytest.mark.parametrize("block,pairs", [(1 << 16, 1 << 19), (7, 3)])
def test_against_a_plain_join(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(structural, "BLOCK", block)
    monkeypatch.setattr(structural, "PAIRS", pairs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        rng = random.Random(block)
        rows = [(f"p{k}", i, e, rng.choice("ab"), "x") for k, n in enumerate([1, 2, 40, 60, 3]) for i, e in tree(rng, n)] + [(None, 0, 5, "a", "x"), (None, 1, 1, "b", "x")]
        nodes = spark.createDataFrame(rows, NODES)
        for above, below in (("a", "b"), ("a", "ab"), ("ab", "ab"), ("", "a"), ("a", "")):
            got = X.descendants(nodes.where(nodes.name.isin(*above)), nodes.where(nodes.name.isin(*below)))
            assert got.columns == ["page_id", "ancestor_id", "node_id", "subtree_end", "name", "ancestor"]
            expected = [(p, i, j, f, m, "x") for p, i, e, n, _ in rows for q, j, f, m, _ in rows if p == q and p is not None and n in above and m in below and i < j <= e]
            assert sorted(map(tuple, got.collect())) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_linear_on_a_long_page(spark):
    """100,000 pairs of one page: a join with a residual would look at 10,000,000,000."""
    n = 100_000
    nodes = spark.range(n).selectExpr("1L AS page_id", "cast(2 * id AS int) AS node_id", "cast(2 * id + 1 AS int) AS subtree_end")
    inner = spark.range(n).selectExpr("1L AS page_id", "cast(2 * id + 1 AS int) AS node_id", "id AS payload")
    started = time.perf_counter()
    row = X.descendants(nodes, inner).selectExpr("count(*) AS n", "sum(ancestor_id) AS a", "count_if(payload * 2 = ancestor_id) AS same").first()
    assert (row.n, row.a, row.same) == (n, n * (n - 1), n) and time.perf_counter() - started < 60


def test_the_stack_is_what_is_open():
    own = structural.Merge()
    kind = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("last", pa.int64())])
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
    found = lambda b: [(int(a), int(r)) for x, y in own.pairs(b) for a, r in zip(x, y)]
    assert found(batch((1, 0, 0, 9), (1, 0, 1, 2), (1, 0, 2, None))) == [(0, 2), (1, 2)]
    assert own.open.tolist() == [[0, 9]]
    assert found(batch((1, 0, 5, None), (1, 1, 70000, None))) == [(0, 0)] and not len(own.open)
    assert found(batch((2, 1, 70001, None))) == []


def test_blocks_hold_what_is_open_in_them(spark):
    """A node is dealt to the blocks that its interval meets, not to more."""
    rows = [(1, 0, 4 * structural.BLOCK), (1, structural.BLOCK + 5, structural.BLOCK + 6)]
    nodes = spark.createDataFrame(rows, "page_id long, node_id int, subtree_end int")
    below = spark.createDataFrame([(1, structural.BLOCK * k + 6) for k in range(4)], "page_id long, node_id int")
    got = sorted((r.ancestor_id, r.node_id) for r in X.descendants(nodes, below).collect())
    assert got == sorted([(0, structural.BLOCK * k + 6) for k in range(4)] + [(structural.BLOCK + 5, structural.BLOCK + 6)])
