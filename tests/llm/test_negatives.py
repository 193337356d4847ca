"""Hard negatives against SQL and a plain version."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweft.llm import negatives, queries

KIND = "vec_id long, embedding array<float>, label int, block int, uid string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def slow(rows, k=5, m=3):
    fit = [(i, [math.floor(256 * x) for x in np.float32(v).astype(float).tolist()], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, l) in enumerate(fit):
        if i % 50:
            continue
        scored = [(-sum(map(int.__mul__, q, r)), j, other == l) for b, (j, r, other) in enumerate(fit) if b != a]
        for s, p, _ in sorted(x for x in scored if x[2])[:k]:
            window = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(window[:m], 1)]
    return sorted(out)


def vectors(rng, n, dimensions, labels):
    centres = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.6) for c in rng.choice(centres)], rng.choice(labels)) for i in range(n)]


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], KIND)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(df, F.col("vec_id") % 50 == 0, label)
    assert found.columns == NAMES
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("sizes", [(4096, 256, 16, 32), (40, 3, 2, 3)])
def test_against_a_plain_version(spark, monkeypatch, sizes):
    for name, x in zip(("ROWS", "ANCHORS", "PANEL", "WIDTH"), sizes):
        monkeypatch.setattr(negatives, name, x)
    monkeypatch.setattr(negatives, "WINDOWS", 4)
    rng = random.Random(1)
    rows = vectors(rng, 700, 8, [0, 0, 0, 0, 1, 2, 3])
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[51][1], 2), (3, rows[3][1], rows[3][2])] * 2  # rows that repeat, an id twice
    rows += [(None, rows[0][1], 1), (800, None, 1), (850, [1.0, None], 1), (900, [float("nan")] * 8, 1), (950, [float("inf")] * 8, 1), (1000, rows[0][1], None)]
    rows += [(1050, [], 1), (1051, [0.5, 0.25], 1), (1100, [0.1] * 8, 9)]
    padded = [(i, v + [0.0] * (8 - len(v)) if v is not None and None not in v else v, l) for i, v, l in rows]
    got = mined(spark, rows)
    assert got == slow(padded) and len(got) > 100


def test_ties(spark):
    rows = [(i, [1.0 if i % 3 else 0.8, 0.0], i % 2) for i in range(130)]
    assert mined(spark, rows) == slow(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(50, None, 1)]) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_components_that_are_too_large_take_no_part(spark):
    rows = vectors(random.Random(2), 150, 4, [0, 1])
    assert mined(spark, rows + [(50, [3e38] * 4, 0), (51, [-3e38] * 4, 1), (52, [1e6] * 4, 1)]) == slow(rows)


def test_product_is_exact_beyond_floating_point():
    rng = np.random.default_rng(0)
    for largest in (10, 1 << 28):
        a, b = rng.integers(-largest, largest, (5, 32)), rng.integers(-largest, largest, (7, 32))
        assert negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_best_takes_equal_scores_by_column():
    rng = np.random.default_rng(0)
    for k, n in itertools.product((1, 3), (1, 2, 9)):
        scores, allowed = rng.integers(0, 3, (20, n)), rng.random((20, n)) < 0.7
        row, column = negatives.best(scores, allowed, k)
        expected = [(r, c) for r in range(20) for c in sorted((c for c in range(n) if allowed[r, c]), key=lambda c: (-scores[r, c], c))[:k]]
        assert list(zip(row.tolist(), column.tolist())) == expected


def test_tiles_are_packed_whole():
    tile = np.array([[0, -1, 2**62], [-(2**62), 255, 256]])
    assert (negatives._expanded(negatives._squeezed(tile), 2, 3) == tile).all()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = con.sql(f"SELECT {', '.join(NAMES)} FROM ({queries.ORACLES['op13_negatives']})").fetchall()
    assert sorted(map(tuple, queries.op13_negatives(spark, sf).collect())) == sorted(expected) and expected


def test_tiles_are_not_shuffled(spark, monkeypatch):
    """Panels are shuffled, of which there are more than one of either side here; their products are not."""
    for name, x in (("ROWS", 32), ("ANCHORS", 8), ("PANEL", 1)):
        monkeypatch.setattr(negatives, name, x)
    rows = [(10 * i, v, label) for i, v, label in vectors(random.Random(3), 300, 40, [0, 1, 2])]
    assert negatives._panels(8, 10) == (2, 10)
    got = mined(spark, rows)
    assert got == slow(rows) and got
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], KIND)
    plan = negatives.mine(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().analyzed().toString()
    assert "multiply" in plan and "tile" not in plan


@pytest.mark.parametrize("windows", [1, 4])
def test_windows_of_a_tile(monkeypatch, windows):
    monkeypatch.setattr(negatives, "WINDOWS", windows)
    rng = np.random.default_rng(4)
    for unit, low, high in ((100, 50, 95), (7, 3, 9)):
        n, m = 6, 40
        scores, labels, own = rng.integers(-20, 60, (n, m)), rng.integers(0, 3, m), rng.integers(0, 3, n)
        asked = [(i, j, 0, int(rng.integers(-10, 80))) for i in range(n) for j in range(5)]
        numbers = {"anchor_block": 0, "ids": np.arange(m), "labels": labels, "anchor_ids": np.arange(n), "anchor_labels": own, "windows": negatives._numbers(np.array(asked))}
        found = negatives._negatives(numbers, scores, 3, (unit, low, high)).to_pydict()
        expected = []
        for i, j, _, s in asked:
            fit = sorted((-int(x), c) for c, x in enumerate(scores[i]) if labels[c] != own[i] and low * s <= unit * x <= high * s)
            expected += [(i, j, c, -x) for x, c in fit[:3]]
        assert sorted(zip(found["row"], found["place"], found["negative_id"], found["negative_score"])) == sorted(expected) and expected
