"""Hard negatives by a two-dimensional block matrix product, in the manner of SUMMA.

Anchors times rows is a product of two matrices, cut in both directions and along the dimensions. Rows are dealt to blocks by
their label and a salt (a label of any size is cut into blocks of about ROWS), anchors likewise to blocks of about ANCHORS,
and vectors into chunks of WIDTH dimensions. A cell of the grid is a panel of anchor blocks and a panel of row blocks. The panels
are what is shuffled; a tile, the product of two blocks, stays in its cell: it is added up chunk by chunk and gives only its
best candidates, which are reduced over the tiles of an anchor.

Two passes make up the product. The first takes the tiles in which labels meet and yields each anchor's positives; the second
takes the tiles in which labels differ and yields, for each anchor and positive, the best rows whose score lies in its
window. A cell holds PANEL * ROWS rows of either side at most, compressed, and two blocks and one tile besides, whatever the table.
What is shuffled is each row once for every so many anchors, and each anchor once for every so many rows or, where that makes
fewer, CELLS times. The product of anchors and rows is what is asked for; no pair of blocks is left out.

Rows with a null id, label, vector or component, or a component that isn't finite, take no part, and neither do rows whose
scaled components are so large that scores would not fit 64 bits (some 26 million for 64 dimensions). Vectors that are shorter than the
longest count as filled up with zeros. Equal scores go by id. Repeated rows are rows of their own: each may be an anchor, a
positive or a negative. Tables without rows or anchors give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import stored

#: Rows of a block of either side, row blocks of a panel (and as many anchors), dimensions of a chunk.
ROWS, ANCHORS, PANEL, WIDTH = 4096, 256, 16, 32
#: Cells that a smaller product is cut into, if there are so many row blocks.
CELLS = 32
#: Groups of labels whose rows share no block, at most.
LABEL_GROUPS = 64
#: Windows that are compared with whole rows of a tile at a time, or more of them with parts of rows.
WINDOWS = 256
#: Components from here on don't fit 64 bits once scaled.
LARGEST = 2.0**54
LEAST = np.iinfo(np.int64).min
BLOCK = "block int, held array<long>, uids binary, ids binary, labels binary, chunks array<binary>"


def quantised(rows: DataFrame, label: Column) -> DataFrame:
    """uid, vec_id, label, q (the scaled components) of the rows that take part. uid tells rows of one id apart."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    found = rows.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit)
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x))
    return found.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("q"))


def _numbers(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _squeezed(tile: np.ndarray) -> bytes:
    """An int64 matrix, compressed by planes of bytes: the upper ones are mostly signs."""
    planes = np.ascontiguousarray(tile.astype("<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="lz4", asbytes=True)


def _expanded(raw: bytes, rows: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * rows * columns, codec="lz4", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(rows, columns)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two int64 matrices: in floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, equal ones by column."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shown = np.where(allowed, scores, LEAST)
    if shown.shape[1] > k:
        least = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k, None]
        allowed = allowed & (scores >= least)
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


def _blocks(rows: DataFrame, count: int, size: int, dimensions: int) -> DataFrame:
    """A row a block of about `size` rows, in order of id. Rows of one group of labels are dealt by salt; the numbers of rows
    of the groups (LABEL_GROUPS at most) are all that the driver sees."""
    groups = max(1, min(LABEL_GROUPS, count // size))
    group = F.pmod(F.hash("label"), F.lit(groups))
    parts = {r.g: math.ceil(r.n / size) for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    first, before = {}, 0
    for g in sorted(parts):
        first[g], before = before, before + parts[g]
    at = lambda known: F.element_at(F.create_map(*[F.lit(int(x)) for e in (known or {0: 1}).items() for x in e]), group)
    dealt = rows.withColumn("block", (at(first) + F.pmod(F.xxhash64("uid"), at(parts)).cast("int")).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids, uids, labels = (table.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
        order = np.lexsort((uids, ids))
        vectors = table.column("q").combine_chunks()
        matrix = np.zeros((len(ids), max(1, math.ceil(dimensions / WIDTH)) * WIDTH), np.int64)
        sizes = np.diff(vectors.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), sizes)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
        matrix = matrix[order]
        chunks = [_squeezed(matrix[:, i : i + WIDTH]) for i in range(0, matrix.shape[1], WIDTH)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())), **{c: pa.array([_numbers(x[order])], pa.binary()) for c, x in (("uids", uids), ("ids", ids), ("labels", labels))}, "chunks": pa.array([chunks], pa.list_(pa.binary()))})

    return stored(dealt.groupBy("block").applyInArrow(pack, BLOCK))


def _panels(anchor_blocks: int, row_blocks: int) -> tuple[int, int]:
    """How many panels anchor blocks and row blocks are dealt to."""
    p = max(1, math.ceil(anchor_blocks / max(1, PANEL * ROWS // ANCHORS)))
    return p, max(1, math.ceil(row_blocks / PANEL), min(row_blocks, math.ceil(CELLS / p)))


def _candidates(anchors: DataFrame, rows: DataFrame, panels: tuple[int, int], same: bool, give: Callable[[dict, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What `give` makes of (the numbers of both blocks, the scores) of each tile where labels meet (same), or of each where they
    differ."""
    p, q = panels
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["block", "held", "uids", "ids", "labels", "chunks"]
    left = anchors.select(F.pmod("block", F.lit(p)).alias("p"), every(q).alias("q"), *names, "windows", F.lit(True).alias("anchor"))
    right = rows.select(every(p).alias("p"), F.pmod("block", F.lit(q)).alias("q"), *names, F.lit(None).cast("binary").alias("windows"), F.lit(False).alias("anchor"))

    def chunks(block: dict) -> list[np.ndarray]:
        return [_expanded(x, len(block["ids"]) // 8, WIDTH) for x in block["chunks"]]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = [r for batch in batches for r in batch.to_pylist()]
        for y in (r for r in cell if not r["anchor"]):
            asking = [r for r in cell if r["anchor"] and (set(r["held"]) & set(y["held"]) if same else len({*r["held"], *y["held"]}) > 1)]
            panel = chunks(y) if asking else []
            for x in asking:
                tile = sum(map(product, chunks(x), panel))
                yield give({"anchor_block": x["block"], **{c: _read(y[c]) for c in ("uids", "ids", "labels")}, **{f"anchor_{c}": _read(x[c]) for c in ("uids", "ids", "labels")}, "windows": x["windows"]}, tile)

    # as many tasks as cells: a cell is few bytes and much work
    return left.unionByName(right).repartition(p * q, "p", "q").groupBy("p", "q").applyInArrow(multiply, schema)


def _positives(numbers: dict, scores: np.ndarray, k: int) -> pa.RecordBatch:
    row, column = best(scores, (numbers["anchor_labels"][:, None] == numbers["labels"]) & (numbers["anchor_uids"][:, None] != numbers["uids"]), k)
    found = {"anchor_block": pa.array(np.full(len(row), numbers["anchor_block"]), pa.int32()), "row": pa.array(row, pa.int32()), "positive_id": pa.array(numbers["ids"][column], pa.int64()), "score": pa.array(scores[row, column], pa.int64())}
    return pa.RecordBatch.from_pydict(found)


def _negatives(numbers: dict, scores: np.ndarray, k: int, window: tuple[int, int, int]) -> pa.RecordBatch:
    ids, labels, anchor_ids, anchor_labels = (numbers[c] for c in ("ids", "labels", "anchor_ids", "anchor_labels"))
    row, place, positive, score = _read(numbers["windows"] or b"").reshape(-1, 4).T
    unit, low, high = window
    least, most = -(-low * score // unit), high * score // unit
    # of an anchor, whatever is below the k best up to its lowest window's end is in no window's answer
    shape = len(scores), 1
    ends, first, last = np.full(shape, LEAST), np.full(shape, -(LEAST + 1)), np.full(shape, -(LEAST + 1))
    np.maximum.at(ends, (row, 0), most)
    np.minimum.at(first, (row, 0), most)
    np.minimum.at(last, (row, 0), least)
    shown = np.where((anchor_labels[:, None] != labels) & (scores <= ends), scores, LEAST)
    if shown.shape[1] > k:
        last = np.maximum(last, np.partition(np.where(shown <= first, shown, LEAST), shown.shape[1] - k, axis=1)[:, shown.shape[1] - k, None])
    of, column = np.nonzero((shown >= last) & (shown > LEAST))
    start = np.searchsorted(of, np.arange(len(scores) + 1))
    upto = np.cumsum(np.r_[0, np.diff(start)[row]])
    out: list[np.ndarray] = []
    a = 0
    while a < len(row):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + WINDOWS * scores.shape[1], "right")) - 1)
        w = np.repeat(np.arange(a, z), np.diff(upto[a : z + 1]))
        c = column[start[row[w]] + np.arange(upto[a], upto[z]) - upto[w]]
        own = scores[row[w], c]
        fit = (least[w] <= own) & (own <= most[w])
        w, c, own = w[fit], c[fit], own[fit]
        order = np.lexsort((c, -own, w))
        order = order[np.arange(len(w)) - np.searchsorted(w, w) < k]
        w, c, own = w[order], c[order], own[order]
        out.append(np.stack([row[w], place[w], anchor_ids[row[w]], positive[w], score[w], ids[c], own]))
        a = z
    found = np.concatenate(out, axis=1) if out else np.zeros((7, 0), np.int64)
    names = ("row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    return pa.RecordBatch.from_pydict({"anchor_block": pa.array(np.full(found.shape[1], numbers["anchor_block"]), pa.int32()), **{c: pa.array(x, pa.int64()) for c, x in zip(names, found)}})


def mine(rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (100, 50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the table (vec_id, embedding, label).

    anchors: a condition on vec_id. label: an expression for the label to use. An anchor's positives are the highest
    scores of its own label; a positive's negatives are the highest scores of other labels with
    low * positive_score <= unit * negative_score <= high * positive_score, for window = (unit, low, high)."""
    found = quantised(rows, F.col("label") if label is None else label)
    largest = F.max(F.array_max(F.transform("q", F.abs)))
    shape = found.agg(F.max(F.size("q")).alias("dimensions"), largest.alias("largest")).first()
    dimensions = max(1, shape.dimensions or 0)
    bound = math.isqrt((2**63 - 1) // (2 * max(window) * dimensions))
    if (shape.largest or 0) > bound:
        found = found.where(F.forall("q", lambda x: F.abs(x) <= bound))
    found = stored(found)
    counts = found.agg(F.count("*").alias("rows"), F.count_if(anchors).alias("anchors")).first()
    row_blocks = _blocks(found, counts.rows, ROWS, dimensions)
    anchor_blocks = _blocks(found.where(anchors), counts.anchors, ANCHORS, dimensions).withColumn("windows", F.lit(None).cast("binary"))
    panels = _panels(anchor_blocks.count(), row_blocks.count())

    schema = "anchor_block int, row int, positive_id long, score long"
    near = _candidates(anchor_blocks, row_blocks, panels, True, lambda x, scores: _positives(x, scores, positives), schema)
    place = F.row_number().over(Window.partitionBy("anchor_block", "row").orderBy(F.desc("score"), "positive_id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        numbers = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("row", "place", "positive_id", "score")], axis=1)
        return pa.table({"of": pa.array([key[0].as_py()], pa.int32()), "windows": pa.array([_numbers(numbers)], pa.binary())})

    windows = near.groupBy(F.col("anchor_block").alias("of")).applyInArrow(pack, "of int, windows binary")  # a block's anchors times `positives`
    asked = stored(anchor_blocks.drop("windows").join(windows, F.col("block") == F.col("of")).drop("of"))
    schema = "anchor_block int, row long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _candidates(asked, row_blocks, panels, False, lambda x, scores: _negatives(x, scores, negatives, window), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_block", "row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
