"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text (runs of ASCII letters and digits in lower case, and of other characters), their stems
(the first 5, 6 and 7 bytes of longer words), pairs of neighbours, and pairs with one word between, each hashed to one of
2**BITS coordinates and counted once a text. Training keeps a rate for each coordinate; the L1 term leaves most weights at
zero, so what is broadcast is the list of the others.

The classifier is fitted on a bounded sample: the SAMPLE labelled documents (at most) with the smallest hash of doc_id,
those that are held out excluded. A label repeated for one doc_id counts as 1 if any of its rows is 1; null labels are
ignored. Scoring takes every row and its whole text, and nothing but the text. Null and empty texts get the score of a
text without features. Rows repeat as in the input; a null doc_id is not held out; an empty table gives no rows, and
without labels all scores are 0.5. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, byte_sums, chunks, mix, runs, span_hashes, tidy

BITS = 20
SAMPLE = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.5
STEMS = (5, 6, 7)
THRESHOLD = 0.3

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every occurrence of a feature."""
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    sums = byte_sums(low)
    h = span_hashes(low, starts, ends, sums)
    row = np.searchsorted(offsets, starts, "right") - 1
    found = [(row, h)]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = row[:-gap] == row[gap:]
        found.append((row[:-gap][same], mix(h[:-gap][same] * factor + h[gap:][same])))
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        found.append((row[long], mix(span_hashes(low, starts[long], starts[long] + n, sums) + np.uint64(n))))
    shift = np.uint64(64 - bits)
    return np.concatenate([r for r, _ in found]), (np.concatenate([x for _, x in found]) >> shift).astype(np.int64)


class Ftrl:
    """One weight for each coordinate; the last is the bias, which has no L1 term."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the weights that aren't zero; coordinate 2**bits is the bias."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("y"))
    known = known.where(F.crc32(F.col("labelled").cast("string")) % 4 != 2).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), texts.doc_id == known.labelled)  # broadcast: `sample` rows at most
    rows = rows.groupBy("labelled").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # one text a labelled document

    def read(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                row, at = features(data, offsets, bits)
                both = np.unique((row.astype(np.int64) << bits) | at)
                row, at = both >> bits, (both & ((1 << bits) - 1)).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([at[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "y", "at"])

    def train(batches):
        ids, ys, ats = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            ats += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        model = Ftrl(1 << bits)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], ats[i].tobytes()))
        random = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in random.permutation(len(order)):
                model.learn(ats[order[k]], ys[order[k]])
        at = np.flatnonzero(model.z)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0]), pa.array(w[w != 0])], ["at", "w"])

    # one task trains on the bounded sample; its result has at most 2**bits + 1 rows
    found = rows.mapInArrow(tidy(read), "doc_id long, y int, at binary").repartition(1).mapInArrow(tidy(train), "at long, w double").toPandas()
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, columns: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns named and the score of each row (in column `out`), by a model of fit()."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name in columns]
    place = columns.index("text") if "text" in columns else len(columns)

    def scan(batches):
        at, value = shipped.value
        w = np.zeros((1 << bits) + 1)
        w[at] = value
        used = w[:-1] != 0
        for batch in batches:
            found = np.full(batch.num_rows, w[-1])
            for i, j, data, offsets in chunks(batch.column(place)):
                row, at = features(data, offsets, bits)
                hit = used[at]
                both = np.unique((row[hit].astype(np.int64) << bits) | at[hit])
                found[i:j] += np.bincount(both >> bits, w[both & ((1 << bits) - 1)], j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(1 / (1 + np.exp(-np.clip(found, -35, 35))))], [*columns, out])

    kinds = {f.name: f.dataType.simpleString() for f in kept} | {"text": "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{out}` double"
    text = F.col("text").cast("string")
    spare = _unused("text", columns)
    return docs.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], *[text.alias(spare)] * ("text" not in columns)).mapInArrow(tidy(scan), schema)


def _unused(name: str, columns) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that classify() predicts as 0."""
    out = _unused("toxicity", docs.columns)
    return score(docs, fit(docs, labels), columns=tuple(docs.columns), out=out).where(F.col(out) < threshold).drop(out)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
