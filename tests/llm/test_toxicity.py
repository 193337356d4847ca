"""FTRL-proximal regression over plain dicts and strings against the operator; clashing names, shared ids, repeated rows."""

import math
import random
import re

import numpy as np

from tagweft.llm import repeats, toxicity

KIND = "doc_id long, text string, toxicity string, _text string, score int"


def slow_features(text):
    words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    found = {("w", w) for w in words} | {("p", *p) for p in zip(words, words[1:])} | {("s", *p) for p in zip(words, words[2:])}
    return found | {("t", n, w[:n]) for w in words for n in toxicity.STEMS if len(w) > n}


class Slow:
    """One weight a feature, each with its own rate; None is the bias."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, f):
        z, n = self.z.get(f, 0.0), self.n.get(f, 0.0)
        l1 = 0.0 if f is None else toxicity.L1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)

    def score(self, features):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(map(self.weight, [*sorted(features, key=repr), None]))))))

    def learn(self, features, y):
        g = self.score(features) - y
        for f, w in [(f, self.weight(f)) for f in [*features, None]]:
            n = self.n.get(f, 0.0)
            self.z[f] = self.z.get(f, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / toxicity.ALPHA * w
            self.n[f] = n + g * g


def fixture():
    rng = random.Random(9)
    mild, bad = [f"word{k}é" for k in range(30)], ["vile", "horrid", "nastiness"]
    docs, labels = [], []
    for i in range(160):
        y = i % 3 == 0
        docs.append((i, " ".join(rng.choice(bad if y and rng.random() < 0.3 else mild) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 14))), "t", "u", 1))
        labels.append((i, int(y)))
    return docs, labels


def test_against_dicts(spark):
    docs, labels = fixture()
    import zlib

    train = [(i, slow_features(t), dict(labels)[i]) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    model, rng = Slow(), np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(train)):
            model.learn(*train[k][1:])
    got = {r.doc_id: r for r in toxicity.classify(spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    expected = {i: model.score(slow_features(t)) for i, t, *_ in docs}
    assert max(abs(got[i].score - x) for i, x in expected.items()) < 1e-6
    assert all(got[i].predicted == int(got[i].score >= 0.3) for i in expected) and len({round(x, 3) for x in expected.values()}) > 20


def test_clashing_names_and_shared_ids(spark):
    docs, labels = fixture()
    given = spark.createDataFrame(docs, KIND)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.accepted(given, known)
    assert kept.columns == given.columns and 0 < kept.count() < len(docs)
    # rows that repeat are trained on once, whatever their number
    once, often = (toxicity.fit(df, known) for df in (given, given.union(given).union(given)))
    assert np.array_equal(once[0], often[0]) and np.allclose(once[1], often[1])


def test_repeated_rows_cost_no_more_than_rows(spark):
    """Equal rows with one doc_id: each is judged, and what marks them is gathered once."""
    text = " ".join(f"w{k}" for k in range(80))
    rows = spark.createDataFrame([(1, text)] * 300 + [(2, "a b"), (2, None)], "doc_id long, text string")
    found = repeats.remove_repeats(rows)
    assert found.where("doc_id = 1 AND n_removed = 80").count() == 300 and found.count() == 302
    assert repeats.remove_repeats(rows.where("false")).count() == 0
