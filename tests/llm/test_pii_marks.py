"""Recall of personal data beside every printable mark, and the registered query against the patterns."""

import random
import string

import pytest

from tagweft.llm import pii, queries

from test_operators import slow_base

SF = "/root/testdata/sf0.001"
R = random.Random(77)
NAMES = "john mary.smith sarah_k peter.jones alice bob77 info support jan.novak contact karl-heinz office".split()
HOSTS = "mail example company university bigbank my-shop hospital research northern-lights acme garden".split()


def number(k):
    return "".join(R.choice(string.digits) for _ in range(k))


def address(at, dot):
    return R.choice(NAMES) + at + dot.join([*R.sample(HOSTS, R.choice([1, 1, 2])), R.choice(["org", "com", "net", "de", "fr"])])


def card():
    digits = next(d for d in iter(lambda: number(16), "") if pii.luhn(d))
    return ".".join(digits[i : i + 4] for i in range(0, 16, 4))


MAKERS = {
    "(at) (dot)": (0, lambda: address(" (at) ", " (dot) ")),
    "[at] .": (0, lambda: address(" [at] ", ".")),
    "at dot": (0, lambda: address(" at ", " dot ")),
    "IPv6": (1, lambda: ":".join(f"{R.randint(4096, 65535):x}" for _ in range(8))),
    "IPv6, short": (1, lambda: R.choice(["dead:beef::cafe", "2001:db8::8a2e:370:7334", "fe80::1ff:fe23:4567:890a"])),
    "card": (2, card),
    "telephone, (": (3, lambda: f"({number(3)}) {number(3)}-{number(4)}"),
    "telephone, -": (3, lambda: f"{number(3)}-{number(3)}-{number(4)}"),
}


@pytest.mark.parametrize("name", MAKERS)
def test_recall_beside_every_mark(name):
    """A whole span with each mark directly before it, or directly after."""
    kind, make = MAKERS[name]
    texts = []
    for mark in string.punctuation:
        for k in range(16):
            before = R.choice(["Our office can be reached at ", "She noted down ", "Please use ", "Please write to "]) + mark * (k % 2)
            texts.append((before, make(), mark * (1 - k % 2) + R.choice([" before noon.", " and wait for an answer.", "as agreed"][: 3 - k % 2])))
    found = pii.spans(pii.trained(), ["".join(t) for t in texts])
    hits = [(len(a), kind, len(a) + len(b)) in every for (a, b, _), (_, every) in zip(texts, found)]
    assert sum(hits) >= 0.9 * len(hits)


def test_numbers_that_are_none():
    for text in ("ISBN 978-3-16-148410-0 is it", "On 2021-03-04 at 10:30 std::vector a::b failed.", "Look at example.com; we met!"):
        assert pii.spans(pii.trained(), [text])[0][1] == [], text


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = slow_base(docs[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(pii.joined(base).split(",")) - {""} <= set(every) and len(every) == len(base) + r.n_added
