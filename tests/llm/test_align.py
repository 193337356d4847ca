"""Alignment of tokenizers against a plain version over whole texts."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tagweft.llm import align, bpe, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WIDE = "doc_id long, text string, pair long, block int, documents string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def slow_tokens(libraries, text):
    """(id, bytes) of both sides; none if their bytes differ from the text's."""
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(bpe.byte_names())}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if text and all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])


def slow_document(libraries, text):
    """(ids of A, ids of B, groups, links) of one text."""
    sides = slow_tokens(libraries, text or "")
    ends = [[], []]
    for side, found in zip(sides, ends):
        at = 0
        for _, x in side:
            at += len(x)
            found.append(at)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    grouped = [([], []) for _ in cuts]
    for k in (0, 1):
        for (i, _), e in zip(sides[k], ends[k]):
            grouped[bisect.bisect_left(cuts, e)][k].append(i)
    links = []
    for g in range(len(cuts)):
        low = cuts[g - 1] if g else 0
        own = [[(i, e - len(x), e) for (i, x), e in zip(sides[k], ends[k]) if low < e <= cuts[g]] for k in (0, 1)] if len(cuts) < 300 else None
        if own is None:
            break
        links += [(i, j) for i, s, e in own[0] for j, t, f in own[1] if s < f and t < e]
    if len(cuts) >= 300:  # the same by a merge of both lists
        links, i, j = [], 0, 0
        while i < len(ends[0]):
            links.append((sides[0][i][0], sides[1][j][0]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
    return [i for i, _ in sides[0]], [i for i, _ in sides[1]], grouped, links


def slow_statistics(libraries, rows):
    found = [(i, *slow_document(libraries, t)) for i, t in rows]
    counts = Counter(p for *_, links in found for p in set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for i, a, b, grouped, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped)
        best = sum(counts[p] == highest[p[0]] for p in links)
        out.append((i, len(a), len(b), len(grouped), len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr), counts


PARTS = ["<|endoftext|>", "<s>", "</s>", "<unk>", "▁", " ", "  ", "\n", "\t", "\x1c", " ", "'s", "aaaa", "Hello", "world", "ß", "İ", "é", "日本", "한국", "💥", "1", "23", "_", "...", "\0", "﻿", "का"]
ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "One two"), (4, " \t\n"), (5, "Word word, " * 20_000), (6, "é😀\0 x"), (7, "z" * 50_000), (8, "a ▁ b"), (9, " lead"), (10, "trail "), (11, "a  b\n c"), (12, "<0x41>")]


def rows(n=400):
    rng = random.Random(5)
    return ODD + [(100 + k, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))) for k in range(n)]


def test_against_a_plain_version(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "SPAN", 200)
    monkeypatch.setattr(align, "LINKS", 50)
    given = rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in given], WIDE)
    expected, counts = slow_statistics(libraries, given)
    got = align.statistics(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert {(r.a_id, r.b_id): r.documents for r in align.pair_counts(docs, A, B).collect()} == counts


def test_query(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected, _ = slow_statistics(libraries, [(r.doc_id, r.text) for r in docs])
    assert sorted(map(tuple, queries.op11_alignment(spark, SF).collect()), key=repr) == expected


def test_groups(spark, libraries):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in ODD], WIDE)
    got = sorted(([r.doc_id, [(list(g.a), list(g.b)) for g in r.groups]] for r in align.groups(docs, A, B).collect()), key=repr)
    assert got == sorted(([i, slow_document(libraries, t)[2]] for i, t in ODD), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.statistics(docs, A, B).count() == align.groups(docs, A, B).count() == align.pair_counts(docs, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align.statistics(nothing, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_no_key_has_more_rows_than_blocks(spark):
    docs = spark.createDataFrame([(i, "the same text in every document") for i in range(1000)], "doc_id long, text string").coalesce(1)
    found = align._pairs(align._blocks(docs, A, B))
    assert found.groupBy("pair").count().where("count > 1").count() == 0
    assert {r.found for r in found.collect()} == {1000}


def test_pack():
    for values in ([], [0], [5, 2**32 - 1, 7], range(100_000)):
        values = np.array(list(values), np.int64)
        assert (align.unpack(align.pack(values)) == values).all()


def test_cut_is_where_both_may_be_cut(libraries):
    for text in ["a b", " a", "a  b", "a \n b", "", "a ", "x y z"]:
        runs = align.cut(text)
        assert "".join(" " + r for r in runs) == " " + text
        whole = slow_tokens(libraries, text)
        parts = [slow_tokens(libraries, r) if r else None for r in runs]
        if None not in parts and text:
            assert [t for p in parts for t in p[0]] == whole[0] and [t for p in parts for t in p[1]] == whole[1]
