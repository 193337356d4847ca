"""BPE by pair occurrences against the tokenizers library and a plain merge loop."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Regex, Tokenizer, normalizers

from tagweft.llm import bpe, queries

SF = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["<|startoftext|>", "<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", " ", " ", "'s", "'LL", "aaaa", "aaa", "Hello", "ΑΣ", "Σ", "ß", "İ", "é", "日本", "한국", "💥", "1", "23", "½", "²", "٣", "՘", "Ɤ", "Ᲊ", "_", "...", "\0", "﻿", "‍", "का", "ǅ"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path) as f:
        return bpe.Codec(f.read()), Tokenizer.from_file(path)


def probes():
    rng = random.Random(7)
    return ["", " ", "  ", " a", "a ", "\x1c", "\x1c ", "a\x1cb", "ab" * 5000, "x" * 3000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def test_encode_like_the_library(both):
    own, library = both
    texts = probes()
    assert list(own.encode_all(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode("a <|endoftext|>") == library.encode("a <|endoftext|>", add_special_tokens=False).ids


def test_decode_like_the_library():
    path = public_tokenizers.path(FILES[0])
    with open(path) as f:
        own = bpe.Codec(f.read())
    library = Tokenizer.from_file(path)
    for text in probes()[:500]:
        ids = own.encode(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([]) == "" and own.decode([10**9]) == ""


def test_familiar_characters_have_the_same_classes():
    familiar = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if regex.match(f"[{bpe.FAMILIAR}]", c)]
    assert len(familiar) > 30_000
    for cls in (r"\p{L}", r"\p{N}", r"\s"):
        library, own = normalizers.Replace(Regex(cls), ""), regex.compile(cls)
        assert all((library.normalize_str(c) == "") == bool(own.match(c)) for c in familiar)
    lower = normalizers.Lowercase()
    assert all(lower.normalize_str(c) == c.lower() for c in familiar)


def test_index_against_a_merge_loop():
    rng = random.Random(3)
    for _ in range(60):
        pairs, made, n = [], [], 4
        for k in range(rng.randint(0, 12)):
            pair = rng.randrange(n), rng.randrange(n)
            if pair not in pairs:
                pairs.append(pair)
                made.append(n)
                n += 1
        words = [[rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(20)]
        flat = np.array([s for w in words for s in w], np.int64)
        tokens, ends = bpe.Merges(pairs, made).apply(flat, np.cumsum([len(w) for w in words]))
        cuts = [0, *ends.tolist()]
        assert [tokens[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [slow_merge(w, pairs, made) for w in words]


def slow_merge(word, pairs, made):
    word = list(word)
    while found := [(pairs.index(p), i) for i, p in enumerate(zip(word, word[1:])) if p in pairs]:
        rank, i = min(found)
        word[i : i + 2] = [made[rank]]
    return word


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges([(4, 1), (0, 1)], [5, 4])
    with pytest.raises(ValueError):
        bpe.Merges([(0, 1), (1, 0)], [4, 4])


def expected(library, i, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "One two"), (4, " \t\n"), (5, "Word " * 200_000), (6, "é😀\0 x"), (7, "z" * 300_000), (8, "<|endoftext|>")]
WIDE = "doc_id long, text string, ids string, n_tokens int, key string"


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", 100)
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in ODD], WIDE)
    got = [tuple(r) for r in bpe.digests(docs, public_tokenizers.path(FILES[0])).collect()]
    assert sorted(got, key=repr) == sorted((expected(library, i, t) for i, t in ODD), key=repr)
    assert bpe.digests(docs.where("false"), public_tokenizers.path(FILES[0])).count() == 0


def test_shares():
    texts = ["ab", "", "abcdef", "a", "b"]
    assert [texts[a:b] for a, b in bpe.shares(texts, 3)] == [["ab", ""], ["abcdef"], ["a", "b"]]
    assert list(bpe.shares([])) == []


def test_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_merges(spark, SF).collect()))
    assert got == sorted(expected(library, r.doc_id, r.text) for r in docs)


def test_columns(spark, both):
    own, _ = both
    path = public_tokenizers.path(FILES[0] if own.drops_space else FILES[1])
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in ODD], WIDE)
    rows = bpe.decode_column(bpe.encode_column(docs, path), path).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == own.encode(r.text or "") and r.decoded == own.decode(r.ids) and r.key == "k"
    assert bpe.decode_column(spark.createDataFrame([(None,), ([None, 5],)], "ids array<int>"), path).count() == 2
