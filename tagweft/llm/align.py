"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, links of tokens that overlap, and how
many documents hold each linked pair of ids.

Both tokenizers cut a text before a space that follows other than white space (A's words and B's pieces begin there or
earlier), so a task encodes the distinct runs between such places once, and everything below is done for runs and added up
by document. Within the runs laid out one after another: cumulative sums of token lengths are the tokens' ends; the
intersection of both lists of ends are the common cuts; a search among the cuts labels each token with its group; a search
of each A token's start and end among the B ends gives the range of B tokens that it overlaps, which repetition expands into
links. Nothing is looped over a token.

Counting over the corpus takes two passes. The first writes a row a block (texts of up to SPAN characters of one task, or
one longer text): its documents' numbers, its runs packed, and for each distinct pair of its links the number of its
documents that hold it. These partial counts are added up in two shuffles, first by pair and salt, then by pair; the highest
count of each A id is one row an id of the vocabulary and is broadcast. The counts go back to the blocks by a join on the
pair (a pair is once in a block, so no key has more rows than there are blocks), and each block is met by its counts again
to finish its documents. A group of the second pass is one block; no task holds more.

Texts that are null or empty, or whose tokens' bytes differ from the text, have no tokens: all counts are zero, groups are
none. Repeated rows are documents of their own, each counted; rows with a null doc_id too. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe import Interned, spans
from .text import stored, tidy

#: Characters of texts of one block, and of links that are sorted at a time.
SPAN, LINKS = 6_000_000, 3_000_000
#: Parts into which the rows of one pair are dealt before they are added up.
SALTS = 16
#: A pair is its A id times this and its B id.
SHIFT = 32
MARK = "▁"
PACKED = "runs binary, run_ends binary, link_pairs binary, link_ends binary"
COUNTED = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"


def cut(text: str) -> list[str]:
    """The runs of a space and the text, each without the space that it begins with. A space at the end begins none."""
    if text.startswith(" ") or text.endswith(" ") or re.search(r"\s ", text):
        return re.split(r"(?<=\S) (?!\Z)", text)
    return text.split(" ")


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the values up to each end, from the end before."""
    return np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)


@dataclass
class Runs:
    """Distinct runs, encoded by both tokenizers and linked. *_ends: the end of each run among tokens, groups or links."""

    usable: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    group_ends: np.ndarray
    link_ends: np.ndarray
    pairs: np.ndarray
    link_pairs: np.ndarray


class Aligner:
    """Of a vocabulary file of the tokenizers library (byte-level) and a sentencepiece model."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a = bpe.Codec(spec)
        self.b = SentencePieceProcessor(model_proto=model)
        byte_of = {c: b for b, c in enumerate(bpe.byte_names())}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in self.a.ids.items()}
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        self.a_size, self.b_size = 1 + max(self.a_bytes), len(self.b_bytes)
        self.a_lengths = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.a_size)])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        self.names = [f"{i}{mark}" for i in [*range(self.a_size), *range(self.b_size)] for mark in ",|;"]

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends of both tokenizers, and whether the bytes of both are the run's; other runs get no tokens."""
        a_ids, a_ends = self.a.encode_runs([" " + r for r in runs], special=False)
        found = self.b.encode(runs, num_threads=1) if runs else []
        b_ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        b_ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(b_ends[-1]) if len(found) else 0)
        a_ids = a_ids.astype(np.int64)
        texts = [b" " + r.encode() for r in runs]
        usable = self._same(texts, a_ids, a_ends, self.a_bytes) & self._same(texts, b_ids, b_ends, self.b_bytes)
        if not usable.all():
            for_a, for_b = (np.repeat(usable, np.diff(e, prepend=0)) for e in (a_ends, b_ends))
            a_ids, a_ends = a_ids[for_a], np.append(0, np.cumsum(for_a))[a_ends]
            b_ids, b_ends = b_ids[for_b], np.append(0, np.cumsum(for_b))[b_ends]
        return usable, a_ids, a_ends, b_ids, b_ends

    def _same(self, texts: list[bytes], ids: np.ndarray, ends: np.ndarray, bytes_of) -> np.ndarray:
        tokens = list(map(bytes_of.__getitem__, ids.tolist()))
        cuts = [0, *ends.tolist()]
        return np.array([b"".join(tokens[i:j]) == t for t, i, j in zip(texts, cuts, cuts[1:])], bool)

    def link(self, runs: list[str]) -> Runs:
        usable, a_ids, a_ends, b_ids, b_ends = self.encode(runs)
        a_stops, b_stops = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        common = np.intersect1d(a_stops, b_stops, assume_unique=True)
        a_groups, b_groups = np.searchsorted(common, a_stops), np.searchsorted(common, b_stops)
        first = np.searchsorted(b_stops, a_stops - self.a_lengths[a_ids], "right")
        each = np.searchsorted(b_stops, a_stops) - first + 1
        left, right = np.repeat(np.arange(len(a_ids)), each), spans(first, each)
        pairs, link_pairs = np.unique((a_ids[left] << SHIFT) + b_ids[right], return_inverse=True)
        # a run without tokens ends where the run before ends
        group_ends, link_ends = np.append(0, a_groups + 1)[a_ends], np.append(0, np.cumsum(each))[a_ends]
        return Runs(usable, a_ids, b_ids, a_ends, b_ends, a_groups, b_groups, group_ends, link_ends, pairs, link_pairs)

    def group_texts(self, r: Runs) -> list[str]:
        """Of each run: `a1,a2|b1;a3|b2;`."""
        key = np.concatenate([2 * r.a_groups, 2 * r.b_groups + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        mark = np.full(len(key), 2)
        same = key[1:] == key[:-1]
        mark[:-1] = np.where(same, 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
        which = np.concatenate([r.a_ids, self.a_size + r.b_ids])[order]
        parts = list(map(self.names.__getitem__, (3 * which + mark).tolist()))
        cuts = [0, *(r.a_ends + r.b_ends).tolist()]
        return ["".join(parts[i:j]) for i, j in zip(cuts, cuts[1:])]

    def coded(self, texts: list[str]) -> tuple[Interned, np.ndarray, np.ndarray]:
        """(distinct runs, the runs of all texts, each text's end among them)."""
        runs = Interned()
        found = [list(map(runs.__getitem__, cut(t))) if t else [] for t in texts]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return runs, np.fromiter(itertools.chain.from_iterable(found), np.int64, int(ends[-1]) if found else 0), ends

    def block(self, texts: list[str]) -> tuple[Runs, np.ndarray, np.ndarray]:
        """(linked runs, runs of all texts, ends); texts with an unusable run have none."""
        runs, flat, ends = self.coded(texts)
        linked = self.link(list(runs))
        if not linked.usable.all():
            fine = np.repeat(sums(~linked.usable[flat], ends) == 0, np.diff(ends, prepend=0))
            flat, ends = flat[fine], np.append(0, np.cumsum(fine))[ends]
        return linked, flat, ends


def documents_of_pairs(linked: Runs, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many texts hold each pair of linked.pairs."""
    n_runs, n_pairs = len(linked.link_ends), len(linked.pairs)
    sizes = np.diff(linked.link_ends, prepend=0)
    counted = np.zeros(n_pairs, np.int64)
    if not n_pairs:
        return counted
    starts = linked.link_ends - sizes
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    until = np.cumsum(sizes[flat])
    a = 0
    while a < len(ends):  # some texts at a time: all links of all texts needn't be held
        start = ends[a - 1] if a else 0
        before = until[start - 1] if start else 0
        b = a + 1
        if start < len(flat):
            b = max(b, int(np.searchsorted(ends, np.searchsorted(until, before + LINKS, "right"), "right")))
        stop = ends[b - 1]
        once = np.unique(text[start:stop] * n_runs + flat[start:stop])
        run = once % n_runs
        at = spans(starts[run], sizes[run])
        keys = np.unique(np.repeat(once // n_runs, sizes[run]) * n_pairs + linked.link_pairs[at])
        counted += np.bincount(keys % n_pairs, minlength=n_pairs)
        a = b
    return counted


_aligners: dict[str, Aligner] = {}


def _aligner(key: str, spec, model) -> Aligner:
    if key not in _aligners:
        _aligners[key] = Aligner(spec.value, model.value)
    return _aligners[key]


def _shipped(docs: DataFrame, a_path: str, b_path: str):
    key, spec = bpe.shipped(docs, a_path)
    with open(b_path, "rb") as f:
        model = f.read()  # as large as the model file, whatever the corpus
    return key + hashlib.sha256(model).hexdigest(), spec, docs.sparkSession.sparkContext.broadcast(model)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    key, spec, model = _shipped(docs, a_path, b_path)

    def scan(batches):
        from pyspark import TaskContext

        own, number = _aligner(key, spec, model), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in bpe.shares(texts, SPAN):
                linked, flat, ends = own.block(texts[i:j])
                written = own.group_texts(linked)
                digests = []
                for codes in np.split(flat, ends[:-1]):
                    text = "".join(list(map(written.__getitem__, codes.tolist())))[:-1]
                    digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                found = documents_of_pairs(linked, flat, ends)
                number += 1
                counts = [sums(np.diff(e, prepend=0)[flat], ends) for e in (linked.a_ends, linked.b_ends, linked.group_ends, linked.link_ends)]
                columns = [pa.array([number], pa.int64()), pa.array([batch.column(0)[i:j].to_pylist()], pa.list_(pa.int64()))]
                columns += [pa.array([c], pa.list_(pa.int64())) for c in counts]
                columns += [pa.array([digests], pa.list_(pa.string()))]
                columns += [pa.array([pack(x)], pa.binary()) for x in (flat, ends, linked.link_pairs, linked.link_ends)]
                columns += [pa.array([linked.pairs], pa.list_(pa.int64())), pa.array([found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"block long, doc_ids array<long>, {COUNTED}, {PACKED}, pairs array<long>, found array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    return _rows(docs).mapInArrow(tidy(scan), schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(block, code, pair, found): each block's pairs by their place in it."""
    found = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "found")).alias("code", "p"))
    return found.select("block", "code", F.col("p.pairs").alias("pair"), F.col("p.found").alias("found")).where("found > 0")


def _counted(pairs: DataFrame) -> DataFrame:
    """(pair, documents): partial counts by salt, then whole ones."""
    parts = pairs.groupBy("pair", F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("found").alias("found"))
    return parts.groupBy("pair").agg(F.sum("found").alias("documents"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, documents: how many documents link the two ids."""
    found = _counted(_pairs(_blocks(docs, a_path, b_path)))
    return found.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"), "documents")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, groups: of each document, in order, the ids of both sides that cover the same bytes."""
    key, spec, model = _shipped(docs, a_path, b_path)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def split(text: str) -> list[dict]:
        sides = [g.split("|") for g in text.split(";")[:-1]]
        return [{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in sides]

    def scan(batches):
        own = _aligner(key, spec, model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in bpe.shares(texts, SPAN // 10):
                linked, flat, ends = own.block(texts[i:j])
                written = own.group_texts(linked)
                rows = [split("".join([written[c] for c in codes])) for codes in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows, kind)], ["doc_id", "groups"])

    return _rows(docs).mapInArrow(tidy(scan), "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def _finished(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of a block's documents. counts: the block's pairs, each with its documents in the corpus."""
    row = block.to_pylist()[0]
    flat, ends, link_pairs, link_ends = (unpack(row[c]) for c in ("runs", "run_ends", "link_pairs", "link_ends"))
    out = {"doc_id": pa.array(row["doc_ids"], pa.int64())} | {c: pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
    code = counts.column("code").to_numpy()
    for name, source in (("n_best", "best"), ("count_sum", "documents")):
        of_pair = np.zeros(int(link_pairs.max()) + 1 if len(link_pairs) else 0, np.int64)
        of_pair[code] = counts.column(source).to_numpy()
        out[name] = pa.array(sums(sums(of_pair[link_pairs], link_ends)[flat], ends), pa.int64())
    return pa.table(out | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row. n_best: links whose pair's count
    is the highest of its A id; count_sum: the counts of all links; the digest is of the groups written as
    `a1,a2|b1;a3|b2,b3`, empty without tokens."""
    blocks = stored(_blocks(docs, a_path, b_path))
    pairs = _pairs(blocks)
    counts = stored(_counted(pairs))
    a_id = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("documents").alias("highest"))  # at most a row an id of A
    known = counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id").select("pair", "documents", (F.col("documents") == F.col("highest")).cast("int").alias("best"))
    looked_up = pairs.select("block", "code", "pair").join(known.hint("merge"), "pair").select(F.col("block").alias("of"), "code", "documents", "best")
    whole = blocks.drop("pairs", "found").groupBy("block").cogroup(looked_up.groupBy("of"))
    return whole.applyInArrow(_finished, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
