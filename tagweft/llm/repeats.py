"""Substring deduplication: removal of passages whose windows of WINDOW words start anywhere else.

Suffix automata of reference shards give matching statistics: the state that a window's last word leads to tells how often
the window stands in the shard. With an external reference (remove_reference), every shard of bounded size is broadcast and
the documents are streamed by it. When the corpus is its own reference (remove_repeats), streaming it by every shard would
cost the square of its size, so shards are cut by content and only what can match is brought to each:

1. Each window has an anchor, the place of its least hash of GRAM neighbouring words. Equal windows have equal anchors.
   Windows with one anchor follow each other, and the words they cover are the anchor's segment; about one anchor stands
   in 14 words. Anchors whose key (that hash) is in the corpus once have no repeated window.
2. Equal segments are counted. Where a segment occurs twice, all its windows are repeats; no text is moved.
3. The other segments of keys with several segments are fetched from their documents, one copy each, and dealt by key to
   shards of about SHARD_WORDS words. Each shard's automaton tells which windows of its segments occur twice in it. Every
   occurrence of a window has the same key, so the counts are those of the corpus.
4. A key with more than KEY_SEGMENTS different segments (a passage that very many documents share, at its ends) would
   make its shard large: hashes of its segments' windows are counted over the cluster instead, which is exact too.
5. The marks go back to the documents, which drop the words that marked windows cover. Windows are judged on the input.

Documents are told apart by doc_id and a hash of the text. Null and empty texts have no words. Repeated rows repeat in the
result, and their windows repeat each other's. A null doc_id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, chunks, durable, mix, runs, span_hashes, stored

WINDOW, GRAM = 35, 8
SHARD_WORDS, KEY_SEGMENTS = 100_000, 256
_F1, _F2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each row's words, starts, ends, hashes)."""
    starts, ends = runs(~SPACE[data], offsets)
    return np.searchsorted(starts, offsets), starts, ends, span_hashes(data, starts, ends)


def grams(h: np.ndarray, size: int, factor: np.uint64 = _F1) -> np.ndarray:
    """A hash of each run of `size` hashes, by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    out, done, power, step, at = np.zeros(n, np.uint64), 0, h, 1, size
    while at:
        if at & 1:
            out = mix(out * factor + power[done : done + n])
            done += step
        at >>= 1
        if at:
            power = mix(power[: len(power) - step] * factor + power[step:])
            step *= 2
    return out


def least(g: np.ndarray, size: int) -> np.ndarray:
    """The place of the least value (the first of equals) of each run of `size` values."""
    n = len(g) - size + 1
    best, step = np.arange(len(g)), 1

    def lower(a, b):
        return np.where(g[b] < g[a], b, a)

    while 2 * step <= size:
        best = lower(best[: len(best) - step], best[step:])
        step *= 2
    return lower(best[:n], best[size - step : size - step + n])


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's word hashes: (key, hash of the segment, first window, number of windows)."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(h, GRAM)
    place = least(g, window - GRAM + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    # a segment is made by its first and its last window and its length: they cover it together
    w = grams(h, window, _F2)
    segment = mix(mix(w[first] * _F1 + w[first + count - 1]) * _F2 + count.astype(np.uint64))
    return g[place[first]], segment, first, count


class Automaton:
    """A suffix automaton of texts over integers, each with a weight; what stands in several texts is found in all."""

    def __init__(self, texts: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for text, weight in zip(texts, weights):
            last = 0
            for x in text:
                last = self._extend(last, x, weight)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def _extend(self, last: int, x: int, weight: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(x)
        if q is not None:  # the text is known so far
            if length[q] == length[last] + 1:
                self.count[q] += weight
                return q
            new = self._split(last, x, q)
            self.count[new] += weight
            return new
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(weight)
        p = last
        while p >= 0 and x not in nexts[p]:
            nexts[p][x] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, x, q)
        return new

    def _split(self, p: int, x: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.count.append(0)
        link[q] = clone
        while p >= 0 and nexts[p].get(x) == q:
            nexts[p][x] = clone
            p = link[p]
        return clone

    def statistics(self, text: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        v = matched = 0
        out = []
        for x in text:
            while v and x not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if x in self.next[v]:
                v = self.next[v][x]
                matched += 1
            out.append(matched)
        return out

    def occurrences(self, text: list[int], window: int) -> list[int]:
        """For each window of the text, its weight in the reference."""
        v = matched = 0
        out = []
        for k, x in enumerate(text):
            while v and x not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if x in self.next[v]:
                v = self.next[v][x]
                matched += 1
            while self.length[self.link[v]] >= window if v else False:
                v = self.link[v]
                matched = self.length[v]
            if k >= window - 1:
                out.append(self.count[v] if matched >= window else 0)
        return out


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words windows at the starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _segments(rows: DataFrame, window: int) -> DataFrame:
    """key, segment, doc_id, th, first, count of every anchor."""

    def read(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                bounds, _, _, h = words(data, offsets)
                found = [anchors(h[a:b], window) for a, b in zip(bounds, bounds[1:])]
                row = pa.array(np.repeat(np.arange(i, j), [len(x[0]) for x in found]))
                key, segment, first, count = (np.concatenate([x[k] for x in found]) for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(segment.view(np.int64)), batch.column(0).take(row), batch.column(2).take(row), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "segment", "doc_id", "th", "first", "count"])

    return rows.mapInArrow(read, "key long, segment long, doc_id long, th long, first int, count int")


def _shards(batches, window: int):
    """Of rows key, segment, n, words (hashes) dealt by key: marks of the windows that occur twice."""

    def search(keys, segments, weights, texts):
        automaton = Automaton(texts, weights)
        marks = [sum(1 << k for k, c in enumerate(automaton.occurrences(t, window)) if c > 1) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segments, pa.int64()), pa.array(marks, pa.int64())], ["key", "segment", "marks"])

    held, size = ([], [], [], []), 0
    for batch in batches:
        for key, segment, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SHARD_WORDS and key != held[0][-1]:
                yield search(*held)
                held, size = ([], [], [], []), 0
            if held[1] and key == held[0][-1] and segment == held[1][-1]:
                continue  # from a repeated row
            text = np.frombuffer(raw, np.int64).tolist()
            for column, x in zip(held, (key, segment, n, text)):
                column.append(x)
            size += len(text)
    if held[0]:
        yield search(*held)


def marked_windows(rows: DataFrame, window: int = WINDOW, key_segments: int = KEY_SEGMENTS) -> DataFrame:
    """doc_id, th, first, marks: bit i of marks says that the window first + i of that document is a repeat."""
    if not GRAM <= window <= 62 + GRAM:  # an anchor has window - GRAM + 1 windows at most, and marks have 63 bits
        raise ValueError(f"window must be {GRAM} to {62 + GRAM}")
    every = stored(_segments(rows, window))
    twice = durable(every.groupBy("key").count().where("count > 1").select(F.col("key").alias("k")))
    near = stored(every.join(twice, F.col("key") == F.col("k"), "left_semi"))
    # one row a different segment; how many there are of a key decides what becomes of it
    different = stored(near.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first", "count")).alias("at")))
    of_key = durable(different.groupBy("key").agg(F.count("*").alias("different"), F.min("n").alias("fewest")).select(F.col("key").alias("k"), "different", "fewest"))
    open_ = stored(different.join(of_key.where("different > 1 and fewest = 1"), F.col("key") == F.col("k")).select("key", "segment", "n", "different", "at.*"))
    # what the open segments say, from their documents
    asked = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "segment", "n", "different", "first", "count")).alias("asked")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "asked")

    def fetch(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                _, _, _, h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for a in asked:
                    own = h[a["first"] : a["first"] + a["count"] + window - 1]
                    for column, x in zip(out, (a["key"], a["segment"], a["n"], a["different"], own.tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["key", "segment", "n", "different", "words"])

    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("text", "asked")
    fetched = stored(texts.mapInArrow(fetch, "key long, segment long, n long, different long, words binary"))
    small = fetched.where(F.col("different") <= key_segments).select("key", "segment", "n", "words").repartition("key").sortWithinPartitions("key", "segment")
    marks = small.mapInArrow(lambda b: _shards(b, window), "key long, segment long, marks long")

    def explode(batches):
        for batch in batches:
            for key, segment, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                w = np.frombuffer(raw, np.uint64)
                a, b = grams(w, window), grams(w, window, _F2)
                k = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, key)), pa.array(np.full(k, segment)), pa.array(np.full(k, n)), pa.array(np.arange(k)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "segment", "n", "i", "a", "b"])

    large = fetched.where(F.col("different") > key_segments).dropDuplicates(["key", "segment"]).select("key", "segment", "n", "words").mapInArrow(explode, "key long, segment long, n long, i long, a long, b long")
    large = stored(large)
    common = stored(large.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("a").alias("ca"), F.col("b").alias("cb")))
    of_large = large.join(common, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left_semi").groupBy("key", "segment").agg(F.bit_or(F.expr("shiftleft(1L, int(i))")).alias("marks"))
    marks = stored(marks.union(of_large).select(F.col("key").alias("mk"), F.col("segment").alias("ms"), "marks"))
    # segments that occur twice are marked as a whole, the others by what was found
    whole = different.where("n > 1").select(F.col("key").alias("mk"), F.col("segment").alias("ms"), F.expr("shiftleft(1L, int(at.count)) - 1").alias("marks"))
    single = different.where("n = 1").select("key", "segment").join(marks, (F.col("key") == F.col("mk")) & (F.col("segment") == F.col("ms"))).where("marks <> 0").select("mk", "ms", "marks")
    final = stored(whole.union(single))
    return near.join(final, (F.col("key") == F.col("mk")) & (F.col("segment") == F.col("ms"))).select("doc_id", "th", "first", "marks")


def _drop(batches, window: int):
    """Of rows doc_id, text, found: doc_id, n_words, n_removed, kept."""
    for batch in batches:
        out = [[], [], []]
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = text.encode().split()
            starts = np.array([x["first"] + i for x in found or () for i in range(int(x["marks"]).bit_length()) if x["marks"] >> i & 1], np.int64)
            gone = covered(len(own), starts, window)
            n = int(gone.sum())
            kept = own if not n else [w for w, g in zip(own, gone.tolist()) if not g]
            for column, x in zip(out, (len(own), n, b" ".join(kept).decode())):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, key_segments: int = KEY_SEGMENTS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) or, if digest, kept_sha256 of each row."""
    rows = _rows(docs)
    found = marked_windows(rows, window, key_segments).groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "marks")).alias("found"))  # rows that repeat say the same
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "found")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "found")

    def drop(batches):
        for batch in _drop(batches, window):
            if digest:
                kept = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()], pa.string())
                batch = pa.RecordBatch.from_arrays([*batch.columns[:3], kept], [*batch.schema.names[:3], "kept_sha256"])
            yield batch

    return joined.mapInArrow(drop, "doc_id long, n_words long, n_removed long, " + ("kept_sha256" if digest else "kept") + " string")


def remove_reference(docs: DataFrame, reference: DataFrame, longest: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept: without the maximal spans of `longest` words or more that stand in the reference
    (text). Shards of the reference are broadcast one after another, each of SHARD_WORDS words or a single text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.array().cast("array<int>").alias("spans"))

    def mark(shipped):
        def run(batches):
            ids: dict[str, int] = {}
            texts = [[ids.setdefault(w, len(ids)) for w in t.encode().split()] for t in shipped.value]  # unknown words are -1
            automaton = Automaton(texts, [1] * len(texts))
            for batch in batches:
                out = []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    matched = automaton.statistics([ids.get(w, -1) for w in text.encode().split()])
                    for end, n in enumerate(matched):
                        if n >= longest and (end + 1 == len(matched) or matched[end + 1] != n + 1):
                            spans = [*spans, end + 1 - n, end + 1]
                    out.append(spans)
                yield batch.set_column(2, "spans", pa.array(out, pa.list_(pa.int32())))

        return run

    def ship(held):
        return spark.sparkContext.broadcast(list(held))

    held, size = [], 0
    for row in reference.select(F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        held.append(row.text)
        size += len(row.text.split())
        if size >= SHARD_WORDS:
            rows, held, size = rows.mapInArrow(mark(ship(held)), rows.schema), [], 0
    if held:
        rows = rows.mapInArrow(mark(ship(held)), rows.schema)

    def drop(batches):
        for batch in batches:
            out = [[], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = text.encode().split()
                gone = np.zeros(len(own), bool)
                for a, b in zip(spans[::2], spans[1::2]):
                    gone[a:b] = True
                for column, x in zip(out, (len(own), int(gone.sum()), b" ".join(w for w, g in zip(own, gone) if not g).decode())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")
