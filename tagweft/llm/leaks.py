"""Benchmark decontamination: passages of benchmark items in documents, by edit distance over words.

Words are runs of ASCII letters and digits in lower case and of other characters. An item of m words is found in a
document if some passage of it is within floor((1 - SIMILARITY) * m) word edits. Windows of an item's size start at every
word. Steps:

1. Count filter, lossless: an edit loses one word of the item at most, so the window at the start of a passage within k
   edits has all but k of the item's words, and all but k of its r rare words (those in few items). Windows with fewer
   than r - k words (m - k, where r - k < 3) of those of that size's items are left out.
2. CGK embedding: a random walk repeats or passes each word by a random bit of (step, word); it maps edit distance to
   Hamming distance. REPEATS walks, each read at SAMPLED random steps, give keys (bit-sampling LSH). A window and an item
   that share a key are a candidate. Where half of the steps agree, the recall is 1 - (1 - 0.5**SAMPLED)**REPEATS, 0.99.
3. Exact verification of each candidate: the least edit distance of the item to any passage that touches the window.

The items are broadcast in shards of at most SHARD_CHARS characters; a larger benchmark takes several, one after another,
so what is broadcast never grows. Documents aren't shuffled. Items of fewer than MIN_WORDS words allow no edit and are found
by their words alone; null or empty texts hold and are nothing. Repeated rows repeat in the result, once for
each pair; null ids stay null. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, chunks, mix, runs, span_hashes, tidy
from .toxicity import WORD

SIMILARITY = 0.8
MIN_WORDS = 5
REPEATS, SAMPLED, SEED = 32, 3, 17
SHARD_CHARS = 8_000_000
_BITS = 20


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each row's words, hash of each word)."""
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    return np.searchsorted(starts, offsets), span_hashes(low, starts, ends)


def edits(m: int) -> int:
    return int(m * (1 - SIMILARITY) + 1e-9)


def embed(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys (windows, REPEATS) of the windows tokens[start : min(start + size, end)]."""
    r = np.random.default_rng(SEED)
    share = np.sort(r.random((REPEATS, SAMPLED)), axis=1)
    seeds = r.integers(0, 1 << 63, (int(2 * sizes.max()) + 1, REPEATS)).astype(np.uint64)
    out = np.empty((len(starts), REPEATS), np.uint64)
    padded = np.append(tokens, np.uint64(0))
    for a in range(0, len(starts), 512):
        s, size = starts[a : a + 512], sizes[a : a + 512]
        limit = np.minimum(s + size, ends[a : a + 512])[:, None]
        at = np.repeat(s[:, None], REPEATS, axis=1)
        steps = [(share[None, :, q] * (2 * size)[:, None]).astype(np.int32) for q in range(SAMPLED)]  # each (windows, REPEATS)
        key = np.repeat(mix(size.astype(np.uint64) + np.uint64(1))[:, None], REPEATS, axis=1) + np.arange(REPEATS, dtype=np.uint64)
        for j in range(int(steps[-1].max()) + 1):
            token = padded[np.where(at < limit, at, len(tokens))]
            hit = steps[0] == j
            for other in steps[1:]:
                hit = hit | (other == j)
            if hit.any():
                key[hit] = mix(key[hit] * np.uint64(0x9E3779B97F4A7C15) + token[hit] + np.uint64(j))
            at += (mix(token ^ seeds[j]) >> np.uint64(63)).astype(np.int64)
        out[a : a + 512] = key
    return out


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each row of items (n, m) to any passage of its row of texts (n, width), and where it ends."""
    n, m = items.shape
    step = np.arange(m + 1)
    d = np.repeat(step[None], n, axis=0)
    best, end = np.full(n, m), np.zeros(n, np.int64)
    for t in range(texts.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(d[:, :-1] + (items != texts[:, t : t + 1]), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - step, axis=1) + step
        better = d[:, m] < best
        best[better], end[better] = d[better, m], t + 1
    return best, end


def _joined(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of m words."""
    if len(h) < m:
        return h[:0]
    out = np.zeros(len(h) - m + 1, np.uint64)
    for k in range(m):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


class Index:
    """Of the items of one shard."""

    def __init__(self, ids: list, texts: list[str]):
        col = pa.array(texts, pa.string())
        self.ids, self.tokens = [], []
        short: list[tuple[object, np.ndarray]] = []
        for i, j, data, offsets in chunks(col):
            bounds, h = words(data, offsets)
            for k in range(j - i):
                own = h[bounds[k] : bounds[k + 1]]
                if len(own) >= MIN_WORDS:
                    self.ids.append(ids[i + k])
                    self.tokens.append(own)
                elif len(own):
                    short.append((ids[i + k], own))
        self.long = len(self.ids)
        # short items come last; by number of words, the keys in order and whose they are
        self.short = {}
        for m in {len(t) for _, t in short}:
            own = [x for x in short if len(x[1]) == m]
            keys = _joined(np.concatenate([t for _, t in own]), m)[::m]
            order = np.argsort(keys, kind="stable")
            self.short[m] = keys[order], len(self.ids) + order
            self.ids += [x for x, _ in own]
            self.tokens += [t for _, t in own]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        every, self.tokens = self.sizes, self.tokens[: self.long]
        self.sizes, self.all_sizes = every[: self.long], every
        self.classes = np.unique(self.sizes)
        if not self.long:
            return
        flat = np.concatenate(self.tokens)
        starts = np.cumsum(np.r_[0, self.sizes[:-1]])
        keys = embed(flat, starts, starts + self.sizes, self.sizes)
        self.of = np.repeat(np.arange(self.long), REPEATS)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.of = keys.ravel()[order], self.of[order]
        # groups of items for the count filter: (words, words of an item that count, how many of them a window must have).
        # An item's rare words count, those in few items; an edit loses one at most. Items of common words count all.
        unique, at = np.unique(np.concatenate([np.unique(t) for t in self.tokens]), return_counts=True)
        common = unique[at > max(3, len(self.tokens) // 100)]
        groups: dict[tuple[int, bool], tuple[list, list]] = {}
        for t in self.tokens:
            k, rare = edits(len(t)), t[~np.isin(t, common)]
            strong = len(rare) - k >= 3
            counted, need = groups.setdefault((len(t), strong), ([], []))
            counted.append(rare if strong else t)
            need.append((len(rare) if strong else len(t)) - k)
        self.groups = [(m, np.concatenate(counted), min(need)) for (m, _), (counted, need) in sorted(groups.items())]
        # bit c % 64 of table c // 64: a word that falls there counts in group c, or shares a slot with one
        self.tables = [np.zeros(1 << _BITS, np.uint64) for _ in range(-(-len(self.groups) // 64))]
        for c, (_, t, _) in enumerate(self.groups):
            self.tables[c // 64][(t >> np.uint64(64 - _BITS)).astype(np.int64)] |= np.uint64(1 << (c % 64))

    def windows(self, h: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes) of the windows that pass the count filter."""
        slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        bits = [t[slot] for t in self.tables]
        own = np.zeros(len(h) + int(self.classes[-1]) + 1, np.int32)
        starts, sizes = [], []
        for c, (m, _, need) in enumerate(self.groups):
            np.cumsum(((bits[c // 64] >> np.uint64(c % 64)) & np.uint64(1)).astype(np.int8), out=own[1 : len(h) + 1])
            own[len(h) + 1 :] = own[len(h)]
            at = np.flatnonzero(own[m : m + len(h)] - own[: len(h)] >= need)
            at = at[own[np.minimum(at + m, row_end[at])] - own[at] >= need]  # within the row
            starts.append(at)
            sizes.append(np.full(len(at), m, np.int64))
        both = np.unique(np.concatenate(starts) * (int(self.classes[-1]) + 1) + np.concatenate(sizes))
        return both // (int(self.classes[-1]) + 1), both % (int(self.classes[-1]) + 1)

    def search(self, bounds: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, last word's place) of the best passage for each row and item."""
        return sorted(self._short(bounds, h) + self._long(bounds, h))

    def _short(self, bounds: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each short item in each row."""
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        first: dict[tuple[int, int], int] = {}
        for m, (keys, items) in self.short.items():
            joined = _joined(h, m)
            left, right = np.searchsorted(keys, joined, "left"), np.searchsorted(keys, joined, "right")
            for at in np.flatnonzero((right > left) & (row[: len(joined)] == row[m - 1 :])).tolist():
                for item in items[left[at] : right[at]].tolist():
                    first.setdefault((int(row[at]), item), at + m - int(bounds[row[at]]))
        return [(*pair, 0, end) for pair, end in first.items()]

    def _long(self, bounds: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(h) or not self.long:
            return []
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        row_start, row_end = bounds[:-1][row], bounds[1:][row]
        starts, sizes = self.windows(h, row_end)
        if not len(starts):
            return []
        keys = embed(h, starts, row_end[starts], sizes).ravel()
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = right - left
        window = np.repeat(np.arange(len(starts)).repeat(REPEATS), n)
        item = self.of[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(window * self.long + item)
        window, item = pairs // self.long, pairs % self.long
        same = sizes[window] == self.sizes[item]
        window, item = window[same], item[same]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for m in np.unique(self.sizes[item]):
            own = np.flatnonzero(self.sizes[item] == m)
            k = edits(int(m))
            step = max(1, (1 << 18) // int(m))  # so many words of candidates at a time
            for i in range(0, len(own), step):
                part = own[i : i + step]
                s = starts[window[part]]
                at = s[:, None] + np.arange(-k, m + k)[None]
                inside = (at >= row_start[s][:, None]) & (at < row_end[s][:, None])
                texts = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
                d, end = distances(np.stack([self.tokens[x] for x in item[part]]), texts)
                for w, x, dist, e in zip(s[d <= k].tolist(), item[part][d <= k].tolist(), d[d <= k].tolist(), end[d <= k].tolist()):
                    pair, found = (int(row[w]), x), (dist, int(w - k + e - row_start[w]))
                    if pair not in best or found < best[pair]:
                        best[pair] = found
        return [(*pair, *found) for pair, found in best.items()]


def _item_shards(items: DataFrame, id_column: str):
    items = items.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // SHARD_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").toArrow()
        yield rows.column(0).to_pylist(), rows.column(1).to_pylist()


def _found(index: Index, texts: pa.Array):
    """(row, item, distance, last word's place) of all rows of a column."""
    for i, _, data, offsets in chunks(texts, 4 << 20):
        # words in cache-sized pieces, windows over all of them
        parts, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        own = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
        for _, _, d, o in chunks(own):
            bounds, h = words(d, o)
            parts.append(h)
            base.append(bounds[1:] + base[-1][-1])
        for row, item, distance, last in index.search(np.concatenate(base), np.concatenate(parts)):
            yield i + row, item, distance, last


def hits(docs: DataFrame, items: DataFrame, item_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_words (of the item), distance, last_word (the passage's last word in the document, from 0)."""
    spark, found = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for shard in _item_shards(items, item_column):
        shipped = spark.sparkContext.broadcast(shard)

        def scan(batches, shipped=shipped):
            index = Index(*shipped.value)
            for batch in batches:
                rows = list(_found(index, batch.column(1)))
                columns = [[index.ids[x[1]] for x in rows], [int(index.all_sizes[x[1]]) for x in rows], [x[2] for x in rows], [x[3] - 1 for x in rows]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "n_words", "distance", "last_word"])

        part = docs.mapInArrow(tidy(scan), "doc_id long, item_id long, n_words long, distance long, last_word long")
        found = part if found is None else found.union(part)
    return found


def without_hits(docs: DataFrame, items: DataFrame, item_column: str = "item_id") -> DataFrame:
    """The rows that hold no item, with all their columns; nothing is shuffled."""
    place = docs.columns.index("text")
    for shard in _item_shards(items, item_column):
        shipped = docs.sparkSession.sparkContext.broadcast(shard)

        def scan(batches, shipped=shipped):
            index = Index(*shipped.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _found(index, batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(scan), docs.schema)
    return docs
