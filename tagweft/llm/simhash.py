"""SimHash fingerprints, and exact links between those within a Hamming radius.

A fingerprint is a point under the Hamming distance. Points are dealt to shards first and searched by vantage-point
trees inside each shard:

* A shard is a ball of radius 0 around a value of two of six bit blocks, under the distance counted on those blocks
  alone, which bounds the whole distance from below. A pair within 4 differs in at most four blocks, so it agrees on at
  least two: some shard has both. (A split of all 64 bits at a median distance would copy seven tenths of the points
  across each border, since distances between unrelated fingerprints lie within a few bits of 32.)
* In a shard, a vantage point links the ball within the radius; the rest is cut at its median distance and pairs across
  the cut are tested only where the triangle inequality allows them.
* A shard above SHARD_ROWS is cut into salted parts, and every pair of parts is searched as a shard of its own.

Equal fingerprints are one point, so copies are never paired. A shard emits a tree of links for each component it finds,
never all its pairs.

`similar` is for a threshold on the similarity of shingle sets, as the pipeline needs it, and exact: it links every pair of
texts whose sets of WIDE_WORDS-word shingles have a Jaccard similarity of NEAR or more, and no other pair. It takes three
rounds, each of which compares the candidates' sets exactly and groups what they link:

* Candidates are first the links of the fingerprints of these shingles, by the shards and vantage-point trees above.
* What the radius misses is found by prefixes: two sets at the threshold share one of the first few shingles of each (a
  fifth of the set, and one) in any common order; the order is by frequency, so that these prefixes are rare shingles. Of
  each shared shingle, each text is compared with two others that it isn't grouped with.
* Then with all that share a shingle and aren't grouped with it yet, so a large group of copies takes no more comparisons
  than it has texts. A pair comes from the least shingle that both share, as far as each one's FIRST_TOKENS least tell.

Sketches rule out most candidates before texts are read. Shingles are known by a 64-bit hash.

Null texts count as empty; empty texts have fingerprint zero; repeated rows repeat in the result; a
null doc_id gets a fingerprint and its group's component_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .text import chunks, discard, durable, roots, stored, tidy

WORDS, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
WIDE_WORDS = 5
#: The least similarity, as a fraction.
NEAR = (4, 5)
#: Counters of the frequency of shingles.
SLOTS, _BLOCK = 1 << 20, 1 << 14
#: Bits of the sketch of a set.
SKETCH_BITS = 1024
#: Points of a shard above which it is cut into parts.
SHARD_ROWS = 4000
LEAF = 32
#: Parts of a key that many rows look up.
SALTS = 64
#: Edges up to which one task finds the components.
LOCAL_EDGES = 1 << 20
#: Of a set's shingles that others share, so many go with each of its rows.
FIRST_TOKENS = 16
#: Candidates up to which the texts are filtered by a broadcast of their nodes before they are joined.
WANTED = 1 << 18
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Of each run of so many words of a text in UTF-8, repeats included; of the whole text if it has fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(parts) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of one text in UTF-8."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def scan(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for i, _, data, offsets in chunks(batch.column(1)):
                raw = data.tobytes()
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    found[i + k] = fingerprint(raw[a:b], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(scan), "doc_id long, fp long")


def shard_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> list:
    """One key a shard of the column fp: every choice of blocks - radius blocks that agree."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1)) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of points; a point is a row of 64-bit values."""
    d = np.bitwise_count(x ^ y)
    return d[..., 0] if d.shape[-1] == 1 else d.sum(axis=-1, dtype=np.int16)


def _pairs(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, found: list) -> None:
    """Links between points a and points b, cut to a forest block by block."""
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 1024):
            x, y = a[i : i + 1024], b[j : j + 1024]
            p, q = np.nonzero(_distance(points[x][:, None], points[y][None, :]) <= radius)
            if len(p) > len(x) + len(y):
                both, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                up = roots(len(both), where[p], where[len(x) + q])
                found.append((both, both[up]))
            elif len(p):
                found.append((x[p], y[q]))


def vantage_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two points (rows) within the radius into one component, by a vantage-point tree."""
    found: list = []
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            _pairs(points, own, own, radius, found)
            continue
        v = own[len(own) // 2]
        d = _distance(points[own], points[v])
        ball, rest = own[d <= radius], own[d > radius]
        d_ball, d = d[d <= radius].astype(int), d[d > radius].astype(int)
        found.append((ball, np.full(len(ball), v)))
        if not len(rest):
            continue
        for e in range(radius + 1, 2 * radius + 1):  # |d(x, v) - d(y, v)| <= d(x, y)
            if (d == e).any():
                _pairs(points, ball[d_ball >= e - radius], rest[d == e], radius, found)
        cut = int(np.median(d))
        inner = d <= cut
        if inner.all():
            inner = d < cut
        if not inner.any():  # all as far from v: the next vantage point is another
            half = len(rest) // 2
            stack += [rest[:half], rest[half:]]
            _pairs(points, rest[:half], rest[half:], radius, found)
            continue
        cut = int(d[inner].max())
        _pairs(points, rest[inner & (d > cut - radius)], rest[~inner & (d <= cut + radius)], radius, found)
        stack += [rest[inner], rest[~inner]]
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def shard_links(keys: np.ndarray, points: np.ndarray, names: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of several shards: for each component in a shard, links of each member's name to another, as a tree of low
    degree."""
    order = np.argsort(keys, kind="stable")
    keys, points, names = keys[order], points[order], names[order]
    n = len(keys)
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    a, b = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    at = np.flatnonzero(small)
    for step in range(1, LEAF):
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[_distance(points[at], points[at + step]) <= radius]
        a.append(near)
        b.append(near + step)
    for k in np.flatnonzero(sizes > LEAF):
        x, y = vantage_links(points[bounds[k] : bounds[k + 1]], radius)
        a.append(x + bounds[k])
        b.append(y + bounds[k])
    if not a:
        return names[:0], names[:0]
    root = roots(n, np.concatenate(a), np.concatenate(b))
    order = np.argsort(root, kind="stable")
    root = root[order]
    first = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    rank = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    child = np.flatnonzero(rank > 0)
    parent = child - rank[child] + (rank[child] - 1) // 8
    x, y = names[order[child]], names[order[parent]]
    apart = x != y
    return x[apart], y[apart]


def _dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Rows (key, name, then the point) dealt by key; a key of more than shard_rows rows is cut into salted parts, and each
    pair of parts is a shard of its own."""
    large = rows.groupBy("key").count().where(F.col("count") > shard_rows).select(F.col("key").alias("hot"), F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    rows = rows.join(large, F.col("key") == F.col("hot"), "left")
    part = F.pmod(F.xxhash64("name", F.lit(1)), F.col("parts")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(part, j), F.greatest(part, j)))
    point = [c for c in rows.columns if c not in ("key", "hot", "parts")]
    return rows.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(cut)).alias("key"), *point).repartition("key")


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Links a, b between the names of dealt rows."""

    def search(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            keys, names, *point = (np.concatenate(c) for c in zip(*held))
            a, b = shard_links(keys, np.stack(point, axis=1).view(np.uint64), names, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(tidy(search), "a long, b long").distinct()


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS, name: str = "fp") -> DataFrame:
    """Links a, b between the names of points with distinct values of fp, so that components are those of all pairs within
    the radius."""
    rows = points.select(F.explode(F.array(*shard_keys(radius, blocks))).alias("key"), F.col(name).alias("name"), "fp")
    return _linked(_dealt(rows, shard_rows), radius)


def _told(rows: DataFrame, key: str, name: str, table: DataFrame) -> DataFrame:
    """The rows with the value that a table (at, value) has for their key, null where it has none. A key of many rows is
    dealt by name to SALTS parts, each of which asks the table once, so no task gets all rows of a large component."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
    asked = rows.select(F.col(key).alias("k"), F.col("salt").alias("s")).distinct()
    asked = asked.join(table, F.col("k") == F.col("at"), "left").select("k", "s", "value")
    return rows.join(asked, (F.col(key) == F.col("k")) & (F.col("salt") == F.col("s")), "left").drop("salt", "k", "s")


def _lowest(points: DataFrame, name: str) -> DataFrame:
    """The points (root, least) with component_id, the smallest least of their root."""
    part = F.pmod(F.xxhash64(name), F.lit(SALTS)).alias("part")
    lowest = points.groupBy("root", part).agg(F.min("least").alias("value")).groupBy(F.col("root").alias("at")).agg(F.min("value").alias("value"))
    return _told(points, "root", name, lowest).withColumnRenamed("value", "component_id")


def _forest(batches):
    """node and root of all edges a, b of one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[roots(len(nodes), at[: len(a)], at[len(a) :])]
        for i in range(0, len(nodes), 1 << 16):
            yield _batch(nodes[i : i + (1 << 16)], root[i : i + (1 << 16)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges a, b."""
    return contracted(durable(edges.where("a <> b").distinct()))


def contracted(edges: DataFrame) -> DataFrame:
    """components of durable edges, by contraction: each round every node takes its smallest neighbour, pointers are doubled,
    and the edges are redrawn between what they point to. The last LOCAL_EDGES or fewer are left to one task."""
    member = None
    while n := edges.count():
        if n <= LOCAL_EDGES:
            point = durable(edges.coalesce(1).mapInArrow(tidy(_forest), "node long, root long"))
        else:
            both = edges.union(edges.select("b", "a"))
            point = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
            for _ in range(2):
                up = point.select(F.col("node").alias("at"), F.col("root").alias("value"))
                point = durable(_told(point, "root", "node", up).select("node", F.col("value").alias("root")))
        up = point.select(F.col("node").alias("at"), F.col("root").alias("value"))
        if member is None:
            member = point
        else:
            member = durable(_told(member, "root", "node", up).select("node", F.coalesce("value", "root").alias("root")))
        if n <= LOCAL_EDGES:
            break
        edges = _told(edges, "a", "b", up).withColumnRenamed("value", "r1")
        edges = _told(edges, "b", "a", up).where("r1 <> value").select(F.greatest("r1", "value").alias("a"), F.least("r1", "value").alias("b"))
        edges = durable(edges.distinct())
    if member is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return member


def groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of each row."""
    marked = durable(fingerprints(docs, words))
    points = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(points.select("fp"), radius))
    points = points.join(member, points.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    points = durable(_lowest(points, "fp").select(F.col("fp").alias("f2"), "component_id"))
    return marked.join(points, marked.fp == points.f2).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id of each row that has a row with a smaller doc_id in its group; repeated doc_ids count once."""
    return groups(docs, radius, words).where("component_id < doc_id").select("doc_id").distinct()


# --- by similarity of shingle sets ------------------------------------------------------------------------------------------


def shingle_set(text: bytes, words: int = WIDE_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, words))


def sketch(hashes: np.ndarray) -> bytes:
    """For each of SKETCH_BITS slots, whether an odd number of the hashes falls there. The sketches of two sets differ in at
    most as many bits as the sets do in members."""
    odd = np.bincount((hashes >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(batches, words: int):
    """(doc_id column; for each text its shingles' hashes, their set and the set's hash, 0 for an empty one) of runs of
    rows."""
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column(1)):
            raw = data.tobytes()
            hashes = [shingle_hashes(raw[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sets = [np.unique(x) for x in hashes]
            nodes = np.array([xxh64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            yield batch.column(0).slice(i, j - i), hashes, sets, nodes


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle of each slot. Only the order of shingles depends on it, never what is found."""

    def count(batches):
        sums = np.zeros(SLOTS, np.int64)
        for _, _, sets, _ in _sets(batches, words):
            sums += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        for k in range(0, SLOTS, _BLOCK):
            if sums[k : k + _BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k : k + _BLOCK].tobytes()], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    total = np.zeros(SLOTS, np.int64)
    for row in docs.mapInArrow(tidy(count), schema).repartition("block").mapInArrow(tidy(add), schema).collect():  # 8 MB, in one job
        total[row.block : row.block + _BLOCK] = np.frombuffer(row.counts, np.int64)
    return total.astype(np.uint32) if total.max() < 1 << 32 else total


def _prefixes(docs: DataFrame, words: int) -> DataFrame:
    """The first column (row), node, fingerprint, and the prefix: the shingles of which two sets at the threshold share one, the rarest
    first."""
    shipped = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, words))

    def scan(batches):
        seen = shipped.value
        for ids, hashes, sets, nodes in _sets(batches, words):
            short = []
            for x in sets:
                n = len(x) - -(-len(x) * NEAR[0] // NEAR[1]) + 1 if len(x) else 0
                order = np.lexsort((x, seen[(x & np.uint64(SLOTS - 1)).astype(np.int64)]))
                short.append(x[order[:n]].view(np.int64))
            ends = np.cumsum([0, *map(len, short)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(short)))
            points = np.array([majority(x) for x in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes), pa.array(points), pa.array([len(x) for x in sets], pa.int64()), lists], ["row", "node", "fp", "size", "prefix"])

    return docs.mapInArrow(tidy(scan), f"row {docs.schema[0].dataType.simpleString()}, node long, fp long, size long, prefix array<long>")


def _fingerprint_pairs(made: DataFrame, shard_rows: int) -> DataFrame:
    """Each node with the first of its fingerprint, and those with the ones that links join them to."""
    points = made.select("node", "fp").distinct()
    first = points.groupBy("fp").agg(F.min("node").alias("first"))
    same = points.join(first.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = same.union(links(first, shard_rows=shard_rows, name="first")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(batches, columns: int):
    """All rows as arrays, in order of token, size, node, without repeats; bounds of the tokens."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return [np.zeros(0, np.int64)] * columns, np.zeros(1, np.int64)
    rows = [np.concatenate(c) for c in zip(*held)]
    order = np.lexsort((rows[1], rows[2], rows[0]))
    token, node = rows[0][order], rows[1][order]
    order = order[np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]]
    rows = [c[order] for c in rows]
    return rows, np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1], True])


def _near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return NEAR[1] * np.minimum(a, b) >= NEAR[0] * np.maximum(a, b)


def _batch(*columns, names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _shared(tokens: DataFrame) -> DataFrame:
    """Rows token, node, size of the tokens that several nodes have."""

    def keep(batches):
        rows, bounds = _grouped(batches, 3)
        kept = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        yield _batch(*(c[kept] for c in rows), names=["token", "node", "size"])

    return tokens.repartition("token").mapInArrow(tidy(keep), "token long, node long, size long")


def _open_rows(batches):
    """Of rows token, node, size, root: those of tokens whose nodes aren't all in one component yet, in order, and bounds
    of the tokens."""
    (token, node, size, root), bounds = _grouped(batches, 4)
    if not len(token):
        return token, node, size, root, bounds
    n = np.diff(bounds)
    kept = np.repeat(np.minimum.reduceat(root, bounds[:-1]) < np.maximum.reduceat(root, bounds[:-1]), n)
    token, node, size, root = token[kept], node[kept], size[kept], root[kept]
    return token, node, size, root, np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)


def _rooted(shared: DataFrame, member: DataFrame) -> DataFrame:
    """The rows with the root of their node's component, dealt by token."""
    own = shared.join(member.select(F.col("node").alias("m"), F.col("root").alias("r")).hint("merge"), F.col("node") == F.col("m"), "left")
    return own.select("token", "node", "size", F.coalesce("r", "node").alias("root")).repartition("token")


def _first_pairs(shared: DataFrame, member: DataFrame) -> DataFrame:
    """Of each token, each node with the one before it and with the first, of another component: two pairs a row at most."""

    def emit(batches):
        _, node, size, root, bounds = _open_rows(batches)
        at = np.arange(1, max(1, len(node)))
        lead = np.repeat(bounds[:-1], np.diff(bounds))[1:]
        at, lead = at[lead != at], lead[lead != at]
        a, b = np.r_[at, at], np.r_[at - 1, lead]
        ok = _near_sizes(size[a], size[b]) & (root[a] != root[b])
        pairs = np.unique(np.sort(np.stack([node[a[ok]], node[b[ok]]], axis=1), axis=1), axis=0)
        yield _batch(pairs[:, 0], pairs[:, 1], names=["a", "b"])

    return _rooted(shared, member).mapInArrow(tidy(emit), "a long, b long").distinct()


def _open(shared: DataFrame, member: DataFrame) -> DataFrame:
    """The rows, with roots, of tokens whose nodes aren't all in one component yet."""

    def keep(batches):
        *rows, _ = _open_rows(batches)
        yield _batch(*rows, names=["token", "node", "size", "root"])

    return _rooted(shared, member).mapInArrow(tidy(keep), "token long, node long, size long, root long")


def _sketches_near(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """Sets of similarity s differ in at most (1 - s) / (1 + s) of the sum of their sizes."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (NEAR[1] + NEAR[0]) * differ <= (NEAR[1] - NEAR[0]) * (size_x + size_y)


def _words(column) -> np.ndarray:
    """A column of binaries of equal lengths as rows of 64-bit values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def near_pairs(token: int, size: np.ndarray, sketches: np.ndarray, root: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a token's rows, in order of size, with different roots whose sizes and sketches allow the threshold, and
    whose least tokens show no smaller one that both have: there the pair is found already."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    least = np.where(least < token, least, np.iinfo(np.int64).max)
    for i in range(0, len(size), 64):
        own = slice(i, min(i + 64, len(size)))
        end = int(np.searchsorted(size, NEAR[1] * size[own.stop - 1] // NEAR[0], "right"))
        a, b = size[own][:, None], size[None, i:end]
        p, q = np.nonzero((root[own][:, None] != root[None, i:end]) & (NEAR[1] * a >= NEAR[0] * b) & (np.arange(i, own.stop)[:, None] < np.arange(i, end)[None]))
        for k in range(0, len(p), 1 << 14):
            x, y = p[k : k + (1 << 14)] + i, q[k : k + (1 << 14)] + i
            good = _sketches_near(sketches[x], sketches[y], size[x], size[y])
            x, y = x[good], y[good]
            before = ((least[x][:, :, None] == least[y][:, None]) & (least[x] < token)[:, :, None]).any(axis=(1, 2))
            found.append((x[~before], y[~before]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _across(open_: DataFrame, sets: DataFrame, shard_rows: int) -> DataFrame:
    """Pairs of open rows (token, node, size, root) of a token that aren't in one component and that near_pairs finds."""
    own = open_.groupBy("node", "size", "root").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    own = own.join(sets.select(F.col("node").alias("s"), "sketch").hint("merge"), F.col("node") == F.col("s"))
    rows = own.select(F.explode("tokens").alias("token"), F.col("node").alias("name"), "size", "root", "sketch", F.slice("tokens", 1, FIRST_TOKENS).alias("least"))
    rows = rows.withColumn("key", F.col("token"))

    def emit(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, token, node, size, root = (table.column(c).to_numpy() for c in ("key", "token", "name", "size", "root"))
        bits = _words(table.column("sketch"))
        lists = table.column("least").combine_chunks()
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        least = np.full((len(key), FIRST_TOKENS), np.iinfo(np.int64).max)
        least[np.arange(FIRST_TOKENS)[None] < n[:, None]] = pc.list_flatten(lists).to_numpy()
        order = np.lexsort((node, size, key))
        key, token, node, size, root, bits, least = (c[order] for c in (key, token, node, size, root, bits, least))
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if j - i > 1 and (root[i:j] != root[i]).any():
                x, y = near_pairs(token[i], size[i:j], bits[i:j], root[i:j], least[i:j])
                if len(x):
                    yield _batch(np.minimum(node[i + x], node[i + y]), np.maximum(node[i + x], node[i + y]), names=["a", "b"])

    return _dealt(rows, shard_rows).mapInArrow(tidy(emit), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, words: int, sketched: bool = False) -> DataFrame:
    """The pairs whose sets reach the threshold. A pair with a node that shares no token isn't among them."""

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_words(batch.column(c)) for c in ("k1", "k2"))
                s1, s2 = (batch.column(c).to_numpy() for c in ("s1", "s2"))
                yield batch.select(["a", "b"]).filter(pa.array(_sketches_near(x, y, s1, s2) & _near_sizes(s1, s2)))

    def test(batches):
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (shingle_set(v.as_buffer().to_pybytes(), words) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near[k] = NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    def beside(pairs, sets, **columns):
        one, two = (sets.select(F.col("node").alias(f"n{k}"), *(F.col(c).alias(f"{name}{k}") for name, c in columns.items())) for k in (1, 2))
        return pairs.join(one.hint("merge"), F.col("a") == F.col("n1")).drop("n1").join(two.hint("merge"), F.col("b") == F.col("n2")).drop("n2")

    if not sketched:
        pairs = beside(pairs, sets, s="size", k="sketch").mapInArrow(tidy(likely), "a long, b long")
    pairs = durable(pairs.hint("rebalance"))
    if pairs.count() <= WANTED:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
        sets = sets.join(F.broadcast(wanted), F.col("node") == F.col("w"), "left_semi")
    return durable(beside(pairs, sets, t="text").select("a", "b", "t1", "t2").mapInArrow(tidy(test), "a long, b long").hint("rebalance"))


def row_keys(docs: DataFrame) -> dict:
    """Columns that tell rows apart, unless they are equal in doc_id and text: a null doc_id has a stand-in."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "row_hash": F.xxhash64(text)}


def _grouped_rows(docs: DataFrame, words: int, shard_rows: int) -> DataFrame:
    """doc_id, row_id, row_hash and first (the row_id and row_hash of the row that stands for the group: that of the smallest
    doc_id, null ids last) of each row."""
    gc = docs.sparkSession.sparkContext._jvm.System.gc  # lets Spark remove the shuffle files of what is stored
    keys = row_keys(docs)
    docs = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in keys.items())).alias("row"), F.col("text").cast("string").alias("text"))
    made = stored(_prefixes(docs, words))
    shared = stored(_shared(made.select(F.explode("prefix").alias("token"), "node", "size")))
    kept = stored(made.select("row.*", "node", "fp"))
    discard(made)
    gc()
    marked = kept.select("doc_id", "row_id", "row_hash", "node")
    points = marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "row_id", "row_hash")).alias("least"))

    # the text of one document of each node that shares a token
    needed = shared.select(F.col("node").alias("n")).distinct().join(points.hint("merge"), F.col("n") == F.col("node")).select("node", F.col("least.row_id").alias("i"), F.col("least.row_hash").alias("h"))
    texts = docs.join(needed.hint("merge"), (F.col("row.row_id") == F.col("i")) & (F.col("row.row_hash") == F.col("h"))).select("node", "text")

    def own(batches):
        seen: set[int] = set()  # of the task, which has all rows of a doc_id and text
        for batch in batches:
            at = 0
            for wanted, _, found, nodes in _sets([batch], words):
                rows = batch.slice(at, len(nodes))
                rows = pa.RecordBatch.from_arrays([wanted, rows.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary())], ["node", "text", "size", "sketch"])
                yield rows.filter(pa.array([x == y and not (x in seen or seen.add(x)) for x, y in zip(wanted.to_pylist(), nodes.tolist())], pa.bool_()))
                at += len(nodes)

    sets = stored(texts.mapInArrow(tidy(own), "node long, text string, size long, sketch binary"))
    gc()
    near = _verified(_fingerprint_pairs(kept, shard_rows), sets, words)
    gc()
    near = near.union(_verified(_first_pairs(shared, contracted(near)), sets, words))
    gc()
    open_ = stored(_open(shared, contracted(near)))
    discard(shared)
    gc()
    near = near.union(_verified(_across(open_, sets, shard_rows), sets, words, sketched=True))
    gc()
    discard(open_)
    discard(sets)
    member = contracted(near)
    gc()
    grouped = points.join(member.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("node", "least", "root")
    grouped = _lowest(grouped, "node").select(F.col("node").alias("n2"), "component_id")
    least = points.join(grouped, F.col("node") == F.col("n2"), "left").select(F.col("node").alias("at"), F.coalesce("component_id", "least").alias("value"))
    return _told(marked, "node", "row_id", least).select("doc_id", "row_id", "row_hash", F.col("value").alias("first"))


def similar(docs: DataFrame, words: int = WIDE_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the group, null if none has one) of each row; empty texts are one
    group."""
    found = _grouped_rows(docs, words, shard_rows)
    return found.select("doc_id", F.when(~F.col("first.no_id"), F.col("first.row_id")).alias("component_id"))


def without_similar(docs: DataFrame, words: int = WIDE_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows without those that a row of their group stands for: of each group one row stays, that of the smallest doc_id
    (null ids last). Rows go one by one: a text stays if nothing is similar to it, whatever other rows have its doc_id. Of
    rows that are equal in doc_id and text, one stays."""
    found = _grouped_rows(docs, words, shard_rows)
    gone = found.where((F.col("row_id") != F.col("first.row_id")) | (F.col("row_hash") != F.col("first.row_hash")))
    gone = gone.select(F.col("row_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("given"), *(c.alias(k) for k, c in row_keys(docs).items()))
    # a merge join at every size: the plan stays the same as the corpus grows
    kept = keyed.join(gone.hint("merge"), (F.col("row_id") == F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")), "left_anti")
    place = F.row_number().over(Window.partitionBy("row_id", "row_hash").orderBy(F.xxhash64("given")))
    return kept.withColumn("place", place).where("place = 1").select("given.*")
