"""LM scoring: cross-entropy difference between a target and a background bigram model.

Both models count words (as in toxicity) and pairs of neighbours by 64-bit hash, each on its own, so the tables of counts
grow with the corpus. The background counts every word of every document, the target those of the documents labelled as
wanted. A pair's probability mixes its relative frequency with that of the word; both models use the same smoothing. A
document's score is the mean over its words of the target's loss less the background's: below zero, it is more like the
target.

The counts are never broadcast or collected:

1. Documents are packed into runs of about RUN bytes of text, which are stored.
2. Each run counts its words and pairs and sends them, sorted and cut by the leading bits of the hash, to BUCKETS buckets.
   A bucket adds up what all runs sent, and answers each run with the corpus's counts of the run's own words and pairs.
3. The answers meet their run, in the order that it has sent, and it scores its documents. Only three numbers go through
   the driver: how many words there are in each model, and how many distinct ones.

A common word or pair is one entry of a run, however often the run has it, so no bucket gets more of it than there are runs.

Null and empty texts have no words and score 0. Rows repeat as in the input and count as often; a doc_id labelled more
than once is wanted if any row says so. Null labels are ignored, null doc_ids are never wanted. Without wanted documents
the target knows nothing and all words cost the same in it. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaks import words
from .text import chunks, mix, stored

MIX, ADD = 0.7, 0.5
#: Bytes of text that are counted as one.
RUN = 1 << 24
BUCKETS = 256
#: Entries of a bucket that are sorted at a time, about.
PART = 1 << 20
_FIRST = np.uint64(0x51ED270B9F6C2E35)
_WORDS, _PAIRS = 0, 1


def packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs of documents: run, doc_ids, targets, texts (compressed)."""
    marked = wanted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("w")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a merge join at every size: a side that is broadcast while it is small would change the plan as the corpus grows
    rows = texts.join(marked.hint("merge"), texts.doc_id == marked.w, "left").select("doc_id", F.col("w").isNotNull().alias("target"), "text")

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            own = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), c.chunk(0)) for c in own.columns[:2]]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *lists, pa.array([_squeezed(own.column(2).chunk(0))], pa.binary())], ["run", "doc_ids", "targets", "texts"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            a = 0
            while a < batch.num_rows:
                done = int(ends[a - 1]) if a else 0
                b = max(a + (not held), int(np.searchsorted(ends, done + RUN - size, "right")))
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(ends[b - 1]) - done
                if b < batch.num_rows:
                    yield flush()
                    made, held, size = made + 1, [], 0
                a = b
        if held:
            yield flush()

    return rows.mapInArrow(pack, "run long, doc_ids array<long>, targets array<boolean>, texts binary")


def _squeezed(texts: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], ["text"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _texts(raw: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(raw.as_buffer()).read_next_batch().column(0)


def keys(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(number of words of each text; for words, with the mark before each text last, and for pairs: the distinct hashes in
    order, and which of them each one is; where the word before each word is among the distinct words)."""
    sizes, found = [], []
    for _, _, data, offsets in chunks(texts):
        bounds, h = words(data, offsets)
        sizes.append(np.diff(bounds))
        found.append(h)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = _FIRST
    pair = np.unique(mix(before * np.uint64(0xD6E8FEB86659FD93) + h), return_inverse=True)
    word = np.unique(np.append(h, np.full(len(starts), _FIRST)), return_inverse=True)
    back = np.empty(len(h), np.int64)
    back[1:] = word[1][: len(h)][:-1]
    back[starts] = word[1][len(h) :]
    return sizes, [word[0], pair[0]], [word[1], pair[1]], back


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold each."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


def _steps(hashes: np.ndarray, bucket: int) -> bytes:
    """Hashes of a bucket in order as their differences, byte by byte, so that the upper bytes' zeros lie together."""
    return np.diff(hashes, prepend=np.uint64(bucket * ((1 << 64) // BUCKETS))).view(np.uint8).reshape(-1, 8).T.tobytes()


def _hashes(raw: pa.Buffer, bucket: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]
    return np.cumsum(steps) + np.uint64(bucket * ((1 << 64) // BUCKETS))


def counted(runs: DataFrame) -> DataFrame:
    """For each run, kind and bucket, in the order of the run's distinct hashes: n and n_target (the corpus's counts), size;
    and in one row of each bucket: n_distinct, n_all, n_wanted, of its words."""

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, distinct, which, _ = keys(_texts(batch.column("texts")[row]))
                target = batch.column("targets")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                own = np.repeat(target, sizes)
                owned = {_WORDS: np.append(own, target[sizes > 0]), _PAIRS: own}
                out = []
                for kind in (_WORDS, _PAIRS):
                    u = distinct[kind]
                    n = np.bincount(which[kind], minlength=len(u))
                    wanted = np.bincount(which[kind][owned[kind]], minlength=len(u))
                    cuts = np.searchsorted(u, np.arange(BUCKETS, dtype=np.uint64) * np.uint64((1 << 64) // BUCKETS)).tolist() + [len(u)]
                    out += [(k, kind, _steps(u[a:b], k), _small(n[a:b]), _small(wanted[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if out:
                    bucket, kind, *raw = zip(*out)
                    run = pa.array([batch.column("run")[row].as_py()] * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), run, pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in raw)], ["bucket", "run", "kind", "hashes", "n", "n_target"])

    def add(table: pa.Table) -> pa.Table:
        runs, kinds = table.column("run").to_pylist(), table.column("kind").to_numpy()
        sent = [_hashes(x.as_buffer(), table.column("bucket")[0].as_py()) for x in table.column("hashes")]
        given = [[_wide(x, len(s)) for x, s in zip(table.column(c).to_pylist(), sent)] for c in ("n", "n_target")]
        told = np.zeros((3, len(sent)), np.int64)
        answers: list = [[b""] * len(sent), [b""] * len(sent)]
        for kind in (_WORDS, _PAIRS):
            rows = np.flatnonzero(kinds == kind).tolist()
            if not rows:
                continue
            parts = max(1, sum(len(sent[r]) for r in rows) // PART)
            least = (1 << 64) // BUCKETS // parts
            base = table.column("bucket")[0].as_py() * ((1 << 64) // BUCKETS)
            inner = np.array([base + p * least for p in range(1, parts)], np.uint64)
            cuts = [[0, *np.searchsorted(sent[r], inner).tolist(), len(sent[r])] for r in rows]
            sums = [[np.empty(len(sent[r]), np.int64) for r in rows] for _ in given]
            for p in range(parts):
                u, which = np.unique(np.concatenate([sent[r][c[p] : c[p + 1]] for r, c in zip(rows, cuts)]), return_inverse=True)
                if kind == _WORDS:
                    told[0, rows[0]] += len(u)
                for k, own in enumerate(given):
                    x = np.concatenate([own[r][c[p] : c[p + 1]] for r, c in zip(rows, cuts)])
                    total = np.bincount(which, x, len(u)).astype(np.int64)  # exact below 2**53
                    if kind == _WORDS:
                        told[1 + k, rows[0]] += int(x.sum())
                    every, at = total[which], 0
                    for i, c in enumerate(cuts):
                        sums[k][i][c[p] : c[p + 1]] = every[at : at + c[p + 1] - c[p]]
                        at += c[p + 1] - c[p]
            for k in range(2):
                for r, x in zip(rows, sums[k]):
                    answers[k][r] = _small(x)
        return pa.Table.from_arrays(
            [table.column("bucket"), pa.array(runs, pa.int64()), table.column("kind"), pa.array([len(x) for x in sent], pa.int64()), *(pa.array(x, pa.binary()) for x in answers), *map(pa.array, told)],
            ["bucket", "run", "kind", "size", "n", "n_target", "n_distinct", "n_all", "n_wanted"],
        )

    asked = runs.select("run", "targets", "texts").mapInArrow(send, "bucket int, run long, kind int, hashes binary, n binary, n_target binary")
    return asked.groupBy("bucket").applyInArrow(add, "bucket int, run long, kind int, size long, n binary, n_target binary, n_distinct long, n_all long, n_wanted long")


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, difference of each row; losses are nats a word."""
    gc = docs.sparkSession.sparkContext._jvm.System.gc  # lets Spark remove the shuffle files of what is stored
    runs = stored(packed(docs, wanted))
    gc()
    counts = stored(counted(runs))
    gc()
    whole = counts.agg(F.sum("n_distinct"), F.sum("n_wanted"), F.sum("n_all")).first()
    shared, totals = max(1, whole[0] or 0), [whole[1] or 0, whole[2] or 0]

    def score(run: pa.Table, answers: pa.Table) -> pa.Table:
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "size", "n_target", "n"))))
        table = [[np.concatenate([np.zeros(0, np.int64), *(_wide(x[3 + k], x[2]) for x in told if x[0] == kind)]) for k in range(2)] for kind in (_WORDS, _PAIRS)]
        out = []
        for row in range(run.num_rows):
            sizes, _, (word, pair), before = keys(_texts(run.column("texts")[row]))
            word = word[: len(pair)]
            at = np.repeat(np.arange(len(sizes)), sizes)
            loss = np.zeros((2, len(sizes)))
            for k in range(2):
                alone = (table[_WORDS][k][word] + ADD) / (totals[k] + ADD * shared)
                after = table[_PAIRS][k][pair] / np.maximum(1, table[_WORDS][k][before])
                loss[k] = np.bincount(at, -np.log(MIX * after + (1 - MIX) * alone), len(sizes)) / np.maximum(1, sizes)
            out.append(pa.table([run.column("doc_ids")[row].values, *map(pa.array, (sizes.astype(np.int64), loss[0], loss[1], loss[0] - loss[1]))], ["doc_id", "n_words", "target_loss", "background_loss", "difference"]))
        return pa.concat_tables(out)

    both = runs.select("run", "doc_ids", "texts").groupBy("run").cogroup(counts.select("run", "kind", "bucket", "size", "n", "n_target").groupBy("run"))
    return both.applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, difference double")
