"""Documents from pieces in streams: what a piece costs, repeats, late pieces, gaps, restarts."""

import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest

from tagweft.functions import html as H
from tagweft.operators import tables as X
from tagweft.sources import html as sources
from tagweft.streaming import chunks as C

START = datetime(2024, 1, 1, tzinfo=UTC)


class FakeState:
    """A list or value of the state store that counts the characters written."""

    def __init__(self):
        self.held, self.written, self.puts = [], 0, 0

    def appendList(self, rows):
        self.held += rows
        self.written += sum(len(t) for _, t in rows)

    def put(self, rows):
        self.held, self.puts = list(rows), self.puts + 1

    def get(self):
        return self.held or None

    def exists(self):
        return bool(self.held)

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = []


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, schema):
        return self.states.setdefault(name, FakeState())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def assembler(wait_ms=1000):
    own = C.Assembler(wait_ms, True)
    own.init(FakeHandle())
    return own


def feed(own, *pieces):
    """Rows given out for (seq, chunk, is_last, ms) pieces, a batch each call."""
    frame = pd.DataFrame(pieces, columns=["seq", "chunk", "is_last", "at_ms"])
    return [r for df in own.handleInputRows((1,), iter([frame]), None) for r in df.to_dict("records")]


def test_a_piece_costs_its_own_size():
    own = assembler()
    n = 300
    out = [r for k in range(n) for r in feed(own, (k, "x" * 50, k == n - 1, k))]
    pieces = own.handle.states["pieces"]
    assert pieces.written == 50 * n and pieces.puts == 0 and not pieces.held
    assert [(len(r["html"]), r["complete"]) for r in out] == [(50 * n, True)] and len(own.handle.timers) == 1


def test_repeats_and_surplus_pieces():
    own = assembler()
    assert feed(own, (1, "b", True, 5), (1, "a", True, 5), (None, None, None, 9), (-1, "z", None, 9)) == []
    assert own.handle.states["summary"].held[0] == 1  # the repeated one is gone
    assert feed(own, (0, None, False, 1))[0]["html"] == "a"
    assert feed(own, (0, "late", False, 50)) == [] and not own.handle.states["pieces"].held  # done already
    assert list(own.handleExpiredTimer((1,), None, None)) == [] and not own.handle.states["summary"].held
    other = assembler()
    assert feed(other, (0, "a", True, 1), (2, "c", False, 1)) == []  # a piece beyond the last
    row = next(other.handleExpiredTimer((1,), None, None)).to_dict("records")[0]
    assert (row["html"], row["complete"], row["gap_first"]) == ("ac", False, [1])


@pytest.mark.parametrize("seqs,last,expected", [([], -1, ([0], [None])), ([], 0, ([0], [0])), ([0, 1], -1, ([2], [None])), ([0, 3, 4, 7], 9, ([1, 5, 8], [2, 6, 9])), ([1], 1, ([0], [0])), ([0, 1], 1, ([], []))])
def test_gaps(seqs, last, expected):
    assert C.gaps(seqs, last) == expected


def slow(runs, delay=600, wait=600):
    """What a stream comes to, run by run: the watermark follows each run; a piece behind it is dropped."""
    watermark, held, closed = float("-inf"), {}, []
    for rows in runs:
        for doc, seq, text, last, at in rows:
            if doc is None or seq is None or at < watermark:
                continue
            held.setdefault(doc, {"pieces": {}, "last": -1, "at": at, "done": False})
            d = held[doc]
            d["at"] = max(d["at"], at)
            if d["done"]:
                continue
            d["pieces"].setdefault(seq, text)
            if last:
                d["last"] = max(d["last"], seq)
        for doc, d in held.items():
            if not d["done"] and d["last"] >= 0 and sorted(d["pieces"]) == list(range(d["last"] + 1)):
                closed.append((doc, "".join(d["pieces"][k] for k in sorted(d["pieces"])), True, ()))
                d["done"] = True
        watermark = max([watermark, *(r[4] - delay for r in rows)])
        for doc in [k for k, d in held.items() if d["at"] + wait < watermark]:
            d = held.pop(doc)
            if not d["done"]:
                closed.append((doc, "".join(d["pieces"][k] for k in sorted(d["pieces"])), False, tuple(zip(*C.gaps(d["pieces"], d["last"])))))
    return sorted(closed)


def test_late_pieces_against_a_plain_version(spark, tmp_path):
    rng = random.Random(4)
    pieces = [(doc, seq, f"{doc}.{seq} ", seq == 3, doc + seq) for doc in range(40) for seq in range(4)]
    runs = [[], [], []]
    for p in pieces:
        where = rng.choice([(0,), (0,), (0,), (0, 1), (1,), (2,), ()])  # once, repeated, late, too late, never
        for k in where:
            runs[k].append(p)
    for k, hour in enumerate((0, 1, 24)):
        runs[k] += [(None, None, None, None, 3600 * hour)]
        rng.shuffle(runs[k])
    session = C.streaming_session(spark)
    for rows in runs:  # each goes on from the checkpoint of the one before
        timed = [(*r[:4], START + timedelta(seconds=r[4])) for r in rows]
        spark.createDataFrame(timed, sources.TIMED_CHUNKS).write.mode("append").parquet(str(tmp_path / "in"))
        found = C.take(C.assemble_events(sources.read_chunks(session, str(tmp_path / "in"), streaming=True, timed=True)), str(tmp_path))
    got = sorted((r.doc_id, r.html, r.complete, tuple(zip(r.gap_first, r.gap_last))) for r in found.collect())
    assert got == slow(runs) and {r[2] for r in got} == {True, False}
    assert C.gap_table(found).count() == sum(len(r[3]) for r in got)


def test_stale_documents_are_closed_by_the_clock(spark, tmp_path):
    session = C.streaming_session(spark)
    spark.createDataFrame([(1, 0, "a", False), (2, 0, "<p>b", True), (None, 0, "c", True)], sources.CHUNKS).write.parquet(str(tmp_path / "in"))
    stream = C.assemble_stream(sources.read_chunks(session, str(tmp_path / "in"), streaming=True), wait_ms=1)
    running = stream.writeStream.format("memory").queryName("stale").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            rows = session.sql("SELECT * FROM stale").collect()
            if len(rows) == 2:
                break
            running.awaitTermination(1)
    finally:
        running.stop()
    assert sorted((r.doc_id, r.html, r.complete) for r in rows) == [(1, "a", False), (2, "<p>b", True)]


def test_fragments_and_empty_documents_from_pieces(spark):
    rows = [(1, 0, "<t", False), (1, 1, "d>x", True), (2, 0, "", True), (3, 0, None, True)]
    whole = C.assemble(spark.createDataFrame(rows, sources.CHUNKS)).where("complete")
    cells = {r.doc_id: r.p.html for r in whole.select("doc_id", H.html_parse_fragment((H.TEXT_HTML,), context="tr")("html").alias("p")).collect()}
    assert cells == {1: "<td>x</td>", 2: "", 3: ""}
    assert {r.doc_id: r.html for r in X.serialized(whole, "doc_id").collect()}[2] == "<html><head></head><body></body></html>"
