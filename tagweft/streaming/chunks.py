"""Documents that arrive in pieces: (doc_id, seq, chunk, is_last), in streams with the time of each piece as well.

A document is whole when its pieces 0 to n are there and n is marked as the last. Any cutting gives the same document, so
batches join the pieces and parse once.

In a stream, pieces are appended to a list in the state store, so that each is written once and read once, when its document
is given out: a piece costs its own size, however many came before. Beside the list stands a summary of a few numbers. A timer
closes documents that get no more pieces. Streams with event times first drop what lies behind the watermark and pieces
that repeat within it; what is missing when a document is closed is given as ranges of seq.

A document of which all pieces were taken leaves its summary behind until its timer, so that late repeats don't open it again.
Rows without a doc_id or a seq, or with a seq below 0, hold no piece; with a time, they only move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import html as H

#: What streams give out. gap_first, gap_last: the ranges of missing pieces; the end of the last one is null where the end of
#: the document isn't known.
ASSEMBLED = "doc_id long, html string, complete boolean, gap_first array<long>, gap_last array<long>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that lists and timers take."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return session


def assemble(chunks: DataFrame) -> DataFrame:
    """doc_id, html, complete of a batch. Repeated pieces count once (the least text of one seq)."""
    one = chunks.groupBy("doc_id", "seq").agg(F.min("chunk").alias("chunk"), F.max("is_last").alias("is_last"))
    whole = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("pieces"), F.max(F.when(F.col("is_last"), F.col("seq"))).alias("last"), F.min("seq").alias("first"))
    html = F.array_join(F.transform("pieces", lambda p: F.coalesce(p["chunk"], F.lit(""))), "")
    complete = F.coalesce((F.col("first") == 0) & (F.size("pieces") == F.col("last") + 1), F.lit(False))
    return whole.select("doc_id", html.alias("html"), complete.alias("complete"))


def assemble_fragments(chunks: DataFrame, context: str = "template", facets=(H.NODES,), **options) -> DataFrame:
    """doc_id and p, the PARSED of fragments that arrive in pieces; incomplete ones are left out."""
    return chunks.transform(assemble).where("complete").select("doc_id", H.html_parse_fragment(facets, context=context, **options)("html").alias("p"))


def distinct_pieces(pieces) -> dict[int, str]:
    """seq -> text; of repeated ones the least."""
    found: dict[int, str] = {}
    for seq, text in pieces:
        text = text or ""
        found[seq] = min(found.get(seq, text), text)
    return found


def gaps(seqs, last: int) -> tuple[list[int], list[int | None]]:
    """Starts and ends of the ranges that are missing from 0 to last (below 0: not known)."""
    first: list[int] = []
    until: list[int | None] = []
    due = 0
    for seq in sorted(seqs):
        if seq > due:
            first.append(due)
            until.append(seq - 1)
        due = seq + 1
    if last < 0 or due <= last:
        first.append(due)
        until.append(last if last >= 0 else None)
    return first, until


class Assembler(StatefulProcessor):
    """Joins the pieces of a document. wait_ms: how long after its latest piece it is closed; None: never."""

    def __init__(self, wait_ms: int | None, by_event: bool):
        self.wait_ms, self.by_event = wait_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, chunk string")
        self.summary = handle.getValueState("summary", "n long, last long, due long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, due, done = self.summary.get() or (0, -1, -1, False)
        latest, new = -1, []
        for batch in rows:
            batch = batch[batch["seq"].notna() & (batch["seq"] >= 0)]
            if not len(batch):
                continue
            new += zip(batch["seq"].astype(int).tolist(), batch["chunk"].where(batch["chunk"].notna(), "").tolist())
            marked = batch.loc[batch["is_last"].eq(True), "seq"]
            last = max([last, *marked.astype(int).tolist()])
            if self.by_event:
                latest = max(latest, int(batch["at_ms"].max()))
        if not new:
            return
        due = self._postponed(due, latest if self.by_event else timerValues.getCurrentProcessingTimeInMs())
        if done:
            self.summary.update((0, last, due, True))
            return
        self.pieces.appendList(new)
        n += len(new)
        if 0 <= last < n:
            found = distinct_pieces(self.pieces.get())
            if len(found) == last + 1 and max(found) == last:
                self.pieces.clear()
                self.summary.update((0, last, due, True))
                yield self._row(key, found, last, True)
                return
            if len(found) < n:  # some were repeated
                n = len(found)
                self.pieces.put(list(found.items()))
        self.summary.update((n, last, due, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.summary.exists():
            return
        _, last, _, done = self.summary.get()
        if not done:
            yield self._row(key, distinct_pieces(self.pieces.get()), last, False)
        self.pieces.clear()
        self.summary.clear()

    def _postponed(self, due: int, latest: int) -> int:
        """The time of the document's one timer."""
        if self.wait_ms is None or latest + self.wait_ms <= due:
            return due
        if due >= 0:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(latest + self.wait_ms)
        return latest + self.wait_ms

    def _row(self, key, found: dict[int, str], last: int, complete: bool) -> pd.DataFrame:
        first, until = gaps(found, last)
        return pd.DataFrame({"doc_id": [key[0]], "html": ["".join(found[s] for s in sorted(found))], "complete": [complete], "gap_first": [first], "gap_last": [until]})

    def close(self) -> None:
        pass


def take(stream: DataFrame, folder: str) -> DataFrame:
    """What a run over all that is there now gives out, with all that earlier runs gave, from a folder that keeps both the
    results and the state: the next run goes on from there."""
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def assemble_stream(chunks: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """ASSEMBLED of a stream, as documents become whole. With wait_ms, what gets no piece for so long (of the cluster's clock)
    is given as it is, marked as incomplete; that takes a trigger that goes on."""
    mode = "None" if wait_ms is None else "ProcessingTime"
    return chunks.where("doc_id IS NOT NULL").groupBy("doc_id").transformWithStateInPandas(Assembler(wait_ms, False), ASSEMBLED, "append", mode)


def assemble_events(chunks: DataFrame, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """ASSEMBLED of a stream whose pieces have a time, `at`. A piece that comes later than delay behind the latest is
    dropped, one that repeats within it counts once, and a document is closed wait_ms after its latest piece."""
    timed = chunks.withWatermark("at", delay).dropDuplicatesWithinWatermark(["doc_id", "seq"])
    timed = timed.where("doc_id IS NOT NULL").withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("doc_id").transformWithStateInPandas(Assembler(wait_ms, True), ASSEMBLED, "append", "EventTime")


def gap_table(assembled: DataFrame) -> DataFrame:
    """doc_id, gap_first, gap_last: a row a range of missing pieces of documents that were closed before they were whole."""
    ranges = F.inline(F.arrays_zip("gap_first", "gap_last"))
    return assembled.where(~F.col("complete")).select("doc_id", ranges)
