"""Chat formatting by quotation linking: reply-ordered conversations without their quotes.

A message's lines that begin with `>` are quotes; the number of marks is the level. Each run of lines of one level is cut
at blank lines into passages, which are hashed after lower-casing and folding of white space, and so is each of their lines;
so are the passages that a message says itself, and each of its lines. A line such as `On Monday A wrote:` just before a
quote goes with it.

A quoted passage or line of any level is linked to the message that said it first: in the same conversation at a smaller
turn, or else in the whole table at a smaller (conv_id, turn), if it has LONG words or only one conversation says it (a
short line that many say, as "Yes", tells nothing). A message replies to the linked message of the lowest level, and there
to the one with the greatest (same conversation, conv_id, turn); without links, to the conversation's previous turn.
n_links counts the passages that are linked, as a whole or by a line. Since a parent is always smaller, there
are no cycles; roots and depths come from pointer doubling in O(log depth) joins. Ordering by (root_conv, root_turn,
depth, conv_id, turn) puts every message after the one it replies to.

Rows of one (conv_id, turn) are one message for linking and stay rows of their own. Rows without conv_id or turn stand
alone: they are roots, can't be quoted, and have depth 0. Null and empty texts quote and say nothing. An empty table gives
no rows; role is passed through and other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .text import durable, stored

_MARKS = re.compile(r"((?:\x20{0,3}>)+)\x20?")
_WROTE = re.compile(r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:$")
#: Words from which on a passage is linked across conversations even if several of them say it.
LONG = 5
#: Turns of a conversation that are looked at together for the turn before.
TURNS = 1000


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def passage_hash(passage: str) -> int:
    h = xxh64_intdigest(normalised(passage))
    return h - (1 << 64) if h >> 63 else h


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line) of each line; level 0 is the message's own."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    for i in range(len(out) - 1):
        if out[i][0] == 0 and out[i + 1][0] > 0 and _WROTE.search(out[i][1].rstrip()):
            out[i] = (-1, out[i][1])
    return out


def parse(text: str) -> tuple[str, list[int], list[tuple[int, int, int, int]], int]:
    """(text without quotes, hashes of what it says, (level, words, hash, passage's hash) of the passages that it quotes and of
    their lines, each at its lowest level, number of quoted passages)."""
    lines = levels(text)
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in lines if k == 0)).strip()
    passages: list[tuple[int, str]] = []
    last = None
    for level, line in lines:
        if level < 0 or not line.strip():
            last = None
            continue
        if level == last:
            passages[-1] = (level, passages[-1][1] + "\n" + line)
        else:
            passages.append((level, line))
        last = level
    said = {passage_hash(p) for k, p in passages if k == 0} | {passage_hash(x) for k, x in lines if k == 0 and x.strip()}
    if clean:
        said.add(passage_hash(clean))
    quoted: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for k, p in sorted((x for x in passages if x[0] > 0), key=lambda x: x[0]):
        whole = passage_hash(p)
        for part in [p, *p.split("\n")]:
            h = passage_hash(part)
            quoted.setdefault((h, whole), (k, len(part.split()), h, whole))
    return clean, sorted(said), sorted(quoted.values()), sum(k > 0 for k, _ in passages)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, said, quoted, n_quotes of each row."""

    def read(batches):
        for batch in batches:
            found = [parse(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([[dict(zip(("level", "words", "h", "passage"), q)) for q in x[2]] for x in found], pa.list_(pa.struct([("level", pa.int64()), ("words", pa.int64()), ("h", pa.int64()), ("passage", pa.int64())]))), pa.array([x[3] for x in found], pa.int64())], ["conv_id", "turn", "role", "text", "said", "quoted", "n_quotes"])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(read, "conv_id long, turn long, role string, text string, said array<long>, quoted array<struct<level:bigint,words:bigint,h:bigint,passage:bigint>>, n_quotes long")


def previous(keys: DataFrame) -> DataFrame:
    """conv_id, turn and before (the conversation's next smaller turn) of distinct keys. Turns are taken in blocks, so a
    conversation of any length is never in one task."""
    cut = keys.withColumn("block", F.floor(F.col("turn") / TURNS))
    near = cut.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn")))
    ends = cut.groupBy("conv_id", "block").agg(F.max("turn").alias("top"))
    ends = ends.select("conv_id", "block", F.lag("top").over(Window.partitionBy("conv_id").orderBy("block")).alias("far"))
    return near.join(ends, ["conv_id", "block"], "left").select("conv_id", "turn", F.coalesce("near", "far").alias("before"))


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, n_links, link (near, same, conv_id, turn of the best original) of each message that has one."""
    asked = rows.select("conv_id", "turn", F.inline("quoted")).where("conv_id is not null and turn is not null")
    asked = durable(asked.groupBy("conv_id", "turn", "h", "passage").agg(F.min("level").alias("level"), F.max("words").alias("words")))
    said = rows.select(F.col("conv_id").alias("oc"), F.col("turn").alias("ot"), F.explode("said").alias("sh")).where("oc is not null and ot is not null")
    said = said.join(asked.select("h").distinct(), F.col("sh") == F.col("h"), "left_semi")
    here = durable(said.groupBy("sh", "oc").agg(F.min("ot").alias("ot")))  # a passage that one conversation repeats is one row
    anywhere = here.groupBy("sh").agg(F.min(F.struct("oc", "ot")).alias("first"), (F.min("oc") == F.max("oc")).alias("one"))
    found = asked.join(here, (F.col("h") == F.col("sh")) & (F.col("conv_id") == F.col("oc")) & (F.col("ot") < F.col("turn")), "left").select("conv_id", "turn", "h", "passage", "level", "words", F.col("ot").alias("own"))
    # who said a passage here too, at a later turn, doesn't make it ambiguous: only other conversations do
    found = found.join(anywhere, F.col("h") == F.col("sh"), "left")
    near = (-F.col("level")).alias("near")
    sure = (F.col("words") >= LONG) | F.col("one")
    outside = F.when(sure & (F.col("first") < F.struct(F.col("conv_id").alias("oc"), F.col("turn").alias("ot"))), F.struct(near, F.lit(0).alias("same"), F.col("first.oc").alias("oc"), F.col("first.ot").alias("ot")))
    link = F.when(F.col("own").isNotNull(), F.struct(near, F.lit(1).alias("same"), F.col("conv_id").alias("oc"), F.col("own").alias("ot"))).otherwise(outside)
    found = found.withColumn("link", link).where("link is not null")
    return found.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_links"), F.max("link").alias("link"))


def rooted(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn, depth of messages with parents pc, pt (null for roots), by pointer doubling."""
    top = parents.where("pc is null").select("conv_id", "turn", F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"))
    done = durable(top)
    open_ = durable(parents.where("pc is not null").select("conv_id", "turn", F.col("pc").alias("ac"), F.col("pt").alias("at"), F.lit(1).cast("long").alias("d")))
    while not open_.isEmpty():
        # an ancestor that is done gives the root; one that isn't gives its own ancestor, twice as far
        known = done.select(F.col("conv_id").alias("kc"), F.col("turn").alias("kt"), "root_conv", "root_turn", "depth", F.lit(None).cast("long").alias("nc"), F.lit(None).cast("long").alias("nt"), F.lit(0).cast("long").alias("nd"))
        far = open_.select(F.col("conv_id").alias("kc"), F.col("turn").alias("kt"), F.lit(None).cast("long").alias("root_conv"), F.lit(None).cast("long").alias("root_turn"), F.lit(None).cast("long").alias("depth"), F.col("ac").alias("nc"), F.col("at").alias("nt"), F.col("d").alias("nd"))
        step = open_.join(known.union(far), (F.col("ac") == F.col("kc")) & (F.col("at") == F.col("kt")))
        step = durable(step.select("conv_id", "turn", "root_conv", "root_turn", (F.col("depth") + F.col("d")).alias("depth"), "nc", "nt", (F.col("d") + F.col("nd")).alias("nd")))
        done = done.union(step.where("root_conv is not null").select("conv_id", "turn", "root_conv", "root_turn", "depth"))
        open_ = step.where("root_conv is null").select("conv_id", "turn", F.col("nc").alias("ac"), F.col("nt").alias("at"), F.col("nd").alias("d"))
    return done


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_links, parent_conv, parent_turn, root_conv, root_turn, depth."""
    rows = stored(parsed(messages))
    keys = durable(rows.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct())
    linked = links(rows)
    parents = previous(keys).join(linked, ["conv_id", "turn"], "left")
    parents = parents.select("conv_id", "turn", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("link.oc", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("pc"), F.coalesce("link.ot", "before").alias("pt"))
    parents = durable(parents)
    found = parents.join(rooted(parents.select("conv_id", "turn", "pc", "pt")), ["conv_id", "turn"])
    found = found.select(F.col("conv_id").alias("fc"), F.col("turn").alias("ft"), "n_links", F.col("pc").alias("parent_conv"), F.col("pt").alias("parent_turn"), "root_conv", "root_turn", F.col("depth").alias("found_depth"))
    out = rows.join(found, (F.col("conv_id") == F.col("fc")) & (F.col("turn") == F.col("ft")), "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("found_depth", F.lit(0).cast("long")).alias("depth"))
