"""SentencePiece BPE encoding through a table of prefixes, and decoding.

Byte-pair merging has the property that the encoding of a text's prefix is unique and that a sequence of tokens is an
encoding exactly if every adjacent pair is (the pair's own text encodes to the pair). So for every prefix exactly one
token can come last. An automaton over all pieces yields the tokens that end at each place; the one that is compatible
with the last token of the prefix before it is stored; the ids are read from the table backwards. The cost is linear in
the length of the text, whatever it holds.

A text may be cut, without changing its encoding, between two characters that stand side by side in no piece. So it is
encoded in runs that begin at space marks, punctuation and line ends (as far as the vocabulary allows), and the results of
short runs are kept in a bounded table. Characters that are in no piece become their UTF-8 bytes' tokens.

Null and empty texts have no ids and decode to the empty text. Rows repeat as in the input; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tidy

MARK = "▁"
#: Kept runs (of two generations each) and pairs.
KEPT, KEPT_PAIRS = 300_000, 500_000
KEPT_LENGTH = 64
#: Codes of characters that are in no piece begin here, above all ids.
CHARACTER = 1 << 16


def vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of each id of a model file; kind: normal, byte, unknown or control."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.vocab_size())]


class Codec:
    """Of a vocabulary with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, vocab: list[tuple[str, float, str]]):
        self.kinds = [k for _, _, k in vocab]
        self.pieces = [p for p, _, _ in vocab]
        self.ids = {p: i for i, (p, _, k) in enumerate(vocab) if k == "normal"}
        self.score = {p: s for p, s, k in vocab if k == "normal"}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(vocab) if k == "byte"}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        special = [i for i, k in enumerate(self.kinds) if k != "normal"]
        self.last_byte = max(special, default=-1)  # ids above it are plain pieces
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut = re.compile(self.run_pattern(), re.S)
        self.surfaces = [p.replace(MARK, " ") for p in self.pieces]
        self.names = [str(i) for i in range(len(vocab))]
        self.pairs: dict[int, bool] = {}
        self.histories: dict[str, tuple[float, str | None, str | None, bool]] = {}
        self.runs: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def run_pattern(self) -> str:
        """Of runs that begin only where no piece can span: at a space mark after another character, at a line end, and
        at punctuation after anything else, as far as no piece shows the contrary."""
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == MARK and a != MARK for a, b in inside):
            return ".+"
        marks = {x for p in self.ids for x in p if not (x.isalpha() or x.isdecimal())} - {MARK, "\n"}
        while held := {b for a, b in inside if b in marks and a not in marks and a != MARK}:
            marks -= held
        line = "" if any("\n" in x for x in inside) else "\n"
        c = re.escape("".join(sorted(marks)))
        other = f"[^{MARK}{line}{c}]"
        return "|".join([f"{MARK}+[{c}]*{other}*", f"[{c}]+{other}*"] * bool(c) or [f"{MARK}+{other}*"]) + f"|{other}+" + f"|{line}" * bool(line)

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Of a short text: merge the adjacent pair of the best score, the leftmost of equals, until none is a piece or
        no more than `stop` parts are left."""
        parts = list(text)
        while len(parts) > stop:
            best = max(((self.score[x], -i) for i, x in enumerate(map("".join, zip(parts, parts[1:]))) if x in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def history(self, piece: str) -> tuple[float, str | None, str | None, bool]:
        """(score; left and right part of its last merge, None for a character; whether scores fall along its merges, as
        those of trained vocabularies do). A piece that merging its own text doesn't make has score -inf."""
        found = self.histories.get(piece)
        if found is None:
            if len(piece) == 1:
                found = (math.inf, None, None, True)
            else:
                parts = self.merge(piece, 2)
                if len(parts) != 2 or piece not in self.score:
                    found = (-math.inf, None, None, True)
                else:
                    s, (l, r) = self.score[piece], map(self.history, parts)
                    found = (s, *parts, l[3] and r[3] and l[0] > s and r[0] > s)
            self.histories[piece] = found
        return found

    def piece(self, code: int) -> str:
        """Of an id, or of a character that is in no piece."""
        return self.pieces[code] if code < CHARACTER else chr(code - CHARACTER)

    def apart(self, a: str, b: str) -> bool:
        """Whether tokens a and b stay apart side by side. Merges go by falling score, the left one of equals first. So
        undo the merges that made the border's two sides, the latest first: a and b are apart in the end if no pair that
        was at the border in between could merge before the next merge of either side took place."""
        ha, hb = self.history(a), self.history(b)
        if ha[0] == -math.inf or hb[0] == -math.inf:
            return False
        if not (ha[3] and hb[3]):
            return self.merge(a + b) == [a, b]
        x, y, hx, hy = a, b, ha, hb
        after, right = -math.inf, False  # the score of the merge that followed, and whether it was of the right side
        while True:
            s = self.score.get(x + y)
            if s is not None and (s > after or s == after and right):
                return False
            if hx[1] is None and hy[1] is None:
                return True
            right = hx[1] is None or hy[1] is not None and hy[0] <= hx[0]
            if right:
                after, y = hy[0], hy[1]
                hy = self.history(y)
            else:
                after, x = hx[0], hx[2]
                hx = self.history(x)

    def tokens(self, text: str) -> list[int]:
        """The tokens of a run: ids, or CHARACTER + code point for a character that is in no token."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (code, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            j = end - length
            if not j:
                if length == 1 or self.history(self.pieces[code])[0] > -math.inf:
                    last[end] = code
                continue
            before = last[j]
            if before < 0:  # all matches that end at j are known by now
                before = last[j] = CHARACTER + ord(text[j - 1])
            key = before << 21 | code
            if key in pairs:
                if pairs[key]:
                    last[end] = code
                continue
            if len(pairs) >= KEPT_PAIRS:
                pairs.clear()
            fits = pairs[key] = self.apart(self.piece(before), self.pieces[code])
            if fits:
                last[end] = code
        found, i = [], len(text)
        while i:
            code = last[i]
            if code < 0:
                code = CHARACTER + ord(text[i - 1])
            found.append(code)
            i -= len(self.pieces[code]) if code < CHARACTER else 1
        found.reverse()
        return found

    def run_ids(self, run: str) -> list[int]:
        ids = []
        for code in self.tokens(run):
            if code < CHARACTER:
                ids.append(code)
            else:
                ids.extend(self.byte_ids[b] for b in chr(code - CHARACTER).encode())
        return ids

    def surface(self, ids: list[int]) -> str:
        """Without the removal of the dummy prefix."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_utf8(pending))
                pending = bytearray()
            kind = self.kinds[i]
            if kind == "normal":
                out.append(self.pieces[i].replace(MARK, " "))
            elif kind == "unknown":
                out.append(" ⁇ ")
        if pending:
            out.append(_utf8(pending))
        return "".join(out)

    def run(self, run: str) -> tuple[str, str | None]:
        """Ids joined by commas, and what they decode to, None if that is the run itself with spaces for marks; only the ids
        of such runs are kept. Of two generations of kept runs, the older one is dropped when the newer one is full."""
        found = self.runs.get(run)
        if found is None:
            found = self.older.get(run)
            if found is None:
                ids = self.run_ids(run)
                found = ",".join([self.names[i] for i in ids])
                decoded = "".join([self.surfaces[i] for i in ids]) if min(ids) > self.last_byte else self.surface(ids)
                if decoded != run.replace(MARK, " "):
                    return found, decoded
            if len(run) <= KEPT_LENGTH:
                if len(self.runs) >= KEPT:
                    self.older, self.runs = self.runs, {}
                self.runs[run] = found
        return found, None

    def cut_up(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for run in self.cut_up(text) for i in map(int, self.run(run)[0].split(","))]

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((self.pieces[i] for i in ids if self.kinds[i] != "control"), "")
        return text[1:] if first.startswith(MARK) else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of what they decode to."""
        runs = self.cut_up(text)
        found = list(map(self.runs.get, runs))
        odd = {}
        if None in found:
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i], decoded = self.run(runs[i])
                if decoded is not None:
                    odd[i] = decoded
        ids, text = ",".join(found), "".join([odd.get(i, x.replace(MARK, " ")) for i, x in enumerate(runs)] if odd else runs)
        text = text if odd else text.replace(MARK, " ")
        text = text[1:] if text.startswith(" ") else text
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _utf8(raw: bytearray) -> str:
    """Bytes that are no UTF-8 decode to one U+FFFD each."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4 if 0xF0 <= raw[i] < 0xF5 else 0
        try:
            out.append(bytes(raw[i : i + n]).decode() or "�")
            i += n or 1
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(key: str, vocab) -> Codec:
    """One for each Python worker and vocabulary."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocab.value)
    return _codecs[key]


def _shipped(docs: DataFrame, path: str):
    vocab = vocabulary(path)  # as large as the model file, whatever the corpus
    return hashlib.sha256(repr(vocab).encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(vocab)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text."""
    key, vocab = _shipped(docs, path)

    def scan(batches):
        own = codec(key, vocab)
        for batch in batches:
            found = [own.digests(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(scan), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with a column of token ids."""
    key, vocab = _shipped(docs, path)

    @F.pandas_udf("array<int>")
    def encode(texts):
        own = codec(key, vocab)
        return texts.map(lambda t: own.encode(t or ""))

    return docs.withColumn(out, encode(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that a column of token ids decodes to."""
    key, vocab = _shipped(docs, path)

    @F.pandas_udf("string")
    def decode(rows):
        own = codec(key, vocab)
        return rows.map(lambda x: own.decode([int(i) for i in x]) if x is not None else "")

    return docs.withColumn(out, decode(F.col(ids)))
