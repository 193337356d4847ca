"""BPE encoding through an index of pair occurrences, and decoding.

The distinct words of a task's documents are laid out as one array of symbols, and an index maps each pair of adjacent symbols
to all places where it stands. Ranks are taken in ascending order: the pair's places are merged at once (of overlapping ones
the left one first, as in `aaa`), and the pairs that arise to the left and right enter the lists of their ranks. A pair's rank
is above those of the merges that make its parts, so no list changes once its rank has passed; a vocabulary for which that does
not hold is refused. Each merge is done once for all words of the task, and its cost is that of the pair's places.

Text becomes words in two steps. It is cut into runs where no word can span (at white space), which is cheap, and only
distinct runs are normalised and matched with the vocabulary's pattern. The tokenizers library carries Unicode tables of
its own, so runs with characters outside FAMILIAR, where its classes and those of Python could differ, are normalised and
cut by the library; merging is always done here.

Memory is bounded by SPAN characters of text a task, or by one longer text: whole texts are encoded, however long.
Null and empty texts have no ids and decode to the empty text. Rows repeat as in the input; an empty table gives no rows;
other columns are ignored, those that `out` names are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tidy

#: Characters of texts that share one index.
SPAN = 12_000_000
#: Fixed value: how byte-level vocabularies without a pattern of their own cut text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the classes and the lower case of all Unicode versions in use agree (a test compares them).
FAMILIAR = r"\x00-\u052f\u2010-\u2027\u3000-\u312d\u3400-\u4db5\u4e00-\u9fbb\uac00-\ud7a3"
#: White space to Python's split, but not to patterns.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Interned(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Merges:
    """Pairs of symbols with their rank and what they become."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (*(zip(*pairs) if pairs else ([], [])), made))
        made_by = {m: r for r, m in enumerate(made)}
        if len(made_by) < len(made) or any(made_by.get(x, -1) >= r for r, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge comes before the merges that make its parts, or two make the same token")
        self.base = 1 + max([0, *made, *(x for pair in pairs for x in pair)])
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def apply(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, end of each word in them) of words that end at `ends` in symbols."""
        n = len(symbols)
        symbol = np.append(symbols, -1).astype(np.int64)  # place n is no symbol: what lies beyond a word's border
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        held = ends > starts
        after[ends[held] - 1] = n
        before[starts[held]] = n
        index: list[list[np.ndarray]] = [[] for _ in self.made]

        def enter(places: np.ndarray) -> None:
            """Adds each place to the list of the pair that begins there."""
            following = after[places]
            places, following = places[following < n], following[following < n]
            rank = self.ranks(symbol[places], symbol[following])
            known = rank >= 0
            if not known.any():
                return
            rank, places = rank[known], places[known]
            by = np.argsort(rank, kind="stable")
            rank, places = rank[by], places[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)]):
                index[rank[a]].append(places[a:b])

        enter(np.arange(n))
        for rank, lists in enumerate(index):
            if not lists:
                continue
            at = np.sort(np.concatenate(lists))
            index[rank] = []
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]  # others have been merged meanwhile
            if left == right and len(at) > 1:
                chained = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = made, -1
            after[at], before[beyond] = beyond, at
            nearest = before[at]
            other = nearest < n
            other[1:] &= nearest[1:] != at[:-1]  # those are among at
            enter(np.concatenate([nearest[other], at]))
        kept = symbol[:n] >= 0
        return symbol[:n][kept], np.cumsum(np.append(0, kept))[ends]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Of a vocabulary file of the tokenizers library: byte-level BPE, with or without a mark of word ends."""

    def __init__(self, spec: str):
        self.spec = spec
        found = json.loads(spec)
        model = found["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        suffix = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(self.ids[a], self.ids[b]) for a, b in pairs], [self.ids[a + b] for a, b in pairs])
        self.inside = np.array([self.ids[c] for c in byte_names()])
        self.last = np.array([self.ids[c + suffix] for c in byte_names()])
        self.lowered = found["normalizer"] is not None
        steps = found["pre_tokenizer"].get("pretokenizers", [found["pre_tokenizer"]])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(own[0] if own else BYTE_PATTERN)
        self.drops_space = bool(own)
        self.unfamiliar = re.compile(f"[^{FAMILIAR}]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        return self._library

    def runs(self, text: str) -> list[str]:
        """What can be encoded by itself: no word lies in two runs."""
        if not self.drops_space:
            return re.split(r"(?<=\S)(?= )", text) if text else []
        if any(c in text for c in SEPARATORS):
            return re.findall(rf"[\S{SEPARATORS}]+", text)
        return text.split()

    def cut(self, text: str) -> list[str]:
        """Runs, and special tokens by themselves."""
        if self.specials is None or not any(t in text for t in self.special):
            return self.runs(text)
        return [r for k, part in enumerate(self.specials.split(text)) for r in ([part] if k % 2 else self.runs(part)) if r]

    def words(self, run: str) -> list[bytes]:
        if self.unfamiliar(run):
            library = self.library()
            if library.normalizer is not None:
                run = library.normalizer.normalize_str(run)
            byte_of = {c: b for b, c in enumerate(byte_names())}
            return [bytes(byte_of[c] for c in w) for w, _ in library.pre_tokenizer.pre_tokenize_str(run)]
        if self.lowered:
            if not run.isascii():
                run = unicodedata.normalize("NFC", run).replace("Σ", "σ")  # a last sigma is lowered like any other
            run = run.lower()
        return [w.encode() for w in self.pattern.findall(run)]

    def encode_runs(self, runs: Iterable[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each run in them). With special, a run that is a special token is one."""
        words = Interned()
        taken, lengths, fixed = [], [], []
        for k, run in enumerate(runs):
            if special and run in self.special:
                fixed.append((k, self.special[run]))
                lengths.append(0)
                continue
            found = self.words(run)
            lengths.append(len(found))
            taken.extend(map(words.__getitem__, found))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inside[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        tokens, ends = self.merges.apply(symbols, ends)
        sizes = np.diff(ends, prepend=0)
        taken = np.array(taken, np.int64)
        ids = tokens[spans((ends - sizes)[taken], sizes[taken])] if len(taken) else tokens[:0]
        run_ends = np.append(0, np.cumsum(sizes[taken]))[np.cumsum(np.array(lengths, np.int64))] if lengths else np.zeros(0, np.int64)
        if fixed:
            place, value = map(np.array, zip(*fixed))
            ids = np.insert(ids, run_ends[place], value)
            run_ends = run_ends + np.cumsum(np.bincount(place, minlength=len(run_ends)))
        return ids.astype(np.int32), run_ends

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        runs = Interned()
        coded = [list(map(runs.__getitem__, self.cut(t))) for t in texts]
        ids, ends = self.encode_runs(runs)
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        for codes in coded:
            own = np.array(codes, np.int64)
            yield ids[spans(starts[own], sizes[own])].tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder does: tokens, a space between them. Unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids as 32-bit numbers, SHA-256 of what they decode to, of each text."""
        runs = Interned()
        coded = [np.fromiter(map(runs.__getitem__, words), np.int32, len(words)) for words in map(self.cut, texts)]
        ids, ends = self.encode_runs(runs)
        ids = ids.astype("<i4")
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        tokens = list(map(self.names.__getitem__, ids.tolist()))
        cuts = [0, *ends.tolist()]
        decoded = [" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
        for codes in coded:
            own = ids[spans(starts[codes], sizes[codes])]
            text = " ".join(list(map(decoded.__getitem__, codes.tolist())))
            yield len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(key: str, spec) -> Codec:
    """One for each Python worker and vocabulary; spec: a broadcast."""
    if key not in _codecs:
        _codecs[key] = Codec(spec.value)
    return _codecs[key]


def shipped(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()  # as large as the vocabulary, whatever the corpus
    return hashlib.sha256(spec.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(spec)


def shares(texts: list[str], span: int = SPAN) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to about `span` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > span:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text."""
    key, spec = shipped(docs, path)

    def scan(batches):
        own = codec(key, spec)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in shares(texts):
                n, ids, decoded = zip(*own.digests(texts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(scan), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with a column of token ids."""
    key, spec = shipped(docs, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        rows = [t or "" for t in texts.to_pylist()]
        own = codec(key, spec)
        return pa.array([ids for a, b in shares(rows) for ids in own.encode_all(rows[a:b])], pa.list_(pa.int32()))

    return docs.withColumn(out, encode(F.col(text).cast("string")))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that a column of token ids decodes to; null ids are none, null within them too."""
    key, spec = shipped(docs, path)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        own = codec(key, spec)
        return pa.array([own.decode(x or ()) for x in rows.to_pylist()], pa.string())

    return docs.withColumn(out, decode(F.col(ids).cast("array<int>")))
