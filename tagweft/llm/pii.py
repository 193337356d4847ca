"""Personal data: fixed patterns, and a character tagger (bidirectional LSTM with a CRF) for other ways of writing.

The tagger is trained in numpy, on the driver, from labelled spans that examples() writes: addresses, numbers and their
disguises (`name (at) host dot org`, telephone numbers without a plus, cards with dots, IPv6), among words, dates, prices,
versions and other numbers. Its windows overlap by half; a character's scores are merged over its windows, and one path is
decoded over all windows that touch, so a span may cross windows. It is run on the windows that hold one of the ANCHORS, the
word "dot" or two colons with at most four hexadecimal digits between them, and on the windows beside them: whatever passes
the exact check holds one of these. A bare ` at ` only counts with a ` dot ` or a bracketed one, as `look at example.org` is
no address. An exact check of each tagged span (digits, Luhn, address syntax) follows, which may also tell that it is of another kind. Base spans always stay; tagged ones that overlap
them are dropped, the others are added.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows repeat as in the input, a null doc_id
stays null, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import Tagger, encode, label
from .text import apart, chunks, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: A run of digits that has failed from its start fails from each later digit too, so a look-behind changes no result.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Characters of numbers, what they begin with, and characters of IPv6 addresses.
_DIGIT, _FIRST, _ADDRESS = frozenset(string.digits), frozenset(string.digits + "+("), frozenset(string.hexdigits + ":")

#: What a text must hold for a span: ANCHORS or _MORE for the tagger, any of the ANCHORS but brackets for the patterns.
ANCHORS = "0123456789@(["
_MORE = re.compile(r"(?i)\x20dot\x20|:(?=[0-9a-f]{0,4}:)")
_AT, _DOT = r"(?:\x20?[(\[]\x20?(?:at|@)\x20?[)\]]\x20?|\x20?@\x20?)", r"(?:\x20?[(\[]\x20?(?:dot|\.)\x20?[)\]]\x20?|\x20dot\x20)"
_DISGUISED = re.compile(rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:{_AT}[a-z0-9-]++(?:(?:{_DOT}|\x20?\.\x20?)[a-z0-9-]++)+|\x20at\x20[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)+)")
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})$")
_NUMBER = re.compile(r"\+?[0-9(][0-9()\x20.-]*[0-9]$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, from each @ outwards: linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]):
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(found)


def holds(kind: int, span: str) -> bool:
    """The exact check of a tagged span."""
    if kind == 0:
        return bool(_DISGUISED.fullmatch(span))
    if kind == 1:
        try:
            return bool(ipaddress.ip_address(span)) and len(span) > 6
        except ValueError:
            return False
    if not _NUMBER.fullmatch(span) or _DATE.match(span):
        return False
    digits = "".join(_DIGITS.findall(span))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(span) and span.count("(") == span.count(")")


# --- labelled spans ---------------------------------------------------------------------------------------------------


def _card(r) -> str:
    digits = [r.randrange(10) for _ in range(15)]
    digits[0] = r.randrange(3, 7)
    body = "".join(map(str, digits))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def examples(n: int, width: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of text and their tags: 0, or 1 + 2 * kind at a span's first character and 2 + 2 * kind inside."""
    r = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve co me la que ció ñe ung sch ä ü ß é è ô aux".split()
    small = "a at at dot the of to in on and for is it by or we le la und der en at a that dots what".split()
    pick = lambda *x: r.choice(x)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    hexa = lambda: f"{r.randrange(16 ** r.randrange(1, 5)):x}" if r.random() < 0.7 else "".join(r.choices("abcdef", k=4))

    def word():
        p = r.random()
        return pick(*"aeioxyé") if p < 0.06 else pick(*small) if p < 0.2 else "".join(r.choices(parts, k=r.randrange(1, 5)))

    def plain():
        """A part of an address: of letters at random, or of what words are made of."""
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) if r.random() < 0.4 else "".join(r.choices(parts[:32], k=r.randrange(1, 6)))

    def host(dot):
        return dot.join([plain() + pick("", "", "", "-" + plain(), num(1)), *([plain()] if r.random() < 0.35 else []), pick("com", "org", "net", "edu", "info", "de", "fr", "example", plain()[:3])])

    local = lambda: plain() + pick("", "", "." + plain(), "." + num(2), "_" + pick(num(1), plain()), "-" + plain(), num(2))

    def email():
        if r.random() < 0.25:
            return f"{local()}@{host('.')}"
        left, right = pick("()", "[]")
        gap, at = pick("", " ", " "), pick("at", "at", "at", "@")
        around = f"{gap}{left}{at}{right}{gap}"
        form = pick((around, "."), (around, "."), (around, pick(f"{gap}{left}dot{right}{gap}", " dot ")), (" at ", " dot "), (" at ", " dot "), (" @ ", pick(" . ", ".", " dot ")))
        text = f"{local()}{form[0].upper() if (up := r.random() < 0.25) else form[0]}{host(form[1].upper() if up else form[1])}"
        return text.title() if r.random() < 0.04 else text

    def ip():
        p = r.random()
        if p < 0.3:
            return ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))
        if p < 0.6:
            groups = [hexa() for _ in range(r.randrange(2, 7))]
            at = r.randrange(len(groups))
            return ":".join(groups[:at]) + "::" + ":".join(groups[at:])
        return ".".join(str(r.randrange(1, 256)) for _ in range(4))

    def card():
        c, gap = _card(r), pick("", " ", "-", ".")
        return gap.join(c[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"0{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")

    def other():
        return pick(f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:3{num(1)}:0{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", num(r.randrange(1, 9)), f"{num(2)},{num(3)}.{num(2)}", f"({num(4)})", f"[{num(1)}]", f"({word()} {word()})", f"password={num(3)}ab{num(5)}", f"AKIA{num(8)}", f"{num(2)} %", f"No. {num(6)}", f"{plain()}::{plain()}", f"{plain()} at {host('.')}", f"(at {num(1)}:{num(2)})", f"{word()}: {word()}:", f"@{plain()}", f"[{word()}]", f"({word()})", f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}")

    makers = (email, ip, card, phone)
    codes, tags = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
    for k in range(n):
        text, marks = "", []
        while len(text) < 2 * width:
            p = r.random()
            if p < 0.13:
                kind = pick(0, 0, 0, 1, 1, 2, 3, 3)
                span = makers[kind]()
                if r.random() < 0.4:
                    text += pick(*string.punctuation)
                marks.append((len(text), len(text) + len(span), kind))
                text += span + (pick(*string.punctuation) + pick("", " ", " ", "\n") if r.random() < 0.5 else pick(" ", " ", ". ", ", ", "\n"))
            elif p < 0.22:
                text += other() + pick(" ", " ", ". ")
            else:
                text += (word().title() if r.random() < 0.15 else word()) + pick(" ", " ", " ", ". ", ", ", "\n")
        tag = np.zeros(len(text), np.uint8)
        for a, b, kind in marks:
            tag[a:b] = 2 + 2 * kind
            tag[a] = 1 + 2 * kind
        shift = r.randrange(len(text) - width)
        codes[k], tags[k] = encode(text[shift : shift + width]), tag[shift : shift + width]
    return codes, tags


@functools.cache
def trained(hidden: int = 24, windows: int = 4800, width: int = 64) -> Tagger:
    """The tagger, trained once a process."""
    return Tagger(1 + 2 * len(KINDS), hidden).train(*examples(windows, width), epochs=9)


_ANCHOR = np.zeros(256, bool)
_ANCHOR[np.unique(encode(ANCHORS))] = True
_ANCHOR_BYTES = np.zeros(256, bool)
_ANCHOR_BYTES[list(ANCHORS.encode())] = True


def _anchors(data: np.ndarray) -> np.ndarray:
    """Places in bytes of texts of which each row with an anchor has one: all that _MORE finds are among them."""
    colon = np.flatnonzero(data == 58)
    o = np.flatnonzero((data[1:-1] | 32) == 111) if len(data) > 2 else colon[:0]
    dot = o[((data[o] | 32) == 100) & ((data[o + 2] | 32) == 116)]
    return np.concatenate([np.flatnonzero(_ANCHOR_BYTES[data]), colon[:-1][np.diff(colon) <= 5], dot])


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's tagged spans that pass the exact check."""
    found = []
    for text, tags in zip(texts, label(tagger, [encode(t) for t in texts], _ANCHOR, more=[np.array([m.start() for m in _MORE.finditer(t)], np.int64) for t in texts])):
        own = []
        kind = (tags.astype(int) + 1) // 2  # 0, or 1 + kind
        first = np.flatnonzero((kind > 0) & ((np.r_[0, kind[:-1]] != kind) | (tags % 2 == 1)))
        last = 0
        for a, after in itertools.pairwise([*first.tolist(), len(text)]):
            b = a + 1
            while b < len(tags) and tags[b] == 2 * kind[a]:
                b += 1
            if kind[a] > 1:  # a number: with all digits beside it, without the marks around it
                whole = _DIGIT if kind[a] > 2 or ":" not in text[a:b] else _ADDRESS
                while a > last and text[a - 1] in whole:
                    a -= 1
                while b < after and text[b] in whole:
                    b += 1
                while a < b and text[a] not in (_FIRST if whole is _DIGIT else whole):
                    a += 1
                while b > a and text[b - 1] not in whole:
                    b -= 1
                a += text[a] == ":" != text[a + 1] if a + 1 < b else 0
                b -= text[b - 1] == ":" != text[b - 2] if a + 1 < b else 0
            span = text[a:b].rstrip(" .,\n")
            k = int(kind[a]) - 1
            k = next((x for x in (k, 2, 3, 1, 0) if holds(x, span)), None)  # the check knows a card with dots from an address
            if kind[a] == 1 and k in (0, None):  # an address: of whole words, up to the spans beside it
                while a > last and text[a - 1] in _LOCAL:
                    a -= 1
                while b < after and text[b] in _LABEL:
                    b += 1
                m = _DISGUISED.search(text, a, b)
                span = m[0].lstrip("._%+-") if m else ""
                a, span, k = (m.end() - len(span), span.rstrip("-"), 0) if holds(0, span.rstrip("-")) else (a, "", None)
            if k is not None:
                last = a + len(span)
                own.append((a, k, last))
        found.append(own)
    return found


def spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base and all spans of each text."""
    bases = [base_spans(t) for t in texts]
    found = []
    for base, more in zip(bases, tagged_spans(tagger, texts)):
        over = apart(more, base)
        found.append((base, sorted(base + [x for x, free in zip(more, over) if free])))
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _rows(batch_column, tagger: Tagger):
    """(row, text, base spans, all spans) of the rows that hold an anchor; the others have no span."""
    for i, _, data, offsets in chunks(batch_column):
        rows = np.unique(np.searchsorted(offsets, _anchors(data), "right") - 1).tolist()
        texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in rows]
        for k, text, (base, every) in zip(rows, texts, spans(tagger, texts)):
            yield i + k, text, base, every


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), n_added, base_sha256, spans of each row."""
    tagger = trained()
    nothing = hashlib.sha256(b"").hexdigest()

    def read(batches):
        for batch in batches:
            n = batch.num_rows
            counts, added = np.zeros((len(KINDS), n), np.int64), np.zeros(n, np.int64)
            digest, found = [nothing] * n, [""] * n
            for i, _, base, every in _rows(batch.column(1), tagger):
                for _, kind, _ in base:
                    counts[kind, i] += 1
                added[i] = len(every) - len(base)
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                found[i] = joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(added), pa.array(digest, pa.string()), pa.array(found, pa.string())], ["doc_id", *(f"n_{x}" for x in KINDS), "n_added", "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{x} long" for x in KINDS) + ", n_added long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(read), schema)


def masked(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in brackets, as [EMAIL]; null texts stay null."""
    tagger = trained()
    place = docs.columns.index(column)
    as_text = docs.withColumn(column, F.col(column).cast("string"))

    def read(batches):
        for batch in batches:
            changed = {}
            for i, text, _, every in _rows(batch.column(place), tagger):
                if every:
                    out, last = [], 0
                    for a, kind, b in every:
                        if a >= last:
                            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
                        last = max(last, b)
                    changed[i] = "".join(out) + text[last:]
            if changed:
                old = batch.column(place)
                texts = old.to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, old.type))
            yield batch

    return as_text.mapInArrow(tidy(read), as_text.schema)
