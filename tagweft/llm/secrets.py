"""Secrets: fixed patterns, and an assignment-aware lexer with constant propagation.

The lexer reads name-literal pairs from source and configuration syntax: `name = "x"`, `name: x`, `"name": "x"`,
`name := 'x'`, `name => 'x'`, `name: type = 'x'`, `NAME=x`, `<name>x</name>`, `set_name('x')`, with string literals joined by
`+` or by standing side by side, with prefixes, in brackets and lists, or as what an expression falls back on (`x || 'y'`); of
any length, as are names and blanks; triple quotes, template literals and YAML block scalars go over lines. A literal given to
a name is a constant of that name; a right side that is a name takes over its constant, wherever in the text that is set, and
one that begins with a known name and goes on with `+` reaches its constant and the literals. Each constant is scored by how
sensitive the names are that it reaches and by how much it looks like a generated value. What reaches THRESHOLD is a span
of kind `literal` at the place where the literal stands, unless it overlaps a span of the fixed patterns.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows repeat as in the input, a null doc_id
stays null, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, apart, chunks, runs

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
THRESHOLD = 0.5

#: Characters before `=` in which a name's type is looked for.
TYPED = 200

#: How sensitive the parts of a name are.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "pass": 0.7, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "signature": 0.5}
#: Names of two parts.
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("client", "secret"): 1.0, ("account", "key"): 0.8, ("encryption", "key"): 0.9, ("signing", "key"): 0.9}
#: What a text must hold, in lower case, for any name in it to be sensitive.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"bearer", b"signature")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%|change_?me.*|example.*|your.*|dummy.*|placeholder.*|none|null|true|false|undefined|password|secret|token|test.*)$")

_OPERATOR = re.compile(r"[:=(]")
#: First parts of the names of functions that set what the rest of the name says.
SETTERS = frozenset(("set", "with", "put", "use"))
_NAME_PARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_STRING = re.compile(r"""(?s)[ \t]*+(?:[fFbBrRuU]{1,2}(?=["'`]))?(?:"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|`((?:[^`\\]|\\.)*+)`|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')""")
_JOIN = re.compile(r"[ \t]*+\+?[ \t]*+(?=[\"'`])")
_OPENED = re.compile(r"[ \t]*+(?:[(\[{][ \t\n]*+)++")
_COMMA = re.compile(r"[ \t\n]*+,[ \t\n]*+")
_PLUS = re.compile(r"[ \t]*+\+")
_ELSE = re.compile(r"[ \t]*+(?:\|\||\?\?|\?:|or\b)[ \t]*+(?=[fFbBrRuU]{0,2}[\"'`])")
_TYPED = re.compile(r"([A-Za-z_][\w.-]*)[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w.\[\], |]*+\]?)?[ \t]*+$")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>]++)</([A-Za-z_][\w.-]*+)>")
_BLANK = re.compile(r"[ \t]*+")
_BARE = re.compile(r"[A-Za-z0-9_+/=.~!@#$%^&*:-]+")
_BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]{0,2}[ \t]*\n")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """Of a name like dbPassword, API_KEY or auth.token."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    weights = [SENSITIVE.get(x, SENSITIVE.get(x.removesuffix("s"), 0.0)) for x in parts] + [PAIRS.get(x, 0.0) for x in zip(parts, parts[1:])]
    return max(weights, default=0.0)


def looks_generated(value: str) -> float:
    """0 to 1: length, variety of characters, and no placeholder."""
    if len(value) < 8 or PLACEHOLDER.match(value) or value.isalpha() and (value.islower() or value.istitle() or value.isupper()):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 3.0) * min(1.0, 0.4 + 0.3 * kinds)


def _block(text: str, name: int, at: int) -> tuple[int, int]:
    """Start and end of a YAML block scalar: lines that are indented more than the line of its name, or blank."""
    line = text.rfind("\n", 0, name) + 1
    depth = len(text[line:name]) - len(text[line:name].lstrip(" "))
    end = re.compile(rf"(?:[ ]{{{depth + 1}}}[^\n]*+(?:\n|$)|[ \t]*+\n)*+").match(text, at).end()
    inner = text[at:end]
    return at + len(inner) - len(inner.lstrip()), at + len(inner.rstrip())


def _name(text: str, before: int) -> tuple[int, str] | None:
    """The name that ends before a position, up to a quote or bracket, blanks and one line end, and its start. It holds no
    operator, so the names of a text's operators are read in linear time."""
    end = before - 1 if text[before - 1 : before] == "\n" else before
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"']":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_PARTS:
        start -= 1
    while start < end and text[start] in "0123456789.-":
        start += 1
    return (start, text[start:end]) if start < end else None


def _literal(text: str, at: int) -> tuple[str, int, int, int] | None:
    """(value, start, end, what follows) of string literals that are joined."""
    value, start = "", None
    while s := _STRING.match(text, at):
        k = s.lastindex
        value += s[k]
        start, at = s.start(k) if start is None else start, s.end()
        end = s.end(k)
        joined = _JOIN.match(text, at)
        if not joined:
            break
        at = joined.end()
    return None if start is None else (value, start, end, at)


def _set_by_call(name: str) -> bool:
    parts = [x.lower() for x in _PARTS.findall(name.rpartition(".")[2])]
    return bool(parts) and (parts[0] in SETTERS or all(x in SENSITIVE for x in parts))


def constants(text: str) -> list[tuple[str, str | None, int, int]]:
    """(name, value, start, end) for each literal and each name that it reaches, in the order of the assignments. The value
    is None where it is text[start:end] as it stands: runs like a=b=c are values of each other, and copies would add up."""
    known: dict[str, tuple[str | None, int, int]] = {}
    found: list[tuple[str, str | None, int, int]] = []
    bare: list[int] = []  # of found, those that may be names that are set further on
    longest = 0  # of the known names
    over = 0  # the end of the last run of unquoted characters

    def give(name: str, value: str | None, start: int, end: int) -> None:
        if value or value is None and end > start:
            found.append((name, value, start, end))

    for m in _OPERATOR.finditer(text):
        p = m.start()
        sign, after = m[0], text[p + 1 : p + 2]
        right = p + 1
        if sign == "=" and after == ">":
            right = p + 2
        elif after in ("=", ":", ">") and sign != "(" or sign == ":" and text.startswith("//", p + 1):
            continue
        if sign == "=" and p and text[p - 1] in "=!<>":
            continue
        before = p - 1 if sign == "=" and text[p - 1 : p] == ":" and p else p
        named = _name(text, before)
        if sign == "(":
            if named and _set_by_call(named[1]) and (s := _literal(text, right)):
                give(named[1], *s[:3])
            continue
        if sign == "=" and (typed := _TYPED.search(text, max(text.rfind("\n", 0, p), p - TYPED), p)):
            named = typed.start(1), typed[1]
        if not named:
            continue
        place, name = named
        opened = _OPENED.match(text, right)
        s = _literal(text, opened.end() if opened else right)
        if s:
            known[name] = s[:3]
            longest = max(longest, len(name))
            give(name, *s[:3])
            while opened and (c := _COMMA.match(text, s[3])) and (s := _literal(text, c.end())):  # the rest of a list
                give(name, *s[:3])
            continue
        if sign == ":" and (s := _BLOCK.match(text, right)):
            start, end = _block(text, place, s.end())
        else:
            start = _BLANK.match(text, right).end()
            if start >= over:
                s = _BARE.match(text, start)
                over = s.end() if s else start
            end = over
            if (f := _ELSE.match(text, end)) and (s := _literal(text, f.end())):
                known[name] = s[:3]
                longest = max(longest, len(name))
                give(name, *s[:3])
                continue
            while end > start and text[end - 1] in ".,:":
                end -= 1
            if end - start <= longest and text[start:end] in known:  # the name takes over the other's constant
                value, at, until = known[text[start:end]]
                if (f := _PLUS.match(text, end)) and (s := _literal(text, f.end())):
                    value = (text[at:until] if value is None else value) + s[0]
                    give(name, value, *s[1:3])
                known[name] = value, at, until
                longest = max(longest, len(name))
                give(name, value, at, until)
                continue
            bare.append(len(found))
        if end > start:
            known[name] = None, start, end
            longest = max(longest, len(name))
            found.append((name, None, start, end))
    for k in bare:
        if k < len(found) and found[k][1] is None and found[k][3] - found[k][2] <= longest:
            name, _, start, end = found[k]
            if (later := known.get(text[start:end])) and later[1] > end:  # set further on
                found[k] = (name, *later)
    return found + [(e[1], None, e.start(2) + len(e[2]) - len(e[2].lstrip()), e.start(2) + len(e[2].rstrip())) for e in _ELEMENT.finditer(text) if e[1] == e[3] and e[2].strip()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the lexer, apart from the spans given and from each other."""
    best: dict[tuple[int, int], tuple[float, str | None]] = {}
    for name, value, start, end in constants(text):
        weight = name_weight(name)
        if weight >= THRESHOLD and weight > best.get((start, end), (0.0, None))[0]:
            best[start, end] = (weight, value)
    found: list[tuple[int, int, int]] = []
    last = 0
    ordered = sorted(best)
    for (start, end), free in zip(ordered, apart([(a, 3, b) for a, b in ordered], base)):
        weight, value = best[start, end]
        if start < last or not free:
            continue
        if weight * looks_generated(text[start:end] if value is None else value) >= THRESHOLD:
            found.append((start, 3, end))
            last = end
    return found


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def suspects(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows that may have a span: all others hold none of what every span needs."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    places = []
    for hint, within in [(b"AKIA", raw), *((h, low) for h in HINTS)]:
        at = within.find(hint)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right"))
            places.append(row - 1)
            at = within.find(hint, int(offsets[row]) if row < len(offsets) else len(within))  # the next row
    starts, ends = runs(_HEX[data], offsets)
    places += (np.searchsorted(offsets, starts[ends - starts >= 32], "right") - 1).tolist()
    return set(places)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans of each row."""
    nothing = hashlib.sha256(b"").hexdigest()

    def read(batches):
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            texts = batch.column(1)
            for i, _, data, offsets in chunks(texts):
                for k in suspects(data, offsets):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    base = base_spans(text)
                    every = sorted(base + literal_spans(text, base))
                    for _, kind, _ in every:
                        counts[kind, i + k] += 1
                    digest[i + k] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i + k] = joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{x} long" for x in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, schema)
