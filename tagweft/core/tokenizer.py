"""The HTML tokenizer: whole strings, scanned by regular expressions in runs.

Offsets are those of the normalised text (line ends are LF); `Input` maps them to UTF-16 offsets, lines and columns of the
text as given. A consumer sets `mode` and `foreign` between tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .entities import reference

DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA = "data", "rcdata", "rawtext", "script", "plaintext", "cdata"

START, END, TEXT, COMMENT, DOCTYPE, EOF = "start", "end", "text", "comment", "doctype", "eof"

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TAG_NAME = re.compile(r"[^\t\n\f />]+")
_SPACE = re.compile(r"[\t\n\f ]*")
_ATTR_NAME = re.compile(r"=?[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]+")
#: A plain attribute, which most are: name="value" without references or oddities.
_PLAIN = re.compile(r"[\t\n\f ]+([a-z][a-z0-9-]*)=\"([^\"&\0]*)\"(?=[\t\n\f />])")
_BREAK = re.compile(r"[<&\0]")
_LETTER = re.compile(r"[A-Za-z]")
_CONTROL = re.compile("[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f]|[﷐-﷯]|[" + "".join(chr(p * 0x10000 + c) for p in range(17) for c in (0xFFFE, 0xFFFF)) + "]")
_COMMENT_STOP = re.compile(r"--!?>|\0|<!--(?!>)")
_DOCTYPE_NAME = re.compile(r"[^\t\n\f >]+")
_PLAIN_SCRIPT, _ESCAPED = re.compile(r"<!--|<"), re.compile(r"-->|<")
_SCRIPT_TAG = re.compile(r"<(/?)script[\t\n\f />]", re.I | re.A)


def lower(s: str) -> str:
    return s.translate(_UPPER)


class Token:
    """kind, and as far as it has them: name, attrs [(name, value, start, end)], self_closing; parts [(text, start, end)]
    of text; data of a comment; public_id, system_id, force_quirks; start and end."""

    __slots__ = ("kind", "name", "attrs", "self_closing", "parts", "data", "public_id", "system_id", "force_quirks", "start", "end", "acknowledged")

    def __init__(self, kind, start, name=None):
        self.kind, self.start, self.end, self.name = kind, start, start, name
        self.attrs, self.self_closing, self.acknowledged = [], False, False
        self.parts = self.data = self.public_id = self.system_id = None
        self.force_quirks = False

    def get(self, name: str) -> str | None:
        return next((a[1] for a in self.attrs if a[0] == name), None)

    @property
    def text(self) -> str:
        return self.parts[0][0] if len(self.parts) == 1 else "".join([p[0] for p in self.parts])


class Input:
    """A text with LF line ends, and its places in the original."""

    def __init__(self, raw: str):
        self.raw = raw
        self.text = raw.replace("\r\n", "\n").replace("\r", "\n") if "\r" in raw else raw
        self._map = self._lines = None

    def offset(self, at: int) -> int:
        """The UTF-16 offset in the original text."""
        if self._map is None:
            raw = self.raw
            if len(raw) == len(self.text) and raw.isascii() or raw is self.text and max(raw, default="") < "\U00010000":
                self._map = ()
            else:
                places, k, i = [], 0, 0
                while i < len(raw):
                    places.append(k)
                    c = raw[i]
                    if c == "\r" and raw.startswith("\n", i + 1):
                        i, k = i + 1, k + 1
                    i, k = i + 1, k + (2 if c > "￿" else 1)
                self._map = [*places, k]
        return self._map[at] if self._map else at

    def raw_slice(self, start: int, end: int) -> str:
        if self.raw is self.text:
            return self.raw[start:end]
        a, b = self.offset(start), self.offset(end)
        return self.raw.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le")

    def position(self, at: int) -> tuple[int, int, int]:
        """(line, column, offset), the first two from 1."""
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        line = bisect_right(self._lines, at)
        offset = self.offset(at)
        return line, offset - self.offset(self._lines[line - 1]) + 1, offset

    def problems(self):
        """Control characters and noncharacters of the text: (code, place)."""
        for m in _CONTROL.finditer(self.text):
            c = ord(m[0])
            yield ("control-character-in-input-stream" if c < 0xA0 else "noncharacter-in-input-stream"), m.start()


class Tokenizer:
    def __init__(self, text: str, mode: str = DATA, last_start_tag: str | None = None, errors: list | None = None):
        self.text, self.pos, self.mode = text, 0, mode
        self.last_start_tag, self.errors = last_start_tag, errors
        self.foreign = False

    def error(self, code: str, at: int) -> None:
        if self.errors is not None:
            self.errors.append((code, at, at))

    def insert(self, text: str) -> None:
        """Text to be read next (document.write)."""
        self.text = self.text[: self.pos] + text + self.text[self.pos :]

    def next(self) -> Token:
        while True:
            mode = self.mode
            if mode == CDATA:
                token = self._cdata()
                if token is not None:
                    return token
                continue
            if self.pos >= len(self.text):
                return Token(EOF, len(self.text))
            if mode == DATA or mode == RCDATA:
                token = self._text(mode == RCDATA)
            elif mode == PLAINTEXT:
                token = self._raw(len(self.text))
            else:
                token = self._raw(self._script_end() if mode == SCRIPT else self._raw_end())
            if token is None:
                token = self._tag()
            if token is not None:
                return token

    # --- text -------------------------------------------------------------------------------------------------------

    def _part(self, parts: list, text: str, start: int, end: int) -> None:
        if text:
            parts.append((text, start, end))

    def _text(self, rcdata: bool) -> Token | None:
        """Text up to the next markup; None where markup begins."""
        text, n, i = self.text, len(self.text), self.pos
        parts: list[tuple[str, int, int]] = []
        start = run = i
        while True:
            m = _BREAK.search(text, i)
            at = m.start() if m else n
            if m is None:
                self._part(parts, text[run:n], run, n)
                i = n
                break
            c = text[at]
            if c == "<":
                if rcdata:
                    if self._closes(at):
                        self._part(parts, text[run:at], run, at)
                        i = at
                        break
                elif self._opens(at):
                    self._part(parts, text[run:at], run, at)
                    i = at
                    break
                i = at + 1
            elif c == "&":
                found, end = reference(text, at, False, self.error if self.errors is not None else None)
                if end == at + 1:
                    i = end
                    continue
                self._part(parts, text[run:at], run, at)
                parts.append((found, at, end))
                i = run = end
            else:
                self.error("unexpected-null-character", at)
                self._part(parts, text[run:at], run, at)
                parts.append(("�" if rcdata else "\0", at, at + 1))
                i = run = at + 1
        if not parts:
            return None
        token = Token(TEXT, start)
        token.parts, token.end = parts, i
        self.pos = i
        return token

    def _opens(self, at: int) -> bool:
        """Whether markup begins at '<'; if not, it is text."""
        c = self.text[at + 1 : at + 2]
        if _LETTER.match(c) or c == "!" or c == "?":
            return True
        if c == "/":
            if at + 2 < len(self.text):
                return True
            self.error("eof-before-tag-name", at + 2)
        elif c == "":
            self.error("eof-before-tag-name", at + 1)
        else:
            self.error("invalid-first-character-of-tag-name", at + 1)
        return False

    def _closes(self, at: int) -> bool:
        """Whether the end tag of the last start tag begins at '<'."""
        name, text = self.last_start_tag, self.text
        if not name or not text.startswith("/", at + 1):
            return False
        end = at + 2 + len(name)
        return lower(text[at + 2 : end]) == name and text[end : end + 1] in ("\t", "\n", "\f", " ", "/", ">") and end < len(text)

    def _raw_end(self) -> int:
        """Where raw text ends: at its end tag, or at the end of the text."""
        text, i = self.text, self.pos
        while (at := text.find("</", i)) >= 0:
            if self._closes(at):
                return at
            i = at + 2
        return len(text)

    def _script_end(self) -> int:
        """Where script text ends; in `<!-- <script> </script> -->` the inner end tag ends nothing."""
        text, i = self.text, self.pos
        escaped = inner = False
        while True:
            m = (_ESCAPED if escaped else _PLAIN_SCRIPT).search(text, i)
            if m is None:
                if escaped:
                    self.error("eof-in-script-html-comment-like-text", len(text))
                return len(text)
            at, i = m.start(), m.end()
            if m[0] == "-->":
                escaped = inner = False
            elif m[0] == "<!--":
                escaped, i = True, at + 2  # its dashes may belong to -->
            elif not inner and self._closes(at):
                return at
            elif escaped and (s := _SCRIPT_TAG.match(text, at)):
                if bool(s[1]) == inner:
                    inner = not inner
                i = s.end()

    def _raw(self, end: int) -> Token | None:
        start = self.pos
        if start == end:
            return None
        data = self.text[start:end]
        if "\0" in data:
            if self.errors is not None:
                for m in re.finditer("\0", data):
                    self.error("unexpected-null-character", start + m.start())
            data = data.replace("\0", "�")
        token = Token(TEXT, start)
        token.parts, token.end = [(data, start, end)], end
        self.pos = end
        return token

    def _cdata(self) -> Token | None:
        start, self.mode = self.pos, DATA
        end = self.text.find("]]>", start)
        if end < 0:
            self.error("eof-in-cdata", len(self.text))
            end = after = len(self.text)
        else:
            after = end + 3
        self.pos = after
        if start == end:
            return None
        token = Token(TEXT, start)
        parts = [(m[0], start + m.start(), start + m.end()) for m in re.finditer("\0|[^\0]+", self.text[start:end])]
        token.parts, token.end = parts, end
        return token

    # --- tags -------------------------------------------------------------------------------------------------------

    def _tag(self) -> Token | None:
        """The markup at '<'; None if it comes to nothing."""
        text, at = self.text, self.pos
        c = text[at + 1 : at + 2]
        if self.mode in (RCDATA, RAWTEXT, SCRIPT):
            self.mode = DATA
            return self._element(at, at + 2, END)
        if c == "/":
            d = text[at + 2]
            if _LETTER.match(d):
                return self._element(at, at + 2, END)
            if d == ">":
                self.error("missing-end-tag-name", at + 2)
                self.pos = at + 3
                return None
            self.error("invalid-first-character-of-tag-name", at + 2)
            return self._bogus(at, at + 2)
        if c == "!":
            return self._declaration(at)
        if c == "?":
            self.error("unexpected-question-mark-instead-of-tag-name", at + 1)
            return self._bogus(at, at + 1)
        return self._element(at, at + 1, START)

    def _name(self, raw: str, at: int) -> str:
        if "\0" in raw:
            for m in re.finditer("\0", raw):
                self.error("unexpected-null-character", at + m.start())
            raw = raw.replace("\0", "�")
        return lower(raw)

    def _element(self, start: int, at: int, kind: str) -> Token | None:
        text, n = self.text, len(self.text)
        m = _TAG_NAME.match(text, at)
        token = Token(kind, start, self._name(m[0], at))
        i, attrs, seen = m.end(), token.attrs, set()
        while m := _PLAIN.match(text, i):
            name = m[1]
            if name in seen:
                self.error("duplicate-attribute", m.end(1))
            else:
                seen.add(name)
                attrs.append((name, m[2], m.start(1), m.end()))
            i = m.end()
        quoted = -1  # where a quoted value has ended
        while True:
            spaced = _SPACE.match(text, i).end()
            after_value, i = spaced == i == quoted, spaced
            if i >= n:
                self.error("eof-in-tag", n)
                self.pos = n
                return None
            c = text[i]
            if c == ">":
                i += 1
                break
            if c == "/":
                if text.startswith(">", i + 1):
                    token.self_closing = True
                    i += 2
                    break
                if i + 1 >= n:
                    self.error("eof-in-tag", n)
                    self.pos = n
                    return None
                self.error("unexpected-solidus-in-tag", i + 1)
                i += 1
                continue
            if after_value:
                self.error("missing-whitespace-between-attributes", i)
            if c == "=":
                self.error("unexpected-equals-sign-before-attribute-name", i)
            m = _ATTR_NAME.match(text, i)
            raw, at = m[0], i
            if self.errors is not None:
                for odd in re.finditer("[\"'<]", raw):
                    self.error("unexpected-character-in-attribute-name", at + odd.start())
            name = self._name(raw, at)
            i = m.end()
            fresh = name not in seen
            if not fresh:
                self.error("duplicate-attribute", i)
            seen.add(name)
            value, end = "", i
            j = _SPACE.match(text, i).end()
            if text.startswith("=", j):
                j = _SPACE.match(text, j + 1).end()
                q = text[j : j + 1]
                if q == '"' or q == "'":
                    close = text.find(q, j + 1)
                    if close < 0:
                        self._value(text[j + 1 :], j + 1)
                        self.error("eof-in-tag", n)
                        self.pos = n
                        return None
                    value = self._value(text[j + 1 : close], j + 1)
                    i = end = quoted = close + 1
                elif q == ">":
                    self.error("missing-attribute-value", j)
                    i = end = j
                elif q == "":
                    self.error("eof-in-tag", n)
                    self.pos = n
                    return None
                else:
                    m = _UNQUOTED.match(text, j)
                    if self.errors is not None:
                        for odd in re.finditer("[\"'<=`]", m[0]):
                            self.error("unexpected-character-in-unquoted-attribute-value", j + odd.start())
                    value = self._value(m[0], j)
                    i = end = m.end()
            if fresh:
                attrs.append((name, value, at, end))
        token.end = self.pos = i
        if kind == START:
            self.last_start_tag = token.name
        else:
            if attrs:
                self.error("end-tag-with-attributes", i - 1)
            if token.self_closing:
                self.error("end-tag-with-trailing-solidus", i - 1)
        return token

    def _value(self, raw: str, at: int) -> str:
        if "\0" in raw:
            for m in re.finditer("\0", raw):
                self.error("unexpected-null-character", at + m.start())
            raw = raw.replace("\0", "�")
        if "&" not in raw:
            return raw
        # a reference may look at the character that follows the value only through `=` and letters, which quotes end
        out, last, k = [], 0, raw.find("&")
        report = (lambda code, place: self.error(code, at + place)) if self.errors is not None else None
        while k >= 0:
            c, end = reference(raw, k, True, report)
            out += [raw[last:k], c]
            last = end
            k = raw.find("&", end)
        return "".join([*out, raw[last:]])

    # --- comments and declarations ------------------------------------------------------------------------------------

    def _bogus(self, start: int, at: int) -> Token:
        end = self.text.find(">", at)
        after = end + 1 if end >= 0 else len(self.text)
        end = end if end >= 0 else len(self.text)
        token = Token(COMMENT, start)
        token.data = self.text[at:end]
        if "\0" in token.data:
            for m in re.finditer("\0", token.data):
                self.error("unexpected-null-character", at + m.start())
            token.data = token.data.replace("\0", "�")
        token.end = self.pos = after
        return token

    def _declaration(self, start: int) -> Token | None:
        text, at = self.text, start + 2
        if text.startswith("--", at):
            return self._comment(start, at + 2)
        if lower(text[at : at + 7]) == "doctype":
            return self._doctype(start, at + 7)
        if text.startswith("[CDATA[", at):
            if self.foreign:
                self.pos, self.mode = at + 7, CDATA
                return None
            self.error("cdata-in-html-content", at + 7)
            return self._bogus(start, at)
        self.error("incorrectly-opened-comment", at)
        return self._bogus(start, at)

    def _comment(self, start: int, at: int) -> Token:
        text, n = self.text, len(self.text)
        token = Token(COMMENT, start)
        for close in (">", "->"):
            if text.startswith(close, at):
                self.error("abrupt-closing-of-empty-comment", at + len(close) - 1)
                token.data, token.end = "", at + len(close)
                self.pos = token.end
                return token
        i = at
        while True:
            m = _COMMENT_STOP.search(text, i)
            if m is None:
                self.error("eof-in-comment", n)
                end = n
                for tail in ("--!", "--", "-"):  # what might have begun the end is no part of it
                    if text.endswith(tail) and n - len(tail) >= at:
                        end = n - len(tail)
                        break
                token.data, token.end = text[at:end], n
                break
            if m[0] == "\0":
                self.error("unexpected-null-character", m.start())
                i = m.end()
            elif m[0] == "<!--":
                if m.end() < n:
                    self.error("nested-comment", m.end())
                i = m.end() - 2  # its dashes may begin the end
            else:
                if m[0] == "--!>":
                    self.error("incorrectly-closed-comment", m.end() - 1)
                token.data, token.end = text[at : m.start()], m.end()
                break
        token.data = token.data.replace("\0", "�")
        self.pos = token.end
        return token

    def _doctype(self, start: int, at: int) -> Token:
        text, n = self.text, len(self.text)
        token = Token(DOCTYPE, start)

        def done(end: int, quirks: bool = False) -> Token:
            token.force_quirks = token.force_quirks or quirks
            token.end = self.pos = end
            return token

        def eof() -> Token:
            self.error("eof-in-doctype", n)
            return done(n, True)

        def bogus(i: int) -> Token:
            end = text.find(">", i)
            if self.errors is not None:
                for m in re.finditer("\0", text[i : end if end >= 0 else n]):
                    self.error("unexpected-null-character", i + m.start())
            return done(end + 1 if end >= 0 else n)

        i = _SPACE.match(text, at).end()
        if i >= n:
            return eof()
        if i == at and text[i] != ">":
            self.error("missing-whitespace-before-doctype-name", i)
        if text[i] == ">":
            self.error("missing-doctype-name", i)
            return done(i + 1, True)
        m = _DOCTYPE_NAME.match(text, i)
        token.name = self._name(m[0], i)
        i = _SPACE.match(text, m.end()).end()
        if i >= n:
            return eof()
        if text[i] == ">":
            return done(i + 1)
        word = lower(text[i : i + 6])
        if word not in ("public", "system"):
            self.error("invalid-character-sequence-after-doctype-name", i)
            token.force_quirks = True
            return bogus(i)
        i += 6
        kinds = ("public", "system") if word == "public" else ("system",)
        for k, kind in enumerate(kinds):
            spaced = _SPACE.match(text, i).end()
            if spaced >= n:
                return eof()
            c = text[spaced]
            if kind == "system" and k == 1:
                if c == ">":
                    return done(spaced + 1)
                if spaced == i and c in "\"'":
                    self.error("missing-whitespace-between-doctype-public-and-system-identifiers", spaced)
            elif spaced == i and c in "\"'":
                self.error(f"missing-whitespace-after-doctype-{kind}-keyword", spaced)
            if c not in "\"'":
                if c == ">":
                    self.error(f"missing-doctype-{kind}-identifier", spaced)
                    return done(spaced + 1, True)
                self.error(f"missing-quote-before-doctype-{kind}-identifier", spaced)
                token.force_quirks = True
                return bogus(spaced)
            m = re.compile(f"[^{c}>]*").match(text, spaced + 1)
            raw, end = m[0], m.end()
            for z in re.finditer("\0", raw):
                self.error("unexpected-null-character", spaced + 1 + z.start())
            setattr(token, f"{kind}_id", raw.replace("\0", "�"))
            if end >= n:
                return eof()
            if text[end] == ">":
                self.error(f"abrupt-doctype-{kind}-identifier", end)
                return done(end + 1, True)
            i = end + 1
        i = _SPACE.match(text, i).end()
        if i >= n:
            return eof()
        if text[i] != ">":
            self.error("unexpected-character-after-doctype-system-identifier", i)
            return bogus(i)
        return done(i + 1)
