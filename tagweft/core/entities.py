"""Character references."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5 as NAMED

_LONGEST = max(map(len, NAMED))
_NAME = re.compile(r"[A-Za-z0-9]+;?")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NUMBER = re.compile(r"#(?:[xX]([0-9A-Fa-f]*)|([0-9]*))(;?)")
_AMBIGUOUS = re.compile(r"[A-Za-z0-9]*")

#: What the standard reads for references to the C1 controls, from 0x80 on: fixed values; None: as it is.
_C1 = "€\0‚ƒ„…†‡ˆ‰Š‹Œ\0Ž\0\0‘’“”•–—˜™š›œ\0žŸ"


def is_noncharacter(c: int) -> bool:
    return 0xFDD0 <= c <= 0xFDEF or c & 0xFFFE == 0xFFFE


def numeric(code: int) -> tuple[str, str | None]:
    """(character, error) of a numeric reference."""
    if code == 0:
        return "�", "null-character-reference"
    if code > 0x10FFFF:
        return "�", "character-reference-outside-unicode-range"
    if 0xD800 <= code <= 0xDFFF:
        return "�", "surrogate-character-reference"
    if is_noncharacter(code):
        return chr(code), "noncharacter-character-reference"
    if 0x80 <= code <= 0x9F:
        c = _C1[code - 0x80]
        return (chr(code) if c == "\0" else c), "control-character-reference"
    if code == 0x0D or code < 0x20 and code not in (0x09, 0x0A, 0x0C) or code == 0x7F:
        return chr(code), "control-character-reference"
    return chr(code), None


def reference(text: str, at: int, attribute: bool, error: Callable[[str, int], None] | None = None) -> tuple[str, int]:
    """What the reference at text[at] == '&' stands for, and where it ends. Without one, '&' itself."""
    if text.startswith("#", at + 1):
        m = _NUMBER.match(text, at + 1)
        digits = m[1] if m[1] is not None else m[2]
        if not digits:
            if error:
                error("absence-of-digits-in-numeric-character-reference", m.end() - len(m[3]))
            return text[at : m.end() - len(m[3])], m.end() - len(m[3])
        significant = digits.lstrip("0")
        code = 0x110000 if len(significant) > 8 else int(digits[-9:], 16 if m[1] is not None else 10)
        c, problem = numeric(code)
        if error:
            if not m[3]:
                error("missing-semicolon-after-character-reference", m.end())
            if problem:
                error(problem, m.end())
        return c, m.end()
    m = _NAME.match(text, at + 1, at + 1 + _LONGEST)
    if m:
        name = m[0]
        for k in range(len(name), 1, -1):
            found = NAMED.get(name[:k])
            if found is None:
                continue
            end = at + 1 + k
            if name[k - 1] != ";":
                if attribute and (text.startswith("=", end) or _ALNUM.match(text, end)):
                    break
                if error:
                    error("missing-semicolon-after-character-reference", end)
            return found, end
        else:
            end = _AMBIGUOUS.match(text, at + 1).end()
            if error and text.startswith(";", end):
                error("unknown-named-character-reference", end)
    return "&", at + 1


def unescape(text: str, attribute: bool = False) -> str:
    """The text with its character references resolved."""
    at = text.find("&")
    if at < 0:
        return text
    out, last = [], 0
    while at >= 0:
        c, end = reference(text, at, attribute)
        out += [text[last:at], c]
        last = end
        at = text.find("&", end)
    out.append(text[last:])
    return "".join(out)
