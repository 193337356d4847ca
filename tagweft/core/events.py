"""SAX-like events without a tree, and rewriting by tokens.

The parser's feedback to the tokenizer is guessed from the tags alone, so events differ from the tree in known ways:

* `noscript` is always raw text.
* A breakout tag leaves one level of foreign content, and is no HTML tag yet: no text mode and no line feed depend on it.
* A self-closing `svg` or `math` opens foreign content that only its end tag leaves; `</p>` and `</br>` don't leave it.
* The end of `annotation-xml` is only noticed if the end tag itself has the encoding.
* A first line feed is skipped after <pre> even if tags come between.

Text is one event between two others, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .builder import _TEXT_MODES
from .names import BREAKOUT, FOREIGN_ATTRIBUTES, HTML, MATHML, SVG, SVG_ATTRIBUTES, SVG_TAGS, has_unescaped_text
from .output import escape_attribute, escape_text
from .tokenizer import COMMENT, DOCTYPE, END, EOF, PLAINTEXT, START, TEXT, Input, Tokenizer, lower


class Event:
    """kind; name and attrs [(name, value, prefix, namespace)] of tags; text of text and comments; ids of a doctype; start
    and end in the input; last_tag, the start tag last seen."""

    __slots__ = ("kind", "name", "attrs", "self_closing", "text", "public_id", "system_id", "start", "end", "last_tag")

    def __init__(self, kind, start, end):
        self.kind, self.start, self.end = kind, start, end
        self.name = self.text = self.public_id = self.system_id = self.last_tag = None
        self.attrs, self.self_closing = [], False


#: Tags whose start opens foreign content, and at whose end it is over.
_ROOTS = {"svg": SVG, "math": MATHML}
#: Elements of foreign content that hold HTML.
_HOLD_HTML = {SVG: ("foreignObject", "desc", "title"), MATHML: ("mi", "mo", "mn", "ms", "mtext")}
_LEAVE = "leave"


def _written(space: str, name: str) -> str:
    """A tag's name as its namespace writes it."""
    return SVG_TAGS.get(name, name) if space == SVG else name


def _holds_html(space: str, name: str, attrs: list) -> bool:
    if space == MATHML and name == "annotation-xml":
        return any(a[0] == "encoding" and lower(a[1]) in ("text/html", "application/xhtml+xml") for a in attrs)
    return _written(space, name) in _HOLD_HTML.get(space, ())


def _effect(kind: str, name: str, attrs: list, self_closing: bool, here: str, around: str) -> str | None:
    """What a tag does to the namespace `here`, which stands in `around`: it enters the one returned, _LEAVEs, or neither."""
    if kind == END:
        over = _holds_html(around, name, attrs) if here == HTML else _ROOTS.get(name) == here
        return _LEAVE if over else None
    if name in _ROOTS:
        return _ROOTS[name]
    if here == HTML:
        return None
    if name in BREAKOUT or name == "font" and any(a[0] in ("color", "face", "size") for a in attrs):
        return _LEAVE
    return HTML if not self_closing and _holds_html(here, name, attrs) else None


def _foreign_attribute(space: str, a) -> tuple:
    if a[0] in FOREIGN_ATTRIBUTES:
        prefix, name, own = FOREIGN_ATTRIBUTES[a[0]]
        return name, a[1], prefix, own
    name = SVG_ATTRIBUTES.get(a[0], a[0]) if space == SVG else "definitionURL" if a[0] == "definitionurl" else a[0]
    return name, a[1], "", ""


class Guess:
    """What the tree would tell the tokenizer, guessed from the tags alone."""

    def __init__(self, tokens: Tokenizer):
        self.tokens, self.spaces, self.skip_newline = tokens, [HTML], False

    @property
    def foreign(self) -> bool:
        return self.spaces[-1] != HTML

    def tag(self, kind: str, name: str, attrs: list, self_closing: bool) -> tuple[str, list]:
        """The name and attributes of the event."""
        here, around = self.spaces[-1], self.spaces[-2] if len(self.spaces) > 1 else HTML
        effect = _effect(kind, name, attrs, self_closing, here, around)
        if effect == _LEAVE:
            self.spaces.pop()
        elif effect:
            self.spaces.append(effect)
        self.tokens.foreign = self.foreign
        plain = [(a[0], a[1], "", "") for a in attrs]
        if kind == END:
            return _written(self.spaces[-1], name), plain
        if effect == _LEAVE:
            return name, plain
        space = _ROOTS.get(name, here)
        if space != HTML:
            return _written(space, name), [_foreign_attribute(space, a) for a in attrs]
        self.skip_newline = self.skip_newline or name in ("pre", "textarea", "listing")
        if name in _TEXT_MODES:
            self.tokens.mode = PLAINTEXT if name == "plaintext" else _TEXT_MODES[name]
        return "img" if name == "image" else name, plain


def events(html: str, raw_newlines: bool = False) -> tuple[Input, Iterator[Event]]:
    """raw_newlines: keep a first line feed after <pre>, as the rewriter must."""
    source = Input(html)

    def run() -> Iterator[Event]:
        tokens = Tokenizer(source.text)
        guess = Guess(tokens)
        text: Event | None = None
        while True:
            token = tokens.next()
            if token.kind == TEXT:
                value = token.text
                if guess.foreign:
                    value = value.replace("\0", "�")
                if guess.skip_newline and not raw_newlines:
                    # white space that doesn't begin with a line feed leaves the flag as it is
                    if value.startswith("\n"):
                        value, guess.skip_newline = value[1:], False
                    elif value.strip("\t\n\f\r "):
                        guess.skip_newline = False
                else:
                    guess.skip_newline = False
                if text is None:
                    text = Event(TEXT, token.start, token.end)
                    text.text, text.last_tag = value, tokens.last_start_tag
                else:
                    text.text, text.end = text.text + value, token.end
                continue
            if text is not None:
                if text.text or raw_newlines:
                    yield text
                text = None
            if token.kind == EOF:
                return
            event = Event(token.kind, token.start, token.end)
            event.last_tag = tokens.last_start_tag
            if token.kind in (START, END):
                event.name, attrs = guess.tag(token.kind, token.name, token.attrs, token.self_closing)
                event.self_closing = token.self_closing
                event.attrs = attrs if token.kind == START else []
            elif token.kind == COMMENT:
                event.text = token.data
            elif token.kind == DOCTYPE:
                event.name, event.public_id, event.system_id = token.name, token.public_id, token.system_id
            yield event

    return source, run()


def render(event: Event) -> str:
    """The event as markup; an attribute's prefix is not written."""
    if event.kind == START:
        attrs = "".join(f' {a[0]}="{escape_attribute(a[1])}"' for a in event.attrs)
        return f"<{event.name}{attrs}{'/' if event.self_closing else ''}>"
    if event.kind == END:
        return f"</{event.name}>"
    if event.kind == COMMENT:
        return f"<!--{event.text}-->"
    if event.kind == TEXT:
        return event.text if event.last_tag is not None and has_unescaped_text(event.last_tag, True) else escape_text(event.text)
    out = f"<!DOCTYPE {'null' if event.name is None else event.name}"
    if event.public_id is not None:
        out += f' PUBLIC "{event.public_id}"'
    elif event.system_id is not None:
        out += " SYSTEM"
    if event.system_id is not None:
        out += f' "{event.system_id}"'
    return out + ">"


def rewrite(html: str, handler: Callable[[Event, str], str | None]) -> str:
    """handler(event, raw) gives what is written in the event's place; None keeps the source as it stands, byte for byte."""
    source, found = events(html, raw_newlines=True)
    out, last = [], 0
    for event in found:
        raw = source.raw_slice(event.start, event.end)
        if event.start > last:
            out.append(source.raw_slice(last, event.start))  # markup that makes no event, as </>
        written = handler(event, raw)
        out.append(raw if written is None else written)
        last = event.end
    out.append(source.raw_slice(last, len(source.text)))
    return "".join(out)
