"""Tree construction: tokens to a tree, by the rules of the HTML standard."""

from __future__ import annotations

import re
from collections.abc import Callable

from .names import (
    BLOCK_ENDS,
    BLOCKS,
    BREAKOUT,
    FOREIGN_ATTRIBUTES,
    FORMATTING,
    HEAD_TAGS,
    HEADINGS,
    HTML,
    IMPLIED,
    IMPLIED_THOROUGH,
    MATHML,
    NO_QUIRKS,
    QUIRKS,
    SCOPE,
    SPECIAL,
    SVG,
    SVG_ATTRIBUTES,
    SVG_TAGS,
    TABLE_CONTEXT,
    conforming,
    doctype_mode,
)
from .tokenizer import COMMENT, DATA, DOCTYPE, END, EOF, PLAINTEXT, RAWTEXT, RCDATA, SCRIPT, START, TEXT, Input, Token, Tokenizer, lower

_SPLIT = re.compile("\0+|[\t\n\f\r ]+|[^\0\t\n\f\r ]+")
_BLANK = re.compile("[\t\n\f\r ]*")
_TEXT_MODES = {"title": RCDATA, "textarea": RCDATA, "style": RAWTEXT, "xmp": RAWTEXT, "iframe": RAWTEXT, "noembed": RAWTEXT, "noframes": RAWTEXT, "noscript": RAWTEXT, "script": SCRIPT, "plaintext": PLAINTEXT}
_ANY_MARK = None


class Node:
    """kind: document, fragment, element, text, comment or doctype. place: (start, end) of the source, or None for what is
    implied; start_tag and end_tag likewise."""

    __slots__ = ("kind", "name", "ns", "attrs", "children", "parent", "value", "public_id", "system_id", "content", "place", "start_tag", "end_tag", "attr_places")

    def __init__(self, kind, name=None, ns=None, attrs=(), value=None):
        self.kind, self.name, self.ns, self.attrs, self.value = kind, name, ns, attrs, value
        self.children, self.parent, self.content = [], None, None
        self.public_id = self.system_id = None
        self.place = self.start_tag = self.end_tag = self.attr_places = None

    def get(self, name: str) -> str | None:
        return next((a[1] for a in self.attrs if a[0] == name and not a[2]), None)

    def append(self, child: "Node") -> None:
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: "Node") -> None:
        child.parent = self
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            for k in range(len(self.parent.children) - 1, -1, -1):
                if self.parent.children[k] is self:
                    del self.parent.children[k]
                    break
            self.parent = None


class Entry:
    """Of the list of active formatting elements."""

    __slots__ = ("node", "token")

    def __init__(self, node, token):
        self.node, self.token = node, token


class Parser:
    """One text. context: a fragment's element, as an element Node, or None for a document."""

    def __init__(self, html: str, context: Node | None = None, scripting: bool = True, errors: bool = False, on_script: Callable[[Node], str | None] | None = None, hooks: Callable[[str, Node], None] | None = None):
        self.input = Input(html)
        self.found: list[tuple[str, int, int]] | None = [] if errors else None
        self.tokens = Tokenizer(self.input.text, errors=self.found)
        self.scripting, self.on_script, self.hooks = scripting, on_script, hooks
        self.document = Node("document")
        self.mode = NO_QUIRKS
        self.open: list[Node] = []
        self.active: list[Entry | None] = []
        self.templates: list[str] = []
        self.state = self.original = "initial"
        self.head = self.form = None
        self.frameset_ok, self.fostering, self.skip_newline = True, False, False
        self.pending: list[tuple[str, int, int]] = []
        self.context = context
        self.token: Token | None = None
        self.stopped = False
        if context is not None:
            self.document = Node("fragment")
            self._fragment(context)
        if errors:
            self.found += [(code, at, at) for code, at in self.input.problems()]

    def _fragment(self, context: Node) -> None:
        if context.ns == HTML:
            self.tokens.mode = _TEXT_MODES.get(context.name, DATA)
            if context.name == "template":
                self.templates.append("in_template")
        root = Node("element", "html", HTML, [])
        self.document.append(root)
        self._push(root)
        self._reset()
        at = context
        while at is not None:
            if at.kind == "element" and at.name == "form" and at.ns == HTML:
                self.form = at
                break
            at = at.parent
        self._flag()

    def parse(self) -> Node:
        tokens = self.tokens
        while not self.stopped:
            token = self.token = tokens.next()
            if token.kind == TEXT:
                self._characters(token)
            else:
                self.skip_newline = False
                self.process(token)
                if token.kind == START and token.self_closing and not token.acknowledged:
                    self.error("non-void-html-element-start-tag-with-trailing-solidus", token)
        return self.document

    # --- helpers ----------------------------------------------------------------------------------------------------

    def error(self, code: str, token: Token, point: bool = False) -> None:
        if self.found is not None:
            self.found.append((code, token.start, token.start if point else token.end))

    @property
    def current(self) -> Node:
        return self.open[-1]

    def _adjusted(self) -> Node:
        return self.context if self.context is not None and len(self.open) == 1 else self.open[-1]

    def _flag(self) -> None:
        """Tells the tokenizer whether CDATA sections are read."""
        top = self._adjusted() if self.open else None
        self.tokens.foreign = top is not None and top.ns != HTML and top.kind == "element"

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self._flag()
        if self.hooks:
            self.hooks("push", node)

    def _pop(self) -> Node:
        node = self.open.pop()
        self._close(node)
        self._flag()
        if self.hooks:
            self.hooks("pop", node)
        return node

    def _remove(self, node: Node) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] is node:
                del self.open[k]
                self._close(node)
                self._flag()
                if self.hooks:
                    self.hooks("pop", node)
                return

    def _close(self, node: Node) -> None:
        """Where an element ends: after its own end tag, or where the token begins that closes it."""
        token = self.token
        if token is None or node.place is None:
            return
        if token.kind == END and token.name == lower(node.name) and node.end_tag is None:
            node.end_tag = (token.start, token.end)
            node.place = (node.place[0], token.end)
        else:
            node.place = (node.place[0], max(node.place[1], token.start))

    def _is(self, node: Node, *names: str) -> bool:
        return node.ns == HTML and node.name in names

    def _has(self, name: str) -> bool:
        return any(n.ns == HTML and n.name == name for n in self.open)

    def in_scope(self, names, more: str = "") -> bool:
        """names: a tag name, a set of them, or a node. more: tags that end the search besides the usual ones."""
        for node in reversed(self.open):
            if node is names or node.ns == HTML and (node.name == names if isinstance(names, str) else not isinstance(names, Node) and node.name in names):
                return True
            if node.name in SCOPE.get(node.ns, ()) or more and node.ns == HTML and node.name in more.split():
                return False
        return True

    def in_table_scope(self, names) -> bool:
        for node in reversed(self.open):
            if node.ns == HTML:
                if node.name == names or not isinstance(names, str) and node.name in names:
                    return True
                if node.name in ("table", "html", "template"):
                    return False
        return True

    def in_select_scope(self, name: str) -> bool:
        for node in reversed(self.open):
            if node.ns == HTML:
                if node.name == name:
                    return True
                if node.name not in ("option", "optgroup"):
                    return False
        return True

    def implied(self, tags=IMPLIED, but: str | None = None) -> None:
        while self.open and self.current.ns == HTML and self.current.name in tags and self.current.name != but:
            self._pop()

    def pop_until(self, *names: str) -> None:
        while len(self.open) > 0:
            node = self._pop()
            if node.ns == HTML and node.name in names:
                return

    def clear_to(self, *names: str) -> None:
        while not self._is(self.current, *names, "template", "html"):
            self._pop()

    # --- insertion --------------------------------------------------------------------------------------------------

    def _spot(self, target: Node | None = None) -> tuple[Node, int]:
        """(parent, index) where a node goes."""
        node = target or self.current
        if self.fostering and node.ns == HTML and node.name in TABLE_CONTEXT:
            for k in range(len(self.open) - 1, -1, -1):
                own = self.open[k]
                if own.ns == HTML and own.name == "template":
                    return own.content, len(own.content.children)
                if own.ns == HTML and own.name == "table":
                    if own.parent is not None:
                        return own.parent, next(i for i in range(len(own.parent.children) - 1, -1, -1) if own.parent.children[i] is own)
                    below = self.open[k - 1]
                    return below, len(below.children)
            return self.open[0], len(self.open[0].children)
        if node.content is not None and node.ns == HTML:
            node = node.content
        return node, len(node.children)

    def _place_node(self, node: Node, target: Node | None = None) -> None:
        parent, at = self._spot(target)
        if at == len(parent.children):
            parent.append(node)
        else:
            parent.insert(at, node)

    def element(self, token: Token, ns: str = HTML) -> Node:
        attrs = [(a[0], a[1], "", "") for a in token.attrs]
        name = token.name
        if ns == SVG:
            name = SVG_TAGS.get(name, name)
            attrs = [(SVG_ATTRIBUTES.get(n, n), v, p, s) for n, v, p, s in attrs]
        elif ns == MATHML:
            attrs = [("definitionURL" if n == "definitionurl" else n, v, p, s) for n, v, p, s in attrs]
        if ns != HTML:
            attrs = [(FOREIGN_ATTRIBUTES[n][1], v, FOREIGN_ATTRIBUTES[n][0], FOREIGN_ATTRIBUTES[n][2]) if n in FOREIGN_ATTRIBUTES else (n, v, p, s) for n, v, p, s in attrs]
        node = Node("element", name, ns, attrs)
        node.place = node.start_tag = (token.start, token.end)
        node.attr_places = [(a[0], a[2], a[3]) for a in token.attrs]
        if ns == HTML and name == "template":
            node.content = Node("fragment")
        return node

    def insert(self, token: Token, ns: str = HTML) -> Node:
        node = self.element(token, ns)
        self._place_node(node)
        self._push(node)
        return node

    def insert_void(self, token: Token, ns: str = HTML) -> Node:
        node = self.element(token, ns)
        self._place_node(node)
        token.acknowledged = True
        return node

    def insert_implied(self, name: str) -> Node:
        node = Node("element", name, HTML, [])
        self._place_node(node)
        self._push(node)
        return node

    def insert_text(self, text: str, start: int, end: int) -> None:
        if not text:
            return
        parent, at = self._spot()
        if parent.kind == "document":
            return
        before = parent.children[at - 1] if at else None
        if before is not None and before.kind == "text":
            before.value += text
            if before.place:
                before.place = (before.place[0], end)
            return
        node = Node("text", value=text)
        node.place = (start, end)
        if at == len(parent.children):
            parent.append(node)
        else:
            parent.insert(at, node)

    def insert_parts(self, parts) -> None:
        if len(parts) == 1:
            self.insert_text(*parts[0])
        elif parts:
            self.insert_text("".join([p[0] for p in parts]), parts[0][1], parts[-1][2])

    def comment(self, token: Token, parent: Node | None = None) -> None:
        node = Node("comment", value=token.data)
        node.place = (token.start, token.end)
        if parent is None:
            self._place_node(node)
        else:
            parent.append(node)

    def text_mode(self, token: Token, mode: str) -> None:
        self.insert(token)
        self.tokens.mode = mode
        self.original, self.state = self.state, "text"

    # --- active formatting elements -----------------------------------------------------------------------------------

    def push_active(self, node: Node, token: Token) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            e = self.active[k]
            if e is None:
                break
            if e.node.name == node.name and e.node.ns == node.ns and sorted(e.node.attrs) == sorted(node.attrs):
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(Entry(node, token))

    def clear_to_mark(self) -> None:
        while self.active:
            if self.active.pop() is None:
                return

    def reconstruct(self) -> None:
        active = self.active
        if not active or active[-1] is None or active[-1].node in self.open:
            return
        k = len(active) - 1
        while k > 0 and active[k - 1] is not None and active[k - 1].node not in self.open:
            k -= 1
        for e in active[k:]:
            node = self.element(e.token)
            self._place_node(node)
            self._push(node)
            e.node = node

    def _entry(self, name: str) -> Entry | None:
        for e in reversed(self.active):
            if e is None:
                return None
            if e.node.name == name:
                return e
        return None

    def adoption_agency(self, token: Token) -> None:
        name = token.name
        for _ in range(8):
            entry = self._entry(name)
            if entry is None:
                self.any_end_tag(token)
                return
            formatting = entry.node
            if formatting not in self.open:
                self.active.remove(entry)
                return
            if not self.in_scope(formatting):
                return
            at = self.open.index(formatting)
            furthest = next((k for k in range(at + 1, len(self.open)) if self.open[k].name in SPECIAL.get(self.open[k].ns, ())), None)
            if furthest is None:
                while self._pop() is not formatting:
                    pass
                self.active.remove(entry)
                return
            block = self.open[furthest]
            ancestor = self.open[at - 1]
            mark = self.active.index(entry)
            last, k, inner = block, furthest, 0
            while True:
                inner += 1
                k -= 1
                node = self.open[k]
                if node is formatting:
                    break
                e = next((e for e in self.active if e is not None and e.node is node), None)
                if inner > 3 and e is not None:
                    if self.active.index(e) < mark:
                        mark -= 1
                    self.active.remove(e)
                    e = None
                if e is None:
                    self._remove(node)
                    continue
                clone = self.element(e.token)
                self.open[k] = clone
                e.node = clone
                if last is block:
                    mark = self.active.index(e) + 1
                last.detach()
                clone.append(last)
                last = clone
            last.detach()
            if ancestor.ns == HTML and ancestor.name in TABLE_CONTEXT:
                before, self.fostering = self.fostering, True
                self._place_node(last, ancestor)
                self.fostering = before
            else:
                (ancestor.content if ancestor.content is not None and ancestor.ns == HTML else ancestor).append(last)
            clone = self.element(entry.token)
            for child in block.children:
                child.parent = clone
            clone.children, block.children = block.children, []
            block.append(clone)
            new = Entry(clone, entry.token)
            old = self.active.index(entry)
            del self.active[old]
            self.active.insert(mark - 1 if old < mark else mark, new)
            self._remove(formatting)
            self.open.insert(self.open.index(block) + 1, clone)
            self._flag()

    def any_end_tag(self, token: Token) -> None:
        name = token.name
        for k in range(len(self.open) - 1, -1, -1):
            node = self.open[k]
            if node.ns == HTML and node.name == name:
                self.implied(IMPLIED_THOROUGH, but=name)
                while len(self.open) > k:
                    self._pop()
                return
            if node.name in SPECIAL.get(node.ns, ()):
                return

    # --- dispatch ---------------------------------------------------------------------------------------------------

    def process(self, token: Token) -> None:
        if token.kind in (START, END) and self._foreign(token):
            if token.kind == START:
                self._foreign_start(token)
            else:
                self._foreign_end(token)
        elif token.kind == COMMENT:
            self._comment_token(token)
        elif token.kind == DOCTYPE:
            self._doctype_token(token)
        else:
            _HANDLERS[self.state, token.kind](self, token)

    def again(self, token: Token) -> None:
        """The token once more, under the state as it is now."""
        if token.kind == TEXT:
            self._characters(token)
        else:
            _HANDLERS[self.state, token.kind](self, token)

    def _foreign(self, token: Token) -> bool:
        if not self.open:
            return False
        node = self._adjusted()
        if node.kind != "element" or node.ns == HTML:
            return False
        if token.kind == START:
            if _mathml_text(node) and token.name not in ("mglyph", "malignmark"):
                return False
            if node.ns == MATHML and node.name == "annotation-xml" and token.name == "svg":
                return False
            if _html_point(node):
                return False
        return True

    def _characters(self, token: Token) -> None:
        parts = token.parts
        if self.skip_newline:
            self.skip_newline = False
            text, start, end = parts[0]
            if text[0] == "\n":
                parts = ([(text[1:], start + 1, end)] if len(text) > 1 else []) + parts[1:]
                if not parts:
                    return
        if self.open:
            node = self._adjusted()
            if node.kind == "element" and node.ns != HTML and not _mathml_text(node) and not _html_point(node):
                if "".join([p[0] for p in parts]).strip("\0\t\n\f\r "):
                    self.frameset_ok = False
                self.insert_parts([(p[0].replace("\0", "�"), p[1], p[2]) for p in parts])
                return
        state = self.state
        if state in _BODY_TEXT:
            self._body_text(parts)
        elif state == "text":
            self.insert_parts(parts)
        else:
            self._run_by_run(parts)

    def _body_text(self, parts) -> None:
        text = "".join([p[0] for p in parts])
        if "\0" in text:
            parts = [(p[0].replace("\0", ""), p[1], p[2]) for p in parts]
            text = text.replace("\0", "")
        if not text:
            return
        self.reconstruct()
        self.insert_parts(parts)
        if self.frameset_ok and _BLANK.fullmatch(text) is None:
            self.frameset_ok = False

    def _run_by_run(self, parts) -> None:
        """Runs of white space, NUL and others, each under the state that the one before has left."""
        queue = []
        for text, start, end in parts:
            literal = len(text) == end - start
            for m in _SPLIT.finditer(text):
                queue.append((m[0], start + m.start(), start + m.end()) if literal else (m[0], start, end))
        for k, run in enumerate(queue):
            if self.state in _BODY_TEXT and not self.pending:
                self._body_text(queue[k:])
                return
            kind = "null" if run[0][0] == "\0" else "space" if run[0][0] in "\t\n\f\r " else "char"
            token = Token(TEXT, run[1])
            token.parts, token.end = [run], run[2]
            self._run(token, kind)

    def _run(self, token: Token, kind: str) -> None:
        _TEXT_HANDLERS[self.state](self, token, kind)

    def _comment_token(self, token: Token) -> None:
        foreign = self.open and self._adjusted().ns not in (None, HTML)
        if self.state == "in_table_text":
            self._flush_table_text()
        if not foreign and self.state in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.comment(token, self.document)
        elif not foreign and self.state == "after_body":
            self.comment(token, self.open[0])
        else:
            self.comment(token)

    def _doctype_token(self, token: Token) -> None:
        if self.state == "initial":
            node = Node("doctype", token.name or "")
            node.public_id, node.system_id = token.public_id or "", token.system_id or ""
            node.place = (token.start, token.end)
            self.document.append(node)
            self.mode = doctype_mode(token.name, token.public_id, token.system_id, token.force_quirks)
            if not conforming(token.name, token.public_id, token.system_id):
                self.error("non-conforming-doctype", token)
            self.state = "before_html"
        elif self.state in ("before_head", "in_head", "in_head_noscript", "after_head"):
            self.error("misplaced-doctype", token)
        elif self.state == "in_table_text":
            self._flush_table_text()

    def _reset(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node, last = self.open[k], k == 0
            if last and self.context is not None:
                node = self.context
            name = node.name if node.ns == HTML else None
            if name == "select":
                self.state = "in_select"
                for own in reversed(self.open[1:k]):
                    if self._is(own, "template"):
                        break
                    if self._is(own, "table"):
                        self.state = "in_select_in_table"
                        break
                return
            if name in ("td", "th") and not last:
                self.state = "in_cell"
            elif name == "head" and not last:
                self.state = "in_head"
            elif name in _RESET:
                self.state = _RESET[name]
            elif name == "template":
                self.state = self.templates[-1]
            elif name == "html":
                self.state = "before_head" if self.head is None else "after_head"
            elif last:
                self.state = "in_body"
            else:
                continue
            return

    def _merge(self, node: Node, token: Token) -> None:
        have = {a[0] for a in node.attrs}
        node.attrs = [*node.attrs, *((a[0], a[1], "", "") for a in token.attrs if a[0] not in have)]

    def _stop(self, token: Token) -> None:
        for node in self.open:
            if node.place is not None and node.end_tag is None:
                node.place = (node.place[0], max(node.place[1], token.start))
        self.stopped = True

    # --- before the body ----------------------------------------------------------------------------------------------

    def initial(self, token: Token) -> None:
        self.error("missing-doctype", token, True)
        self.mode = QUIRKS
        self.state = "before_html"
        self.again(token)

    def before_html(self, token: Token) -> None:
        if token.kind == START and token.name == "html":
            node = self.element(token)
            self.document.append(node)
            self._push(node)
            self.state = "before_head"
            return
        if token.kind == END and token.name not in ("head", "body", "html", "br"):
            return
        node = Node("element", "html", HTML, [])
        self.document.append(node)
        self._push(node)
        self.state = "before_head"
        self.again(token)

    def before_head(self, token: Token) -> None:
        if token.kind == START:
            if token.name == "html":
                return self.start_in_body(token)
            if token.name == "head":
                self.head = self.insert(token)
                self.state = "in_head"
                return
        elif token.kind == END and token.name not in ("head", "body", "html", "br"):
            self.error("end-tag-without-matching-open-element", token)
            return
        self.head = self.insert_implied("head")
        self.state = "in_head"
        self.again(token)

    def start_in_head(self, token: Token) -> None:
        name = token.name
        if name == "html":
            self.start_in_body(token)
        elif name in ("base", "basefont", "bgsound", "link", "meta"):
            self.insert_void(token)
        elif name == "title":
            self.text_mode(token, RCDATA)
        elif name == "noscript":
            if self.scripting:
                self.text_mode(token, RAWTEXT)
            else:
                self.insert(token)
                self.state = "in_head_noscript"
        elif name in ("noframes", "style"):
            self.text_mode(token, RAWTEXT)
        elif name == "script":
            self.text_mode(token, SCRIPT)
        elif name == "template":
            self.insert(token)
            self.active.append(_ANY_MARK)
            self.frameset_ok = False
            self.state = "in_template"
            self.templates.append("in_template")
        elif name == "head":
            self.error("misplaced-start-tag-for-head-element", token)
        else:
            self._leave_head(token)

    def end_in_head(self, token: Token) -> None:
        if token.name == "head":
            self._pop()
            self.state = "after_head"
        elif token.name in ("body", "br", "html"):
            self._leave_head(token)
        elif token.name == "template":
            self.end_template(token)
        else:
            self.error("end-tag-without-matching-open-element", token)

    def end_template(self, token: Token) -> None:
        if not self._has("template"):
            self.error("end-tag-without-matching-open-element", token)
            return
        self.implied(IMPLIED_THOROUGH)
        if not self._is(self.current, "template"):
            self.error("closing-of-element-with-open-child-elements", token)
        self.pop_until("template")
        self.clear_to_mark()
        self.templates.pop()
        self._reset()

    def _leave_head(self, token: Token) -> None:
        self._pop()
        self.state = "after_head"
        self.again(token)

    def start_in_head_noscript(self, token: Token) -> None:
        if token.name == "html":
            self.start_in_body(token)
        elif token.name in ("basefont", "bgsound", "head", "link", "meta", "noframes", "style"):
            if token.name == "head":
                self.error("misplaced-start-tag-for-head-element", token)
            else:
                self.start_in_head(token)
        elif token.name == "noscript":
            self.error("nested-noscript-in-head", token)
        else:
            self._leave_noscript(token)

    def end_in_head_noscript(self, token: Token) -> None:
        if token.name == "noscript":
            self._pop()
            self.state = "in_head"
        elif token.name == "br":
            self._leave_noscript(token)
        else:
            self.error("end-tag-without-matching-open-element", token)

    def _leave_noscript(self, token: Token) -> None:
        self.error("open-elements-left-after-eof" if token.kind == EOF else "disallowed-content-in-noscript-in-head", token)
        self._pop()
        self.state = "in_head"
        self.again(token)

    def start_after_head(self, token: Token) -> None:
        name = token.name
        if name == "html":
            self.start_in_body(token)
        elif name == "body":
            self.insert(token)
            self.frameset_ok = False
            self.state = "in_body"
        elif name == "frameset":
            self.insert(token)
            self.state = "in_frameset"
        elif name in HEAD_TAGS:
            self.error("abandoned-head-element-child", token)
            self._push(self.head)
            self.start_in_head(token)
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] is self.head:
                    del self.open[k]
                    break
            self._flag()
        elif name == "head":
            self.error("misplaced-start-tag-for-head-element", token)
        else:
            self._imply_body(token)

    def end_after_head(self, token: Token) -> None:
        if token.name in ("body", "html", "br"):
            self._imply_body(token)
        elif token.name == "template":
            self.end_template(token)
        else:
            self.error("end-tag-without-matching-open-element", token)

    def _imply_body(self, token: Token) -> None:
        self.insert_implied("body")
        self.state = "in_body"
        self.again(token)

    def text_early(self, token: Token, kind: str) -> None:
        """initial, before html and before head drop white space."""
        if kind != "space":
            _HANDLERS[self.state, TEXT](self, token)

    def text_in_head(self, token: Token, kind: str) -> None:
        if kind == "space":
            self.insert_parts(token.parts)
        else:
            _HANDLERS[self.state, TEXT](self, token)

    # --- body ---------------------------------------------------------------------------------------------------------

    def _close_p(self) -> None:
        self.implied(but="p")
        self.pop_until("p")

    def _close_p_in_scope(self) -> None:
        if self.in_scope("p", "button"):
            self._close_p()

    def start_in_body(self, token: Token) -> None:
        name = token.name
        handler = _START_BODY.get(name)
        if handler is not None:
            handler(self, token)
        else:
            self.reconstruct()
            self.insert(token)

    def s_html(self, token):
        if not self._has("template"):
            self._merge(self.open[0], token)

    def s_body(self, token):
        if len(self.open) > 1 and self._is(self.open[1], "body") and not self._has("template"):
            self.frameset_ok = False
            self._merge(self.open[1], token)

    def s_frameset(self, token):
        if self.frameset_ok and len(self.open) > 1 and self._is(self.open[1], "body"):
            self.open[1].detach()
            while len(self.open) > 1:
                self._pop()
            self.insert(token)
            self.state = "in_frameset"

    def s_block(self, token):
        self._close_p_in_scope()
        self.insert(token)

    def s_heading(self, token):
        self._close_p_in_scope()
        if self.current.ns == HTML and self.current.name in HEADINGS:
            self._pop()
        self.insert(token)

    def s_pre(self, token):
        self._close_p_in_scope()
        self.insert(token)
        self.skip_newline = True
        self.frameset_ok = False

    def s_form(self, token):
        templated = self._has("template")
        if self.form is None or templated:
            self._close_p_in_scope()
            node = self.insert(token)
            if not templated:
                self.form = node

    def s_item(self, token):
        self.frameset_ok = False
        names = ("li",) if token.name == "li" else ("dd", "dt")
        for node in reversed(self.open):
            if node.ns == HTML and node.name in names:
                self.implied(IMPLIED, but=node.name)
                self.pop_until(node.name)
                break
            if node.name in SPECIAL.get(node.ns, ()) and not self._is(node, "address", "div", "p"):
                break
        self._close_p_in_scope()
        self.insert(token)

    def s_plaintext(self, token):
        self._close_p_in_scope()
        self.insert(token)
        self.tokens.mode = PLAINTEXT

    def s_button(self, token):
        if self.in_scope("button"):
            self.implied()
            self.pop_until("button")
        self.reconstruct()
        self.insert(token)
        self.frameset_ok = False

    def s_a(self, token):
        entry = self._entry("a")
        if entry is not None:
            self.adoption_agency(token)
            if entry in self.active:
                self.active.remove(entry)
            if entry.node in self.open:
                self._remove(entry.node)
        self.s_formatting(token)

    def s_formatting(self, token):
        self.reconstruct()
        self.push_active(self.insert(token), token)

    def s_nobr(self, token):
        self.reconstruct()
        if self.in_scope("nobr"):
            self.adoption_agency(token)
            self.reconstruct()
        self.push_active(self.insert(token), token)

    def s_marked(self, token):
        self.reconstruct()
        self.insert(token)
        self.active.append(_ANY_MARK)
        self.frameset_ok = False

    def s_table(self, token):
        if (self.context is not None or self.mode != QUIRKS) and self.in_scope("p", "button"):
            self._close_p()
        self.insert(token)
        self.frameset_ok = False
        self.state = "in_table"

    def s_void(self, token):
        self.reconstruct()
        self.insert_void(token)
        self.frameset_ok = False

    def s_input(self, token):
        self.reconstruct()
        self.insert_void(token)
        if lower(token.get("type") or "") != "hidden":
            self.frameset_ok = False

    def s_param(self, token):
        self.insert_void(token)

    def s_hr(self, token):
        self._close_p_in_scope()
        self.insert_void(token)
        self.frameset_ok = False

    def s_image(self, token):
        token.name = "img"
        self.s_void(token)

    def s_textarea(self, token):
        self.insert(token)
        self.skip_newline = True
        self.tokens.mode = RCDATA
        self.original = self.state
        self.frameset_ok = False
        self.state = "text"

    def s_xmp(self, token):
        self._close_p_in_scope()
        self.reconstruct()
        self.frameset_ok = False
        self.text_mode(token, RAWTEXT)

    def s_iframe(self, token):
        self.frameset_ok = False
        self.text_mode(token, RAWTEXT)

    def s_raw(self, token):
        self.text_mode(token, RAWTEXT)

    def s_noscript(self, token):
        if self.scripting:
            self.text_mode(token, RAWTEXT)
        else:
            self.reconstruct()
            self.insert(token)

    def s_select(self, token):
        self.reconstruct()
        self.insert(token)
        self.frameset_ok = False
        self.state = "in_select_in_table" if self.state in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"

    def s_option(self, token):
        if self._is(self.current, "option"):
            self._pop()
        self.reconstruct()
        self.insert(token)

    def s_rb(self, token):
        if self.in_scope("ruby"):
            self.implied()
        self.insert(token)

    def s_rt(self, token):
        if self.in_scope("ruby"):
            self.implied(but="rtc")
        self.insert(token)

    def s_foreign(self, token):
        self.reconstruct()
        ns = MATHML if token.name == "math" else SVG
        if token.self_closing:
            self.insert_void(token, ns)
        else:
            self.insert(token, ns)
        token.acknowledged = True

    def s_ignored(self, token):
        pass

    def end_in_body(self, token: Token) -> None:
        name = token.name
        if name in FORMATTING:
            self.adoption_agency(token)
        elif name == "p":
            if not self.in_scope("p", "button"):
                self.insert_implied("p")
            self._close_p()
        elif name in BLOCK_ENDS:
            if self.in_scope(name):
                self.implied()
                self.pop_until(name)
        elif name == "li":
            if self.in_scope("li", "ol ul"):
                self.implied(but="li")
                self.pop_until("li")
        elif name in ("dd", "dt"):
            if self.in_scope(name):
                self.implied(but=name)
                self.pop_until(name)
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied()
                self.pop_until(*HEADINGS)
        elif name == "br":
            self.reconstruct()
            self.insert_implied("br")
            self.open.pop()
            self._flag()
            self.frameset_ok = False
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.state = "after_body"
                if name == "body":
                    body = next((n for n in self.open if self._is(n, "body")), None)
                    if body is not None:
                        self._close(body)
                else:
                    self.again(token)
        elif name == "form":
            self.end_form(token)
        elif name in ("applet", "object", "marquee"):
            if self.in_scope(name):
                self.implied()
                self.pop_until(name)
                self.clear_to_mark()
        elif name == "template":
            self.end_template(token)
        else:
            self.any_end_tag(token)

    def end_form(self, token: Token) -> None:
        templated = self._has("template")
        form = self.form
        if not templated:
            self.form = None
        if (form is not None or templated) and self.in_scope("form"):
            self.implied()
            if templated:
                self.pop_until("form")
            elif form is not None:
                self._remove(form)

    def eof_in_body(self, token: Token) -> None:
        if self.templates:
            self.eof_in_template(token)
        else:
            self._stop(token)

    # --- text ---------------------------------------------------------------------------------------------------------

    def end_text(self, token: Token) -> None:
        node = self._pop()
        self.tokens.mode = DATA
        self.state = self.original
        if self.on_script is not None and node.name == "script" and node.ns == HTML:
            written = self.on_script(node)
            if written:
                self.tokens.insert(written.replace("\r\n", "\n").replace("\r", "\n"))

    def eof_text(self, token: Token) -> None:
        self.error("eof-in-element-that-can-contain-only-text", token)
        self._pop()
        self.tokens.mode = DATA
        self.state = self.original
        self.again(token)

    # --- tables -------------------------------------------------------------------------------------------------------

    def text_in_table(self, token: Token, kind: str) -> None:
        if self.current.ns == HTML and self.current.name in TABLE_CONTEXT:
            self.pending = []
            self.original, self.state = self.state, "in_table_text"
            self._run(token, kind)
        else:
            self.foster(token)

    def text_in_table_text(self, token: Token, kind: str) -> None:
        if kind != "null":
            self.pending.append(token.parts[0])

    def _flush_table_text(self) -> None:
        runs, self.pending = self.pending, []
        self.state = self.original
        if any(_BLANK.fullmatch(r[0]) is None for r in runs):
            before, self.fostering = self.fostering, True
            self._body_text(runs)
            self.fostering = before
        else:
            self.insert_parts(runs)

    def other_in_table_text(self, token: Token) -> None:
        self._flush_table_text()
        self.process(token)

    def foster(self, token: Token) -> None:
        before, self.fostering = self.fostering, True
        if token.kind == TEXT:
            self._body_text(token.parts)
        elif token.kind == START:
            self.start_in_body(token)
        else:
            self.end_in_body(token)
        self.fostering = before

    def start_in_table(self, token: Token) -> None:
        name = token.name
        if name == "caption":
            self.clear_to("table")
            self.active.append(_ANY_MARK)
            self.insert(token)
            self.state = "in_caption"
        elif name == "colgroup":
            self.clear_to("table")
            self.insert(token)
            self.state = "in_column_group"
        elif name == "col":
            self.clear_to("table")
            self.insert_implied("colgroup")
            self.state = "in_column_group"
            self.again(token)
        elif name in ("tbody", "tfoot", "thead"):
            self.clear_to("table")
            self.insert(token)
            self.state = "in_table_body"
        elif name in ("td", "th", "tr"):
            self.clear_to("table")
            self.insert_implied("tbody")
            self.state = "in_table_body"
            self.again(token)
        elif name == "table":
            if self.in_table_scope("table"):
                self.pop_until("table")
                self._reset()
                self.process(token)
        elif name in ("style", "script", "template"):
            self.start_in_head(token)
        elif name == "input" and lower(token.get("type") or "") == "hidden":
            self.insert_void(token)
        elif name == "form":
            if self.form is None and not self._has("template"):
                self.form = self.insert(token)
                self._pop()
        else:
            self.foster(token)

    def end_in_table(self, token: Token) -> None:
        name = token.name
        if name == "table":
            if self.in_table_scope("table"):
                self.pop_until("table")
                self._reset()
        elif name == "template":
            self.end_template(token)
        elif name not in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.foster(token)

    def start_in_caption(self, token: Token) -> None:
        if token.name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.in_table_scope("caption"):
                self._close_caption()
                self.again(token)
        else:
            self.start_in_body(token)

    def _close_caption(self) -> None:
        self.implied()
        self.pop_until("caption")
        self.clear_to_mark()
        self.state = "in_table"

    def end_in_caption(self, token: Token) -> None:
        if token.name in ("caption", "table"):
            if self.in_table_scope("caption"):
                self._close_caption()
                if token.name == "table":
                    self.again(token)
        elif token.name not in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.end_in_body(token)

    def start_in_column_group(self, token: Token) -> None:
        if token.name == "html":
            self.start_in_body(token)
        elif token.name == "col":
            self.insert_void(token)
        elif token.name == "template":
            self.start_in_head(token)
        else:
            self._leave_column_group(token)

    def end_in_column_group(self, token: Token) -> None:
        if token.name == "colgroup":
            if self._is(self.current, "colgroup"):
                self._pop()
                self.state = "in_table"
        elif token.name == "template":
            self.end_template(token)
        elif token.name != "col":
            self._leave_column_group(token)

    def _leave_column_group(self, token: Token) -> None:
        if self._is(self.current, "colgroup"):
            self._pop()
            self.state = "in_table"
            if token.kind == TEXT:
                self._run_by_run(token.parts)
            else:
                self.again(token)

    def text_in_column_group(self, token: Token, kind: str) -> None:
        if kind == "space":
            self.insert_parts(token.parts)
        else:
            self._leave_column_group(token)

    def start_in_table_body(self, token: Token) -> None:
        name = token.name
        if name == "tr":
            self.clear_to("tbody", "tfoot", "thead")
            self.insert(token)
            self.state = "in_row"
        elif name in ("td", "th"):
            self.clear_to("tbody", "tfoot", "thead")
            self.insert_implied("tr")
            self.state = "in_row"
            self.again(token)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            self._leave_table_body(token)
        else:
            self.start_in_table(token)

    def _leave_table_body(self, token: Token) -> None:
        if self.in_table_scope(("tbody", "tfoot", "thead")):
            self.clear_to("tbody", "tfoot", "thead")
            self._pop()
            self.state = "in_table"
            self.again(token)

    def end_in_table_body(self, token: Token) -> None:
        name = token.name
        if name in ("tbody", "tfoot", "thead"):
            if self.in_table_scope(name):
                self.clear_to("tbody", "tfoot", "thead")
                self._pop()
                self.state = "in_table"
        elif name == "table":
            self._leave_table_body(token)
        elif name not in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self.end_in_table(token)

    def start_in_row(self, token: Token) -> None:
        name = token.name
        if name in ("td", "th"):
            self.clear_to("tr")
            self.insert(token)
            self.state = "in_cell"
            self.active.append(_ANY_MARK)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self._leave_row():
                self.again(token)
        else:
            self.start_in_table(token)

    def _leave_row(self) -> bool:
        if not self.in_table_scope("tr"):
            return False
        self.clear_to("tr")
        self._pop()
        self.state = "in_table_body"
        return True

    def end_in_row(self, token: Token) -> None:
        name = token.name
        if name == "tr":
            self._leave_row()
        elif name == "table":
            if self._leave_row():
                self.again(token)
        elif name in ("tbody", "tfoot", "thead"):
            if self.in_table_scope(name) and self._leave_row():
                self.again(token)
        elif name not in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self.end_in_table(token)

    def _close_cell(self) -> None:
        self.implied()
        self.pop_until("td", "th")
        self.clear_to_mark()
        self.state = "in_row"

    def start_in_cell(self, token: Token) -> None:
        if token.name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.in_table_scope(("td", "th")):
                self._close_cell()
                self.again(token)
        else:
            self.start_in_body(token)

    def end_in_cell(self, token: Token) -> None:
        name = token.name
        if name in ("td", "th"):
            if self.in_table_scope(name):
                self.implied()
                self.pop_until(name)
                self.clear_to_mark()
                self.state = "in_row"
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_table_scope(name):
                self._close_cell()
                self.again(token)
        elif name not in ("body", "caption", "col", "colgroup", "html"):
            self.end_in_body(token)

    # --- select, template, frames, after ------------------------------------------------------------------------------

    def text_in_select(self, token: Token, kind: str) -> None:
        if kind != "null":
            self.insert_parts(token.parts)

    def start_in_select(self, token: Token) -> None:
        name = token.name
        if name == "html":
            self.start_in_body(token)
        elif name == "option":
            if self._is(self.current, "option"):
                self._pop()
            self.insert(token)
        elif name == "optgroup":
            if self._is(self.current, "option"):
                self._pop()
            if self._is(self.current, "optgroup"):
                self._pop()
            self.insert(token)
        elif name == "hr":
            if self._is(self.current, "option"):
                self._pop()
            if self._is(self.current, "optgroup"):
                self._pop()
            self.insert_void(token)
        elif name in ("input", "keygen", "textarea", "select"):
            if self.in_select_scope("select"):
                self.pop_until("select")
                self._reset()
                if name != "select":
                    self.process(token)
        elif name in ("script", "template"):
            self.start_in_head(token)

    def end_in_select(self, token: Token) -> None:
        name = token.name
        if name == "optgroup":
            if self._is(self.current, "option") and len(self.open) > 1 and self._is(self.open[-2], "optgroup"):
                self._pop()
            if self._is(self.current, "optgroup"):
                self._pop()
        elif name == "option":
            if self._is(self.current, "option"):
                self._pop()
        elif name == "select":
            if self.in_select_scope("select"):
                self.pop_until("select")
                self._reset()
        elif name == "template":
            self.end_template(token)

    def start_in_select_in_table(self, token: Token) -> None:
        if token.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.pop_until("select")
            self._reset()
            self.process(token)
        else:
            self.start_in_select(token)

    def end_in_select_in_table(self, token: Token) -> None:
        if token.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if self.in_table_scope(token.name):
                self.pop_until("select")
                self._reset()
                self.process(token)
        else:
            self.end_in_select(token)

    def start_in_template(self, token: Token) -> None:
        name = token.name
        if name in HEAD_TAGS:
            self.start_in_head(token)
            return
        state = "in_table" if name in ("caption", "colgroup", "tbody", "tfoot", "thead") else {"col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_body")
        self.templates[-1] = self.state = state
        self.again(token)

    def end_in_template(self, token: Token) -> None:
        if token.name == "template":
            self.end_template(token)

    def eof_in_template(self, token: Token) -> None:
        if not self._has("template"):
            self._stop(token)
            return
        self.pop_until("template")
        self.clear_to_mark()
        self.templates.pop()
        self._reset()
        self.again(token)

    def start_after_body(self, token: Token) -> None:
        if token.name == "html":
            self.start_in_body(token)
        else:
            self._back_to_body(token)

    def end_after_body(self, token: Token) -> None:
        if token.name == "html":
            if self.context is None:
                self.state = "after_after_body"
            if self._is(self.open[0], "html"):
                html = self.open[0]
                if html.place is not None:
                    html.end_tag, html.place = (token.start, token.end), (html.place[0], token.end)
                body = self.open[1] if len(self.open) > 1 else None
                if body is not None and body.place is not None and body.end_tag is None:
                    body.place = (body.place[0], token.start)
        else:
            self._back_to_body(token)

    def _back_to_body(self, token: Token) -> None:
        self.state = "in_body"
        self.again(token)

    def text_after_body(self, token: Token, kind: str) -> None:
        if kind != "space":
            self.state = "in_body"
        self._body_text(token.parts)

    def text_in_frameset(self, token: Token, kind: str) -> None:
        if kind == "space":
            self.insert_parts(token.parts)

    def start_in_frameset(self, token: Token) -> None:
        if token.name == "html":
            self.start_in_body(token)
        elif token.name == "frameset":
            self.insert(token)
        elif token.name == "frame":
            self.insert_void(token)
        elif token.name == "noframes":
            self.start_in_head(token)

    def end_in_frameset(self, token: Token) -> None:
        if token.name == "frameset" and not (len(self.open) == 1 and self._is(self.current, "html")):
            self._pop()
            if self.context is None and not self._is(self.current, "frameset"):
                self.state = "after_frameset"

    def start_after_frameset(self, token: Token) -> None:
        if token.name == "html":
            self.start_in_body(token)
        elif token.name == "noframes":
            self.start_in_head(token)

    def end_after_frameset(self, token: Token) -> None:
        if token.name == "html":
            self.state = "after_after_frameset"

    def ignore(self, token: Token) -> None:
        pass

    def text_after_after_frameset(self, token: Token, kind: str) -> None:
        if kind == "space":
            self._body_text(token.parts)

    # --- foreign content ------------------------------------------------------------------------------------------------

    def _foreign_start(self, token: Token) -> None:
        name = token.name
        if name in BREAKOUT or name == "font" and any(a[0] in ("color", "face", "size") for a in token.attrs):
            self._break_out(token)
            return
        ns = self._adjusted().ns
        if token.self_closing:
            self.insert_void(token, ns)
        else:
            self.insert(token, ns)
        token.acknowledged = True

    def _break_out(self, token: Token) -> None:
        while self.current.ns != HTML and not _mathml_text(self.current) and not _html_point(self.current) and len(self.open) > 1:
            self._pop()
        self.again(token)

    def _foreign_end(self, token: Token) -> None:
        if token.name in ("p", "br"):
            self._break_out(token)
            return
        for k in range(len(self.open) - 1, 0, -1):
            node = self.open[k]
            if node.ns == HTML:
                self.again(token)
                return
            if lower(node.name) == token.name:
                while len(self.open) > k:
                    self._pop()
                return


def _mathml_text(node: Node) -> bool:
    return node.ns == MATHML and node.name in ("mi", "mo", "mn", "ms", "mtext")


def _html_point(node: Node) -> bool:
    if node.ns == SVG:
        return node.name in ("foreignObject", "desc", "title")
    if node.ns == MATHML and node.name == "annotation-xml":
        return any(a[0] == "encoding" and lower(a[1]) in ("text/html", "application/xhtml+xml") for a in node.attrs)
    return False


_RESET = {"tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "body": "in_body", "frameset": "in_frameset"}
_BODY_TEXT = frozenset(["in_body", "in_caption", "in_cell", "in_template"])

P = Parser
_START_BODY: dict[str, Callable] = {}
for _names, _handler in (
    (HEAD_TAGS, P.start_in_head),
    (BLOCKS, P.s_block),
    (HEADINGS, P.s_heading),
    (FORMATTING - {"a", "nobr"}, P.s_formatting),
    (("html",), P.s_html),
    (("body",), P.s_body),
    (("frameset",), P.s_frameset),
    (("pre", "listing"), P.s_pre),
    (("form",), P.s_form),
    (("li", "dd", "dt"), P.s_item),
    (("plaintext",), P.s_plaintext),
    (("button",), P.s_button),
    (("a",), P.s_a),
    (("nobr",), P.s_nobr),
    (("applet", "marquee", "object"), P.s_marked),
    (("table",), P.s_table),
    (("area", "br", "embed", "img", "keygen", "wbr"), P.s_void),
    (("input",), P.s_input),
    (("param", "source", "track"), P.s_param),
    (("hr",), P.s_hr),
    (("image",), P.s_image),
    (("textarea",), P.s_textarea),
    (("xmp",), P.s_xmp),
    (("iframe",), P.s_iframe),
    (("noembed",), P.s_raw),
    (("noscript",), P.s_noscript),
    (("select",), P.s_select),
    (("optgroup", "option"), P.s_option),
    (("rb", "rtc"), P.s_rb),
    (("rp", "rt"), P.s_rt),
    (("math", "svg"), P.s_foreign),
    (("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"), P.s_ignored),
):
    for _name in _names:
        _START_BODY[_name] = _handler

_HANDLERS: dict[tuple[str, str], Callable] = {}
for _state, _start, _end, _eof, _text in (
    ("initial", P.initial, P.initial, P.initial, P.initial),
    ("before_html", P.before_html, P.before_html, P.before_html, P.before_html),
    ("before_head", P.before_head, P.before_head, P.before_head, P.before_head),
    ("in_head", P.start_in_head, P.end_in_head, P._leave_head, P._leave_head),
    ("in_head_noscript", P.start_in_head_noscript, P.end_in_head_noscript, P._leave_noscript, P._leave_noscript),
    ("after_head", P.start_after_head, P.end_after_head, P._imply_body, P._imply_body),
    ("in_body", P.start_in_body, P.end_in_body, P.eof_in_body, None),
    ("text", P.ignore, P.end_text, P.eof_text, None),
    ("in_table", P.start_in_table, P.end_in_table, P.eof_in_body, None),
    ("in_table_text", P.other_in_table_text, P.other_in_table_text, P.other_in_table_text, None),
    ("in_caption", P.start_in_caption, P.end_in_caption, P.eof_in_body, None),
    ("in_column_group", P.start_in_column_group, P.end_in_column_group, P.eof_in_body, None),
    ("in_table_body", P.start_in_table_body, P.end_in_table_body, P.eof_in_body, None),
    ("in_row", P.start_in_row, P.end_in_row, P.eof_in_body, None),
    ("in_cell", P.start_in_cell, P.end_in_cell, P.eof_in_body, None),
    ("in_select", P.start_in_select, P.end_in_select, P.eof_in_body, None),
    ("in_select_in_table", P.start_in_select_in_table, P.end_in_select_in_table, P.eof_in_body, None),
    ("in_template", P.start_in_template, P.end_in_template, P.eof_in_template, None),
    ("after_body", P.start_after_body, P.end_after_body, P._stop, None),
    ("in_frameset", P.start_in_frameset, P.end_in_frameset, P._stop, None),
    ("after_frameset", P.start_after_frameset, P.end_after_frameset, P._stop, None),
    ("after_after_body", P.start_after_body, P._back_to_body, P._stop, None),
    ("after_after_frameset", P.start_after_frameset, P.ignore, P._stop, None),
):
    _HANDLERS[_state, START], _HANDLERS[_state, END], _HANDLERS[_state, EOF], _HANDLERS[_state, TEXT] = _start, _end, _eof, _text

_TEXT_HANDLERS = {
    "initial": P.text_early,
    "before_html": P.text_early,
    "before_head": P.text_early,
    "in_head": P.text_in_head,
    "in_head_noscript": P.text_in_head,
    "after_head": P.text_in_head,
    "in_table": P.text_in_table,
    "in_table_body": P.text_in_table,
    "in_row": P.text_in_table,
    "in_table_text": P.text_in_table_text,
    "in_column_group": P.text_in_column_group,
    "in_select": P.text_in_select,
    "in_select_in_table": P.text_in_select,
    "after_body": P.text_after_body,
    "after_after_body": P.text_after_body,
    "in_frameset": P.text_in_frameset,
    "after_frameset": P.text_in_frameset,
    "after_after_frameset": P.text_after_after_frameset,
} | {state: (lambda self, token, kind: self._body_text(token.parts)) for state in _BODY_TEXT}


def context_of(spec: str) -> Node:
    """An element for a fragment's context, written as `td`, `svg desc` or `math mi`."""
    ns, _, name = spec.strip().rpartition(" ")
    return Node("element", name, {"svg": SVG, "math": MATHML}.get(ns, HTML), [])


def parse(html: str, **options) -> Parser:
    """The finished parser of a document."""
    p = Parser(html, **options)
    p.parse()
    return p


def parse_fragment(html: str, context: str | Node = "template", **options) -> tuple[Parser, Node]:
    """The finished parser of a fragment, and the fragment."""
    p = Parser(html, context=context if isinstance(context, Node) else context_of(context), **options)
    p.parse()
    fragment = Node("fragment")
    for child in p.document.children[0].children:
        fragment.append(child)
    return p, fragment
