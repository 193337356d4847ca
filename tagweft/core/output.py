"""Trees to text: serialization, the indented dump that tests use, and flat rows."""

from __future__ import annotations

from collections.abc import Iterator

from .builder import Node
from .names import HTML, MATHML, SVG, VOID, XLINK, XML, XMLNS, has_unescaped_text


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def attribute_name(name: str, prefix: str, ns: str) -> str:
    if not ns:
        return name
    if ns == XML:
        return f"xml:{name}"
    if ns == XMLNS:
        return name if name == "xmlns" else f"xmlns:{name}"
    if ns == XLINK:
        return f"xlink:{name}"
    return f"{prefix}:{name}"


def start_tag(node: Node) -> str:
    return f"<{node.name}" + "".join([f' {attribute_name(n, p, ns)}="{escape_attribute(v)}"' for n, v, p, ns in node.attrs]) + ">"


def _children(node: Node) -> list[Node]:
    return (node.content if node.content is not None else node).children


def serialize(nodes: list[Node], scripting: bool = True) -> str:
    """Of sibling nodes, without recursion."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == "element":
            out.append(start_tag(node))
            if not (node.ns == HTML and node.name in VOID):
                stack.append(f"</{node.name}>")
                stack.extend(reversed(_children(node)))
        elif node.kind == "text":
            parent = node.parent
            raw = parent is not None and parent.kind == "element" and parent.ns == HTML and has_unescaped_text(parent.name, scripting)
            out.append(node.value if raw else escape_text(node.value))
        elif node.kind == "comment":
            out.append(f"<!--{node.value}-->")
        elif node.kind == "doctype":
            out.append(f"<!DOCTYPE {node.name}>")
    return "".join(out)


def inner(node: Node, scripting: bool = True) -> str:
    """The serialized content; nothing for elements that have none by name."""
    return "" if node.kind == "element" and node.ns == HTML and node.name in VOID else serialize(_children(node), scripting)


def dump(nodes: list[Node]) -> str:
    """A line a node, indented by depth, as tree-construction tests write it."""
    lines: list[str] = []
    stack: list[tuple[Node | str, int]] = [(n, 0) for n in reversed(nodes)]
    while stack:
        node, depth = stack.pop()
        pad = "| " + "  " * depth
        if isinstance(node, str):
            lines.append(pad + node)
        elif node.kind == "element":
            lines.append(f"{pad}<{ {SVG: 'svg ', MATHML: 'math '}.get(node.ns, '') }{node.name}>")
            for n, v, p, _ in sorted(node.attrs, key=lambda a: f"{a[2]} {a[0]}" if a[2] else a[0]):
                lines.append(f'{pad}  {f"{p} {n}" if p else n}="{v}"')
            below = [(n, depth + 1) for n in node.children]
            if node.content is not None:
                below = [("content", depth + 1), *((n, depth + 2) for n in node.content.children)]
            stack.extend(reversed(below))
        elif node.kind == "text":
            lines.append(f'{pad}"{node.value}"')
        elif node.kind == "comment":
            lines.append(f"{pad}<!-- {node.value} -->")
        elif node.kind == "doctype":
            ids = f' "{node.public_id}" "{node.system_id}"' if node.public_id or node.system_id else ""
            lines.append(f"{pad}<!DOCTYPE {node.name}{ids}>")
    return "\n".join(lines)


def flatten(root: Node) -> Iterator[tuple[int, int | None, int, int, int, Node, str]]:
    """(node_id, parent_id, sib_idx, depth, subtree_end, node, node_type) in document order. A template's content is a node
    of type template_content below it."""
    order: list[list] = []
    stack: list[tuple[Node, int | None, int, int, str]] = [(root, None, 0, 0, root.kind)]
    while stack:
        node, parent, index, depth, kind = stack.pop()
        me = len(order)
        order.append([me, parent, index, depth, me, node, kind])
        below = [(c, me, k, depth + 1, c.kind) for k, c in enumerate(node.children)]
        if node.content is not None:
            below.insert(0, (node.content, me, 0, depth + 1, "template_content"))
        stack.extend(reversed(below))
    for row in reversed(order):
        if row[1] is not None:
            order[row[1]][4] = max(order[row[1]][4], row[4])
    return (tuple(row) for row in order)
