"""Column functions: Arrow functions around the parser, and native expressions where the semantics are closed-form.

Each function that parses takes whole strings and works on Arrow batches. What isn't asked for (locations, errors, text) is
not computed. A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schemas
from ..core import builder, entities, names, output
from ..core import events as core_events
from ..core.builder import Node
from ..core.tokenizer import DATA, EOF, TEXT, Input, Tokenizer

#: The type of markup that makes no event.
GAP = "gap"
NODES, LOC, ERRORS, TEXT_HTML, DUMP, OPEN = "nodes", "loc", "errors", "html", "dump", "open_events"


#: Rows of a batch of results, and characters or entries of what they are made from, at most (or one row).
ROWS, SIZE = 64, 1 << 18


def _plain(a: pa.Array) -> list:
    """a.to_pylist(), but a column of structs at a time: a call a value costs more than parsing the page does."""
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_struct(a.type):
        keys = [a.type.field(k).name for k in range(a.type.num_fields)]
        rows = [dict(zip(keys, row)) for row in zip(*map(_plain, a.flatten()))]
    elif pa.types.is_list(a.type):
        cuts = a.offsets.to_numpy().tolist()
        values = _plain(a.values.slice(cuts[0], cuts[-1] - cuts[0]))
        rows = [values[i - cuts[0] : j - cuts[0]] for i, j in zip(cuts, cuts[1:])]
    elif pa.types.is_int32(a.type):
        rows = a.fill_null(0).to_numpy().tolist()
    elif pa.types.is_string(a.type):
        cuts = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].tolist()
        data = a.buffers()[2].slice(cuts[0], cuts[-1] - cuts[0]).to_pybytes() if cuts[0] < cuts[-1] else b""
        whole = data.decode()
        if len(whole) == len(data):
            rows = [whole[i - cuts[0] : j - cuts[0]] for i, j in zip(cuts, cuts[1:])]
        else:
            rows = [data[i - cuts[0] : j - cuts[0]].decode() for i, j in zip(cuts, cuts[1:])]
    else:
        return a.to_pylist()
    return [r if good else None for r, good in zip(rows, a.is_valid().to_numpy(zero_copy_only=False).tolist())] if a.null_count else rows


def _stepwise(f: Callable, batches: Iterator[tuple], arrow: pa.DataType) -> Iterator[pa.Array]:
    """f of each row of batches of columns. A row is some hundred times as large in Python as in Arrow, so rows are taken one by
    one and their results given back by ROWS and SIZE, however many rows a batch has."""
    done, size = [], 0
    for columns in batches:
        for i in range(len(columns[0])):
            row = [_plain(c.slice(i, 1))[0] for c in columns]
            done.append(None if row[0] is None else f(*row))
            size += 0 if row[0] is None else len(row[0])
            if len(done) >= ROWS or size >= SIZE:
                yield pa.array(done, arrow)
                done, size = [], 0
    if done:
        yield pa.array(done, arrow)


def arrow_function(kind: T.DataType, *, types: tuple = ()):
    """A decorator: a function of plain values, made one of columns; null in the first gives null."""
    arrow = to_arrow_type(kind)

    def wrap(f: Callable) -> Callable:
        if not types:  # one text column
            def own(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return _stepwise(f, ((a,) for a in batches), arrow)
        else:
            def own(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                return _stepwise(f, batches, arrow)
        return F.arrow_udf(own, returnType=kind)

    return wrap


# --- values of rows -----------------------------------------------------------------------------------------------------


def _location(source: Input, place: tuple[int, int] | None) -> dict | None:
    if place is None:
        return None
    (a, b, c), (d, e, f) = source.position(place[0]), source.position(place[1])
    return {"start_line": a, "start_col": b, "start_offset": c, "end_line": d, "end_col": e, "end_offset": f}


def _attributes(attrs) -> list[dict]:
    return [{"name": n, "value": v, "prefix": p or None, "namespace": ns or None} for n, v, p, ns in attrs]


def node_rows(root: Node, source: Input | None = None) -> list[dict]:
    """The flat node table of a tree; with a source, with locations."""
    rows = []
    for me, parent, index, depth, end, node, kind in output.flatten(root):
        row = {"node_id": me, "parent_id": parent, "sib_idx": index, "depth": depth, "subtree_end": end, "node_type": kind, "name": node.name, "namespace": node.ns, "value": node.value, "public_id": node.public_id, "system_id": node.system_id, "attrs": _attributes(node.attrs) if node.kind == "element" else None}
        if source is not None and kind != "template_content":
            row["loc"] = _location(source, node.place)
            row["start_tag_loc"] = _location(source, node.start_tag)
            row["end_tag_loc"] = _location(source, node.end_tag)
            if node.attr_places:
                row["attr_locs"] = [(n, _location(source, (a, b))) for n, a, b in node.attr_places]
        rows.append(row)
    return rows


def tree_of(rows: list[dict]) -> list[Node]:
    """The nodes of a flat node table as a tree, in the order of node_id; the first is the root."""
    nodes: list[Node] = []
    for r in sorted(rows, key=lambda r: r["node_id"]):
        kind = r["node_type"]
        node = Node("fragment" if kind == "template_content" else kind, r["name"], r["namespace"], [(a["name"], a["value"], a["prefix"] or "", a["namespace"] or "") for a in r["attrs"] or ()], r["value"])
        node.public_id, node.system_id = r["public_id"], r["system_id"]
        if r["parent_id"] is not None:
            parent = nodes[r["parent_id"]]
            if kind == "template_content":
                parent.content, node.parent = node, parent
            else:
                parent.append(node)
        nodes.append(node)
    return nodes


def error_rows(parser: builder.Parser) -> list[dict]:
    rows = []
    for k, (code, start, end) in enumerate(sorted(parser.found or (), key=lambda e: (e[1], e[2], e[0]))):
        rows.append({"err_idx": k, "code": code} | _location(parser.input, (start, end)))
    return rows


def parsed(html: str, facets: frozenset, context: str | None, scripting: bool, on_script: Callable | None = None) -> dict:
    """What html_parse returns for one text."""
    steps: list[dict] = []
    hooks = (lambda op, node: steps.append({"op": op, "step": len(steps), "name": node.name, "namespace": node.ns})) if OPEN in facets else None
    options = {"scripting": scripting, "errors": ERRORS in facets, "on_script": on_script, "hooks": hooks}
    if context is None:
        p = builder.parse(html, **options)
        root = p.document
    else:
        p, root = builder.parse_fragment(html, context, **options)
    return {
        "mode": p.mode if context is None else None,
        "nodes": node_rows(root, p.input if LOC in facets else None) if NODES in facets else None,
        "errors": error_rows(p) if ERRORS in facets else None,
        "html": output.serialize(root.children, scripting) if TEXT_HTML in facets else None,
        "dump": output.dump(root.children) if DUMP in facets else None,
        "open_events": steps if OPEN in facets else None,
    }


# --- parsing ------------------------------------------------------------------------------------------------------------


def html_parse(facets=(NODES,), context: str | None = None, scripting: bool = True, on_script: Callable | None = None):
    """A function of a text column to PARSED. facets: any of nodes, loc, errors, html, dump, open_events. context: None for a
    document, or a fragment's element as `td`, `svg desc`, `math mi` (`template` is the default of fragments). on_script gets
    each finished script element and may return text to parse next (document.write)."""
    wanted = frozenset(facets)
    return arrow_function(schemas.PARSED)(lambda html: parsed(html, wanted, context, scripting, on_script))


def html_parse_fragment(facets=(NODES,), context: str = "template", **options):
    return html_parse(facets, context, **options)


def token_rows(html: str, mode: str = DATA, last_start_tag: str | None = None) -> list[dict]:
    source = Input(html)
    tokens, rows = Tokenizer(source.text, mode, last_start_tag), []
    while (t := tokens.next()).kind != EOF:
        rows.append({"tok_idx": len(rows), "type": t.kind, "name": t.name, "text": t.text if t.kind == TEXT else t.data, "attrs": _attributes((a[0], a[1], "", "") for a in t.attrs), "self_closing": t.self_closing, "force_quirks": t.force_quirks, "public_id": t.public_id, "system_id": t.system_id, "loc": _location(source, (t.start, t.end)), "raw": source.raw_slice(t.start, t.end), "last_start_tag": tokens.last_start_tag})
    return rows


def html_tokenize(mode: str = DATA, last_start_tag: str | None = None):
    """A function of a text column to array<TOKEN>: the tokenizer alone, from the state given."""
    return arrow_function(T.ArrayType(schemas.TOKEN))(lambda html: token_rows(html, mode, last_start_tag))


def event_rows(html: str, kinds: frozenset | None = None, limit: int | None = None, locations: bool = True, source_kept: bool = False) -> list[dict]:
    """source_kept: with the line feed after <pre>, and the markup that makes no event as rows of type `gap`, so that the raw
    columns together are the source."""
    source, found = core_events.events(html, raw_newlines=source_kept)
    rows: list[dict] = []
    last = 0

    def gap(to: int) -> None:
        if source_kept and to > last:
            rows.append({"tok_idx": len(rows), "type": GAP, "name": None, "text": None, "attrs": [], "self_closing": False, "force_quirks": False, "public_id": None, "system_id": None, "loc": None, "raw": source.raw_slice(last, to), "last_start_tag": None})

    for e in found:
        gap(e.start)
        last = e.end
        if kinds is None or e.kind in kinds:
            if limit is not None and len(rows) >= limit:
                break
            rows.append({"tok_idx": len(rows), "type": e.kind, "name": e.name, "text": e.text, "attrs": _attributes(e.attrs), "self_closing": e.self_closing, "force_quirks": False, "public_id": e.public_id, "system_id": e.system_id, "loc": _location(source, (e.start, e.end)) if locations else None, "raw": source.raw_slice(e.start, e.end), "last_start_tag": e.last_tag})
    gap(len(source.text))
    return rows


def html_events(kinds=None, limit: int | None = None, locations: bool = True, source_kept: bool = False):
    """A function of a text column to array<TOKEN>: SAX-like events. kinds: those to give; limit: stop after so many;
    source_kept: as in event_rows."""
    wanted = None if kinds is None else frozenset(kinds)
    return arrow_function(T.ArrayType(schemas.TOKEN))(lambda html: event_rows(html, wanted, limit, locations, source_kept))


def html_rewrite(handler: Callable):
    """A function of a text column: handler(event, raw) returns what stands in an event's place, or None to keep it."""
    return arrow_function(T.StringType())(lambda html: core_events.rewrite(html, handler))


html_unescape = arrow_function(T.StringType())(lambda s: entities.unescape(s))
html_unescape_attribute = arrow_function(T.StringType())(lambda s: entities.unescape(s, True))


def html_serialize(scripting: bool = True, outer: bool = False):
    """A function of (nodes, node_id): the inner or outer HTML of a node."""

    def one(rows, node_id):
        node = tree_of(rows)[node_id]
        return output.serialize([node] if node.kind not in ("document", "fragment") else node.children, scripting) if outer else output.inner(node, scripting)

    return arrow_function(T.StringType(), types=(1, 2))(one)


def html_serialize_each(scripting: bool = True):
    """A function of (nodes, array of node_id): the outer HTML of each of these nodes, from one tree."""

    def each(rows, wanted):
        nodes = tree_of(rows)
        return [output.serialize([nodes[k]], scripting) for k in wanted]

    return arrow_function(T.ArrayType(T.StringType()), types=(1, 2))(each)


def _slices(html: str, spans: list[dict]) -> list[str | None]:
    units = html.encode("utf-16-be")
    return [None if s["start"] is None or s["end"] is None else units[2 * s["start"] : 2 * s["end"]].decode("utf-16-be") for s in spans]


#: A function of (text, array<struct<start, end>>): the source at each of these UTF-16 offsets. The text is encoded once.
raw_slices = arrow_function(T.ArrayType(T.StringType()), types=(1, 2))(_slices)

html_dump = arrow_function(T.StringType())(lambda rows: output.dump(tree_of(rows)[0].children))


def html_written(scripting: bool = True):
    """A function of nodes: html, the root's inner HTML, and dump, from one tree."""

    def both(rows):
        root = tree_of(rows)[0]
        return {"html": output.inner(root, scripting), "dump": output.dump(root.children)}

    return arrow_function(T.StructType().add("html", T.StringType()).add("dump", T.StringType()))(both)


# --- native expressions ---------------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_text(c) -> Column:
    return _replaced(_col(c), ("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_attribute(c) -> Column:
    return _replaced(_col(c), ("&", "&amp;"), ("\u00a0", "&nbsp;"), ('"', "&quot;"))


def normalize_newlines(c) -> Column:
    return _replaced(_col(c), ("\r\n", "\n"), ("\r", "\n"))


def replace_nul(c) -> Column:
    return _replaced(_col(c), ("\0", "�"))


def ascii_lower(c) -> Column:
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_text_document(c) -> Column:
    """A text as a document of one <pre>."""
    return F.concat(F.lit("<html><head></head><body><pre>\n"), escape_text(replace_nul(normalize_newlines(c))), F.lit("</pre></body></html>"))


def doctype_mode(name, public_id, system_id) -> Column:
    """The document mode that a doctype asks for."""
    name, public, system = _col(name), F.lower(_col(public_id)), _col(system_id)
    starts = lambda prefixes: F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(public, p)), F.lit(True))
    quirks = (
        (F.coalesce(name, F.lit("")) != "html")
        | (F.coalesce(F.lower(system), F.lit("")) == names.QUIRKS_SYSTEM_ID)
        | F.coalesce(public.isin(*names.QUIRKS_IDS) | starts(names.QUIRKS_PREFIXES) | starts(names.TRANSITIONAL_401) & system.isNull(), F.lit(False))
    )
    limited = F.coalesce(starts(names.TRANSITIONAL_XHTML) | starts(names.TRANSITIONAL_401), F.lit(False))
    return F.when(quirks, names.QUIRKS).when(limited, names.LIMITED_QUIRKS).otherwise(names.NO_QUIRKS)


def doctype_conforming(name, public_id, system_id) -> Column:
    return F.coalesce(_col(name) == "html", F.lit(False)) & _col(public_id).isNull() & (_col(system_id).isNull() | (_col(system_id) == names.LEGACY_SYSTEM_ID))


def doctype_data(name, public_id, system_id) -> Column:
    """What stands between <! and > of a doctype, with its identifiers quoted."""
    quoted = lambda c: F.when(F.instr(c, '"') > 0, F.concat(F.lit("'"), c, F.lit("'"))).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    name, public, system = F.coalesce(_col(name), F.lit("")), F.coalesce(_col(public_id), F.lit("")), F.coalesce(_col(system_id), F.lit(""))
    ids = F.when(public != "", F.concat(F.lit(" PUBLIC "), quoted(public))).when(system != "", F.lit(" SYSTEM")).otherwise("")
    return F.concat(F.lit("!DOCTYPE "), name, ids, F.when(system != "", F.concat(F.lit(" "), quoted(system))).otherwise(""))


def get_attribute(attrs, name: str) -> Column:
    """The value of a plain attribute; null if there is none."""
    return F.get(F.filter(_col(attrs), lambda a: (a["name"] == name) & a["prefix"].isNull()), F.lit(0))["value"]


def is_void(name) -> Column:
    return _col(name).isin(*names.VOID)


def has_unescaped_text(name, scripting: bool = True) -> Column:
    return _col(name).isin(*names.UNESCAPED, *(["noscript"] if scripting else []))


def raw_slice(html, start, end) -> Column:
    """The source at UTF-16 offsets."""
    units = F.encode(_col(html), "UTF-16BE")
    return F.decode(F.substring(units, 2 * _col(start) + 1, 2 * (_col(end) - _col(start))), "UTF-16BE")


def render_event(e: Column) -> Column:
    """An event's markup, written anew: no prefixes in attributes; text is escaped unless its last start tag says otherwise."""
    attrs = F.array_join(F.transform(e["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape_attribute(a["value"]), F.lit('"'))), "")
    doctype = F.concat(
        F.lit("<!DOCTYPE "), F.coalesce(e["name"], F.lit("null")),
        F.when(e["public_id"].isNotNull(), F.concat(F.lit(' PUBLIC "'), e["public_id"], F.lit('"'))).when(e["system_id"].isNotNull(), F.lit(" SYSTEM")).otherwise(""),
        F.when(e["system_id"].isNotNull(), F.concat(F.lit(' "'), e["system_id"], F.lit('"'))).otherwise(""), F.lit(">"),
    )
    return (
        F.when(e["type"] == "start", F.concat(F.lit("<"), e["name"], attrs, F.when(e["self_closing"], "/").otherwise(""), F.lit(">")))
        .when(e["type"] == "end", F.concat(F.lit("</"), e["name"], F.lit(">")))
        .when(e["type"] == "comment", F.concat(F.lit("<!--"), e["text"], F.lit("-->")))
        .when(e["type"] == "text", F.when(F.coalesce(has_unescaped_text(e["last_start_tag"]), F.lit(False)), e["text"]).otherwise(escape_text(e["text"])))
        .otherwise(doctype)
    )


# --- classes of code points, as Columns over a number ---------------------------------------------------------------------


def is_white_space(point) -> Column:
    """Tab, line feed, form feed, space; carriage returns are line feeds by then."""
    return _col(point).isin(0x09, 0x0A, 0x0C, 0x20)


def is_ascii_digit(point) -> Column:
    return _col(point).between(0x30, 0x39)


def is_ascii_upper(point) -> Column:
    return _col(point).between(0x41, 0x5A)


def is_ascii_lower(point) -> Column:
    return _col(point).between(0x61, 0x7A)


def is_ascii_letter(point) -> Column:
    return is_ascii_upper(point) | is_ascii_lower(point)


def is_ascii_hex_digit(point) -> Column:
    return is_ascii_digit(point) | _col(point).between(0x41, 0x46) | _col(point).between(0x61, 0x66)


def is_surrogate(point) -> Column:
    return _col(point).between(0xD800, 0xDFFF)


def is_control(point) -> Column:
    """Controls other than NUL and white space."""
    return (_col(point).between(0x01, 0x1F) & ~_col(point).isin(0x09, 0x0A, 0x0C, 0x0D)) | _col(point).between(0x7F, 0x9F)


def is_noncharacter(point) -> Column:
    """U+FDD0 to U+FDEF, and the last two of every plane."""
    return _col(point).between(0xFDD0, 0xFDEF) | (_col(point).between(0, 0x10FFFF) & (F.pmod(_col(point), F.lit(0x10000)) >= 0xFFFE))


def error_codes(spark):
    """The parse error codes, as a table."""
    return spark.createDataFrame([(k, c) for k, c in enumerate(names.ERROR_CODES)], "position int, code string")
