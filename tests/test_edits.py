"""Edits of node tables against edits of plain trees."""

import random

import pytest

from tagweft.functions import html as H
from tagweft.operators import edits as E
from tagweft.operators import tables as X

PAGES = "page_id long, html string"
EDITS = "page_id long, edit int, op string, begin_label array<long>, html string"


class Plain:
    """A tree of lists that edits are applied to one by one."""

    def __init__(self, html):
        parsed = H.parsed(html, frozenset([H.NODES]), None, True)["nodes"]
        self.nodes = {}
        for r in parsed:
            self.add(r, self.nodes.get(r["parent_id"]), None)
        self.root = self.nodes[0]

    def add(self, row, parent, index):
        node = {"row": row, "children": [], "parent": parent}
        self.nodes[row["node_id"]] = node
        if parent is not None:
            parent["children"].insert(len(parent["children"]) if index is None else index, node)
        return node

    def insert(self, op, node, html):
        rows = H.parsed(html, frozenset([H.NODES]), "body", True)["nodes"]
        made = Plain.__new__(Plain)
        made.nodes = {}
        for r in rows:
            made.add(r, made.nodes.get(r["parent_id"]), None)
        for child in made.nodes[0]["children"]:
            parent = node["parent"] if op == E.BEFORE else node
            at = next(i for i, c in enumerate(parent["children"]) if c is node) if op == E.BEFORE else len(parent["children"])
            child["parent"] = parent
            parent["children"].insert(at, child)

    def in_order(self):
        stack, out = [self.root], []
        while stack:
            node = stack.pop()
            out.append(node)
            stack += reversed(node["children"])
        return out

    def text(self, node=None):
        node = node or self.root
        r = node["row"]
        attrs = [(a["name"], a["value"]) for a in r["attrs"] or ()]
        return (r["node_type"], r["name"], r["value"], attrs, [self.text(c) for c in node["children"]])


def nested(rows):
    by = {r.node_id: (r.node_type, r.name, r.value, [(a.name, a.value) for a in r.attrs or ()], []) for r in rows}
    for r in sorted(rows, key=lambda r: (r.parent_id is not None, r.parent_id, r.sib_idx)):
        if r.parent_id is not None:
            by[r.parent_id][4].append(by[r.node_id])
    return by[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_of_edits_against_plain_trees(spark, tmp_path, seed):
    rng = random.Random(seed)
    pages = [(k, "".join(rng.choice(["<p>a", "<ul><li>b<li>c</ul>", "<i>d</i>", "<!--e-->", "f"]) for _ in range(6))) for k in range(8)]
    plain = {k: Plain(h) for k, h in pages}
    table = E.labelled(X.nodes(spark.createDataFrame(pages, PAGES)))
    for turn in range(3):
        table.write.parquet(str(tmp_path / str(turn)))
        table = spark.read.parquet(str(tmp_path / str(turn)))
        numbered = E.renumbered(table).collect()
        edits, gone = [], []
        for k, tree in plain.items():
            if k == 7:
                continue  # a page without edits
            nodes = tree.in_order()
            labels = {r.node_id: list(r.begin_label) for r in numbered if r.page_id == k}
            assert len(labels) == len(nodes)
            places = [i for i in range(len(nodes)) if nodes[i]["row"]["node_type"] == "element" and nodes[i]["row"]["name"] not in ("html", "head", "body")]
            same = rng.choice(places or [len(nodes) - 1])
            for e in range(6):
                at = same if e % 2 else rng.choice(places or [same])
                op = rng.choice([E.BEFORE, E.APPEND])
                html = rng.choice(["x", f"<b>{turn}{e}</b>", "<s>y</s>z", "", "<!--q-->"])
                edits.append((k, e, op, labels[at], html))
                tree.insert(op, nodes[at], html)
            if places and rng.random() < 0.7:
                at = rng.choice(places)
                edits.append((k, 9, E.DETACH, labels[at], None))
                gone.append((tree, nodes[at]))
            edits.append((k, 8, E.BEFORE, [10**9], "never"))
        for _, node in gone:
            node["parent"]["children"] = [c for c in node["parent"]["children"] if c is not node]
        rng.shuffle(edits)
        before = {(r.page_id, tuple(r.begin_label)) for r in table.collect()}
        table = E.applied(table, spark.createDataFrame(edits, EDITS))
        after = {(r.page_id, tuple(r.begin_label)) for r in table.collect()}
        assert len(before & after) > len(before) / 2  # labels stay
        rows = E.renumbered(table).collect()
        for k, tree in plain.items():
            own = [r for r in rows if r.page_id == k]
            assert nested(own) == tree.text(), (turn, k)
            assert sorted(r.node_id for r in own) == list(range(len(own)))
            for r in own:
                below = [x for x in own if r.node_id < x.node_id <= r.subtree_end]
                assert all(x.depth > r.depth for x in below) and sum(x.parent_id == r.node_id for x in own) == sum(x.depth == r.depth + 1 for x in below)


def test_labels_between_neighbours_never_run_out(spark):
    """Insertions at one place, over and over, each before the one made last."""
    nodes = X.nodes(spark.createDataFrame([(1, "<p>a</p>")], PAGES))
    table, ref = E.labelled(nodes), None
    for k in range(6):
        rows = table.where("name = 'p'" if ref is None else f"name = 'i{k - 1}'").collect()
        ref = list(rows[0].begin_label)
        table = spark.createDataFrame(E.applied(table, spark.createDataFrame([(1, 1, E.BEFORE, ref, f"<i{k}></i{k}>")], EDITS)).collect(), table.schema)
    names = [r.name for r in sorted(E.renumbered(table).collect(), key=lambda r: r.node_id) if r.depth == 3]
    assert names == ["i5", "i4", "i3", "i2", "i1", "i0", "p"]


def test_serialized_again(spark):
    pages = spark.createDataFrame([(1, "<!DOCTYPE html><p a=1>x<b>y</b><svg><g></g></svg>"), (2, "")], PAGES)
    whole = {r.page_id: r.html for r in X.serialized(pages).collect()}
    again = E.serialized(E.renumbered(E.labelled(X.nodes(pages))))
    assert {r.page_id: r.html for r in again.collect()} == whole
    assert E.renumbered(E.labelled(X.nodes(pages.where("false")))).count() == 0
