"""The parser alone: cases of the standard, properties over random markup, locations, events."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweft.core import events, output
from tagweft.core.builder import parse, parse_fragment
from tagweft.core.entities import unescape
from tagweft.core.names import ERROR_CODES, doctype_mode
from tagweft.functions.html import event_rows
from tagweft.core.tokenizer import END, EOF, RAWTEXT, RCDATA, START, Input, Tokenizer
from tagweft.plans import cases

NAME = "PERU"


def fill(s):
    return s.replace("{n}", NAME)


def whole(html, **options):
    return output.serialize(parse(html, **options).document.children, options.get("scripting", True))


@pytest.mark.parametrize(("name", "html", "expected"), [(n, a, b) for n, c in cases.BODIES.items() for a, b in c])
def test_body(name, html, expected):
    assert whole(cases.START + fill(html)) == cases.START + cases.BETWEEN + fill(expected) + cases.FINISH


@pytest.mark.parametrize(("name", "html", "expected"), [(n, a, b) for n, c in cases.DOCUMENTS.items() for a, b in c])
def test_document(name, html, expected):
    assert whole(fill(html)) == fill(expected)


@pytest.mark.parametrize(("context", "html", "expected"), [(c, a, b) for c, x in cases.FRAGMENTS.values() for a, b in x])
def test_fragment(context, html, expected):
    assert output.serialize(parse_fragment(fill(html), context)[1].children) == fill(expected)


@pytest.mark.parametrize(("html", "code"), cases.ERRORS)
def test_error_codes(html, code):
    assert {c for c, _, _ in parse(fill(html), errors=True).found} == {code}
    assert code in ERROR_CODES and len(ERROR_CODES) == 60


@pytest.mark.parametrize(("html", "codes"), [(x, set(c)) for x, c in cases.MORE_ERRORS])
def test_more_error_codes(html, codes):
    assert {c for c, _, _ in parse(fill(html), errors=True).found} == codes


@pytest.mark.parametrize(("html", "expected"), cases.EVENTS)
def test_foreign_events(html, expected):
    assert "|".join(f"{e.kind} {e.name or e.text}" for e in events.events(fill(html))[1]) == fill(expected)


@pytest.mark.parametrize(("name", "public", "system", "mode"), cases.DOCTYPES)
def test_doctype_mode(name, public, system, mode):
    assert doctype_mode(name, public, system) == mode


PIECES = "<p> </p> <b> </b> <table> <td> <tr> </table> x &amp; &#0; <!--c--> <svg> </svg> <script> </script> <select> <option> <a> </a> <template> </template> <math> <mi> <title> </title> < </ <pre> <li> <form> <frameset> </body> </html> <caption> <![CDATA[z]]> <nobr> <h1> <button> </br> <col> <i> </i>".split() + ["\n", "\r\n", "\0", "😀", " ", "<!DOCTYPE html>"]
MARKUP = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_any_markup(html):
    p = parse(html, errors=True)
    rows = list(output.flatten(p.document))
    for me, parent, _, depth, end, _, _ in rows:
        assert me <= end < len(rows)
        if parent is not None:
            assert parent < me <= rows[parent][4] and depth == rows[parent][3] + 1
    assert {c for c, _, _ in p.found} <= set(ERROR_CODES)
    for _, a, b in p.found:
        assert 0 <= a <= b <= len(p.input.text)


@settings(max_examples=200, deadline=None)
@given(MARKUP)
def test_rewriting_keeps_the_source(html):
    assert events.rewrite(html, lambda e, raw: None) == html
    assert "".join(r["raw"] for r in event_rows(html, locations=False, source_kept=True)) == html


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "x", "<div>", "</div>", "<ul><li>", "</ul>"]), max_size=20).map("".join))
def test_serialization_is_stable(html):
    once = whole(cases.START + html)
    assert whole(once) == once or "<p>" in once  # a <p> that a <div> was moved out of may parse anew


def test_locations_in_utf16_and_raw_newlines():
    p = parse("<p>😀\r\n<b>x</b></p>")
    b = p.document.children[0].children[1].children[0].children[1]
    assert p.input.position(b.place[0]) == (2, 1, 7) and p.input.raw_slice(*b.place) == "<b>x</b>"
    assert b.end_tag is not None and p.document.children[0].place is None  # implied elements have no place


def test_unclosed_elements_end_where_they_are_closed():
    p = parse("<!DOCTYPE html><p>a<p>b")
    first, second = p.document.children[1].children[1].children
    assert p.input.raw_slice(*first.place) == "<p>a" and p.input.raw_slice(*second.place) == "<p>b" and first.end_tag is None


def test_tokenizer_states():
    t = Tokenizer("a</title>b", RCDATA, "title")
    assert [t.next().kind for _ in range(4)] == ["text", END, "text", EOF]
    assert Tokenizer("<b>&amp;", RAWTEXT, "style").next().text == "<b>&amp;"
    t = Tokenizer('<A B=C d="e" d=f />').next()
    assert (t.kind, t.name, [a[:2] for a in t.attrs], t.self_closing) == (START, "a", [("b", "C"), ("d", "e")], True)


def test_character_references():
    assert unescape("&notin; &notit; &amp &x; &#x41;&#128;") == "∉ ¬it; & &x; A€"
    assert unescape("&notit;&amp=&lt", True) == "&notit;&amp=<"


def test_script_hook_writes_into_the_parser():
    written = iter(["<p>a<script>2</script>", "b"])
    assert whole("<script>1</script>c", on_script=lambda n: next(written)) == "<html><head><script>1</script></head><body><p>a<script>2</script>bc</p></body></html>"


def test_template_content_is_separate():
    html = parse("<template>a</template>").document.children[0]
    template = html.children[0].children[0]
    assert template.children == [] and template.content.children[0].value == "a"
    assert output.inner(template) == "a" and output.dump([template]) == '| <template>\n|   content\n|     "a"'


def test_events():
    source, found = events.events("<pre>\nx</pre><svg><a xlink:href=1/></svg><noscript><b></noscript>\0")
    rows = [(e.kind, e.name, e.text) for e in found]
    assert rows[1] == ("text", None, "x") and ("text", None, "<b>") in rows and rows[-1] == ("text", None, "\0")
    rendered = events.rewrite("<p  a=1>x &lt; y</p><!DOCTYPE a PUBLIC 'b'>", lambda e, raw: events.render(e))
    assert rendered == '<p a="1">x &lt; y</p><!DOCTYPE a PUBLIC "b">'


def test_deep_and_long_inputs():
    assert whole("<div>" * 5000).count("<div>") == 5000
    assert len(whole("x" * 1_000_000)) > 1_000_000
    assert whole("</>" * 3000) == "<html><head></head><body></body></html>"
    assert Input("").position(0) == (1, 1, 0)
