"""Cases derived by hand from the HTML standard: what is parsed, and what its serialization must be. {n} stands for a name
that a table's row gives. Unless a case has a context, both are the body of a document with a standard doctype."""

from __future__ import annotations

START, BETWEEN, FINISH = "<!DOCTYPE html>", "<html><head></head><body>", "</body></html>"

#: Query name -> [(body, expected body)].
BODIES: dict[str, list[tuple[str, str]]] = {
    "adoption_agency": [
        ("<p>1<b>2<i>{n}</b>4</i>5</p>", "<p>1<b>2<i>{n}</i></b><i>4</i>5</p>"),
        ("<b>1<p>{n}</b>3</p>", "<b>1</b><p><b>{n}</b>3</p>"),
        ("<i>1<p>{n}<em>2</i>3</em>4</p>", "<i>1</i><p><i>{n}<em>2</em></i><em>3</em>4</p>"),
        ("<b><em><u>{n}<p></b>x", "<b><em><u>{n}</u></em></b><em><u><p><b></b>x</p></u></em>"),
    ],
    "nested_anchor": [("<a href=1>{n}<a href=2>y", '<a href="1">{n}</a><a href="2">y</a>')],
    "noahs_ark": [("<p>{n}<b><b><b><b><p>c", "<p>{n}<b><b><b><b></b></b></b></b></p><p><b><b><b>c</b></b></b></p>")],
    "misnested_block": [
        ("<p>{n}<div>y</p>z</div>", "<p>{n}</p><div>y<p></p>z</div>"),
        ("<b>{n}<div>y</b>z</div>", "<b>{n}</b><div><b>y</b>z</div>"),
    ],
    "foster_text": [
        ("<table>{n}<tr><td>x</table>", "{n}<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table> <tr><td>{n}</table>", "<table> <tbody><tr><td>{n}</td></tr></tbody></table>"),
        ("<table><tr> {n} <td>x</table>", " {n} <table><tbody><tr><td>x</td></tr></tbody></table>"),
    ],
    "foster_element": [
        ("<table><b><tr><td>{n}</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>{n}</td></tr></tbody></table><b>ccc</b>"),
        ("<table><input type=hidden><input value={n}x></table>", '<input value="{n}x"><table><input type="hidden"></table>'),
        ("<table><div>{n}</div><td>x</table>", "<div>{n}</div><table><tbody><tr><td>x</td></tr></tbody></table>"),
    ],
    "implied_tbody_tr": [
        ("<table><td>{n}", "<table><tbody><tr><td>{n}</td></tr></tbody></table>"),
        ("<table><caption>{n}<col><tr><th>h<tfoot><td>f", "<table><caption>{n}</caption><colgroup><col></colgroup><tbody><tr><th>h</th></tr></tbody><tfoot><tr><td>f</td></tr></tfoot></table>"),
        ("<table><tr><td>{n}<td>b<tr><td>c</table>d", "<table><tbody><tr><td>{n}</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d"),
        ("<table><tr><td>{n}<table><td>i</table>o</table>", "<table><tbody><tr><td>{n}<table><tbody><tr><td>i</td></tr></tbody></table>o</td></tr></tbody></table>"),
    ],
    "table_in_p": [("<p>{n}<table>", "<p>{n}</p><table></table>")],
    "select_rules": [
        ("<select><b>{n}<option>a<option>b<hr>", "<select>{n}<option>a</option><option>b</option><hr></select>"),
        ("<select><optgroup><option>{n}<optgroup><option>b</select>c", "<select><optgroup><option>{n}</option></optgroup><optgroup><option>b</option></optgroup></select>c"),
        ("<select><option>{n}<input>", "<select><option>{n}</option></select><input>"),
        ("<table><tr><td><select><option>{n}<tr><td>x</table>", "<table><tbody><tr><td><select><option>{n}</option></select></td></tr><tr><td>x</td></tr></tbody></table>"),
    ],
    "template_content": [
        ("x<template><td>{n}</template>y", "x<template><td>{n}</td></template>y"),
        ("x<template><tr><td>{n}</template>", "x<template><tr><td>{n}</td></tr></template>"),
        ("x<table><template><tr></tr>{n}</template></table>", "x<table><template><tr></tr>{n}</template></table>"),
    ],
    "list_autoclose": [
        ("<ul><li>{n}<li>b</ul>", "<ul><li>{n}</li><li>b</li></ul>"),
        ("<ul><li>{n}<ul><li>b</ul><li>c</ul>", "<ul><li>{n}<ul><li>b</li></ul></li><li>c</li></ul>"),
    ],
    "dl_autoclose": [("<dl><dt>{n}<dd>b<dt>c</dl>", "<dl><dt>{n}</dt><dd>b</dd><dt>c</dt></dl>")],
    "heading_autoclose": [("<h1>{n}<h2>b</h3>c", "<h1>{n}</h1><h2>b</h2>c")],
    "pre_newline": [("<pre>\n\n{n}</pre>", "<pre>\n{n}</pre>"), ("<textarea>\n{n}&lt;</textarea>", "<textarea>{n}&lt;</textarea>"), ("<pre>\r\n{n}\r\nb</pre>", "<pre>{n}\nb</pre>")],
    "form_pointer": [("<form><form>{n}", "<form>{n}</form>"), ("<form><div></form>{n}<form>y", "<form><div>{n}<form>y</form></div></form>")],
    "button_autoclose": [("<button>{n}<button>2", "<button>{n}</button><button>2</button>")],
    "ruby": [("<ruby>{n}<rb>b<rt>c<rp>d</ruby>", "<ruby>{n}<rb>b</rb><rt>c</rt><rp>d</rp></ruby>"), ("<ruby>{n}<rtc>b<rt>c</ruby>", "<ruby>{n}<rtc>b<rt>c</rt></rtc></ruby>")],
    "image_alias": [("<image alt={n}x>", '<img alt="{n}x">')],
    "stray_end_p_br": [("{n}</p></br>", "{n}<p></p><br>")],
    "marker_scope": [("<b>{n}<object>x</b>y</object>z", "<b>{n}<object>xy</object>z</b>"), ("<b>{n}<table><td>x</b>y</table>z", "<b>{n}<table><tbody><tr><td>xy</td></tr></tbody></table>z</b>")],
    "nobr_autoclose": [("<nobr>{n}<nobr>b", "<nobr>{n}</nobr><nobr>b</nobr>")],
    "void_elements": [("{n}<br/><hr>x<img><wbr><embed><area><input></br>", "{n}<br><hr>x<img><wbr><embed><area><input><br>")],
    "raw_text": [
        ("x<style>a<b>{n}&amp;</style>", "x<style>a<b>{n}&amp;</style>"),
        ("x<xmp><p>{n}</xmp>y", "x<xmp><p>{n}</xmp>y"),
        ("x<script>if(a<b){'{n}'}</script>", "x<script>if(a<b){'{n}'}</script>"),
        ("x<script><!--<script>{n}</script>--></script>y", "x<script><!--<script>{n}</script>--></script>y"),
        ("x<iframe><p>{n}</iframe>", "x<iframe><p>{n}</iframe>"),
        ("x<plaintext></p>{n}", "x<plaintext></p>{n}</plaintext>"),
    ],
    "after_body": [("{n}</body>x</html>y", "{n}xy")],
    "svg_attr_case": [("<svg viewbox={n}x preserveaspectratio=b>", '<svg viewBox="{n}x" preserveAspectRatio="b"></svg>')],
    "svg_tag_case": [("<svg><foreignobject><p>{n}", "<svg><foreignObject><p>{n}</p></foreignObject></svg>"), ("<svg><lineargradient>{n}", "<svg><linearGradient>{n}</linearGradient></svg>")],
    "mathml_definitionurl": [("<math definitionurl={n}x><mi>a", '<math definitionURL="{n}x"><mi>a</mi></math>')],
    "xlink_attrs": [("<svg xlink:href={n}x xml:lang=en xml:base=b>", '<svg xlink:href="{n}x" xml:lang="en" xml:base="b"></svg>')],
    "foreign_breakout": [("<svg><p>{n}", "<svg></svg><p>{n}</p>"), ("<svg><font color=red>{n}", '<svg></svg><font color="red">{n}</font>'), ("<svg><font>{n}", "<svg><font>{n}</font></svg>")],
    "integration_point": [("<svg><desc><b>{n}</b></desc><g>", "<svg><desc><b>{n}</b></desc><g></g></svg>"), ("<math><annotation-xml encoding=text/html><p>{n}", '<math><annotation-xml encoding="text/html"><p>{n}</p></annotation-xml></math>')],
    "cdata": [("<svg><![CDATA[a<{n}]]>b</svg><![CDATA[x]]>", "<svg>a&lt;{n}b</svg><!--[CDATA[x]]-->")],
    "entities_text": [("a&notit;{n} &notin; &ampx &nosuch; &", "a¬it;{n} ∉ &amp;x &amp;nosuch; &amp;")],
    "entities_attr": [('<i t="&notit;{n}&amp;&lt=&copy">', '<i t="&amp;notit;{n}&amp;&amp;lt=©"></i>')],
    "numeric_refs": [("{n}&#128;&#0;&#xD800;&#x110000;&#65;&#x42", "{n}€���AB")],
    "comments": [("{n}<!-->x<!--->y<!--a--!>z<!--b-- >c-->", "{n}<!---->x<!---->y<!--a-->z<!--b-- >c-->"), ("{n}<?pi?><!x></1><!--e", "{n}<!--?pi?--><!--x--><!--1--><!--e-->")],
    "tag_states": [
        ("{n}</><p/a =b  c = 'd' e=f/ G=\"h\">", "{n}<p a=\"b\" c=\"d\" e=\"f/\" g=\"h\"></p>"),
        ("{n}<div =a b=c b=d>< x", "{n}<div =a=\"\" b=\"c\">&lt; x</div>"),
        ("{n}<div class=\"y", "{n}"),
    ],
    "nul_characters": [("{n}\0x<svg>\0</svg><xmp>\0</xmp>", "{n}x<svg>�</svg><xmp>�</xmp>")],
    "generic_end": [("<foo>{n}<bar></foo>x</bar>", "<foo>{n}<bar></bar></foo>x")],
}

#: Query name -> [(whole input, expected document)].
DOCUMENTS: dict[str, list[tuple[str, str]]] = {
    "table_in_p_quirks": [("<p>{n}<table>", "<html><head></head><body><p>{n}<table></table></p></body></html>")],
    "frameset_doc": [
        ("<!DOCTYPE html><frameset rows={n}x><frame></frameset>x", '<!DOCTYPE html><html><head></head><frameset rows="{n}x"><frame></frameset></html>'),
        ("<!DOCTYPE html><p><frameset><noframes>{n}</noframes>", "<!DOCTYPE html><html><head></head><frameset><noframes>{n}</noframes></frameset></html>"),
    ],
    "head_modes": [
        ("<!DOCTYPE html><title>{n}</title><meta charset=a><p>x<title>y", '<!DOCTYPE html><html><head><title>{n}</title><meta charset="a"></head><body><p>x<title>y</title></p></body></html>'),
        ("<html lang={n}x><body class=a><html dir=b><body class=c id=d>", '<html lang="{n}x" dir="b"><head></head><body class="a" id="d"></body></html>'),
        ("<!--{n}--><head></head><!--b--><link>c", "<!--{n}--><html><head><link></head><!--b--><body>c</body></html>"),
        ("x</body><!--{n}--></html><!--b-->", "<html><head></head><body>x</body><!--{n}--></html><!--b-->"),
        ("", "<html><head></head><body></body></html>"),
    ],
    "doctype_output": [('<!doctype HTML PUBLIC "{n}" "s">x', "<!DOCTYPE html><html><head></head><body>x</body></html>")],
}

#: Query name -> (context, [(input, expected)]).
FRAGMENTS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "fragment_td": ("td", [("{n}</td><td>b", "{n}b")]),
    "fragment_select": ("select", [("<option>{n}<b>c", "<option>{n}c</option>")]),
    "fragment_title": ("title", [("{n}<b>&amp;", "{n}&lt;b&gt;&amp;")]),
    "fragment_svg": ("svg desc", [("<p>{n}", "<p>{n}</p>")]),
    "fragment_template": ("template", [("<tr><td>{n}", "<tr><td>{n}</td></tr>"), ("<p>{n}", "<p>{n}</p>")]),
    "fragment_math": ("math mi", [("<p>{n}</p>x", "<p>{n}</p>x"), ("{n}<mglyph>x", "{n}<mglyph>x</mglyph>")]),
    "fragment_table": ("table", [("<tr><td>{n}", "<tbody><tr><td>{n}</td></tr></tbody>")]),
}

#: With scripting off.
NO_SCRIPTING: dict[str, list[tuple[str, str]]] = {
    "noscript_scripting_off": [("{n}<noscript><p>x</noscript>", "{n}<noscript><p>x</p></noscript>")],
    "noscript_in_head": [("<!DOCTYPE html><head><noscript><link><p>{n}", "<!DOCTYPE html><html><head><noscript><link></noscript></head><body><p>{n}</p></body></html>")],
}

#: (name, public, system) -> mode.
DOCTYPES = [
    ("html", None, None, "no-quirks"),
    ("html", None, "about:legacy-compat", "no-quirks"),
    ("foo", None, None, "quirks"),
    (None, None, None, "quirks"),
    ("html", "-//W3C//DTD HTML 4.01 Transitional//EN", None, "quirks"),
    ("html", "-//W3C//DTD HTML 4.01 Transitional//EN", "http://www.w3.org/TR/html4/loose.dtd", "limited-quirks"),
    ("html", "-//W3C//DTD XHTML 1.0 Transitional//EN", "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd", "limited-quirks"),
    ("html", "-//W3C//DTD XHTML 1.0 Strict//EN", "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd", "no-quirks"),
    ("html", "-//IETF//DTD HTML 2.0//EN", None, "quirks"),
    ("html", "HTML", None, "quirks"),
    ("html", "x", "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd", "quirks"),
]

#: Input -> the error codes of the text after it, each once.
ERRORS = [
    ("{n}", "missing-doctype"),
    ("<!DOCTYPE html>{n}<p a=1 a=2>", "duplicate-attribute"),
    ("<!DOCTYPE html>{n}</p a=1>", "end-tag-with-attributes"),
    ("<!DOCTYPE html>{n}<div/>", "non-void-html-element-start-tag-with-trailing-solidus"),
    ("<!DOCTYPE html>{n}&nosuch;", "unknown-named-character-reference"),
    ("<!DOCTYPE html>{n}&amp", "missing-semicolon-after-character-reference"),
    ("<!DOCTYPE html>{n}&#0;", "null-character-reference"),
    ("<!DOCTYPE html>{n}&#x110000;", "character-reference-outside-unicode-range"),
    ("<!DOCTYPE html>{n}&#xD800;", "surrogate-character-reference"),
    ("<!DOCTYPE html>{n}&#x80;", "control-character-reference"),
    ("<!DOCTYPE html>{n}&#xFFFF;", "noncharacter-character-reference"),
    ("<!DOCTYPE html>{n}&#;", "absence-of-digits-in-numeric-character-reference"),
    ("<!DOCTYPE html>{n}<!-->", "abrupt-closing-of-empty-comment"),
    ("<!DOCTYPE html>{n}<!--a", "eof-in-comment"),
    ("<!DOCTYPE html>{n}<!--a--!>", "incorrectly-closed-comment"),
    ("<!DOCTYPE html>{n}<!--a<!--b-->", "nested-comment"),
    ("<!DOCTYPE html>{n}<!x>", "incorrectly-opened-comment"),
    ("<!DOCTYPE html>{n}<?x>", "unexpected-question-mark-instead-of-tag-name"),
    ("<!DOCTYPE html>{n}</>", "missing-end-tag-name"),
    ("<!DOCTYPE html>{n}<1", "invalid-first-character-of-tag-name"),
    ("<!DOCTYPE html>{n}<", "eof-before-tag-name"),
    ("<!DOCTYPE html>{n}<p a", "eof-in-tag"),
    ("<!DOCTYPE html>{n}<p a=>", "missing-attribute-value"),
    ("<!DOCTYPE html>{n}<p a=\"b\"c>", "missing-whitespace-between-attributes"),
    ("<!DOCTYPE html>{n}<p =>", "unexpected-equals-sign-before-attribute-name"),
    ("<!DOCTYPE html>{n}<p a\"b>", "unexpected-character-in-attribute-name"),
    ("<!DOCTYPE html>{n}<p a=b\"c>", "unexpected-character-in-unquoted-attribute-value"),
    ("<!DOCTYPE html>{n}<p / a>", "unexpected-solidus-in-tag"),
    ("<!DOCTYPE html>{n}<![CDATA[x]]>", "cdata-in-html-content"),
    ("<!DOCTYPE html>{n}<svg><![CDATA[x", "eof-in-cdata"),
    ("<!DOCTYPE html>{n}<script>a", "eof-in-element-that-can-contain-only-text"),
    ("<!DOCTYPE html SYSTEM \"x\">{n}", "non-conforming-doctype"),
    ("<!DOCTYPEhtml>{n}", "missing-whitespace-before-doctype-name"),
    ("<!DOCTYPE html><head></p></head>{n}", "end-tag-without-matching-open-element"),
    ("<!DOCTYPE html><head></head><title></title>{n}", "abandoned-head-element-child"),
    ("<!DOCTYPE html><head><!DOCTYPE html></head>{n}", "misplaced-doctype"),
    ("<!DOCTYPE html><head><head></head>{n}", "misplaced-start-tag-for-head-element"),
    ("<!DOCTYPE html>{n}<template><b></template>", "closing-of-element-with-open-child-elements"),
    ("<!DOCTYPE html>{n}\x01", "control-character-in-input-stream"),
]

#: Inputs with all the codes that they give.
MORE_ERRORS = [
    ("<!DOCTYPE html>{n}<b></b/>", ("end-tag-with-trailing-solidus",)),
    ("<!DOCTYPE html>{n}\0", ("unexpected-null-character",)),
    ("<!DOCTYPE html>{n}\ufdd0", ("noncharacter-in-input-stream",)),
    ('<!DOCTYPE html SYSTEM "about:legacy-compat" x>{n}', ("unexpected-character-after-doctype-system-identifier",)),
    ('<!DOCTYPE html PUBLIC"x">{n}', ("missing-whitespace-after-doctype-public-keyword", "non-conforming-doctype")),
    ("<!DOCTYPE html PUBLIC 'x''y'>{n}", ("missing-whitespace-between-doctype-public-and-system-identifiers", "non-conforming-doctype")),
    ("<!DOCTYPE html SYSTEM'about:legacy-compat'>{n}", ("missing-whitespace-after-doctype-system-keyword",)),
    ("<!DOCTYPE html PUBLIC x>{n}", ("missing-quote-before-doctype-public-identifier",)),
    ("<!DOCTYPE html SYSTEM x>{n}", ("missing-quote-before-doctype-system-identifier",)),
    ("<!DOCTYPE html PUBLIC>{n}", ("missing-doctype-public-identifier",)),
    ("<!DOCTYPE html SYSTEM>{n}", ("missing-doctype-system-identifier",)),
    ('<!DOCTYPE html PUBLIC "x>{n}', ("abrupt-doctype-public-identifier", "non-conforming-doctype")),
    ("<!DOCTYPE html SYSTEM 'x>{n}", ("abrupt-doctype-system-identifier", "non-conforming-doctype")),
    ("<!DOCTYPE>{n}", ("missing-doctype-name", "non-conforming-doctype")),
    ("<!DOCTYPE html x {n}>", ("invalid-character-sequence-after-doctype-name",)),
    ("<!DOCTYPE html", ("eof-in-doctype",)),
    ("<!DOCTYPE html>{n}<script><!--a", ("eof-in-script-html-comment-like-text", "eof-in-element-that-can-contain-only-text")),
]
#: The same without scripting.
NOSCRIPT_ERRORS = [
    ("<!DOCTYPE html><head><noscript><p>{n}", ("disallowed-content-in-noscript-in-head",)),
    ("<!DOCTYPE html><head><noscript><noscript></noscript></head>{n}", ("nested-noscript-in-head",)),
]
#: Events in foreign content: each event's type and name, or text, in order.
EVENTS = [
    ("<svg><foreignobject><p>{n}</p></foreignobject><lineargradient/></svg><p>", "start svg|start foreignObject|start p|text {n}|end p|end foreignObject|start linearGradient|end svg|start p"),
    ("<svg><title>{n}</title><![CDATA[<b>]]></svg>", "start svg|start title|text {n}|end title|text <b>|end svg"),
    ("<math><mi>{n}<image></mi><image></math><image>", "start math|start mi|text {n}|start img|end mi|start image|end math|start img"),
    ("<svg><p>{n}<foreignobject></svg>", "start svg|start p|text {n}|start foreignobject|end svg"),
    ("<svg/><lineargradient>{n}</p><lineargradient></svg><lineargradient>", "start svg|start linearGradient|text {n}|end p|start linearGradient|end svg|start lineargradient"),
    ("<math><annotation-xml encoding=text/html><svg></svg><image></annotation-xml><image>{n}", "start math|start annotation-xml|start svg|end svg|start img|end annotation-xml|start img|text {n}"),
    ("<svg><font>{n}<font color=a><lineargradient>", "start svg|start font|text {n}|start font|start lineargradient"),
    ("<svg><style><b>{n}</b></style></svg><style><b>{n}</b></style>", "start svg|start style|start b|text {n}|end b|end style|end svg|start style|text <b>{n}</b>|end style"),
    ("<pre>\n{n}</pre><noscript><b></noscript>", "start pre|text {n}|end pre|start noscript|text <b>|end noscript"),
]
#: Markup that a rewriter must keep, whatever it means.
KEPT = ["<pre>\n{n}</pre>", "<pre>\n</pre>{n}", "a</>{n}", "<p>{n}</p", "<p>{n}<", "<p a='{n}", "<!doctype  HTML ><P  A=1>{n}&amp</P >", "<!x{n}><?y>", "<textarea>\n\n{n}", "<script><!--{n}<script>", "\n{n}\n"]
