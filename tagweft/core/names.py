"""Names and tables of the HTML standard: namespaces, tag sets, foreign spellings, document modes, error codes."""

from __future__ import annotations

HTML = "http://www.w3.org/1999/xhtml"
MATHML = "http://www.w3.org/1998/Math/MathML"
SVG = "http://www.w3.org/2000/svg"
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns/"
NAMESPACES = {"HTML": HTML, "MATHML": MATHML, "SVG": SVG, "XLINK": XLINK, "XML": XML, "XMLNS": XMLNS}

NO_QUIRKS, QUIRKS, LIMITED_QUIRKS = "no-quirks", "quirks", "limited-quirks"


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Fixed values of the standard, in its own terms.
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
VOID = _set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
UNESCAPED = _set("style script xmp iframe noembed noframes plaintext")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
SPECIAL_HTML = _set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd "
    "details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe img input li link listing main marquee menu meta nav noembed noframes noscript object ol p "
    "param plaintext pre script section select source style summary table tbody td template textarea tfoot th thead "
    "title tr track ul wbr xmp"
)
SPECIAL = {HTML: SPECIAL_HTML, MATHML: _set("mi mo mn ms mtext annotation-xml"), SVG: _set("title foreignObject desc")}
BLOCKS = _set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup "
    "main menu nav ol p search section summary ul"
)
BLOCK_ENDS = (BLOCKS - {"p"}) | {"button", "listing", "pre"}
HEAD_TAGS = _set("base basefont bgsound link meta noframes script style template title")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
IMPLIED_THOROUGH = IMPLIED | _set("caption colgroup tbody td tfoot th thead tr")
TABLE_CONTEXT = _set("table tbody tfoot thead tr")

#: Where a search of the open elements for one in scope ends.
SCOPE = {HTML: _set("applet caption html marquee object table td template th"), MATHML: SPECIAL[MATHML], SVG: SPECIAL[SVG]}

BREAKOUT = _set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var"
)

SVG_TAGS = {
    n.lower(): n
    for n in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix "
        "feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feFlood feFuncA "
        "feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight "
        "feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRIBUTES = {
    n.lower(): n
    for n in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits "
        "glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust "
        "limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength "
        "patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio "
        "primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant "
        "specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX "
        "targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
#: Name -> (prefix, local name, namespace).
FOREIGN_ATTRIBUTES = {f"xlink:{n}": ("xlink", n, XLINK) for n in "actuate arcrole href role show title type".split()}
FOREIGN_ATTRIBUTES |= {f"xml:{n}": ("xml", n, XML) for n in ("lang", "space")}
FOREIGN_ATTRIBUTES |= {"xmlns": ("", "xmlns", XMLNS), "xmlns:xlink": ("xmlns", "xlink", XMLNS)}

#: Public identifiers, in lower case, whose prefix asks for quirks mode.
QUIRKS_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
TRANSITIONAL_401 = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
TRANSITIONAL_XHTML = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
QUIRKS_IDS = frozenset(["-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html"])
QUIRKS_SYSTEM_ID = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"
LEGACY_SYSTEM_ID = "about:legacy-compat"

#: Codes of the standard's tokenizer, and after them the tree builder's, which the standard has no names for.
ERROR_CODES = (
    "abrupt-closing-of-empty-comment",
    "abrupt-doctype-public-identifier",
    "abrupt-doctype-system-identifier",
    "absence-of-digits-in-numeric-character-reference",
    "cdata-in-html-content",
    "character-reference-outside-unicode-range",
    "control-character-in-input-stream",
    "control-character-reference",
    "duplicate-attribute",
    "end-tag-with-attributes",
    "end-tag-with-trailing-solidus",
    "eof-before-tag-name",
    "eof-in-cdata",
    "eof-in-comment",
    "eof-in-doctype",
    "eof-in-script-html-comment-like-text",
    "eof-in-tag",
    "incorrectly-closed-comment",
    "incorrectly-opened-comment",
    "invalid-character-sequence-after-doctype-name",
    "invalid-first-character-of-tag-name",
    "missing-attribute-value",
    "missing-doctype-name",
    "missing-doctype-public-identifier",
    "missing-doctype-system-identifier",
    "missing-end-tag-name",
    "missing-quote-before-doctype-public-identifier",
    "missing-quote-before-doctype-system-identifier",
    "missing-semicolon-after-character-reference",
    "missing-whitespace-after-doctype-public-keyword",
    "missing-whitespace-after-doctype-system-keyword",
    "missing-whitespace-before-doctype-name",
    "missing-whitespace-between-attributes",
    "missing-whitespace-between-doctype-public-and-system-identifiers",
    "nested-comment",
    "non-void-html-element-start-tag-with-trailing-solidus",
    "noncharacter-character-reference",
    "noncharacter-in-input-stream",
    "null-character-reference",
    "surrogate-character-reference",
    "surrogate-in-input-stream",
    "unexpected-character-after-doctype-system-identifier",
    "unexpected-character-in-attribute-name",
    "unexpected-character-in-unquoted-attribute-value",
    "unexpected-equals-sign-before-attribute-name",
    "unexpected-null-character",
    "unexpected-question-mark-instead-of-tag-name",
    "unexpected-solidus-in-tag",
    "unknown-named-character-reference",
    "abandoned-head-element-child",
    "closing-of-element-with-open-child-elements",
    "disallowed-content-in-noscript-in-head",
    "end-tag-without-matching-open-element",
    "eof-in-element-that-can-contain-only-text",
    "misplaced-doctype",
    "misplaced-start-tag-for-head-element",
    "missing-doctype",
    "nested-noscript-in-head",
    "non-conforming-doctype",
    "open-elements-left-after-eof",
)


def doctype_mode(name: str | None, public_id: str | None, system_id: str | None, force_quirks: bool = False) -> str:
    if force_quirks or name != "html" or system_id and system_id.lower() == QUIRKS_SYSTEM_ID:
        return QUIRKS
    if public_id is None:
        return NO_QUIRKS
    public = public_id.lower()
    if public in QUIRKS_IDS or public.startswith(QUIRKS_PREFIXES):
        return QUIRKS
    if public.startswith(TRANSITIONAL_401):
        return QUIRKS if system_id is None else LIMITED_QUIRKS
    return LIMITED_QUIRKS if public.startswith(TRANSITIONAL_XHTML) else NO_QUIRKS


def conforming(name: str | None, public_id: str | None, system_id: str | None) -> bool:
    return name == "html" and public_id is None and system_id in (None, LEGACY_SYSTEM_ID)


def has_unescaped_text(name: str, scripting: bool = True) -> bool:
    """Whether an HTML element's text is serialized as it is."""
    return name in UNESCAPED or scripting and name == "noscript"
