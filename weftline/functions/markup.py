"""References in CSS, JavaScript, srcset, HTML and SVG: small regex tokenizers that run inside tasks.

Offsets count code points. A text that breaks off inside a construct raises ValueError, which operators turn into a diagnostic.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

from .whatwg import reference

# Which attributes hold references, and which roles run code.
URL_ATTRIBUTES = {"src", "href", "data", "poster", "action", "formaction", "cite", "background"}
LAZY_ATTRIBUTES = {"data-src", "data-lazy-src", "data-original", "data-bg", "data-background"}
SRCSET_ATTRIBUTES = {"srcset", "data-srcset", "data-lazy-srcset"}
SVG_URL_ATTRIBUTES = {"href", "xlink:href"}
SVG_PAINT_ATTRIBUTES = {"filter", "mask", "clip-path", "fill", "stroke", "cursor", "marker", "marker-start", "marker-mid", "marker-end"}
SVG_ELEMENTS = {"svg", "use", "image", "script", "a", "feimage", "mpath", "animate", "set", "lineargradient", "radialgradient", "pattern", "filter", "mask", "clippath", "marker"}
EXECUTABLE_ROLES = {"script", "module", "stylesheet", "css-import"}


class Reference(NamedTuple):
    syntax: str
    role: str
    raw: str
    start: int
    end: int
    quote: str = ""
    policy: str = ""
    tag: str = ""
    attribute: str = ""

    def shifted(self, by: int, **changes: str) -> Reference:
        return self._replace(start=self.start + by, end=self.end + by, **changes)

    def resolved(self, base: str | None) -> str | None:
        try:
            found = reference(self.raw, base)
        except ValueError:
            return None
        return found and found[1]


def policy_for(role: str) -> str:
    if role in EXECUTABLE_ROLES:
        return "block-unresolved-executable"
    return "preserve-navigation" if role == "navigation" else "block-unresolved-subresource"


def _made(syntax: str, role: str, raw: str, start: int, end: int, quote: str = "", policy: str = "") -> Reference:
    return Reference(syntax, role, raw, start, end, quote, policy or policy_for(role))


_QUOTED = r'"(?:\\(?:\r\n|.)|[^"\\])*"|' + r"'(?:\\(?:\r\n|.)|[^'\\])*'"
_URL = rf"url\s*\(\s*(?:(?P<quoted>{_QUOTED})|(?P<bare>(?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*)\))"
_CSS = re.compile(rf"(?P<skip>/\*.*?\*/)|(?P<import>@import\s+)|{_URL}|(?P<string>{_QUOTED})|(?P<face>@font-face\b)|(?P<set>(?:-webkit-)?image-set\s*\()|(?P<mark>[{{}};])|(?P<broken>/\*|[\"']|url\s*\()", re.S | re.I)
_IN_SET = re.compile(rf"{_URL}|(?P<string>{_QUOTED})|(?P<paren>[()])|(?P<broken>[\"']|url\s*\()", re.S | re.I)
_CSS_ESCAPE = re.compile(r"\\([0-9a-f]{1,6})(?:\r\n|[\t\n\f\r ])?|\\([^\r\n\f])", re.I)


def _unescaped(text: str) -> str:
    return _CSS_ESCAPE.sub(lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], text)


def _css_value(m: re.Match, group: str, syntax: str, role: str) -> Reference:
    """The reference in a quoted string or a bare url()."""
    start, end = m.span(group)
    quote = ""
    if group != "bare":
        quote, start, end = m[group][0], start + 1, end - 1
    inner = m.string[start:end]
    lead = len(inner) - len(inner.lstrip())
    return _made(syntax, role, _unescaped(inner.strip()), start + (lead if inner.strip() else 0), start + len(inner.rstrip()) if inner.strip() else start, quote)


def css_references(text: str) -> Iterator[Reference]:
    """@import, url() and image-set(); fonts are what stands in @font-face."""
    at, depth, faces, face_next, importing = 0, 0, [], False, False
    while m := _CSS.search(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "broken":
            raise ValueError(f"CSS breaks off in {m['broken'][:4]!r}")
        if kind == "import":
            importing = True
            continue
        if kind in ("quoted", "bare"):
            role = "font" if faces else "css-import" if importing else "image"
            yield _css_value(m, kind, "css-import" if role == "css-import" else "css-url", role)
        elif kind == "string" and importing:
            yield _css_value(m, "string", "css-import", "css-import")
        elif kind == "face":
            face_next = True
        elif kind == "mark":
            if m["mark"] == "{":
                depth += 1
                if face_next:
                    faces.append(depth)
                    face_next = False
            elif m["mark"] == "}":
                if faces and faces[-1] == depth:
                    faces.pop()
                depth = max(0, depth - 1)
        elif kind == "set":
            open_ = 1
            while open_:
                n = _IN_SET.search(text, at)
                if not n or n.lastgroup == "broken":
                    raise ValueError("CSS breaks off in image-set()")
                at = n.end()
                if n.lastgroup == "paren":
                    open_ += 1 if n["paren"] == "(" else -1
                else:
                    yield _css_value(n, n.lastgroup, "css-image-set", "image")
        if kind != "skip":
            importing = False


_JS = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\(?:\r\n|.)|[^"\\\n\r])*"|'(?:\\(?:\r\n|.)|[^'\\\n\r])*')|(?P<template>`(?:\\.|[^\\`])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<broken>/\*|["'`])|(?P<mark>.)""", re.S | re.A)
_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n\r])*\]|[^/\\\[\n\r])*/[A-Za-z]*", re.S)
_BEFORE_REGEX = {"return", "throw", "case", "delete", "void", "typeof", "instanceof", "in", "of", "new", "yield", "await", "else", "do"}
_JS_ESCAPE = re.compile(r"\\(?:u\{([0-9a-f]+)\}|u([0-9a-f]{4})|x([0-9a-f]{2})|(\r\n|[\n\r])|(.))", re.I | re.S)
_JS_SIMPLE = {"0": "\0", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}
_JS_TARGET = re.compile(r"(?:\.\.?/|/|https?:|data:|blob:)", re.I)
_ASSET = re.compile(r"\.(avif|gif|ico|jpe?g|json|mp4|otf|png|svg|ttf|webm|webp|woff2?)(?:[?#]|$)", re.I)
_ASSET_ROLES = {**dict.fromkeys(("avif", "gif", "ico", "jpg", "jpeg", "png", "svg", "webp"), "image"), **dict.fromkeys(("mp4", "webm"), "media"), **dict.fromkeys(("otf", "ttf", "woff", "woff2"), "font")}


def _js_text(body: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16))
        if m[4]:
            return ""
        return _JS_SIMPLE.get(m[5], m[5] if m[5] in "'\"\\" else m[0])

    return _JS_ESCAPE.sub(one, body)


def _js_tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) without spaces and comments; strings decoded, their span inside the quotes."""
    tokens, at, regex_may = [], 0, True
    while at < len(text):
        m = _JS.match(text, at)
        kind = m.lastgroup
        if kind == "mark" and m[0] == "/" and regex_may and (r := _JS_REGEX.match(text, at)):
            tokens.append(("regex", "", at, r.end()))
            at, regex_may = r.end(), False
            continue
        at = m.end()
        if kind == "space":
            continue
        if kind == "broken":
            raise ValueError(f"JavaScript breaks off in {m[0]!r}")
        if kind == "string":
            tokens.append(("string", _js_text(m[0][1:-1]), m.start() + 1, m.end() - 1))
        else:
            tokens.append((kind, m[0], m.start(), m.end()))
        regex_may = m[0] in _BEFORE_REGEX if kind == "name" else kind == "mark" and m[0] in "({[,:;=!?&|+-*%^~<>"
    return tokens


def js_references(text: str) -> Iterator[Reference]:
    """Static and dynamic imports, re-exports, .src = and setAttribute("src", ...), and absolute URLs of static files in strings."""
    tokens = _js_tokens(text)
    value = lambda i: tokens[i][1] if 0 <= i < len(tokens) else None
    kind = lambda i: tokens[i][0] if 0 <= i < len(tokens) else None
    used = set()

    def take(i: int, syntax: str, role: str = "module", policy: str = "") -> Iterator[Reference]:
        _, raw, start, end = tokens[i]
        if _JS_TARGET.match(raw):
            used.add(i)
            yield _made(syntax, role, raw, start, end, text[start - 1], policy)

    for i, (k, name, _, _) in enumerate(tokens):
        if k != "name":
            continue
        if name == "src" and kind(i - 1) == "mark" and value(i - 1) == "." and value(i + 1) == "=" and kind(i + 2) == "string" and (i + 3 >= len(tokens) or value(i + 3) in (";", ")", "]", "}")):
            yield from take(i + 2, "javascript-src-assignment", "script")
        elif name == "setAttribute" and value(i + 1) == "(" and kind(i + 2) == "string" and value(i + 2).lower() == "src" and value(i + 3) == "," and kind(i + 4) == "string" and value(i + 5) == ")":
            yield from take(i + 4, "javascript-setattribute-src", "script")
        elif name in ("import", "export"):
            following = value(i + 1) if kind(i + 1) != "string" else None
            if name == "import" and following == ".":
                continue
            if name == "import" and following == "(":
                if kind(i + 2) == "string" and value(i + 3) in (")", ","):
                    yield from take(i + 2, "javascript-dynamic-import")
                continue
            if name == "import" and kind(i + 1) == "string":
                yield from take(i + 1, "javascript-import")
                continue
            for j in range(i + 1, min(i + 40, len(tokens))):
                if tokens[j][:2] == ("mark", ";"):
                    break
                if tokens[j][:2] == ("name", "from") and kind(j + 1) == "string":
                    yield from take(j + 1, f"javascript-{name}-from")
                    break
    for i, (k, raw, start, end) in enumerate(tokens):
        if k == "string" and i not in used and re.match("https?:", raw, re.I) and (m := _ASSET.search(raw)):
            yield _made("javascript-static-asset-url", _ASSET_ROLES.get(m[1].lower(), "resource"), raw, start, end, text[start - 1], "localize-if-captured")


_CANDIDATE = re.compile(r"[\s,]*(?P<url>data:\S+|[^\s,]+)[^,]*,?", re.I)


def srcset_references(text: str) -> Iterator[Reference]:
    """Candidates of a srcset; commas of data URLs are theirs."""
    at = 0
    while (m := _CANDIDATE.match(text, at)) and m.end() > at:
        yield _made("html-srcset-candidate", "image", m["url"], *m.span("url"))
        at = m.end()


_TAG = re.compile(r"<!--(?P<comment>.*?-->)?|</\s*(?P<close>[\w:-]*)[^>]*>?|<[!?][^>]*>?|<(?P<name>[A-Za-z][\w:-]*)", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(?P<end>/?>)|(?P<name>[^\s=/>]+)\s*(?:=\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<open>["'])|(?P<plain>[^\s>]*)))?|=)""", re.S)
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|amp|quot|apos|lt|gt);", re.I)


def _html_text(value: str) -> str:
    return _ENTITY.sub(lambda m: entities.unescape(m[0].lower()), value)


def _role(tag: str, attribute: str, rel: str) -> str:
    if attribute in ("action", "formaction") or tag in ("a", "area"):
        return "navigation"
    if tag == "script":
        return "script"
    if tag in ("iframe", "frame"):
        return "frame"
    if tag == "link":
        for pattern, role in ((r"\bstylesheet\b", "stylesheet"), (r"\bmodulepreload\b", "module"), (r"\b(?:icon|preload|manifest)\b", "resource")):
            if re.search(pattern, rel, re.A):
                return role
        return "navigation"
    if tag in ("img", "image", "source", "input") or "background" in attribute:
        return "image"
    if tag in ("video", "audio", "track") or attribute == "poster":
        return "media"
    return "object" if tag in ("object", "embed") else "resource"


def html_references(text: str, *, svg: bool = False) -> Iterator[Reference]:
    """References of tags, inline styles and scripts; svg: the whole text is SVG."""
    at, depth = 0, int(svg)
    lower = text.lower()
    while m := _TAG.search(text, at):
        at = m.end()
        if m[0].startswith("<!--"):
            if m["comment"] is None:
                raise ValueError("HTML breaks off in a comment")
            continue
        if m["name"] is None:
            depth = max(0, depth - 1) if (m["close"] or "").lower() == "svg" else depth
            continue
        tag = m["name"].lower()
        attributes: dict[str, tuple[str, int, int, str]] = {}
        while True:
            a = _ATTRIBUTE.match(text, at)
            if not a or a["open"]:
                raise ValueError("HTML breaks off in a tag")
            at = a.end()
            if a["end"]:
                break
            if a["name"]:
                group = next((g for g in ("double", "single", "plain") if a[g] is not None), None)
                span = a.span(group) if group else (at, at)
                attributes[a["name"].lower()] = (_html_text(a[group]) if group else "", *span, {"double": '"', "single": "'"}.get(group, ""))
        in_svg = bool(depth) or svg or tag in SVG_ELEMENTS
        depth += tag == "svg"
        rel = attributes.get("rel", ("",))[0].lower()
        for name, (value, start, end, quote) in attributes.items():
            named = {"tag": tag, "attribute": name}
            if name in SRCSET_ATTRIBUTES:
                yield from (r.shifted(start, **named) for r in srcset_references(value))
            elif name == "style" or (in_svg and name in SVG_PAINT_ATTRIBUTES):
                syntax = "html-style-attribute" if name == "style" else f"svg-{name}"
                yield from (r.shifted(start, syntax=syntax, **named) for r in css_references(value))
            elif (in_svg and name in SVG_URL_ATTRIBUTES) or name in URL_ATTRIBUTES or name in LAZY_ATTRIBUTES:
                syntax = f"svg-{name}" if in_svg and name in SVG_URL_ATTRIBUTES else "html-lazy-attribute" if name in LAZY_ATTRIBUTES else "html-url-attribute"
                yield _made(syntax, _role(tag, name, rel), value, start, end, quote)._replace(**named)
        if tag in ("style", "script"):
            close = lower.find(f"</{tag}", at)
            if close >= 0:
                kind = attributes.get("type", ("",))[0].lower()
                inner = text[at:close]
                if tag == "style":
                    yield from (r.shifted(at, syntax=f"html-{r.syntax}", tag="style") for r in css_references(inner))
                elif not kind or kind == "module" or re.search("(?:java|ecma)script", kind):
                    yield from (r.shifted(at, syntax=f"html-{r.syntax}", tag="script") for r in js_references(inner))
                at = close


READERS = {"html": html_references, "css": css_references, "javascript": js_references, "srcset": srcset_references, "svg": lambda text: html_references(text, svg=True)}


def blocked_value(role: str) -> str:
    """What stands in for a reference that leads nowhere."""
    if role in ("stylesheet", "css-import"):
        return "data:text/css,"
    if role in ("script", "module"):
        return "data:text/javascript,export%20{}"
    return "about:blank" if role == "frame" else "data:,"


# Pages that stand on their own ---------------------------------------------------------------------------------------

_INNER = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_ELEMENT = re.compile(rf"<!--.*?-->|<script\b(?P<script>{_INNER})>(?P<code>.*?)</script\s*>|<(?P<tag>meta|base|link|iframe|img|source|video|audio|track|object|embed|input|[a-z][a-z0-9-]*)\b(?P<inner>{_INNER})>", re.S | re.I)
_NAMED = re.compile(r"\s+([a-z][a-z0-9:-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_SET_SOURCE = re.compile(r"(?:\.src\s*=|setAttribute\(\s*['\"]src['\"]\s*,)\s*['\"]([^'\"]+)['\"]", re.I)
_MAP_COMMENT = re.compile(r"//[#@]\s*sourceMappingURL=[^\r\n]*|/\*[#@]\s*sourceMappingURL=[^*]*\*/", re.I)
_AWAY = re.compile(r"https?:", re.I)
# Elements whose sources are taken away if they lead elsewhere, the attributes that hold them, and links that are.
_MEDIA = {"img", "source", "video", "audio", "track", "object", "embed", "input", "iframe"}
_MEDIA_ATTRIBUTES = ("src", "data-src", "data", "poster")
_LINKS = re.compile(r"\b(?:stylesheet|modulepreload|preload|manifest|icon)\b")


def _attributes(inner: str) -> dict[str, str]:
    return {m[1].lower(): m[2].strip("\"'") for m in _NAMED.finditer(inner)}


def _without(inner: str, names: tuple[str, ...]) -> str:
    return _NAMED.sub(lambda m: "" if m[1].lower() in names else m[0], inner)


def standalone_page(text: str) -> str:
    """A page without what would reach out: integrity, policy meta tags, base, scripts and linked resources of other hosts, sources of foreign media and frames;
    scripts that are there twice, or that an inline script loads, go too, and so do comments that name source maps."""
    loaded = {url for m in _ELEMENT.finditer(text) if m["code"] is not None and "src" not in _attributes(m["script"]) for url in _SET_SOURCE.findall(m["code"])}
    seen: set[str] = set()

    def one(m: re.Match) -> str:
        if m["code"] is not None:
            own = _attributes(m["script"])
            source = own.get("src", "")
            if "src" not in own:
                return f"<script{_without(m['script'], ('integrity',))}>{_MAP_COMMENT.sub('', m['code'])}</script>" if "integrity" in own or _MAP_COMMENT.search(m["code"]) else m[0]
            if _AWAY.match(source) or source in seen or source in loaded:
                return ""
            seen.add(source)
            return m[0].replace(m["script"], _without(m["script"], ("integrity",)), 1) if "integrity" in own else m[0]
        if m["tag"] is None:
            return m[0]
        tag, own = m["tag"].lower(), _attributes(m["inner"])
        if tag == "base" or (tag == "meta" and own.get("http-equiv", "").lower() == "content-security-policy"):
            return ""
        if tag == "link" and _AWAY.match(own.get("href", "")) and _LINKS.search(own.get("rel", "").lower()):
            return ""
        away = tuple(a for a in (("src",) if tag == "iframe" else _MEDIA_ATTRIBUTES) if tag in _MEDIA and _AWAY.match(own.get(a, "")))
        gone = away + (("integrity",) if "integrity" in own else ())
        return f"<{m['tag']}{_without(m['inner'], gone)}>" if gone else m[0]

    return _ELEMENT.sub(one, text)
