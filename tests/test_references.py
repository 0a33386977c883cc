"""Discovery, resolution and rewriting of references on texts of our own."""

from __future__ import annotations

import pytest

from weftline.functions import markup, whatwg
from weftline.operators import references


def found(reader, text):
    return [(r.syntax, r.role, r.raw) for r in reader(text)]


def test_css():
    sheet = '@import "a.css"; @import url(b.css) screen; .x{background:url( "c.png" )} @font-face{src:url(f.woff2)} .y{background:-webkit-image-set("d.png" 1x, url(e.png) 2x)} /* url(no) */ .z{content:"url(no)"}'
    assert found(markup.css_references, sheet) == [
        ("css-import", "css-import", "a.css"), ("css-import", "css-import", "b.css"), ("css-url", "image", "c.png"), ("css-url", "font", "f.woff2"), ("css-image-set", "image", "d.png"), ("css-image-set", "image", "e.png"),
    ]


@pytest.mark.parametrize("sheet", ["/* open", "a{b:url(x", "a{b:'x", "a{b:image-set(url(x) 1x"])
def test_css_that_breaks_off(sheet):
    with pytest.raises(ValueError, match="breaks off"):
        list(markup.css_references(sheet))


def test_css_escapes_and_offsets():
    text = r".a{b:url(  q\20 r.png  )}"
    (r,) = markup.css_references(text)
    assert r.raw == "q r.png"
    assert text[r.start : r.end] == r"q\20 r.png"


def test_javascript():
    code = "import a from './a.js'; import('/b.js'); export * from \"../c.js\"; x.src='/d.js'; e.setAttribute('src','/e.js'); var s='plain', r=/['\"]/g; `import('/no')`; import.meta.url; // import 'no'\nvar u='https://h/i.png'"
    assert found(markup.js_references, code) == [
        ("javascript-import-from", "module", "./a.js"), ("javascript-dynamic-import", "module", "/b.js"), ("javascript-export-from", "module", "../c.js"), ("javascript-src-assignment", "script", "/d.js"),
        ("javascript-setattribute-src", "script", "/e.js"), ("javascript-static-asset-url", "image", "https://h/i.png"),
    ]


def test_srcset_keeps_commas_of_data_urls():
    assert [r.raw for r in markup.srcset_references(" a.png 1x, data:image/png;base64,AA== 2x,b.png")] == ["a.png", "data:image/png;base64,AA==", "b.png"]
    assert list(markup.srcset_references("")) == []


def test_html():
    page = '<!-- <a href="no"> --><a href="/x?a=1&amp;b=2">t</a><IMG src=i.png data-src=\'l.png\'><style>b{background:url(bg.png)}</style><script src="s.js"></script><script type="text/plain">import("/no")</script><link rel="Stylesheet" href="c.css"><iframe src="f.html"></iframe>'
    rows = found(markup.html_references, page)
    assert ("html-url-attribute", "image", "i.png") in rows
    assert ("html-lazy-attribute", "image", "l.png") in rows
    assert ("html-css-url", "image", "bg.png") in rows
    assert ("html-url-attribute", "stylesheet", "c.css") in rows
    assert ("html-url-attribute", "frame", "f.html") in rows
    assert [r.raw for r in markup.html_references(page) if r.role == "navigation"] == ["/x?a=1&b=2"]
    assert not any("no" in raw for _, _, raw in rows)


def test_svg():
    assert found(markup.READERS["svg"], '<use xlink:href="#g"/><rect fill="url(p.svg#a)"/>') == [("svg-xlink:href", "resource", "#g"), ("svg-fill", "image", "p.svg#a")]


@pytest.mark.parametrize(("value", "base", "want"), [
    ("HTTPS://A.Test:443/x/../y z?q#f", None, "https://a.test/y%20z?q#f"), ("../b", "https://h.test/a/c/d", "https://h.test/a/b"), ("?x", "https://h.test/a", "https://h.test/a?x"), ("//o.test/p", "http://h.test/", "http://o.test/p"), ("data:text/css,", None, "data:text/css,"),
])
def test_urls(value, base, want):
    assert whatwg.parsed(value, base) == want


def test_url_without_base():
    with pytest.raises(ValueError, match="not a URL"):
        whatwg.parsed("/x")


def test_rewriting(spark):
    page = '<link rel="stylesheet" href="/gone.css"><img src="/i.png#x"><a href="/p">p</a><script src="https://h.test/s.js"></script><img src="data:,"><img src="">'
    texts = spark.createDataFrame([("1", "https://h.test/", page), ("2", "https://h.test/", "no references"), ("3", "https://h.test/", '<a href="')], "owner string, base_url string, text string")
    seen = references.discover(texts, "html")
    assert seen.where("n = -1").select("owner").collect() == [("3",)]
    resolved = references.resolve(seen, spark.createDataFrame([("https://h.test/i.png", "assets/i.png")], "url string, local_path string"))
    text = {r["owner"]: r["text"] for r in references.rewrite(texts, resolved).collect()}
    assert text["1"] == '<link rel="stylesheet" href="data:text/css,"><img src="/assets/i.png#x"><a href="/p">p</a><script src="data:text/javascript,export%20{}"></script><img src="data:,"><img src="">'
    assert text["2"] == "no references"
    codes = {(r["code"], r["severity"]) for r in references.diagnostics(resolved).collect()}
    assert codes == {("unresolved-executable", "error"), ("empty-url", "warning")}


def test_page_cleaning(spark):
    from pyspark.sql import functions as F

    page = '<html><HEAD lang="x"><base href="/b"><meta http-equiv="Content-Security-Policy" content="x"><script src="https://o.test/a.js">x</script><script src="/b.js" integrity="sha-1"></script></head>'
    row = spark.createDataFrame([(page,), ("<p>",)], "t string").select(references.with_bootstrap(references.without_foreign(F.col("t")), "<B>").alias("t")).collect()
    assert row[0]["t"] == '<html><HEAD lang="x"><B><script src="/b.js"></script></head>'
    assert row[1]["t"] == "<B><p>"


@pytest.mark.parametrize(("page", "want"), [
    ('<script src="https://o.test/a.js"></script><script src="/b.js" integrity="x"></script><script src=/b.js></script>', '<script src="/b.js"></script>'),
    ('<link rel="icon" href="https://o.test/i"><link rel=canonical href="https://o.test/"><link rel="stylesheet" href="/s.css">', '<link rel=canonical href="https://o.test/"><link rel="stylesheet" href="/s.css">'),
    ('<iframe src="https://o.test/" title="t"></iframe><img src="http://o.test/i.png" alt="a"><video poster="/p.png" src=https://o.test/v>', '<iframe title="t"></iframe><img alt="a"><video poster="/p.png">'),
    ('<script>x.src = "/c.js"; //# sourceMappingURL=x.map\n</script><script src="/c.js"></script><a href="https://o.test/">o</a>', '<script>x.src = "/c.js"; \n</script><a href="https://o.test/">o</a>'),
    ('<!-- <base href="/"> --><BASE href="/"><meta http-equiv=Content-Security-Policy content="x"><meta charset="utf-8">', '<!-- <base href="/"> --><meta charset="utf-8">'),
])
def test_pages_that_stand_on_their_own(page, want):
    assert markup.standalone_page(page) == want


def test_a_broken_resource_is_left_alone_and_reported(spark):
    rows = [
        ("1", "https://h.test/a.css", "text/css", "a{b:url(/i.png)} /* open", False), ("2", "https://h.test/b.css", "text/css", "a{b:url(/i.png)} /*# sourceMappingURL=b.map */", False), ("3", "https://h.test/p", "text/html", '<head></head><img src="/i.png">', True),
        ("4", "https://h.test/x.gltf", "", '{"a":[{"uri":"i.png"}]}', False), ("5", "https://h.test/y.gltf", "", "no json", False), ("6", "https://h.test/t", "text/plain", "url(/i.png)", False),
    ]
    known = spark.createDataFrame([("https://h.test/i.png", "old.png", 1), ("https://h.test/i.png", "new.png", 2)], "url string, local_path string, position int")
    out, wrong = references.rewrite_resources(spark.createDataFrame(rows, "owner string, url string, mime_type string, text string, route_page boolean"), known, "<B>")
    got = {r["owner"]: (r["text"], r["artifact_hash"] is not None) for r in out.collect()}
    assert got == {"1": (rows[0][3], False), "2": ("a{b:url(/new.png)} ", True), "3": ('<head><B></head><img src="/new.png">', True), "4": ('{"a":[{"uri":"/new.png"}]}', True), "5": ("no json", True), "6": ("url(/i.png)", False)}
    assert [(r["owner"], r["code"], r["severity"]) for r in wrong.collect()] == [("1", "resource-parser-rewrite-failed", "warning")]
