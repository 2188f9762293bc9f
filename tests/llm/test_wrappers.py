import html
import re

from tapeworks.llm import wrappers as W


def simple(page):
    """The pages of the test tables have one article of h1 and p elements."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not m:
        return ""
    parts = re.split(r"</?(?:h1|p)>", m[1])
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = W.op8_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == simple(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)


PAGE = """<!doctype html><html><head><title>x</title><script>if (a<b) "</p>";</script><style>p{{}}</style></head><body>
<header>Site</header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp;  line</h1></header><p>First <b>bold</b>,&nbsp;then<br>more &lt;i&gt; &#233; &euro;<p>Second
 line<!-- no --><aside>Side</aside><ul><li>item 1<li>item 2</ul><form><p>Name <input></form><section id="comments"><p>Me too</section><p>{}</article>
<div class="ad">Buy</div><footer>&copy; us</footer></body></html>"""


def test_article():
    text = W.extract(PAGE.format("Last &am 3 < 4"), [])
    assert text == "Head & line\nFirst bold, then more <i> é €\nSecond line\nitem 1\nitem 2\nLast &am 3 < 4"


def test_broken_and_empty():
    assert W.extract(None, []) == "" and W.extract("", []) == ""
    assert W.extract("plain words", []) == "plain words"
    assert W.extract("<p>a<p>b<div", []) == "a\nb"
    assert W.extract("<p>a</b></div></p>b <span>c", []) == "a\nb c"
    assert W.extract("<script>x", []) == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert W.extract(deep, []) == "deep"


def wrapped(body, extra=""):
    return f"<body><div><p>Welcome to the site</p></div><div><h2>{body}</h2><p>About {body}</p>{extra}</div><div><p>All rights reserved</p></div></body>"


def test_template_without_article(spark):
    pages = [(k, f"http://H.example/{k}", wrapped(f"story {k}", "<p>more</p>" * (k % 3))) for k in range(9)]
    pages += [(20, "http://alone.example/", wrapped("alone")), (21, None, wrapped("nowhere")), (22, "http://h.example/x", None), (22, "http://h.example/x", pages[0][2])]
    docs = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, text string")
    out = {}
    for r in W.main_text(docs).collect():
        out.setdefault(r.page_id, []).append(r.text)
    for k in range(9):
        assert out[k][0].split("\n")[:2] == [f"story {k}", f"About story {k}"] and "Welcome" not in out[k][0] and "rights" not in out[k][0]
    assert out[20] == ["Welcome to the site\nalone\nAbout alone\nAll rights reserved"]
    assert sorted(out[22], key=len)[0] == "" and len(out[22]) == 2
    assert W.main_text(docs.limit(0)).count() == 0


def test_matching():
    a = ["b", 0, [["p", 1, []], ["div", 0, [["p", 2, []], ["p", 3, []]]], ["p", 4, []]]]
    b = ["b", 0, [["div", 0, [["p", 9, []], ["p", 3, []]]], ["p", 4, []]]]
    assert W.match(a, b) == {4, 5}
    assert W.match(a, ["x", 0, []]) == set()


def texts(spark, pages):
    return {r.page_id: r.text for r in W.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_votes_inside_articles(spark):
    page = lambda k: f"<body><article><h1>Story {k}</h1><p>{f'Body {k} of many own words. ' * 4}</p><div><p>Read our terms of use</p></div></article></body>"
    pages = [(k, f"http://a.example/{k}", page(k)) for k in range(5)] + [(k, f"http://a.example/{k}", page(0)) for k in range(5, 9)]
    pages += [(20 + k, f"http://copies.example/{k}", page(77)) for k in range(6)]
    out = texts(spark, pages)
    for k in range(9):
        own = k if k < 5 else 0
        assert out[k] == f"Story {own}\n" + (f"Body {own} of many own words. " * 4).strip()
    assert all(out[20 + k].endswith("Read our terms of use") and "Body 77" in out[20 + k] for k in range(6))


def test_minority_layout_and_copies(spark):
    other = lambda k: f"<body><table><tr><td>Our own shop</td></tr><tr><td><p>Thing {k}</p></td></tr></table></body>"
    pages = [(k, f"http://b.example/{k}", wrapped(f"story {k}")) for k in range(40)]
    pages += [(100 + k, f"http://b.example/t{k}", other(k)) for k in range(5)]
    pages += [(200 + k, f"http://b.example/c{k}", wrapped("story 0")) for k in range(30)]
    pages += [(300, "http://b.example/n", wrapped("story 0", "<p>one more line</p>"))]
    out = texts(spark, pages)
    assert all(out[100 + k] == f"Thing {k}" for k in range(5))
    assert all(out[200 + k] == out[0] == "story 0\nAbout story 0" for k in range(30))
    assert out[300] == "story 0\nAbout story 0\none more line"


def test_deep_pages(spark):
    deep = lambda k: "<div>" * 3000 + f"<p>Hello</p><p>deep {k}</p>" + "</div>" * 3000
    assert texts(spark, [(k, f"http://d.example/{k}", deep(k)) for k in range(3)]) == {k: f"deep {k}" for k in range(3)}
