from fixtures import CLASHING
from pyspark.sql import functions as F

from segmenta.llm import pages


def page(body, ad="Buy now", extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
            f"<div class=\"ad\">{ad}</div>{extra}<article>{body}</article><section id='comments'><p>First!</p></section><footer>&copy; me</footer></body></html>")


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return [r.text for r in pages.main_text(df).orderBy("page_id").collect()]


def test_articles(spark):
    got = run(spark, [("http://h.example/1", page("<h1>One &amp; two</h1><p>First   block\nhere.<p><b>Second<br>&eacute;nd</b> x</p>")),
                      ("http://h.example/2", page("<p>Other</p><ul><li>a<li>b</ul>", "Else")), ("https://h.example:80/3", page("<p>Third</p>tail <i>text</i>", "More")),
                      ("http://h.example/4", page("", "No"))])
    assert got == ["One & two\nFirst block here.\nSecond énd x", "Other\na\nb", "Third\ntail text", ""]


def test_constant_nodes_are_template(spark):
    """A box inside the article that says the same on all pages of a host, and varies on none, is no content."""
    rows = [(f"http://k.example/{i}", page(f"<div class='box'>Read our terms</div><p>Text number {i}</p>")) for i in range(4)]
    assert run(spark, rows) == [f"Text number {i}" for i in range(4)]
    # one page many times proves nothing
    assert run(spark, [rows[0]] * 4) == ["Read our terms\nText number 0"] * 4


def test_pages_without_articles(spark):
    rows = [("http://n.example/a", "<body><div id='menu'>m</div><div><p>Only text</p></div><form>f<input></form></body>"), (None, "plain words only"), (None, None), ("", ""),
            ("x", "<p>open <b>markup"), ("x", "before<!-- open comment <p>hidden"), ("x", "<script>never closed <p>hidden"), ("x", "a < b and c > d"),
            ("http://deep.example", "<div>" * 3000 + "deep" + "</div>" * 3000), ("http://long.example", "<p>" + "word " * 200_000 + "</p>")]
    got = run(spark, rows)
    assert got[:9] == ["Only text", "plain words only", "", "", "open markup", "before", "", "a < b and c > d", "deep"] and len(got[9]) == 999_999


def test_matching():
    def tree(label, *children):
        n = pages.Node(label)
        n.children = list(children)
        return n

    a = tree("", tree("a", tree("b"), tree("c")), tree("d"))
    b = tree("", tree("x"), tree("a", tree("c"), tree("b")), tree("d", tree("e")))
    score, pairs = pages.simple_tree_matching(a, b)
    assert score == 4 and len(pairs) == 4 and all(x.label == y.label for x, y in pairs)
    text = pages.numbered(b)
    assert [n.label for n in pages.read_skeleton(text)] == ["", "x", "a", "c", "b", "d", "e"] and pages.simple_tree_matching(tree("p"), tree("q"))[0] == 0


def test_wrapper_of_two_shapes(spark):
    """Shapes of one host share a wrapper: what is constant over both is template in both."""
    box = "<div class='note'>House rules</div>"
    rows = [(f"http://w.example/{i}", page(f"{box}<p>Text {i}</p>" + ("<h2>Sub</h2><div class='fig'>Figure %d</div>" % i if i % 2 else ""))) for i in range(6)]
    got = run(spark, rows)
    assert got == [f"Text {i}" + (f"\nSub\nFigure {i}" if i % 2 else "") for i in range(6)] or got == [f"Text {i}" + (f"\nFigure {i}" if i % 2 else "") for i in range(6)]


def test_flow_elements(spark):
    """Paragraphs, lists and cells go by their class, and by what all pages say, inside and outside an article."""
    def body(i):
        return (f"<p class='advert'>Buy {i}</p><p>Read our terms</p><p class='intro'>Intro {i}</p><ul class='menu'><li>M {i}</li></ul><ul><li>Item {i}</li><li>Same item</li>"
                f"<li class='share'>Share {i}</li></ul><h2 id='related-work'>Head {i}</h2><table><tr><td class='sidebar'>S {i}</td><td>Cell {i}</td><td>Same cell</td></tr></table>"
                f"<p id='notice'>N {i}</p><p>Text {i}</p>")

    want = [f"Intro {i}\nItem {i}\nHead {i}\nCell {i}\nText {i}" for i in range(4)]
    assert run(spark, [(f"http://f.example/{i}", f"<body><article>{body(i)}</article></body>") for i in range(4)]) == want
    assert run(spark, [(f"http://g.example/{i}", f"<body>{body(i)}</body>") for i in range(4)]) == want


def test_many_structures(spark, monkeypatch):
    """The wrappers of a host with many page structures act as one."""
    def extra(i):
        return "".join(f"<div class='{c}'>{c} {i}</div>" for k, c in enumerate(("one", "two", "three", "four")) if i >> k & 1)

    # the slot says the same on all pages of a structure; the box says the same on all pages, on one of each structure
    rows = [(f"http://m.example/{i}", page(f"<div class='box'>Read our terms</div><div class='slot'>Slot {i % 2}</div>{extra(i)}<p>Text {i}</p>")) for i in range(16)]
    rows += [(f"http://m.example/{i}/{j}", page(f"<div class='box'>Read our terms</div><div class='slot'>Slot 0</div><div class='last'>L {j}</div><p>More {j}</p>")) for i, j in ((0, 1), (0, 2), (0, 3))]
    want = run(spark, rows)
    assert all("Read our terms" not in t and "Slot" in t for t in want)
    monkeypatch.setattr(pages, "VARIANTS", 2)
    assert run(spark, rows) == want


def test_no_pages(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens_name_things_as_a_whole(spark):
    """Layouts named after a sidebar keep the article, headers of the article are its own, adverts are none."""
    def wrapped(before, after=""):
        return lambda i: f"<body>{before}<article><h1>Title {i}</h1><p>Text {i}</p></article>{after}</body>"

    whole = "Title {i}\nText {i}"
    cases = {
        "body": (lambda i: f"<body class='single right-sidebar'><article><p>Text {i}</p></article></body>", "Text {i}"),
        "wrap": (wrapped("<div class='content-sidebar-wrap'>", "</div>"), whole), "layout": (wrapped("<div class='right-sidebar'>", "</div>"), whole),
        "form": (wrapped("<form id='aspnet'>", "</form>"), whole),
        "header": (lambda i: f"<body><article><div class='article-header'><h1>Title {i}</h1></div><div class='header'><p>By {i}</p></div><p>Text {i}</p></article></body>",
                   "Title {i}\nBy {i}\nText {i}"),
        "price": (lambda i: f"<body><article><p class='share-price'>Price {i}</p><p>Text {i}</p></article></body>", "Price {i}\nText {i}"),
        "advert": (lambda i: f"<body><article class='advert sponsored'><p>Buy {i}</p></article><article class='post has-sidebar'><p>Text {i}</p></article></body>", "Text {i}"),
        "teasers": (lambda i: f"<body><article><p>Text {i}</p></article><div class='sidebar-left'><article><p>Teaser {i}</p></article></div></body>", "Text {i}"),
        "tails": (lambda i: f"<body><article><p>Text {i}</p><div class='comments-area'><p>C {i}</p></div><div id='ad-slot-2'>A {i}</div><div class='post-comments'>D {i}</div>"
                            f"<div class='social-share'>S {i}</div></article><div class='site-footer'>F {i}</div></body>", "Text {i}"),
    }
    rows = [(f"http://{name}.example/{i}", make(i)) for name, (make, _) in cases.items() for i in range(4)]
    want = [text.format(i=i) for _, text in cases.values() for i in range(4)]
    assert run(spark, rows) == want


def plain_reading(html):
    """Article paragraphs that no cut element holds, by a parser of its own."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, dict(attrs).get("class", "")))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            cut = any(c in CUT for t, c in self.stack if t != "body")
            if data.strip() and "article" in tags and not cut and not set(tags) & {"aside", "nav", "footer"}:
                self.out.append(data.strip())

    reader = Reader()
    reader.feed(html)
    return "\n".join(reader.out)


CUT = ("advert", "top-menu", "comments-list", "cookie-notice", "related")
KEPT = ("intro", "share-price", "has-sidebar", "story", "box-1", "article-header")


def test_generated_pages(spark):
    import random

    def some(rng, depth, i):
        kind = rng.choice(["div", "section", "p", "aside"] if depth else ["p"])
        name = rng.choice(KEPT + CUT)
        inner = f"T {i} {rng.randrange(10 ** 9)}" if kind == "p" else "".join(some(rng, depth - 1, i) for _ in range(rng.randrange(1, 4)))
        return f"<{kind} class='{name}'>{inner}</{kind}>"

    rng, rows = random.Random(12), []
    for i in range(60):
        parts = ["".join(some(rng, 2, i) for _ in range(3)) for _ in range(3)]
        rows.append((f"http://r{i % 7}.example/{i}", f"<html><body class='{rng.choice(['left-sidebar', 'home'])}'><nav>N {i}</nav>{parts[0]}"
                     f"<article class='{rng.choice(KEPT[:5])}'>{parts[1]}</article>{parts[2]}</body></html>"))
    assert run(spark, rows) == [plain_reading(h) for _, h in rows]
