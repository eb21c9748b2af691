import json

import pytest

from belegwerk.llm import wrappers


def page(title, paragraphs, extra="", tail="</body></html>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>"
        f"<header class=top><a href=/>Site</a></header><nav><ul><li>One</li><li>Two</li></ul></nav><div class='ad'>Buy</div>"
        f"<article><h1>{title}</h1>{body}{extra}</article><div id=comments><p>Reader says</p></div><aside>More</aside>"
        f"<form><p>Name</p></form><footer>&copy; Site</footer>{tail}"
    )


def test_article_of_pages(spark, ws):
    rows, want = [], {}
    for i in range(30):
        texts = [f"Text {i} &amp; more\n <b>bold</b>,  {k}" for k in range(i % 4)]
        extra = "<ul><li>a<li>b</ul>" * (i % 2) + "<div class='share'>Share</div><div class=tip>Read on &gt;</div>"
        rows.append((i, f"https://h{i % 2}.example/x/{i}", page(f"Title {i}", texts, extra, "" if i % 5 == 0 else "</body></html>")))
        blocks = [f"Title {i}", *[f"Text {i} & more bold, {k}" for k in range(i % 4)], *(["a", "b"] if i % 2 else [])]
        want[i] = "\n\n".join(blocks)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in wrappers.main_texts(ws, frame).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id][1] for r in got.values())


def tree(html):
    return wrappers.wrapper_of(wrappers.parse(html))


def test_merging_finds_slots_groups_and_options():
    a = tree("<div><h1>A</h1><p>x</p></div>")
    wrappers.merge(a, tree("<div><h1>B</h1><p>y</p><p>z</p><table><tr><td>1</td></tr></table></div>"))
    (div,) = a[4]
    kinds = [(c[0], c[2]) for c in div[4]]
    assert kinds == [("h1", 0), ("p", wrappers.REPEATED), ("table", wrappers.OPTIONAL)]
    assert div[4][0][4][0][3] is None  # the title is a slot
    same = tree("<div><h1>A</h1></div>")
    wrappers.merge(same, tree("<div><h1>A</h1></div>"))
    assert same[4][0][4][0][4][0][3] == "A"


def test_merging_order_does_not_change_the_kinds():
    pages = ["<div><p>a</p></div>", "<div><h2>t</h2><p>b</p></div>", "<div><p>c</p><p>d</p><ul><li>x</ul></div>"]

    def shape(node):
        return (node[0], node[2], tuple(shape(c) for c in node[4] if c[0] != "#"))

    shapes = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        w = tree(pages[order[0]])
        for i in order[1:]:
            wrappers.merge(w, tree(pages[i]))
        shapes.add(shape(w))
    assert len(shapes) == 1


def test_pages_without_article():
    w = tree("<body><div class=menu>m</div><div class=content><p>x</p></div><div>y</div></body>")
    assert wrappers.extract("<body><div class=menu>m</div><div class=content><p>x<br>z</p></div><div>y</div></body>", w) == "x z"
    assert wrappers.extract("plain &lt; text", tree("plain &lt; text")) == "plain < text"
    assert wrappers.extract("<p>a<p>b", tree("<p>a<p>b")) == "a\n\nb"
    assert wrappers.extract(None, tree(None)) == ""


def test_odd_rows(spark, ws):
    long = page("Long", [f"part {i}" for i in range(5000)])
    rows = [(1, None, None), (1, None, None), (2, "no url", "<article>"), (None, "http://a.example/", page("T", ["x"])), (4, "http://a.example:80/", ""), (5, "HTTP://A.example", long), (6, "http://b.example", "< <b <> </ p> &#0; <!-- open")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, part int, host_key string")
    got = wrappers.main_texts(ws, frame)
    assert got.count() == len(rows) and got.where("text is null").count() == 0
    assert wrappers.main_texts(ws, frame.limit(0)).count() == 0
    assert len(got.where("page_id = 5").first().text.split("\n\n")) == 5001


def test_a_host_with_two_templates_keeps_both(spark, ws):
    rows, want = [], {}
    for i in range(24):
        kind = i % 4
        body = (
            f"<article><h1>T {i}</h1><p>one {i}</p></article>",
            f"<div class=content><p>two {i}</p></div><div>beside</div>",
            f"<main><p>three {i}</p></main><div>beside</div>",
            f"<div><p>four {i}</p></div><article></article>",
        )[kind]
        want[i] = (f"T {i}\n\none {i}", f"two {i}", f"three {i}", f"four {i}")[kind]
        rows.append((i, "http://two.example/", f"<body><nav>Menu</nav>{body}<footer>End</footer></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in wrappers.main_texts(ws, frame).collect()} == want


def test_template_texts_are_those_of_most_pages_at_their_place(spark, ws):
    rows, want = [], {}
    for i in range(30):
        # Ten copies of one article (their marks differ), ten pages with a heading in common, ten others.
        text = "copied" if i < 10 else f"text {i}"
        more = "<blockquote>Quoted</blockquote>" if i < 10 else "<h2>Summary</h2><p>Read on</p>" if i < 20 else f"<ul><li>Read on</li></ul><p>more {i}</p>"
        rows.append((i, "http://one.example/", f"<body><article data-n='{i}'><h1>T</h1><div class=tip>Read on</div><p>{text}</p>{more}</article></body>"))
        want[i] = "\n\n".join(["T", text, *(["Quoted"] if i < 10 else ["Summary", "Read on"] if i < 20 else ["Read on", f"more {i}"])])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in wrappers.main_texts(ws, frame).collect()} == want
    (wrapper,) = wrappers.infer(ws, frame.selectExpr("'h' AS host_key", "html")).collect()
    assert json.loads(wrapper.wrapper)[1] == 21


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><meta charset=u><body><div class=menu>Menu</div><article><h1>Head</h1><p>One</p></article></body>", "Head\n\nOne"),
        ("<body><div class='wrapper has-sidebar'><article><p>One</p></article><div class=sidebar>Side</div></div>", "One"),
        ("<body><div class='sidebar-layout'><main><p>One</p></main></div>", "One"),
        ("<body><form id=aspnetForm><div id=content><p>One is longest</p></div></form><form>Name</form>", "One is longest"),
        ("<body><button>Menu<article><p>One</p><p>two</p></article>", "One\n\ntwo"),
        ("<body><svg><article><p>One</p></article>", "One"),
        ("<body><button>Menu</button><article><p>One <select><option>x</select>two</p></article>", "One two"),
        ("<body><article class='post category-search'><p>One</p></article>", "One"),
        ("<body><main><h1>Title</h1><article><p>One</p></article></main>", "Title\n\nOne"),
        ("<body><div class=content><p>An intro that is longer</p><article><p>Teaser</p></article></div>", "An intro that is longer\n\nTeaser"),
        ("<body><main><p>One</p></main><section class=comments><article class=comment><p>I say</p></article></section>", "One"),
        ("<div>" * 3000 + "<p>Deep</p>after" + "</div>" * 3000 + "<p>end</p>", "Deep\n\nafter\n\nend"),
    ],
)
def test_pages_keep_their_text(page, text):
    assert wrappers.extract(page, wrappers.wrapper_of(wrappers.parse(page))) == text


def test_slots_decide_without_names():
    """A host whose markup tells nothing: what its pages agree on is template, and the slots are the text."""
    pages = [
        f"<body><div class=a><div>Home</div><div>About us</div></div><div class=b><div>Title {i}</div><p>First {i}</p><p>Second {i} text</p></div><div class=c>All rights</div></body>"
        for i in range(8)
    ]
    known = wrappers.wrapper_of(wrappers.parse(pages[0]))
    for page in pages[1:]:
        wrappers.merge(known, wrappers.wrapper_of(wrappers.parse(page)))
    assert [wrappers.extract(p, known) for p in pages] == [f"Title {i}\n\nFirst {i}\n\nSecond {i} text" for i in range(8)]
    alone = wrappers.wrapper_of(wrappers.parse(pages[0]))
    assert wrappers.extract(pages[0], alone).startswith("Home\n\nAbout us\n\nTitle 0")


def test_own_ids_do_not_grow_the_wrapper():
    def page(i):
        return "<body><article>" + "".join(f"<h2 id='part-{w}'>{w}</h2><p>text {i}</p>" for w in ("alpha" * (i + 1), "beta" * (i + 2))) + "</article></body>"

    def size(n):
        known = wrappers.wrapper_of(wrappers.parse(page(0)))
        for i in range(1, n):
            wrappers.merge(known, wrappers.wrapper_of(wrappers.parse(page(i))))
        return len(str(known))

    # A slot keeps some texts at most, so the wrapper stops growing.
    assert size(240) <= size(120) + 400
