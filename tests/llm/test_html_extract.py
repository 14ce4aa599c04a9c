from orbitmill.llm import html_extract as h

from .conftest import as_set

BODY = "<p>A first paragraph, which is long enough to be taken for text.</p><p>Second &amp; last&nbsp;one,\n with <b>bold</b> and <a href=x>a link</a>.</p>"
EXPECTED = "Head line\nA first paragraph, which is long enough to be taken for text.\nSecond & last one, with bold and a link."


def page(body, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body class='home'><header>Site</header>"
        f"<nav><ul><li><a href=/>Home<li>More</ul></nav><!-- <p>c</p> --><div class='ad-box'>Buy</div>{body}{extra}<aside>Side</aside><form>Your <input> name</form>"
        "<div id=comments><article class='comment'><p>A reader's comment of some length that says nothing at all about it</p></article></div><footer>&copy; me</footer></body></html>"
    )


def text(html, winners=()):
    return h.Page(html).text(list(winners))


def test_article_and_nothing_else():
    for box in ("<article><h1>Head line</h1>%s</article>", "<main><h1>Head line</h1>%s</main>", "<div class='post post-123'><h1>Head line</h1>%s</div>", "<div><section><h1>Head line</h1>%s</section></div>"):
        assert text(page(box % BODY)) == EXPECTED


def test_broken_markup():
    assert text("<body><article><p><b>one<br><p>two</i></article>") == "one\ntwo"
    assert text("plain text & no tags") == "plain text & no tags"
    assert text("") == "" and text("<p") == "" and text("a < b and <3") == "a < b and <3"
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a\nb\nc\nd"
    assert text("<div>x<script>if (a < b) '</div>'</script>y</div>") == "xy"
    assert text("<article>&#65;&eacute;&unknown; &lt;p&gt;</article>") == "Aé&unknown; <p>"
    assert text("<p>" * 3000 + "deep" + "<div>" * 500 + "er") == "deep\ner"


def test_names_of_classes():
    kept = "<div class='layout has-sidebar no-comments'><p>text</p><div class='shareBar'>x</div><p id='ad-slot-3'>y</p><span class='promo'>z</span></div>"
    assert text(f"<body>{kept}<div role=navigation>n</div><div hidden>h</div><section class='reader-comments'>c</section></body>") == "text"


def test_generalised_paths():
    one, other = (h.Page(page(f"<div class='{c}'><p>x y z</p></div>")) for c in ("post post-77 Wide", "wide post-8 post"))
    assert h.path_digest("div.post.post-#.wide") in one.path and h.path_digest("div.post.post-#.wide") in other.path
    assert h.path_digest("div.post") not in one.path


def test_names_do_not_overrule_the_text():
    for wrapper in ("class='page right-sidebar'", "id='side-effects'", "class='comments-page'", "class=sidebar", "class=header", "class='ad-free'", "id=comment"):
        assert text(page(f"<div {wrapper}><article><h1>Head line</h1>{BODY}</article></div>")) == EXPECTED
        assert text(page(f"<div {wrapper}><div class=inner><h1>Head line</h1>{BODY}</div><div class=sidebar><p>Other</p></div></div>")) == EXPECTED
    assert text(f"<body><div class='main right-sidebar'>{BODY}</div><div class=sidebar>x</div></body>") == EXPECTED.split("\n", 1)[1]
    long = "<p>" + "A sentence that isn't the story's. " * 40 + "</p>"
    for box in ("class=sidebar", "class='reader-comments'", "class=ad", "id=cookie-notice", "class='relatedStories'", "id=respond"):
        assert text(page(f"<article><h1>Head line</h1>{BODY}</article><div {box}>{long}</div>")) == EXPECTED
    assert text(page(f"<article><h1>Head line</h1>{BODY}<div id='side-effects'><p>Some.</p></div></article>")) == EXPECTED + "\nSome."


def test_quotes_without_end():
    assert text('<article><a title="it\'s>two</a> three</article>') == "two three"
    assert text("<article><p title='>one</p><p>two</p></article>") == "one\ntwo"
    assert text("<article><p title=\"a>b\" class='c>d'>one</p><p don't>two</p><br/><p/>three</article>") == "one\ntwo\nthree"
    assert text("<article>one<p class=\"x") == "one" and text("<article>one</article></div x") == "one"


def test_time_grows_with_length():
    import time

    for body in ("<a ", "<b>", "<div>", "<div class=x>", "<a title='", '<p "', "</b>", "<b><hr>", "<p><b></i>", "<", "&", "<!--", "<li>", "<table><td>", "<div><p>x</div>", "<div class=sidebar>x", "<b></div>", "< a=", "a \t"):
        n = (1 << 20) // len(body)
        began = time.process_time()
        h.Page(body * n).text([])
        h.Page("<b>" * (n // 2) + body * (n // 2)).best()
        assert time.process_time() - began < 60


def plain_extraction(html):
    """Independent: the blocks of the only article, by the standard library's parser."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.deep, self.out = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            if tag in h.BLOCK:
                self.out.append([])
            elif tag == "br":
                self.out[-1].append(" ")

        def handle_endtag(self, tag):
            if tag in h.BLOCK:
                self.out.append([])
            self.deep -= tag == "article"

        def handle_data(self, data):
            if self.deep:
                self.out[-1].append(data)

    p = P()
    p.feed(html)
    p.close()
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in p.out) if t)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in h.extract(pages).collect()}
    want = {i: plain_extraction(t or "") for i, t in html.items()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_what_lies_beside_an_inner_box():
    story = "<p>" + "A sentence of the story, one of many. " * 30 + "</p>"
    want = " ".join(("A sentence of the story, one of many. " * 30).split())
    for box in (
        "<div class=post><h1>Head line</h1><div class=entry>%s</div></div>",
        "<div class=post><h1><a href=/1>Head line</a></h1><div class=entry>%s</div></div>",
        "<article><h1>Head line</h1><div><div class=entry>%s</div></div></article>",
        "<div class=wrap><div class=title><h2>Head line</h2></div><div><div class=entry>%s</div></div></div>",
        "<main><h1>Head line</h1><article>%s</article></main>",
        "<h1>Head line</h1><div class=entry>%s</div>",
    ):
        assert text(page(box % story)) == f"Head line\n{want}"
        assert text(page(box % story, "<div class=more><p>Short</p></div>")).endswith(want)
    lead = "<div class=post><h1>Head line</h1><p class=lead>Lead.</p><div class=entry>%s</div><p>By <a href=x>me</a>, in town</p><div class=share>x</div></div>"
    assert text(page(lead % story)) == f"Head line\nLead.\n{want}\nBy me, in town"
    links = "<div class=page><div class=list><p><a href=1>Another story</a></p><p><a href=2>And one more</a></p></div><div class=entry>%s</div></div>"
    assert text(page(links % story)) == want


def test_heading_beside_the_hosts_box(make_pages):
    story = "<p>" + "A sentence of the story, one of many. " * 30 + "</p>"
    rows = [(i, f"http://a.com/{i}", page(f"<div class='post p{i}'><h1>Head {i}</h1><div class=entry>{story}</div></div>")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in h.extract(make_pages(rows)).collect()}
    assert all(got[i].startswith(f"Head {i}\nA sentence") for i in range(4))


def test_hosts_vote(make_pages):
    rows = [(i, f"http://a.com/{i}", page(f"<div class='story s{i}'><h1>Head line</h1>{BODY}</div>", "<div class='story-list'><p>Short</p></div>")) for i in range(5)]
    odd = page("<div class='story s9'><p>Hi.</p></div>", "<div class='other'><p>A much longer text than the story of this page has, but in the wrong place of it.</p></div>")
    rows.append((9, "http://A.com/odd", odd))
    rows.append((10, "http://b.com/odd", odd))
    got = {r["page_id"]: r["text"] for r in h.extract(make_pages(rows)).collect()}
    assert all(got[i] == EXPECTED for i in range(5))
    assert got[9] == "Hi."  # the host's path
    assert got[10].startswith("A much longer text")


def test_odd_rows(make_pages):
    long = page("<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>")
    rows = [(None, None, "<article>x</article>"), (1, "nothing", None), (2, "http://h/", ""), (3, "http://h/", "   "), (4, None, long), (5, "http://h/", "<article>y"), (5, "http://h/", "<article>y")]
    got = as_set(h.extract(make_pages(rows)), "page_id", "url", "text", "n_chars")
    want = "\n".join(["word & word"] * 20_000)
    expected = [(None, None, "x", 1), (1, "nothing", "", 0), (2, "http://h/", "", 0), (3, "http://h/", "", 0), (4, None, want, len(want)), (5, "http://h/", "y", 1), (5, "http://h/", "y", 1)]
    assert got == sorted(expected, key=repr)
    assert h.extract(make_pages([])).count() == 0
