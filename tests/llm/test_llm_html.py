from carryover.llm import html as H

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";a<b;</script></head>
<body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div><header>head</header>
<article><h1>Title &eacute;&#33;</h1><p><b>First  line.<br>more<p>Second <i>in</i>line.</p><ul><li>one<li>two</ul><aside>side</aside>
<form><input name="q">send</form><div id="newsletter-box" class="newsletter">join</div><section class="comments"><p>nice post</p></section><table><tr><td>x<td>y</table></article>
<footer>&copy; foot</footer></body></html>"""
WANT = "Title é! First line. more Second inline. one two x y"


def text(page):
    return H.read_page(page).text(set(), set())


def test_article_of_a_page():
    assert text(PAGE) == WANT


def test_tolerates_broken_markup():
    assert text("") == "" and text("plain a < b & c &amp; d") == "plain a < b & c & d"
    assert text("<p>a<p>b<div>c</p>d") == "a b c d"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("<p>x<!-- never closed <p>y") == "x" and text("<script>never closed <p>y") == ""
    assert text('<p title="a>b">c</p>') == "c" and text("</p></div>x</article>") == "x"
    assert text("<main><p>m</p></main><p>n</p>") == "m" and text("<p>a</p><p hidden class='x comment y'>b</p>") == "a"
    assert text("<b>no</b><i>space</i>") == "nospace" and text("<" * 2000 + "p>a") .endswith("a")


def test_all_parts_of_an_article():
    assert text("<div><article><p>one</p></article><article><p>two, longer</p></article></div><div><article>elsewhere</article></div>") == "one two, longer"
    assert text("<main><h1>Head</h1><p>lead</p><article><p>body of it</p></article><p>tail</p></main><p>no</p>") == "Head lead body of it tail"
    assert text('<article class="share-price"><h2 id="promo-code">Share price</h2><p>up</p></article>') == "Share price up"
    assert text('<div class="post has-sidebar"><article><p>body</p></article></div>') == "body"
    assert text('<article><p>body</p></article><article class="comment">first!</article>') == "body"
    assert text("<article><p>body <article>inner</article> end</p></article>") == "body inner end"


def test_hostile_pages_take_time_in_proportion():
    import time
    words = "x" * 40
    pages = ["<div>" * 20_000 + "text", f"<blockquote><b>{words}" * 15_000, "<a " * 300_000, f"<p>{words}</b></i>" * 15_000, "<li>" * 100_000, "<b><div>" * 40_000 + "</b>" * 40_000,
             "<article>" * 20_000 + words, "<!--" * 200_000, f"<table><tr><td>{words}" * 8_000]
    for p in pages:
        at = time.process_time()
        page = H.read_page(p)
        page.subtrees(), page.text({1}, {1})
        assert time.process_time() - at < 8, p[:30]


def test_templates_of_a_folder(spark):
    """A block on all pages of a folder with a third of the host's pages goes, in marked articles
    too; a paragraph that exact and near copies of one article share stays."""
    note = "<p>This section is brought to you by our partners</p>"
    story = lambda i: f"<article><h1>Story {i}</h1><p>text {i * 7}</p>{note if i % 3 == 0 else ''}</article>"
    rows = [(i, f"http://a.example.com/{'news' if i % 3 == 0 else 'blog' if i % 3 == 1 else 'misc'}/{i}", story(i)) for i in range(90)]
    rows += [(1000 + i, f"http://b.example.com/x/{i}", "<article><h1>Same</h1><p>copied all over</p></article>") for i in range(60)]
    rows += [(2000 + i, f"http://c.example.com/x/{i}", f"<article><p>shared paragraph</p><p>own {i if i < 30 else 0}</p></article>") for i in range(30)]
    rows += [(3000 + i, f"http://c.example.com/x/y{i}", f"<article><p>other {i}</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} text {i * 7}" for i in range(90))
    assert {got[1000 + i] for i in range(60)} == {"Same copied all over"}
    assert all(got[2000 + i] == f"shared paragraph own {i}" for i in range(30))


def test_site_templates_go_and_articles_stay(spark):
    body = lambda i: f"<body><div><p>Welcome to the portal of things</p></div><div><p>story {i} about {i * 7}</p></div><div><p>same story</p></div></body>"
    rows = [(i, f"http://a.example.com/{i}", body(i).replace("<div><p>same story</p></div>", "" if i % 3 else "<div><p>same story</p></div>")) for i in range(9)]
    rows += [(100 + i, f"http://b.example.com/{i}", "<p>Welcome to the portal of things</p>") for i in range(2)]
    rows += [(200 + i, f"http://c.example.com/{i}", "<article><p>one article on all pages</p></article>") for i in range(6)]
    rows += [(300, None, "<p>x</p>"), (301, "no host", None), (None, "http://d.example.com", ""), (1, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, blocks string")
    got = H.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "story 1 about 7" and by[3] == "story 3 about 21 same story"
    assert by[100] == "Welcome to the portal of things" and by[200] == "one article on all pages"
    assert by[300] == "x" and by[301] == by[None] == ""
    assert H.extract_text(pages.limit(0)).count() == 0


def test_templates_inside_articles(spark):
    rows = [(i, f"http://a.example.com/{i}", f"<article><p>story {i}</p><p>Read more on our portal every day</p></article>") for i in range(25)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"story {i}" for i in range(25)}
