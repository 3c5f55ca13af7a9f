import html
import itertools
import random
import re

import pytest

from firnline.llm import wrappers as W

FURNISHED = ("<html><head><title>x</title></head><body><header><a>Home</a></header><div id='cookie-notice'>We use cookies</div><main><header><h1>T &amp; U</h1></header>"
             "<div class=post><p>One <b>two</b>\n three<p>Four<br>five<ul><li>a<li>b</ul><form>f</form><aside>s</aside><script>if (a<b) x('</p>')</script>"
             "<table><tr><td>1<td>2</table></div><section id='comments'><p>c</p></section></main><footer>z</footer></body>")
PLAIN = ('<body><div class="top-menu"><a>m</a></div><div class="wrap"><div class="body"><p>Alpha</p><h2>H</h2><p>Beta</p><p>G</p></div></div>'
         '<div class="footer">f</div></body>')


def alone(page):
    tree = W.parse(page)
    wrapper = W.folded(tree)
    return W.main_text(tree, wrapper, W.content_nodes(wrapper))


@pytest.mark.parametrize("page, text", [
    (FURNISHED, "T & U\nOne two three\nFour five\na\nb\n1\n2"), (PLAIN, "Alpha\nH\nBeta\nG"), ("", ""), ("just text", "just text"),
    ("<article><p>a&lt;b &copy; &#233;\xa0x</p></article>", "a<b © é x"), ("<article><p>open <b>never closed", "open never closed"),
    ("<article>" + "<div>" * 400 + "deep" + "</div>" * 400 + "</article>", "deep"), ("<!-- <p>no</p> --><article>a<p></p> <p> </p>b</article>", "a\nb")])
def test_pages(page, text):
    assert alone(page) == text


def test_alignment_gives_options_repeats_and_slots():
    one = W.folded(W.parse("<body><h1>A</h1><p>x</p><p>y</p></body>"))
    two = W.folded(W.parse("<body><h1>B</h1><div>extra</div><p>x</p></body>"))
    body = W.merged(one, two)[2][0]
    assert [(n[0], n[1]) for n in body[2]] == [("h1", 0), ("div", 1), ("p", 2)]
    assert body[2][0][2] == [["#", 0]] and body[2][1][2][0][1] != 0
    groups = W.folded(W.parse("<body>" + "<h2>a</h2><p>b</p>" * 5 + "</body>"))[2][0]
    assert [(n[0], n[1]) for n in groups[2]] == [("h2", 2), ("p", 2)]


def test_wrapper_fits_all_pages_of_a_host():
    pages = [f"<body><nav>n</nav><article><h1>t{i}</h1>" + "".join(f"<p>p{i}{k}</p>" for k in range(i)) + ("<blockquote>q</blockquote>" if i % 2 else "")
             + "</article><div class='comments'><p>c</p></div></body>" for i in range(6)]
    wrapper = W.folded(W.parse(pages[0]))
    for p in pages[1:]:
        wrapper = W.merged(wrapper, W.folded(W.parse(p)))
    for i, p in enumerate(pages):
        want = [f"t{i}", *[f"p{i}{k}" for k in range(i)], *(["q"] if i % 2 else [])]
        assert W.main_text(W.parse(p), wrapper, W.content_nodes(wrapper)) == "\n".join(want)


def test_table_rows(spark, small):
    kind = "page_id long, url string, html string, host string, wrapper string, text string"
    rows = [(1, "http://a.org/x", FURNISHED, "h", "w", "t"), (2, None, PLAIN, "h", "w", "t"), (3, "http://a.org/y", None, "h", "w", "t"),
            (4, "nonsense", "", "h", "w", "t"), (None, "http://a.org/x", FURNISHED, None, None, None)]
    got = W.main_texts(spark.createDataFrame([*rows, rows[0]], kind)).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(r[0]), alone(r[2] or "")) for r in [*rows, rows[0]])
    assert W.main_texts(spark.createDataFrame([], kind)).collect() == []


def test_generated_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in W.main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def of_host(pages):
    wrapper = W.folded(W.parse(pages[0]))
    for p in pages[1:]:
        wrapper = W.merged(wrapper, W.folded(W.parse(p)))
    return [W.main_text(W.parse(p), wrapper, W.content_nodes(wrapper)) for p in pages]


@pytest.mark.parametrize("before, after", [
    ('<body class="single no-sidebar"><article>', "</article></body>"), ('<html class="has-menu"><body class="right-sidebar"><main>', "</main></body></html>"),
    ('<body><main class="with-sidebar">', "</main></body>"), ('<body><article class="post comments-open">', "</article></body>"),
    ('<body><div id="page" class="right-sidebar"><article class="social">', "</article></div></body>"),
    ('<body class="menu-open"><div class="layout with-sidebar"><div class="post comments-open">', "</div></div></body>"),
    ('<body><div class="wrap has-header"><div class="post share-enabled">', "</div></div></body>")])
def test_names_of_outer_parts_do_not_empty_a_page(before, after):
    inner = "<h1>t{0}</h1><p>a{0} long enough</p><p>b{0} long enough</p><div class='share'>tell</div><div class='comments'><p>c{0}</p></div>"
    pages = [f"{before}{inner.format(i)}{after}" for i in range(4)]
    want = [f"t{i}\na{i} long enough\nb{i} long enough" for i in range(4)]
    assert of_host(pages) == want and [alone(p) for p in pages] == want


def test_a_long_discussion_is_left_out():
    pages = [f"<body><div class=page><div class=post><h1>t{i}</h1><p>p{i}</p></div><div id=comments>" + f"<p>much longer comment {i}</p>" * 9 + "</div></div></body>" for i in range(3)]
    assert of_host(pages) == [f"t{i}\np{i}" for i in range(3)]


ARTICLE = "<body><div class=top>Site</div><article><h1>t{0}</h1><p>p{0}</p></article></body>"
OLDER = "<body><div class=top>Site</div><div class=post><h2>t{0}</h2><div class=text>p{0}<p>q{0}</p></div></div></body>"


def test_host_of_mixed_templates():
    pages = [(ARTICLE if i % 2 else OLDER).format(i) for i in range(6)]
    for i, text in enumerate(of_host(pages)):
        assert text.endswith(f"t{i}\np{i}" if i % 2 else f"t{i}\np{i}\nq{i}")


def test_pages_without_a_host_are_grouped_by_structure(spark):
    rows = [(i, (None, "/x/y", "nonsense")[i % 3], (ARTICLE if i in (3, 7, 8) else OLDER).format(i)) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in W.main_texts(frame).collect()}
    for i in range(12):
        assert got[i].endswith(f"t{i}\np{i}" if i in (3, 7, 8) else f"t{i}\np{i}\nq{i}")
    assert frame.select(W.host_of(frame.url, frame.html)).distinct().count() == 2


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_text_without_a_place_in_the_wrapper_stays(order):
    inner = ["<div>c{0}</div>", "<h2>h{0}</h2><p>p{0}</p><div>b{0}</div>", "<div><p>a{0}</p></div><h2>h{0}</h2><p>p{0}</p>"]
    want = ["c{0}", "h{0}\np{0}\nb{0}", "a{0}\nh{0}\np{0}"]
    pages = [f"<article>{inner[k].format(i)}</article>" for i, k in enumerate(order)]
    assert of_host(pages) == [want[k].format(i) for i, k in enumerate(order)]


@pytest.mark.parametrize("n, m", [(700, 600), (1, 260_000), (3, 100_000), (900, 900)])
def test_long_lists_are_aligned_exactly(n, m):
    rnd = random.Random(n)
    a, b = ([rnd.choice("pqrstu") for _ in range(k)] for k in (n, m))
    got = W.pairs([[x] for x in a], [[x] for x in b])
    assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
    row = [0] * (m + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    assert len(got) == row[-1]


@pytest.mark.parametrize("before, after", [
    ("<h1>t{0}</h1>", ""), ("<div class=lead><p>lead{0}</p></div>", "<p>last{0}</p>"), ("<header class=entry-header><h1>t{0}</h1></header>", "<div>end{0}</div>"),
    ("<div class=entry-header><h2>t{0}</h2></div>", "")])
def test_headline_and_lead_outside_the_body_part_stay(before, after):
    page = ("<body><header><h1>Site</h1></header><nav>n</nav><div class=top>Same</div><div class=wrap>" + before + "<div class=body>{1}</div>" + after
            + "</div><div class=footer>f</div></body>")
    pages = [page.format(i, "".join(f"<p>p{i}{k}</p>" for k in range(3 + i))) for i in range(5)]
    for i, text in enumerate(of_host(pages)):
        want = [before.format(i), *[f"p{i}{k}" for k in range(3 + i)], after.format(i)]
        assert text.split("\n") == [w for w in (re.sub("<[^>]*>", "", x) for x in want) if w]


@pytest.mark.parametrize("part", [
    '<h2 id="discussion">Discussion</h2>', '<h2 id="related-work">Related work</h2>', '<h3 id="search-results">Search results</h3>', '<h2 class="share">Share</h2>',
    '<div class="side-by-side">two columns</div>', '<p class="no-skip">text</p>', '<p id="notice">text</p>', '<section id="menu"><p>The menu of the day</p></section>',
    '<div id="banner-effects"><p>On banners</p></div>', '<ul id="related"><li>one</li></ul>', '<div class="without-sidebar">wide</div>'])
@pytest.mark.parametrize("content", ["article", "main"])
def test_anchors_and_negations_lose_no_text(part, content):
    page = f"<body><nav>n</nav><{content}><h1>t{{0}}</h1><p>first{{0}}</p>{part}<p>last{{0}}</p></{content}><footer>f</footer></body>"
    pages = [page.format(i) for i in range(3)]
    text = re.sub("<[^>]*>", "", part)
    assert of_host(pages) == [f"t{i}\nfirst{i}\n{text}\nlast{i}" for i in range(3)] and [alone(p) for p in pages] == of_host(pages)


@pytest.mark.parametrize("part", [
    "<div id=comments><p>c{0}</p></div>", "<section id=disqus-thread>c{0}</section>", "<div class=related-posts>r{0}</div>", "<ul class=pagination><li>{0}</li></ul>", "<p class=advert>buy{0}</p>"])
def test_furniture_in_the_text_still_goes(part):
    pages = [f"<body><article><h1>t{i}</h1><p>p{i}</p>{part.format(i)}</article><div id=sidebar>s{i}</div></body>" for i in range(3)]
    assert of_host(pages) == [f"t{i}\np{i}" for i in range(3)]
